import json

import pytest
from pyspark.sql import functions as F

from chorale.functions.patterns import pattern_of, split_words
from chorale.plans import config
from chorale.sources import landing, sinks


def lines(path, rows):
    path.mkdir()
    (path / "a.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_hits_by_both_readers(spark, tmp_path):
    folder = lines(tmp_path / "hits", [{"id": "abcdefghijk", "title": "T", "duration": 61.5, "view_count": 3}, {"id": "", "title": "x"}, {"title": "no id"}, "{broken"])
    spark.dataSource.register(landing.HitSource)
    for hits in (landing.landed_hits(spark, folder), spark.read.format("landed_hits").option("path", folder).load()):
        got = landing.normal_hits(hits).collect()
        assert [(r.video_id, r.duration, r.view_count, r.channel) for r in got] == [("abcdefghijk", 61, 3, "")]


def test_sections_lists_and_pages(spark, tmp_path):
    e = spark.createDataFrame([("a", None), ("a", 0), ("b", 10)], "channel string, duration int")
    assert [r.channel for r in landing.only_sections(e).collect()] == ["a"]
    (tmp_path / "c.txt").write_text("# all\n\n  one \ntwo\n")
    assert sorted(r.channel for r in landing.channel_list(spark, str(tmp_path / "c.txt")).collect()) == ["one", "two"]
    html = '<p><a href="https://v.example/watch?v=abcdefghijk" x>One &amp; T</a> 3:05 <A href="/other">no</A><a href="/watch?v=bbbbbbbbbbb">Two</a>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    got = [(r.page_id, r.linked_id, r.linked_title, r.seconds) for r in landing.links_in_pages(pages).collect()]
    assert got == [(1, "abcdefghijk", "One &amp; T", 185), (1, "bbbbbbbbbbb", "Two", None)]


def test_catalogue_answers(spark, tmp_path):
    rec = lines(tmp_path / "rec", [{"id": "r1", "title": "S", "score": 90, "length": 61000, "artist-credit": [{"name": "A", "artist": {"id": "x"}}, {"name": "B"}], "releases": [{"date": "1999-01"}, {"date": "bad"}], "tags": [{"name": "pop", "count": 1}]}, {"id": "r2"}])
    got = {r.id: r for r in landing.recordings(spark, rec).collect()}
    assert (got["r1"].artist, got["r1"].artist_id, got["r1"].first_year, got["r1"].seconds) == ("A, B", "x", 1999, 61) and got["r2"].score == 0
    rel = lines(tmp_path / "rel", [{"id": 1, "title": "A - T", "label": ["L", "M"], "genre": ["x", "y"]}, {"id": 2, "title": "B - T", "artist": "b"}, {"id": 3, "title": "T", "artist": "C"}])
    assert [(r.artist, r.title) for r in landing.releases(spark, rel).orderBy("id").collect()] == [("A", "T"), ("b", "T"), ("C", "T")]


def test_cache_swap_and_evolution(spark, tmp_path):
    path = str(tmp_path / "cache")
    put = lambda rows: sinks.put_cache(spark, path, spark.createDataFrame(rows, "key string, value string, created_at string, ttl_seconds long").withColumn("created_at", F.col("created_at").cast("timestamp")))
    put([("a", "1", "2025-01-01 00:00:00", 3600), ("b", "1", "2025-01-01 00:30:00", 60)])
    put([("a", "2", "2025-01-01 00:10:00", 3600)])
    assert [(r.key, r.value) for r in sinks.cached(spark, path, "2025-01-01 01:00:00").collect()] == [("a", "2")]
    assert sinks.cached(spark, path, "2025-01-01 00:30:30", most=1).collect()[0].key == "b"
    t = str(tmp_path / "t")
    assert sinks.replace_table(spark, spark.range(3), t) is None
    backup = sinks.replace_table(spark, spark.range(5), t)
    assert spark.read.parquet(t).count() == 5 and spark.read.parquet(backup).count() == 3
    spark.range(1).withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "new"))
    assert sorted(sinks.evolved(spark, [t, str(tmp_path / "new")]).columns) == ["id", "more"]


def test_settings(tmp_path):
    config.write_template(str(tmp_path / "s.json"))
    assert config.settings(str(tmp_path / "s.json")) == config.Settings()
    s = config.settings(None, ranking={"relevance": 1.0}, nonsense=3)
    assert s.ranking.relevance == 1.0 and s.ranking.quality == 0.25 and abs(sum(s.ranking.normal()) - 1) < 1e-9
    for bad in ({"max_results": 0}, {"ladder": {"rules": 2}}, {"least_seconds": 901}, {"cache_seconds": "x"}):
        with pytest.raises(ValueError):
            config.settings(None, **bad)
    assert config.Ranking(0, 0, 0, 0).normal() == (0.25,) * 4


def test_patterns_from_examples():
    import re

    p, a, s = pattern_of("Ann - River (Karaoke) [HD]", "Ann", "River")
    m = re.match(p, "Bo Ray - Lamp (Karaoke) [HD]")
    assert (m[a], m[s]) == ("Bo Ray", "Lamp") and not re.match(p, "Bo Ray - Lamp Karaoke")
    assert pattern_of("River by Ann", "Ann", "River")[1:] == (2, 1) and pattern_of("x", "Ann", "River") is None
    assert split_words("the blue lamp river song") == ("the blue lamp", "river song") and split_words("ann") == ("ann", "") and split_words("ann lee river", {"ann lee": 2}) == ("ann lee", "river")
