import difflib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from chorale.functions import similarity as S
from chorale.functions import strings as T
from chorale.functions.text import id_in_url, letters
from chorale.functions.title_rules import BY_CHANNEL, BY_SCRIPT, CORE, LIBRARY, LIBRARY_OF, PLAIN
from chorale.operators.parsing import ladder
from chorale.plans.rules import plain_parse, template_result, validation_factor


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("r")).collect()[0].r


@pytest.mark.parametrize("text,want", [("P!nk", "pnk"), ("The Beatles", "beatles"), ("Artist & Friends", "artist friends"), ("Mary J. Blige", "mary j blige"), (None, None), ("", "")])
def test_artist_key(spark, text, want):
    assert one(spark, text, T.artist_key("t")) == want


@pytest.mark.parametrize("text,want", [("Smith", "smth"), ("Smyth", "smyth"), ("", ""), ("a", "a")])
def test_vowelless(spark, text, want):
    assert one(spark, text, T.vowelless("t")) == want


@pytest.mark.parametrize("text,want", [("PT1H2M3S", 3723), ("PT1M30S", 90), ("1:30", 90), ("1:02:03", 3723), ("45", 45), ("x", 0), (None, 0), ("", 0), ("1:2:3:4", 0)])
def test_seconds(spark, text, want):
    assert one(spark, text, T.seconds_of("t")) == want


@pytest.mark.parametrize("url,want", [("https://v.example/watch?v=abcdefghijk&x=1", "abcdefghijk"), ("v.example/embed/abc-_fghijk", "abc-_fghijk"), ("https://m.example/watch?list=PL&v=abcdefghijk", "abcdefghijk"), ("https://x.example/abcdefghijkl", None), (None, None)])
def test_id_in_url(spark, url, want):
    assert one(spark, url, id_in_url("t")) == want


def test_letters(spark):
    assert one(spark, "  Li​nh, K-9 É!", letters("t")) == "linhk9é"


@pytest.mark.parametrize("title,year", [("X (1899)", None), ("X [1500]", None), ("X (1900)", 1900), ("X (2020)", 2020), ("1980's hits from 1999", 1999), ("(2025)", None)])
def test_release_year(spark, title, year):
    df = spark.createDataFrame([(title, None)], "title string, description string")
    assert df.select(T.release_year_in("title", "description", 2025).alias("y")).collect()[0].y == year


LADDER = [
    ("Artist Name - Song Title", None, "dash", "Artist Name", "Song Title"), ("Artist — Song", None, "dash", "Artist", "Song"), ("Song (in the style of Artist)", None, "style_of", "Artist", "Song"), ("", None, None, None, None), (None, None, None, None, None),
    ("가수 - 노래 (가라오케)", None, "korean_standard", "가수", "노래"), ("Fischer, Helene - Atemlos (Karaoke & Lyrics)", "x", "last_first", "Helene Fischer", "Atemlos"), ("DE sarah lombardi wohin gehst du 57948", None, "german_numbered", "Sarah Lombardi", "Wohin Gehst Du"),
    ("DE the little mermaid 1989 film unter dem meer 1234", None, "german_numbered", "The Little Mermaid", "1989 Film Unter Dem Meer"), ("DE die biene maja film lied eins 12345", None, "german_numbered", "Die Biene Maja Film", "Lied Eins"),
    ("DE der kleine prinz singt laut 12345", None, "german_numbered", "Der Kleine Prinz", "Singt Laut"), ("My Song (Karaoke) - Some One", None, "song_karaoke_artist", "Some One", "My Song"), ("My Song / Some One (Karaoke)", None, "song_slash_artist", "Some One", "My Song"),
    ("Some One • My Song • Karaoke", "LUGN", "channel_dots", "Some One", "My Song"), ("[Studio] Some One - My Song [Karaoke]", None, "bracket_end", "Some One", "My Song"), ("no na-shoot (Loud Version)", None, "hyphenated_song", None, "No Na-Shoot"),
    ('"Some One" - "My Song" - "Karaoke by Zoom Karaoke"', "Zoom Karaoke Official", "channel_three_quoted", "Some One", "My Song"), ("[노래방 가라오케] 가수 - 노래", None, "korean_bracket", "가수", "노래"), ("歌手 - 歌手歌 (卡拉OK)", None, "chinese_standard", "歌手", "歌手歌"),
    ("[カラオケ] うた - かな", None, "japanese_bracket", "うた", "かな"),
]


def test_ladder_by_example(spark):
    rows = [(k, t, c) for k, (t, c, *_) in enumerate(LADDER)]
    got = ladder(spark.createDataFrame(rows, "k int, title string, channel_name string")).orderBy("k").collect()
    assert [(r.parsed_rule, r.parsed_artist, r.parsed_song) for r in got] == [x[2:] for x in LADDER]


def test_every_rule_compiles_and_has_its_groups(spark):
    rules = CORE + PLAIN + [r for rs in BY_SCRIPT.values() for r in rs] + [r for _, _, rs in BY_CHANNEL for r in rs] + [r for rs in LIBRARY.values() for r in rs]
    assert (len(CORE), len(PLAIN), sum(map(len, LIBRARY.values())), len(LIBRARY), LIBRARY_OF["@singkaraoke9783"]) == (30, 18, 81, 23, "singkaraoke")
    df = spark.createDataFrame([("a - b (karaoke)",)], "title string")
    for _, pattern, artist, song, _ in rules:
        assert re.compile(pattern).groups >= max([song, *artist])
    tried = df.select(*[F.col("title").rlike("(?iUu)" + r[1]).alias(f"r{k}") for k, r in enumerate(rules)]).collect()[0]
    assert sum(bool(x) for x in tried) > 10


def test_plain_parse(spark):
    rows = [("[x] Some One - My Song (Karaoke)", None), ("Karaoke - My Song - Some One", ""), ("nothing", "Performed by: Some One"), ("nothing", None), ("One ~ Two", "x"), (None, None)]
    got = plain_parse(spark.createDataFrame(rows, "title string, description string"), [r"^(.+?) ~ (.+)$"]).collect()
    assert [(r.rule, r.artist, r.song, r.confidence) for r in got] == [("plain_artist_song", "Some One", "My Song", 0.85), ("plain_karaoke_dashes", "Some One", "My Song", 0.95), ("plain_description", "Some One", None, 0.5), (None, None, None, 0.0), ("custom_0", "One", "Two", 0.6), (None, None, None, 0.0)]


def test_template_result(spark):
    rules = LIBRARY["zzangkaraoke"]
    rows = [("가수(Singer) - 노래 (Melody) (Karaoke Version)", 0, 0), ("A · B - Song (Melody) (Karaoke Version)", 0, 0), ("A - Song", 10, 5), (None, 0, 0)]
    df = spark.createDataFrame(rows, "title string, attempts long, successes long")
    got = template_result(df, rules, F.col("attempts"), F.col("successes")).collect()
    assert [(r.artist, r.song, r.confidence) for r in got] == [("가수(Singer", "노래", 0.8978), ("A, B", "Song", 0.855), ("A", "Song", 0.675), (None, None, 0.0)]


def test_validation_factor_against_its_definition(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), rng.uniform(0, 100)) for _ in range(200)] + [(1.0, 1.0, 100.0), (0.0, 0.0, 0.0), (0.93, 0.3, 50.0)]
    for r in spark.createDataFrame(rows, "a double, s double, c double").withColumn("f", validation_factor(F.col("a"), F.col("s"), F.col("c"))).collect():
        exact = 0.3 if r.a > 0.95 and r.s > 0.95 else 0.15 if r.a > 0.9 or r.s > 0.9 else 0
        assert r.f == pytest.approx(max(0, min(1.5, (r.a + r.s) / 2 + min(r.c / 100, 0.2) + exact - (0.2 if r.a < 0.5 or r.s < 0.5 else 0))))


def test_jaro_winkler_and_ratcliff_against_published_versions(spark):
    pairs = [("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), ("a", "a"), ("tide", "diet"), ("diet", "tide"), ("jellyfish", "smellyfish")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.jaro_winkler("a", "b").alias("j"), S.ratcliff("a", "b").alias("r")).collect()
    for r in rows:
        assert r.r == pytest.approx(difflib.SequenceMatcher(None, r.a, r.b).ratio())
        assert r.j == pytest.approx(duckdb.connect().execute(f"select jaro_winkler_similarity('{r.a}', '{r.b}')").fetchall()[0][0])


def test_similarities_are_bounded_and_defined_for_blanks(spark):
    df = spark.createDataFrame([("", ""), ("a b", ""), ("The A (x)", "the a"), ("é", "e"), ("x" * 5000, "y")], "a string, b string")
    for r in df.select(S.release_similarity("a", "b").alias("t"), S.release_similarity("a", "b", True).alias("p"), S.token_similarity("a", "b").alias("k")).collect():
        assert all(0 <= x <= 1 for x in r)
    assert df.select(S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).collect()[0].c == 0
