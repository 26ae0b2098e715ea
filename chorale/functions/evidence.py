"""Checks and penalties of search queries and matches against a title (FLT10, FLT11, PAR6, SCR15 to SCR20, STR7, STR15)."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chorale.functions.scoring import has_any
from chorale.functions.strings import artist_key, chained, stripped, titled

#: Words that carry no search intent, and words too common to tell names apart. Fixed values.
NOISE = ["karaoke", "lyrics", "instrumental", "backing", "track", "version", "cover", "live", "audio", "video", "clip", "music", "song"]
COMMON = ["the", "and", "or", "of", "in", "on", "at", "to", "for", "a", "an"]
FRAGMENTS = ["load", "outstay", "don't let me get", "next to you me", "for you"]
SHORT_RUNS = [r"\b\w{1,2}\s+\w{1,2}\s+\w{1,2}\b", r"\b\d+\s+\w{1,2}\s+\w{1,2}\b", r"\bthe\s+\w{1,2}\s+\w{1,2}\b"]

#: What speaks for an artist, and for a song. Fixed patterns.
ARTIST_SIGNS = [r"\b(band|boys|girls|brothers|sisters|orchestra|ensemble|duo|trio|quartet)\b", r"\b(ft\.|feat\.|featuring|with|and|&)\b", r"^(the|los|las|le|la|der|die|das)\s+\w+", r"^\w+\s+(and|&)\s+\w+$"]
SONG_SIGNS = [r"\b(love|heart|soul|dream|night|day|time|life|world|baby|girl|boy)\b", r"\b(dance|sing|song|music|melody|rhythm)\b", r"(n't|'s|'ve|'re|'ll|'d)\b", r"^(i|you|we|they|he|she|it)\s+", r"\?$"]

GUESTS = r"(?:\bfeat\.?|\bfeaturing|\bft\.?|\bwith|&|\+|\bvs\.?)\s+([^(\[,]+)"

#: Marks of a title that don't help to match it. Fixed patterns.
MATCHING = [(p, "") for p in (r"\(karaoke version\)", r"\(mr/(?:instrumental)?\)", r"\(\s*version\)", r"\((?:melody|instrumental|karaoke)\)", r"\[(?:karaoke|mr|instrumental|melody)\]", r"\bmelody\b")] + [
    (r"\([^)]*(?:version|remix|edit|remaster|feat|ft|featuring)[^)]*\)", ""), (r"([\p{L}\p{N}])-([\p{L}\p{N}])", "$1 - $2"), (r"\s+", " "), (r"^\s+|\s+$", ""),
]


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def valid_query(c: Column) -> Column:
    """A query worth sending: not too short, not mostly noise or short words, no fragment."""
    w = _words(c)
    n = F.size(w)
    few = lambda keep, share: F.size(F.filter(w, keep)) <= n * share
    ok = (F.length(stripped(c)) >= 3) & few(lambda x: x.isin(NOISE), 0.6) & few(lambda x: F.length(x) <= 2, 0.5) & ~(c.rlike("[가-힯]") & (n > 5))
    ok &= ~has_any(F.lower(c), FRAGMENTS) & (F.size(F.filter(w, lambda x: F.length(x) >= 3)) >= 2)
    return reduce(lambda a, p: a & ~F.lower(c).rlike("(?U)" + p), SHORT_RUNS, ok)


def worth_comparing(artist: Column, query: Column) -> Column:
    """A cheap test before a similarity: the artist is in the query, or shares a telling word with it."""
    a, b = (F.array_except(F.array_distinct(_words(c)), F.array(*[F.lit(w) for w in COMMON])) for c in (artist, query))
    return F.lower(query).contains(F.lower(artist)) | F.arrays_overlap(a, b) | (F.size(a) <= 1)


def signs(c: Column, patterns: list[str]) -> Column:
    return reduce(Column.__add__, [c.rlike("(?iU)" + p).cast("int") for p in patterns])


def fields_switched(artist: Column, song: Column) -> Column:
    """More than one sign more for the other way round."""
    return signs(song, ARTIST_SIGNS) + signs(artist, SONG_SIGNS) > signs(artist, ARTIST_SIGNS) + signs(song, SONG_SIGNS) + 1


def guests(text: Column) -> Column:
    """Names after a word for a guest, sorted, each once, capitalised."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?iU)" + GUESTS), F.lit(1))
    parts = F.flatten(F.transform(found, lambda x: F.split(F.regexp_replace(x, r"(?U)[^\w\s,&]", ""), r"\s*[,&]\s*|\s+and\s+")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: titled(F.trim(x))), lambda x: F.length(x) > 2)))


def for_matching(c: Column) -> Column:
    return chained(c, MATCHING)


def _two(one):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, DoubleType())


def _mismatch(artist: str, query: str) -> float:
    """Penalty of an artist that no place of the query resembles."""
    if artist in query:
        return 0.0
    words = query.split()
    places = [" ".join(words[-k:]) for k in (2, 3) if len(words) >= k]
    for mark in ("-", ":"):
        if mark in query:
            places.append(query.split(mark, 1)[0].strip())
    if "," in query:
        last, rest = (x.strip() for x in query.split(",", 1))
        first = rest.split("-", 1)[0].strip()
        places += [f"{last}, {first}", f"{first} {last}"]
    best = max((SequenceMatcher(None, artist, p).ratio() for p in places if len(p) >= 3 and not any(n in p for n in ("karaoke", "lyrics", "instrumental"))), default=0.0)
    return next(p for least, p in ((0.85, 0.0), (0.7, 0.15), (0.5, 0.4), (0.3, 0.7), (-1.0, 0.9)) if best >= least)


def mismatch_penalty(artist: Column, query: Column) -> Column:
    return _two(_mismatch)(F.lower(artist), F.lower(query))


def _title_check(match: str, title: str) -> float:
    """Factor for a match (artist and song, tab between) against the title it was found for."""
    artist, _, song = match.partition("\t")
    both = f"{artist} {song}"
    like = SequenceMatcher(None, both, title).ratio()
    if artist in title and song in title:
        score = 1.1
    elif like > 0.6:
        score = 0.9 + (like - 0.6) * 0.5
    elif max(SequenceMatcher(None, artist, title).ratio(), SequenceMatcher(None, song, title).ratio()) > 0.7:
        score = 0.8
    else:
        score = 0.2 if like < 0.3 else 0.6
    if artist in ("( )", "unknown", "various", "n/a", ""):
        score *= 0.3
    words = set(title.split())
    if len(words) > 2 and not (words & set(both.split())) - set(COMMON):
        score *= 0.4
    return min(score, 1.0)


def title_check(artist: Column, song: Column, title: Column) -> Column:
    return _two(_title_check)(F.lower(F.concat_ws("\t", artist, song)), F.lower(title))


def _alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def validated(artist: Column, song: Column, known_artist: Column, known_song: Column, sound) -> tuple[Column, Column]:
    """(score, valid): the mean of four similarities, by letters and by sound; valid if either of each is above 0.8."""
    k = _two(_alike)
    la, ls = k(F.lower(artist), F.lower(known_artist)), k(F.lower(song), F.lower(known_song))
    pa, ps = k(sound(artist), sound(known_artist)), k(sound(song), sound(known_song))
    return (la + ls + pa + ps) / 4, ((la > 0.8) | (pa > 0.8)) & ((ls > 0.8) | (ps > 0.8))


def search_confidence(score: Column, title: Column, artist: Column, query: Column) -> Column:
    """A catalogue's own score, less for a mismatch, more for what the query holds."""
    t, a, q = F.lower(title), F.lower(artist), F.lower(query)
    base = F.least(score / 100.0, F.lit(1.0)) * (F.lit(1.0) - mismatch_penalty(artist, query))
    base *= F.when(q.contains(t) & q.contains(a), 1.3).when(q.contains(t) | q.contains(a), 1.1).otherwise(1.0)
    best = F.greatest(_two(_alike)(t, q), _two(_alike)(F.concat_ws(" ", a, t), q))
    base *= F.when(best > 0.85, F.lit(1.0) + best * 0.2).otherwise(1.0) * F.when((F.length(title) < 3) | (F.length(artist) < 2), 0.7).otherwise(1.0)
    return F.least(base, F.lit(0.95))


def key_overlap(a: Column, b: Column) -> Column:
    """Whether one artist's telling words lie within the other's."""
    x, y = artist_key(a), artist_key(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))
