"""Scores of catalogue matches and of the whole evidence of a video (SCR8 to SCR21, STR27, AGG29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale.functions import similarity as S
from chorale.functions.scoring import clamp, has_any, term_ratio, text_of, weighed

#: Bonus words of the two secondary search sources. Fixed values.
SECOND_WORDS = {"karaoke": 0.3, "instrumental": 0.2, "backing track": 0.2, "sing along": 0.2, "with lyrics": 0.2}
THIRD_WORDS = {"karaoke": 0.2, "instrumental": 0.15, "backing track": 0.15, "sing along": 0.15, "with lyrics": 0.15}
#: Weights of the search sources, first to last. Fixed values.
SOURCE_WEIGHTS = {"first": 1.0, "second": 0.6, "third": 0.4}

#: Words of an artist's name that tell a genre, in order of precedence. Fixed values.
GENRE_OF_ARTIST = [("Folk, World, & Country", ["country", "nashville"]), ("Hip Hop", ["rap", "hip", "hop"]), ("Rock", ["rock", "metal", "punk"])]

#: Words of a tag that tell a genre; of several genres with as many tags the first wins. Fixed values.
GENRE_OF_TAG = {
    "rock": ["rock"], "pop": ["pop"], "jazz": ["jazz", "bebop", "swing", "fusion", "big band"], "classical": ["classical", "orchestral", "opera", "symphony", "chamber music", "baroque"],
    "blues": ["blues"], "country": ["country", "bluegrass", "americana"], "folk": ["folk", "acoustic"], "electronic": ["electronic", "techno", "house", "ambient", "drum and bass", "dubstep"],
    "hip-hop": ["hip hop", "rap", "hip-hop"], "r&b": ["r&b", "neo soul"], "soul": ["soul", "motown"], "reggae": ["reggae", "ska", "dub", "dancehall"], "metal": ["metal"], "punk": ["punk"], "funk": ["funk"],
    "gospel": ["gospel"], "world": ["world music", "ethnic", "traditional", "regional"],
}

VARIOUS = ["various", "various artists", "compilation"]


def second_source(query: str, title: str = "title") -> Column:
    t = text_of(title)
    return F.least(F.lit(1.5), t.contains(query.lower()).cast("double") * 0.8 + term_ratio(t, query) * 0.4 + weighed(t, SECOND_WORDS))


def third_source(query: str, title: str = "title") -> Column:
    t = text_of(title)
    return F.least(F.lit(1.2), t.contains(query.lower()).cast("double") * 0.7 + term_ratio(t, query) * 0.3 + weighed(t, THIRD_WORDS))


def votes_trust(likes: Column, dislikes: Column, rating: Column, deleted: Column) -> Column:
    k, d = F.coalesce(likes, F.lit(0)), F.coalesce(dislikes, F.lit(0))
    share = k / F.greatest(k + d, F.lit(1))
    score = F.when(d > 0, 0.3).otherwise(0.0) + F.when((k > 0) & (d > 0) & share.between(0.1, 0.99), 0.4).otherwise(0.0) + F.when(rating > 0, 0.2).otherwise(0.0) + F.when(F.coalesce(deleted, F.lit(False)), 0.0).otherwise(0.1)
    return F.least(F.lit(1.0), score)


def parse_confidence(own_artist: Column, own_song: Column, artist: Column, song: Column, extras: list[Column]) -> Column:
    """A base, more for an equal, contained or alike artist and song, and a little for each extra that is there."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a == b, 0.3).when(a.contains(b) | b.contains(a), 0.2).when(S.words_match(a, b), 0.1).otherwise(0.0)

    a, b, x, y = (F.lower(c) for c in (own_artist, own_song, artist, song))
    more = reduce(Column.__add__, [F.when(e, 0.05).otherwise(0.0) for e in extras], F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.3) + part(a, x) + part(b, y) + more)


def release_confidence(own_artist: Column, own_song: Column, artist: Column, song: Column, master: Column) -> Column:
    """Half for the artist, which must be alike, 0.4 for the title; less for collections and soundtracks, more with a master."""
    alike = S.release_similarity(F.lower(own_artist), F.lower(artist), artist=True)
    score = alike * 0.5 + S.release_similarity(F.lower(own_song), F.lower(song)) * 0.4
    score *= F.when(F.lower(artist).isin(VARIOUS), 0.2).otherwise(1.0) * F.when(has_any(F.lower(song), ["soundtrack", "ost"]), 0.5).otherwise(1.0)
    score = F.least(F.lit(1.0), score + F.when(master.isNotNull(), 0.1).otherwise(0.0))
    return F.when(alike < 0.75, 0.0).otherwise(score)


def overall_confidence(title: Column, views: Column, duration: Column, features: list[Column], trust: Column, validation: Column, errors: Column) -> Column:
    positive = F.filter(F.array(*features), lambda x: x > 0)
    mean = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(positive), F.lit(1))).otherwise(0.0)
    known = reduce(Column.__add__, [F.when(c, 0.2).otherwise(0.0) for c in (F.length(title) > 0, views > 0, duration > 0)])
    base = clamp(known + mean * 0.3 + F.coalesce(trust, F.lit(0.0)) * 0.1 + validation * 0.2 - F.least(errors * 0.1, F.lit(0.3)))
    return F.least(F.lit(1.0), base * (F.lit(0.7) + validation * 0.3))


def genre_of_artist(artist: Column) -> Column:
    a, chain = F.lower(artist), F
    for genre, words in GENRE_OF_ARTIST:
        chain = chain.when(has_any(a, words), genre)
    return chain.otherwise(F.lit(None))


def genres_of_tag(tag: Column) -> Column:
    """array of (place of the genre, genre) that a tag speaks for."""
    t = F.lower(tag)
    found = [F.when(has_any(t, words), F.struct(F.lit(-k).alias("place"), F.lit(genre).alias("genre"))) for k, (genre, words) in enumerate(GENRE_OF_TAG.items())]
    return F.array_compact(F.array(*found))


def swapped_fields(artist: Column, song: Column) -> Column:
    """Points for artist and song standing in each other's place, by words that only titles or only artists have."""
    title_like = lambda c: F.lower(c).rlike(r"\b(?:me|my|your|you|tonight|like|don't|nobody|every|when|before|serenade)\b").cast("int")
    artist_like = lambda c: F.lower(c).rlike(r"\b(?:and the|brothers|sisters|trio|quartet|orchestra|choir|ensemble|collective|dj|mc)\b").cast("int")
    many = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    return title_like(artist) * 0.4 + artist_like(song) * 0.4 + F.when(many(artist) > many(song) + 2, 0.2).otherwise(0.0) - title_like(song) * 0.4 - artist_like(artist) * 0.4
