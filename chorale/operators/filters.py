"""Filters of search hits and names (FLT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions import words as W
from chorale.functions.scoring import duration_limit, has_any, hits, text_of, upload_day


def likely_karaoke(title: str = "title", description: str = "description") -> Column:
    text = text_of(title, description)
    return has_any(text, W.KARAOKE) & ~has_any(text, W.NOT_KARAOKE)


def plausible_duration(c: str = "duration_seconds", least: int = 45, most: int = 900) -> Column:
    """A missing or zero duration passes."""
    return (F.coalesce(F.col(c), F.lit(0)) == 0) | F.col(c).between(least, most)


def karaoke_hits(df: DataFrame) -> DataFrame:
    return df.where(likely_karaoke() & plausible_duration())


def not_stored(batch: DataFrame, stored: DataFrame, key: str = "video_id") -> DataFrame:
    """The rows of a batch with a strict duration whose key is not stored yet; a null key is never stored."""
    return batch.where(F.coalesce(F.col("duration_seconds"), F.lit(0)).between(45, 900)).join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def within_channel_limits(channel: str = "channel_name", duration: str = "duration_seconds") -> Column:
    return F.col(duration).between(duration_limit(channel, 0), duration_limit(channel, 1))


def uploaded_after(day: str, c: str = "upload_date") -> Column:
    """Later than the day; a date that can't be read passes."""
    d = upload_day(c)
    return d.isNull() | (d > F.lit(day).cast("date"))


def karaoke_channel(name: str = "channel_name", description: str = "description") -> Column:
    return (hits(text_of(name, description), W.KARAOKE_CHANNEL) >= 2) | text_of(name).contains("karaoke")


def valid_artist(c: str) -> Column:
    """No general term, not over 100 characters, a fifth of them letters or digits at least."""
    a = F.trim(F.col(c))
    return (F.length(a) >= 1) & ~F.lower(a).isin(W.NO_ARTIST) & (F.regexp_count(F.col(c), F.lit(r"(?U)\w")) >= F.length(F.col(c)) * 0.2) & (F.length(a) <= 100)


def valid_name(c: str) -> Column:
    """None of the terms of three sets as a whole, not blank, not over 100 characters, three in ten of them letters or digits at least."""
    a = F.lower(F.trim(F.col(c)))
    known = [~a.isin(some) for some in W.NO_NAME]
    return (F.length(a) >= 1) & known[0] & known[1] & known[2] & (F.regexp_count(F.col(c), F.lit(r"(?U)\w")) >= F.length(F.col(c)) * 0.3) & (F.length(F.col(c)) <= 100)


def valid_song(c: str) -> Column:
    s = F.trim(F.col(c))
    return F.length(s).between(2, 200) & ~F.lower(s).isin(W.NO_SONG)


def valid_guest(c: Column) -> Column:
    """A featured artist: no general term within, not only digits and signs, two characters or more."""
    return ~has_any(F.lower(c), W.NO_GUEST) & ~c.rlike(r"^[\d\s\-_.]+$") & (F.length(F.trim(c)) >= 2)


def complete_metadata(genre: str = "genre", year: str = "release_year") -> Column:
    return (F.coalesce(F.length(F.trim(genre)), F.lit(0)) > 0) & (F.coalesce(F.col(year), F.lit(0)) != 0)
