"""Scores of search hits and videos as column expressions (SCR, FEA, NUM2, NUM3, STR24)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale.functions import words as W


def text_of(*fields: str) -> Column:
    """The fields in lower case, joined by blanks; null counts as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    return reduce(Column.__add__, [text.contains(w).cast("int") for w in words])


def weighed(text: Column, weights: dict[str, float], scale: float = 1.0) -> Column:
    return reduce(Column.__add__, [F.when(text.contains(w), F.lit(x * scale)).otherwise(F.lit(0.0)) for w, x in weights.items()])


def first_weight(text: Column, weights: dict[str, float]) -> Column:
    chain = F
    for w, x in weights.items():
        chain = chain.when(text.contains(w), F.lit(x))
    return chain.otherwise(F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def upload_day(c: Column | str = "upload_date") -> Column:
    """YYYYMMDD or YYYY-MM-DD as a date; null for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(c.rlike("^[0-9]{8}$"), F.try_to_date(c, "yyyyMMdd")), F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd")))


def term_ratio(text: Column, query: str) -> Column:
    terms = query.lower().split()
    return hits(text, terms) / F.lit(float(len(terms))) if terms else F.lit(0.0)


def relevance(query: str, title: str = "title", description: str = "description") -> Column:
    """How well a hit answers a query: the phrase and its terms in title and description; long titles count less."""
    if not query.strip():
        return F.lit(0.5)
    t, d, q = text_of(title), text_of(description), query.lower()
    score = t.contains(q).cast("double") * 0.4 + d.contains(q).cast("double") * 0.1 + term_ratio(t, query) * 0.3 + term_ratio(d, query) * 0.1
    return F.least(F.lit(1.0), score * F.when(F.length(t) > 100, 0.9).otherwise(1.0))


def quality(title: str = "title", description: str = "description", duration: str = "duration_seconds", channel: str = "channel_name") -> Column:
    minutes, name = F.col(duration) / 60.0, text_of(channel)
    score = F.lit(0.5) + weighed(text_of(title, description), W.QUALITY, 0.1)
    score += F.when(F.coalesce(F.col(duration), F.lit(0)) == 0, 0.0).when(minutes.between(2, 6), 0.1).when((minutes < 1) | (minutes > 10), -0.2).otherwise(0.0)
    score += first_weight(name, W.VERIFIED_CHANNELS) * 0.1
    score += F.when(has_any(name, W.PROFESSIONAL), 0.05).otherwise(0.0) - F.when(has_any(name, W.AMATEUR), 0.05).otherwise(0.0)
    return clamp(score)


def view_score(views: Column) -> Column:
    v = F.greatest(F.lit(1), views)
    # whole powers of ten are compared as such, not by their logarithms
    return F.when(v <= 10**3, 0.1).when(v <= 10**4, 0.3).when(v <= 10**5, 0.5).when(v <= 10**6, 0.7).when(v <= 10**7, 0.9).otherwise(1.0)


def age_score(day: Column, as_of: str) -> Column:
    days = F.datediff(F.lit(as_of).cast("date"), day)
    return F.when(day.isNull(), 0.5).when(days <= 30, 0.9).when(days <= 180, 0.7).when(days <= 365, 0.5).when(days <= 3 * 365, 0.3).otherwise(0.2)


def popularity(as_of: str, views: str = "view_count", day: Column | None = None) -> Column:
    v = F.col(views)
    return F.when(F.coalesce(v, F.lit(0)) == 0, 0.3).otherwise(view_score(v) * 0.7 + age_score(upload_day() if day is None else day, as_of) * 0.3)


def metadata_score() -> Column:
    given = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0))
    points = [(given("title") > 10, 0.3), (given("channel_name") > 0, 0.2), (given("description") > 50, 0.2), (F.coalesce(F.col("duration_seconds"), F.lit(0)) > 0, 0.1), (F.coalesce(F.col("view_count"), F.lit(0)) > 0, 0.1), (given("upload_date") > 0, 0.1)]
    return F.least(F.lit(1.0), reduce(Column.__add__, [F.when(c, F.lit(x)).otherwise(F.lit(0.0)) for c, x in points]))


#: Weights of relevance, quality, popularity and metadata; they sum to 1. Fixed values.
RANK_WEIGHTS = (0.35, 0.25, 0.20, 0.20)


def final_score(query: str, as_of: str, weights: tuple[float, float, float, float] = RANK_WEIGHTS) -> Column:
    total = sum(weights)
    parts = (relevance(query), quality(), popularity(as_of), metadata_score())
    return clamp(reduce(Column.__add__, [p * (w / total) for p, w in zip(parts, weights)]))


def channel_kind(channel: str = "channel_name") -> Column:
    name = text_of(channel)
    return F.when(has_any(name, list(W.VERIFIED_CHANNELS)), "verified_karaoke").when(has_any(name, W.PROFESSIONAL), "professional").when(has_any(name, W.AMATEUR), "amateur").otherwise("unknown")


def hit_relevance(query: str, title: str = "title") -> Column:
    t = text_of(title)
    return F.least(F.lit(2.0), t.contains(query.lower()).cast("double") + term_ratio(t, query) * 0.5 + weighed(t, W.HIT_WORDS))


def channel_video_score(title: str = "title") -> Column:
    t = text_of(title)
    return F.least(F.lit(2.0), F.lit(0.5) + F.when(has_any(t, ["karaoke", "backing track", "instrumental", "sing along"]), 0.3).otherwise(0.0) + weighed(t, W.CHANNEL_WORDS))


def engagement(views: Column, likes: Column, dislikes: Column) -> Column:
    """Net likes per view in percent; null without views or likes."""
    net = F.when(F.coalesce(dislikes, F.lit(0)) > 0, likes - dislikes).otherwise(likes)
    return F.when((views > 0) & likes.isNotNull(), F.round(net.cast("double") / views * 100, 3))


def engagement_quality(views: Column, likes: Column, dislikes: Column, trust: Column, least_trust: float = 0.5) -> Column:
    v, k, d = (F.coalesce(x, F.lit(0)) for x in (views, likes, dislikes))
    score = F.when(v > 1000, 0.3).otherwise(0.0) + F.when(v > 10000, 0.2).otherwise(0.0) + F.when(k > 50, 0.3).otherwise(0.0) + F.when((v > 0) & (k.cast("double") / F.greatest(v, F.lit(1)) > 0.01), 0.2).otherwise(0.0)
    score -= F.when((F.coalesce(trust, F.lit(0.0)) > least_trust) & (k + d > 0) & (d.cast("double") / F.greatest(k + d, F.lit(1)) > 0.3), 0.2).otherwise(0.0)
    return clamp(score)


def technical_quality(duration: Column) -> Column:
    s = F.coalesce(duration, F.lit(0))
    return F.when(s.between(120, 360), 0.3).when(s.between(60, 480), 0.2).otherwise(0.0)


def feature_flag(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """(whether any pattern is there, confidence growing with the number of patterns)."""
    n = hits(text, patterns)
    return n > 0, F.when(n > 0, F.least(F.lit(1.0), F.lit(0.6) + (n - 1) * 0.1)).otherwise(0.0)


def duration_limit(channel: str, which: int) -> Column:
    name, chain = text_of(channel), F
    for word, limits in W.DURATIONS.items():
        chain = chain.when(name.contains(word), limits[which])
    return chain.otherwise(W.DURATION_ELSE[which])
