"""Column expressions on text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed form of a video id: 11 characters of A-Z a-z 0-9 _ -
ID = "[A-Za-z0-9_-]{11}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""), F.lit(""))


def letters(c: Column | str) -> Column:
    """Lower case with all but Unicode letters and digits removed; null stays null."""
    return F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "")


def id_in_url(c: Column | str) -> Column:
    """The video id within a URL in any of its forms (v=, path segment); null if there is none."""
    query = F.regexp_extract(col(c), rf"[?&]v=({ID})(?![A-Za-z0-9_-])", 1)
    path = F.regexp_extract(col(c), rf"/({ID})(?=$|[?&#/])", 1)
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(path, F.lit("")))


def video_key(video_id: Column | str, url: Column | str) -> Column:
    """The video a record is of: its video_id, or the id within its url where video_id is missing."""
    return F.coalesce(trimmed(video_id), id_in_url(url))
