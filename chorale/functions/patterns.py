"""Patterns made from examples, and splitting without separators (STR19, STR21)."""

from __future__ import annotations

import re

ARTICLES = {"the", "a", "an", "der", "die", "das", "ein", "eine"}


def pattern_of(title: str, artist: str, song: str) -> tuple[str, int, int] | None:
    """(pattern, artist group, song group) of titles written like this one; None if either part isn't there.

    All but artist and song is matched as written, so brackets in a title are no groups.
    """
    low = title.lower()
    a, s = low.find(artist.lower()) if artist else -1, low.find(song.lower()) if song else -1
    if a < 0 or s < 0 or a < s + len(song) and s < a + len(artist):
        return None
    first, second = sorted(((a, len(artist), "a"), (s, len(song), "s")))
    parts = [title[: first[0]], title[first[0] + first[1] : second[0]], title[second[0] + second[1] :]]
    body = "(.+?)".join(re.sub(r"(\\ )+", r"\\s+", re.escape(p)) for p in parts)
    return f"^{body}$", 1 + (first[2] == "s"), 1 + (first[2] == "a")


def split_words(text: str, artists: dict[str, int] | None = None) -> tuple[str, str]:
    """Artist and song of words without a separator: a known artist's words, else two, one more after an article."""
    words = text.split()
    for name, n in (artists or {}).items():
        if text.lower().startswith(name):
            return " ".join(words[:n]), " ".join(words[n:])
    if len(words) < 2:
        return text.strip(), ""
    if len(words) == 2:
        return words[0], words[1]
    n = 3 if words[0].lower() in ARTICLES and len(words) > 3 and words[2].lower() not in ARTICLES else 2
    return " ".join(words[:n]), " ".join(words[n:])
