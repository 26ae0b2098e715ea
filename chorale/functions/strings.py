"""Text functions of titles, artists and queries (STR), as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale.functions.text import col

#: Rules are (pattern, replacement), applied in order, case-insensitively, with Unicode classes.
Rules = list[tuple[str, str]]

_MARKED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1 and unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c))[0].isalpha() and len([x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1]
#: Latin letters with marks, and their plain letters.
MARKED = "".join(_MARKED)
PLAIN = "".join(unicodedata.normalize("NFKD", x)[0] for x in _MARKED)

NORMAL: Rules = [(r"^the\s+", ""), (r"^a\s+", ""), (r"^an\s+", ""), (r"&", "and"), (r"[.,\\\]^_]", " "), ("['\"]", "")]
QUERY: Rules = [
    (r"\b(?:karaoke|karaokê|karaoké)\b", " "),
    (r"\b(?:instrumental|backing track|minus one|minusone|minus-one)\b", " "),
    (r"\b(?:sing along|singalong)\b", " "),
    (r"\b(?:mr|inst|playback|accompaniment|melody)\b", " "),
    (r"\b(?:hd|hq|4k|1080p|720p|480p|high quality|high def|ultra hd|uhd|full hd)\b", " "),
    (r"\b(?:official|music video|video|audio|clip|lyrics)\b", " "),
    (r"\b(?:version|cover|tribute|style|remake|rendition)\b", " "),
    (r"\s+", " "),
]
RELEASE_QUERY: Rules = [
    *[(pattern, "") for word in ("karaoke", "instrumental", "backing track") for pattern in (rf"\s*\({word}.*?\)", rf"\s*\[{word}.*?\]", rf"\s*-\s*{word}.*$")],
    *[(pattern, "") for word in ("official", "lyrics", "sing", "cover", "remix", "version") for pattern in (rf"\s*\({word}.*?\)", rf"\s*\[{word}.*?\]")],
    (r"\s+", " "),
]
LEADING: Rules = [(r"^\[[^\]]*\]\s*", ""), (r"^【[^】]*】\s*", ""), (r"^.*?karaoke[^:]*:\s*", ""), (r"^.*?presents\s*:?\s*", "")]
CLEAN_TITLE: Rules = [
    *LEADING, (r"^Official\s+", ""), (r"^HD\s+", ""), (r"^(?:DE|EN|FR|ES|IT|PT|NL|PL|RU|JP|KR|CN)\s+", ""),
    (r"\s*\|\s*karaoke\s+version\s*\|\s*karafun$", ""), (r"\s*\|\s*karaoke\s+version$", ""), (r"\s*\|\s*karafun$", ""), (r"\s*\|\s*official\s+karaoke.*$", ""),
    (r"\b\d{4,}\b", ""), (r"\b(?:HD|HQ|4K|1080p|720p|480p)\b", ""), (r"[–—]", "-"), (r"\s+", " "), (r"^\s+|\s+$", ""),
]
EXTRACTED: Rules = [
    (r"^\s+|\s+$", ""), (r"^[\"'`]+|[\"'`]+$", ""), (r"^\([^)]*\)|^\[[^\]]*\]", ""), (r"^\s+|\s+$", ""), (r"^karaoke\s+", ""),
    (r"\s*\|.*$", ""), (r"\s*\(\s*(?:karaoke|instrumental|minus|mr|backing track|version)\s*\)$", ""), (r"\s*\[\s*(?:karaoke|instrumental|minus|mr)\s*\]$", ""), (r"\s*\([^)]*karaoke\s+version\s*\)$", ""),
    (r"\s*\(official\s+karaoke\s+instrumental\s*\)$", ""), (r"\s*\(\s*(?:rock|acoustic|live|demo|radio|piano|jazz|club|dance|edit|mix)\s+version\s*\)$", ""), (r"\s*\([^)]*melody\s*\)$", ""),
    (r"\s*-\s*karaoke.*$", ""), (r"\s*mr$", ""), (r"\s*inst\.?$", ""), (r"\s*\([^)]*key\)$", ""), (r"\s*\(.*?backing.*?\)$", ""), (r"\s*\*+\s*$", ""), (r"\s+", " "), (r"^\s+|\s+$", ""),
]
EXTRACTED_PLAIN: Rules = [
    (r"^\s+|\s+$", ""), (r"^[\"'`]+|[\"'`]+$", ""), (r"^\([^)]*\)|^\[[^\]]*\]", ""), (r"^\s+|\s+$", ""),
    (r"\s*\([^)]*(?:karaoke|instrumental|minus|mr)[^)]*\)$", ""), (r"\s*\[[^\]]*(?:karaoke|instrumental|minus|mr)[^\]]*\]$", ""), (r"\s*-\s*karaoke.*$", ""), (r"\s*mr$", ""), (r"\s*inst\.?$", ""), (r"\s*\([^)]*key\)$", ""), (r"\s+", " "), (r"^\s+|\s+$", ""),
]
CACHE_QUERY: Rules = [
    (r"\s+", " "), (r"^\s+|\s+$", ""), (r"[–—−]", "-"), ("[“”`´]", '"'), ("…", "..."), (r"\b(?:hd|hq|4k|1080p|720p|480p)\b", ""), (r"\b(?:high\s*quality|low\s*quality)\b", ""),
    (r"\s+", " "), (r"^\s+|\s+$", ""),
]

#: First match wins; a title's structure by name. Fixed patterns.
STRUCTURES = [
    ("ARTIST-SONG-KARAOKE", r"^[^\-–—]+\s*[\-–—]\s*[^(]+\s*\([^)]*karaoke[^)]*\)$"),
    ("CHANNEL-ARTIST-SONG", r"^\[[^\]]+\]\s*[^\-–—]+[\-–—].+"),
    ("SONG-BY-ARTIST-KARAOKE", r"^[^(]+?\s*by\s+[^(]+?\s*\([^)]*karaoke[^)]*\)$"),
    ("ARTIST-SONG-PIPE", r"^[^\-–—|]+\s*[\-–—]\s*[^|]+\s*\|"),
]

SCRIPTS = [("chinese", "[一-鿿]"), ("japanese", "[぀-ゟ゠-ヿ]"), ("korean", "[가-힯]"), ("russian", "[Ѐ-ӿ]")]

STOP_WORDS = ["the", "and", "&", "feat", "featuring", "ft"]


def chained(c: Column | str, rules: Rules) -> Column:
    c = col(c)
    for pattern, replacement in rules:
        c = F.regexp_replace(c, F.lit("(?iUu)" + pattern), F.lit(replacement))
    return c


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def unmarked(c: Column | str) -> Column:
    """Latin letters without their marks, composed or combining."""
    return F.regexp_replace(F.translate(col(c), MARKED, PLAIN), r"[\x{0300}-\x{036f}]", "")


def plain_ascii(c: Column | str) -> Column:
    """Latin letters without marks; all else that is not printable ASCII left out."""
    return F.regexp_replace(unmarked(c), "[^ -~]", "")


def normal_name(c: Column | str) -> Column:
    """Lower case without marks, leading articles, quotes and some signs."""
    return F.regexp_replace(chained(unmarked(F.lower(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""))), NORMAL), r"(?U)^\s+|\s+$", "")


def titled(c: Column | str) -> Column:
    """Every run of letters with a capital first."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def extracted(c: Column | str) -> Column:
    """An artist or title cut out of a text: without noise, capitalised if it was all in lower case."""
    x = chained(c, EXTRACTED)
    x = F.when((F.length(x) > 3) & (x == F.lower(x)) & x.rlike(r"\p{L}"), titled(x)).otherwise(x)
    return F.when(x.rlike(r"[!?.]$"), x).otherwise(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]+$", ""), r"(?U)\s+$", ""))


def without_repetition(c: Column | str) -> Column:
    """'A - a' becomes 'A'; equal words in a row become one; only where ' - ' is in the text."""
    c = col(c)
    parts = F.split(c, " - ")
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    kept = F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: (s["i"] == 0) | (F.lower(s["w"]) != F.lower(F.get(words, s["i"] - 1)))), lambda s: s["w"])
    twice = (F.size(parts) == 2) & (F.lower(F.trim(F.get(parts, F.lit(0)))) == F.lower(F.trim(F.get(parts, F.lit(1)))))
    return F.when(~c.contains(" - "), c).when(twice, F.trim(F.get(parts, F.lit(0)))).when(F.size(kept) < F.size(words), F.array_join(kept, " ")).otherwise(c)


def script(c: Column | str) -> Column:
    chain = F
    for name, pattern in SCRIPTS:
        chain = chain.when(col(c).rlike(pattern), name)
    return chain.otherwise("english")


def artist_key(c: Column | str) -> Column:
    """Lower case, no punctuation, without words that don't tell artists apart."""
    words = F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"(?U)[^\w\s]", ""), r"(?U)\s+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.array_join(words, " ")


def structure(c: Column | str) -> Column:
    chain = F
    for name, pattern in STRUCTURES:
        chain = chain.when(col(c).rlike("(?iUu)" + pattern), name)
    return chain.otherwise(F.lit(None))


def song_only(c: Column | str) -> Column:
    """What stands right of ' - ', else left of ' by '; null without either."""
    c = col(c)
    dash, by = F.instr(c, " - "), F.instr(F.lower(c), " by ")
    return F.when(dash > 0, stripped(F.substring(c, dash + 3, F.length(c)))).when(by > 0, stripped(F.substring(c, F.lit(1), by - 1)))


def vowelless(c: Column | str) -> Column:
    """The first letter and the consonants after it."""
    x = F.regexp_replace(F.lower(col(c)), "[^a-z]", "")
    return F.concat(F.left(x, F.lit(1)), F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), "[aeiou]", ""))


def short_sound(c: Column | str) -> Column:
    """Letters without repetition, no vowels but a first one, four at most, in capitals."""
    x = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z]", ""), r"(.)\1+", "$1")
    return F.upper(F.left(F.concat(F.left(x, F.lit(1)), F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), "[aeiou]", "")), F.lit(4)))


def sound(c: Column | str) -> Column:
    """Soundex whose vowels, h and w all part equal codes."""
    x = F.upper(F.regexp_replace(col(c), "[^A-Za-z]", ""))
    codes = F.translate(x, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    rest = F.regexp_replace(F.substring(F.regexp_replace(codes, r"(.)\1+", "$1"), F.lit(2), F.length(x)), "0", "")
    return F.when(x == "", "").otherwise(F.rpad(F.left(F.concat(F.left(x, F.lit(1)), rest), F.lit(4)), 4, "0"))


def sanitized(c: Column | str, most: int = 500) -> Column:
    """Null if blank; cut to `most` characters with an ellipsis; without control characters."""
    c = col(c)
    cut = F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)
    return F.when(F.length(F.regexp_replace(c, r"(?U)\s+", "")) > 0, F.regexp_replace(cut, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))


def seconds_of(c: Column | str) -> Column:
    """Seconds of PT1H2M3S, H:M:S, M:S or a number; 0 for anything else."""
    c = F.trim(col(c))
    part = lambda p: F.coalesce(F.expr("1").cast("long") * F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("long"), F.lit(0))
    iso = part(r"^PT.*?(\d+)H") * 3600 + part(r"^PT.*?(\d+)M") * 60 + part(r"^PT.*?(\d+)S")
    hms = part(r"^(\d+):\d+:\d+$") * 3600 + part(r"^\d+:(\d+):\d+$") * 60 + part(r"^\d+:\d+:(\d+)$")
    ms = part(r"^(\d+):\d+$") * 60 + part(r"^\d+:(\d+)$")
    return F.coalesce(F.when(c.startswith("PT"), iso).when(c.contains(":"), F.when(c.rlike(r"^\d+:\d+:\d+$"), hms).otherwise(ms)).otherwise(F.coalesce(c.try_cast("long"), F.lit(0))), F.lit(0))


def clock(c: Column | str) -> Column:
    """HH:MM:SS, or MM:SS below an hour; 00:00 below zero."""
    c = col(c)
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    h, m, s = F.floor(c / 3600), F.floor(c % 3600 / 60), c % 60
    return F.when(c < 0, "00:00").when(h > 0, F.concat_ws(":", two(h), two(m), two(s))).otherwise(F.concat_ws(":", two(m), two(s)))


def release_year_in(title: str, description: str, as_of_year: int) -> Column:
    """The earliest plausible year written as a release year in the texts; null if there is none."""
    text = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(description), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, r"\b\d{4}'s\s+\w+\s+[Pp]laylist", ""), r"\b\d{4}'s\b", "")
    found = [F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in YEARS]
    years = F.transform(F.concat(*found), lambda y: y.cast("int"))
    return F.array_min(F.filter(years, lambda y: y.between(1900, as_of_year - 1)))


#: Where a release year may stand. Fixed patterns.
YEARS = [r"\((\d{4})\)", r"\[(\d{4})\]", r"from\s+(\d{4})", r"released\s+(\d{4})", r"(\d{4})\s+version", r"circa\s+(\d{4})"]
