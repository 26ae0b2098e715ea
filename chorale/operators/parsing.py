"""Artist and song out of titles by ordered rules (PAR, JN16), as column expressions.

Which rule applies is settled first; only its groups are then cut out and cleaned, so the cleaning is in
the plan once and not once a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.strings import extracted, script, titled
from chorale.functions.title_rules import BY_CHANNEL, BY_SCRIPT, CORE, NEEDED, SPLITS, Rule
from chorale.operators.filters import valid_name, valid_song

_FLAGS = "(?iUu)"


def first_rule(title: Column, rules: list[Rule]) -> Column:
    chain, low = F, F.lower(title)
    for name, pattern, *_ in rules:
        fits = title.rlike(_FLAGS + pattern)
        chain = chain.when(reduce(lambda a, c: c & a, [low.contains(x) for x in reversed(NEEDED.get(name, []))], fits), name)
    return chain.otherwise(F.lit(None))


def split_name(text: Column, patterns: list[str], which: str) -> Column:
    """Artist or song of a text that holds both, by the first pattern that fits."""
    chain = F
    for p in patterns:
        chain = chain.when(text.rlike(_FLAGS + p), F.regexp_extract(text, _FLAGS + p, 1 if which == "artist" else 2))
    return chain.otherwise(F.lit(None))


def _group(title: Column, rule: Column, rules: list[Rule], which: str, whole: str) -> Column:
    chain = F
    for name, pattern, artist, song, _ in rules:
        if name in SPLITS:
            chain = chain.when(rule == name, split_name(F.col(whole), SPLITS[name], which))
            continue
        groups = artist if which == "artist" else (song,) if song else ()
        parts = [F.regexp_extract(title, _FLAGS + pattern, g) for g in groups]
        chain = chain.when(rule == name, parts[0] if len(parts) == 1 else F.concat_ws(" ", *parts) if parts else F.lit(None).cast("string"))
    return chain.otherwise(F.lit(None))


def parsed(df: DataFrame, rules: list[Rule], title: str = "title", prefix: str = "", clean=extracted, artist_ok=valid_name, partial: float = 0.7) -> DataFrame:
    """df with rule, artist, song and confidence of the first rule that fits: the rule's own with both parts valid, `partial` of it with one.

    `clean` is applied to what the groups hold, `artist_ok` tells whether the name of a column is an artist's.
    """
    t, names = F.col(title), [f"{prefix}{c}" for c in ("rule", "artist", "song", "confidence")]
    rule, artist, song, conf = names
    df = df.withColumn(rule, first_rule(t, rules))
    whole, split = f"{prefix}whole", [r for r in rules if r[0] in SPLITS]
    for name, pattern, *_ in split:  # what is cut a second time, cleaned once
        df = df.withColumn(whole, F.when(F.col(rule) == name, F.regexp_extract(t, _FLAGS + pattern, 1)))
        df = df.withColumn(whole, clean(F.col(whole)))
    # groups first, then their cleaning: each is a column of its own, as cleaning refers to it several times
    df = df.withColumns({artist: _group(t, F.col(rule), rules, "artist", whole), song: _group(t, F.col(rule), rules, "song", whole)})
    if split:
        was_split = F.col(rule).isin([r[0] for r in split])
        df = df.drop(whole).withColumns({c: F.when(was_split, titled(c)).otherwise(F.col(c)) for c in (artist, song)})
    df = df.withColumns({artist: clean(F.col(artist)), song: clean(F.col(song))})
    df = df.withColumns({artist: F.when(artist_ok(artist), F.col(artist)), song: F.when(valid_song(song), F.col(song))})
    base = F
    for name, *_, c in rules:
        base = base.when(F.col(rule) == name, F.lit(c))
    have = F.col(artist).isNotNull().cast("int") + F.col(song).isNotNull().cast("int")
    return df.withColumn(conf, F.round(base.otherwise(0.0) * F.when(have == 2, 1.0).when(have == 1, partial).otherwise(0.0), 4))


def channel_rules(channel: str = "channel_name") -> list[tuple[Column, list[Rule]]]:
    """Whether a channel is of a kind, and that kind's rules; a channel is of the first kind its name matches."""
    name, before, out = F.lower(F.coalesce(F.col(channel), F.lit(""))), F.lit(False), []
    for _, pattern, rules in BY_CHANNEL:
        fits = name.rlike(pattern)
        out.append((fits & ~before, rules))
        before = before | fits
    return out


def ladder(df: DataFrame, title: str = "title", channel: str = "channel_name") -> DataFrame:
    """Rules of the channel (above 0.7), of the script (above 0.8), then the core rules; the first stage that is sure enough wins."""
    out = df
    stages: list[tuple[Column, str, float]] = []
    for k, (applies, rules) in enumerate(channel_rules(channel)):
        out = parsed(out, rules, title, f"__c{k}_")
        stages.append((applies, f"__c{k}_", 0.7))
    for k, (name, rules) in enumerate(BY_SCRIPT.items()):
        out = parsed(out, rules, title, f"__s{k}_")
        stages.append((script(title) == name, f"__s{k}_", 0.8))
    out = parsed(out, CORE, title, "__core_")
    stages.append((F.lit(True), "__core_", -1.0))

    def chosen(c: str) -> Column:
        chain = F
        for applies, prefix, least in stages:
            chain = chain.when(applies & (F.col(f"{prefix}confidence") > least), F.col(f"{prefix}{c}"))
        return chain.otherwise(F.lit(None))

    return out.select(*df.columns, *[chosen(c).alias(f"parsed_{c}") for c in ("rule", "artist", "song", "confidence")])
