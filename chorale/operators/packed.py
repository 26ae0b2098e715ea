"""Several values packed in one field (problem 3).

Method: for each source the delimiters in use are inferred by scoring every candidate character on
piece-count consistency and on how regular the pieces are, over all rows; fields are then split at
those, with quoting respected, and exploded with position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.text import col, trimmed

#: Candidate delimiters: signs that are written between values somewhere. Fixed values.
CANDIDATES = [",", ";", "|", "/", "·", "&", "\t", "\n", "+", "•", "-", ".", "'", ":", "_"]

_CLASS = {"\t": r"\t", "\n": r"\n\r", "|": r"\|", "/": "/", "-": r"\-", ".": r"\.", "+": r"\+", "&": "&", "'": "'"}


@dataclass(frozen=True)
class DelimiterScore:
    """rows: fields in which it stands outside quotes; consistency: share of those that give two or more
    whole pieces or an empty place at the end; regularity: share of pieces that look like the source's
    values; apart: 1 if the sign has white space or an end of the field beside it in one row of twenty or
    more, less in proportion (signs within words, as in double names, never have)."""

    delimiter: str
    rows: int
    consistency: float
    regularity: float
    apart: float

    @property
    def score(self) -> float:
        return self.consistency * self.regularity * self.apart


def _unquoted(c: Column) -> Column:
    """The text with quoted parts (and the brackets of a list) made a plain value."""
    bare = F.regexp_replace(c, r'"(?:[^"\\]|\\.|"")*"', "Quoted")
    return F.when(bare.startswith("[") & bare.endswith("]"), F.lit(None)).otherwise(bare)


def infer_delimiters(df: DataFrame, field: str, candidates: list[str] = CANDIDATES, threshold: float = 0.5) -> tuple[list[str], list[DelimiterScore]]:
    """The delimiters in use in df.field, and the scores of all candidates.

    One pass over all rows; what reaches the driver is one row. A candidate counts if its score is at
    least `threshold` and four pieces of five are regular, in however many rows it stands.
    """
    text = df.select(_unquoted(trimmed(field)).alias("v"))
    aggs = []
    for i, c in enumerate(candidates):
        pieces = F.transform(F.split("v", f"[{_CLASS.get(c, c)}]"), lambda x: F.trim(x))
        whole = F.filter(pieces, lambda x: x != "")
        has = F.col("v").contains(c)
        # a value starts with a capital or digit and has two letters or more
        good = F.filter(whole, lambda x: x.rlike(r"^[\p{Lu}\p{N}].*\p{L}"))
        sign = _CLASS.get(c, c)
        beside = F.lit(True) if c.isspace() else F.col("v").rlike(rf"\s[{sign}]|[{sign}]\s|[{sign}]$")
        aggs += [
            F.count_if(has).alias(f"n{i}"),
            F.count_if(has & ((F.size(whole) >= 2) | (F.size(pieces) > F.size(whole)))).alias(f"c{i}"),
            F.sum(F.when(has, F.size(good))).alias(f"g{i}"),
            F.sum(F.when(has, F.size(whole))).alias(f"w{i}"),
            F.count_if(has & beside).alias(f"b{i}"),
        ]
    row = text.agg(*aggs).collect()[0]
    scores = []
    for i, c in enumerate(candidates):
        n = row[f"n{i}"] or 0
        apart = min(1.0, (row[f"b{i}"] or 0) / max(1, n) * 20)
        scores.append(DelimiterScore(c, n, (row[f"c{i}"] or 0) / max(1, n), (row[f"g{i}"] or 0) / max(1, row[f"w{i}"] or 0), apart))
    chosen = [s.delimiter for s in scores if s.rows and s.score >= threshold and s.regularity >= 0.8]
    return chosen, scores


def packed_values(field: Column | str, delimiters: list[str]) -> Column:
    """array<string> of the values in one field.

    A JSON or Python list gives its items; else the text is split at any of `delimiters` outside
    quotes. A value in quotes is one value, without its quotes and escapes (a doubled quote or a
    backslash). Empty places are no values; values are trimmed; null, blank and [] give an empty array.
    """
    text = trimmed(col(field))
    signs = "".join(_CLASS.get(c, c) for c in delimiters)
    quoted = r'\s*"(?:[^"\\]|\\.|"")*"\s*'
    single = r"\s*'(?:[^'\\]|\\.)*'\s*"
    inner = F.regexp_extract(text, r"(?s)^\[(.*)\]$", 1)
    as_list = F.regexp_extract_all(inner, F.lit(rf"(?s){quoted}(?=,|$)|{single}(?=,|$)|[^,]+"), F.lit(0))
    plain = F.regexp_extract_all(text, F.lit(rf"(?s){quoted}(?=[{signs}]|$)|[^{signs}]+" if signs else r"(?s).+"), F.lit(0))
    is_list = text.startswith("[") & text.endswith("]")

    def bare(x: Column, brackets: bool) -> Column:
        x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
        body = F.substring(x, F.lit(2), F.length(x) - 2)
        double = x.rlike(r'(?s)^".*"$') & (F.length(x) > 1)
        if not brackets:
            unescaped = F.regexp_replace(F.replace(body, F.lit('""'), F.lit('"')), r'\\(["\\])', "$1")
            return F.trim(F.when(double, unescaped).otherwise(x))
        one = x.rlike(r"(?s)^'.*'$") & (F.length(x) > 1)
        unescaped = F.regexp_replace(body, r"""\\(["'\\])""", "$1")
        return F.trim(F.when(double | one, unescaped).otherwise(x))

    json = F.from_json(F.when(is_list, text), "array<string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    values = F.when(
        is_list,
        F.coalesce(F.when(F.forall(json, lambda x: x.isNotNull()), F.transform(json, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), F.transform(as_list, lambda x: bare(x, True))),
    ).otherwise(F.transform(plain, lambda x: bare(x, False)))
    return F.coalesce(F.filter(values, lambda x: x != ""), F.array().cast("array<string>"))


def split_packed(df: DataFrame, field: str, delimiters: list[str] | None = None, at_least: int = 1, position: str = "pos", value: str = "item_value") -> DataFrame:
    """df with one row per value of `field`: `position` counts from 1, `value` is the value.

    delimiters: those to split at; inferred from all rows of df where not given. Rows with fewer than
    `at_least` values are left out. Repeated rows stay; an empty table gives an empty one; columns of
    df named as `position` or `value` are replaced.
    """
    if delimiters is None:
        delimiters, _ = infer_delimiters(df, field)
    values = df.withColumn("__values", packed_values(field, delimiters)).where(F.size("__values") >= at_least)
    kept = [c for c in df.columns if c not in (position, value)]
    return values.select(*kept, F.posexplode("__values").alias("__pos", value)).withColumn(position, (F.col("__pos") + 1).cast("long")).drop("__pos").select(*kept, position, value)
