"""Queries of the problems on text: packing (8), leakage (9), quality (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.leakage import contaminated, leaks, paraphrases
from chorale.llm.packing import pack_documents
from chorale.llm.quality import not_prose, text_statistics
from chorale.sources.tables import spread, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or piece of one, for every target."""
    return pack_documents(_documents(spark, d), table(spark, d, "pack_targets"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each target are."""
    targets = table(spark, d, "pack_targets").select(F.col("target_id").cast("long").alias("target_id"), "capacity_tokens")
    used = p8_containers(spark, d).where("container is not null").groupBy("target_id").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("container").alias("containers"))
    return used.join(F.broadcast(targets), "target_id").select("target_id", "tokens", "containers", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item_id of every document with nine or more consecutive words of an item."""
    return contaminated(_documents(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of the latent search with their checks; paraphrases have a long subsequence without a long run."""
    return leaks(_documents(spark, d), table(spark, d, "eval_items")).withColumn("cosine", F.round("cosine", 6))


def p9_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item_id of every document that holds an item in other words."""
    return paraphrases(_documents(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of every document that is mostly list, table or junk."""
    return not_prose(_documents(spark, d))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document."""
    df = text_statistics(_documents(spark, d))
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_candidates": p9_candidates, "p9_paraphrases": p9_paraphrases}
ORACLE: dict[str, str] = {}
