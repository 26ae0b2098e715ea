"""Written stages: cut lineage in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder of its own; on a cluster that
    would not be seen by other machines, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="chorale-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_OWN: set[str] = set()


def _removed_at_exit(spark: SparkSession, folder: str) -> None:
    """The application's own stages go when its driver ends; until then a lazy result may still read them."""
    if folder in _OWN:
        return
    _OWN.add(folder)

    def remove() -> None:
        try:
            if folder.startswith("file:") or "://" not in folder:
                shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
            else:
                hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone already; what is left is in a folder of its own
            pass

    atexit.register(remove)


def released(spark: SparkSession) -> None:
    """Have the shuffle files that no plan refers to any more deleted; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str, release: bool = True) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back.

    What comes after reads the files, so a lost executor costs no recomputation of the stages before,
    and several readers share one computation. The shuffles that made it are deleted from disk; release=False
    leaves them for a later stage to delete, for small ones.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stages/{spark.sparkContext.applicationId}"
    _removed_at_exit(spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    if release:
        released(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if "/stages/" in path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
