"""Written tables in the folder that driver and executors share, and broadcasts behind a check of size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, a new one in local mode (as in tests); on a cluster an error, as a
    folder of one machine would not be seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, *keys: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read again, and its path. It ends the lineage: a lost executor costs no recomputation.

    The file goes when the session ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*keys).parquet(path)
    with contextlib.suppress(Exception):  # a tidy-up only; the table itself is there
        _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    return spark.read.schema(df.schema).parquet(path), path


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df to be broadcast if it has at most ``most`` rows, else as it is: the join then shuffles. Hand over a written table of narrow rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
