"""Sinks: data first, manifest last, and what reads them back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _at, _exists, write_file


def text_csv(df: DataFrame, path: str) -> None:
    """K1, K4: a CSV with header; the commit protocol replaces the folder as a whole."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def digest(df: DataFrame) -> tuple[int, str]:
    """Row count and a hash of the rows that does not depend on their order; sums in the executors, nothing is collected."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]).cast("decimal(38,0)")
    found = df.agg(F.count("*").alias("n"), F.sum(row).alias("h")).first()
    return found["n"], str(found["h"] or 0)


def publish(df: DataFrame, path: str) -> tuple[int, str]:
    """K8, K9: the data, then a manifest with the row count and hash of what was read back; the manifest is the commit mark."""
    spark = df.sparkSession
    fs, mark = _at(spark, f"{path}/manifest")
    fs.delete(mark, True)  # no mark stands over data that are being replaced
    df.write.mode("overwrite").parquet(f"{path}/data")
    n, h = digest(spark.read.parquet(f"{path}/data"))
    spark.createDataFrame([(n, h)], "n bigint, hash string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return n, h


def publish_once(df: DataFrame, path: str) -> bool:
    """An equal export is reused, another one refused. Returns whether it was written."""
    spark = df.sparkSession
    if _exists(spark, f"{path}/manifest"):
        found = spark.read.json(f"{path}/manifest").first()
        if (found["n"], found["hash"]) != digest(df):
            raise ValueError(f"{path} holds another export")
        return False
    publish(df, path)
    return True


def verified(spark: SparkSession, path: str) -> bool:
    """The data agree with the manifest."""
    found = spark.read.json(f"{path}/manifest").first()
    return (found["n"], found["hash"]) == digest(spark.read.parquet(f"{path}/data"))


def recover(df: DataFrame, path: str) -> bool:
    """A valid export stays, any other is written anew. Returns whether it was."""
    try:
        if verified(df.sparkSession, path):
            return False
    except Exception:  # noqa: BLE001  no manifest or no data: not valid
        pass
    publish(df, path)
    return True


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: the rows that only one of the two has, with side; empty if they agree."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def append_evolving(df: DataFrame, path: str) -> None:
    """K1: rows appended to a set of Parquet files whose columns are the union of all that were ever appended; read with mergeSchema."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def replaced_csv(df: DataFrame, path: str) -> int:
    """K4: a CSV that replaces the one before, read back: header and row count must agree. Returns the rows."""
    spark = df.sparkSession
    text_csv(df, f"{path}.new")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}.new")
    n, wanted = back.count(), df.count()
    if n != wanted or (n and back.columns != df.columns):
        raise ValueError(f"{path}: {n} rows of {back.columns} were written, not {wanted} of {df.columns}")
    fs, where = _at(spark, path)
    fs.delete(where, True)
    if not fs.rename(_at(spark, f"{path}.new")[1], where):
        raise OSError(f"{path} was not replaced")
    return n


def point_latest(spark: SparkSession, folder: str, name: str) -> None:
    """K5: the pointer to the newest export in a folder; it is replaced at once, after the export itself is there."""
    if not _exists(spark, f"{folder}/{name}"):
        raise ValueError(f"{folder}/{name} is not there")
    write_file(spark, f"{folder}/latest.json", json.dumps({"name": name}).encode())


def latest(spark: SparkSession, folder: str) -> str:
    """The path that the pointer names."""
    return f"{folder}/{spark.read.json(f'{folder}/latest.json').first()['name']}"


def run_export(df: DataFrame, folder: str, run_id: str, order: str, columns: list[str]) -> str:
    """K6: the given columns of a run's rows in order, as a CSV of that run that has a header even without rows, and the pointer to it."""
    name = f"run-{run_id}"
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], F.col(order).alias("_order")).orderBy("_order").drop("_order")
    text_csv(rows, f"{folder}/{name}")
    point_latest(df.sparkSession, folder, name)
    return f"{folder}/{name}"


def canonical(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def report(spark: SparkSession, path: str, document: dict, lines: list[str] = ()) -> bool:
    """Canonical JSON, with fixed-width text beside it if lines are given. Equal bytes are left alone. Returns whether it was written."""
    text = canonical(document)
    if _exists(spark, f"{path}.json") and spark.read.text(f"{path}.json", wholetext=True).first()["value"] == text:
        return False
    if lines:
        write_file(spark, f"{path}.txt", "\n".join(lines).encode())
    write_file(spark, f"{path}.json", text.encode())
    return True


def fixed_width(rows: list[dict], widths: dict[str, int]) -> list[str]:
    """Lines of a report: a header and the rows, cut and padded."""
    line = lambda values: " ".join(str(v)[:w].ljust(w) for v, w in zip(values, widths.values(), strict=True)).rstrip()
    return [line(widths), *(line(["N/A" if r[c] is None else r[c] for c in widths]) for r in rows)]


def log_comparisons(comparisons: DataFrame, path: str, status: str) -> dict:
    """Each comparison as a line of JSON, appended, and the summary of the whole log by status, which is written beside it."""
    spark = comparisons.sparkSession
    comparisons.select(F.to_json(F.struct(*comparisons.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(f"{path}/log")
    counts = spark.read.text(f"{path}/log").groupBy(F.get_json_object("value", f"$.{status}").alias("status")).count()
    summary = {r["status"]: r["count"] for r in counts.collect()}  # a row a status
    report(spark, f"{path}/summary", summary)
    return summary


def validation_report(cases: DataFrame, path: str, ok: str) -> dict:
    """The failed cases as CSV, the counts as JSON, the finding in words."""
    spark = cases.sparkSession
    text_csv(cases.where(~F.col(ok)), f"{path}/cases")
    counted = cases.agg(F.count("*").alias("cases"), F.count_if(~F.col(ok)).alias("failed")).first()
    summary = {"cases": counted["cases"], "failed": counted["failed"], "stable": counted["failed"] == 0}
    report(spark, f"{path}/summary", summary, [f"{counted['failed']} of {counted['cases']} cases failed"])
    return summary


def insert_entities(spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, int]:
    """Rows of each table (with its key) that it does not have yet; what others refer to comes first in the dict. Returns the rows added."""
    from ..streaming.telemetry import append_new

    return {name: append_new(rows, f"{folder}/{name}", key) for name, (rows, key) in tables.items()}


def persist_result(run: DataFrame, children: dict[str, DataFrame], folder: str, fingerprint: str) -> bool:
    """A run (one row) with its recommendations and proposals, once for each fingerprint. Returns whether it was new."""
    from ..streaming.telemetry import append_new

    if not append_new(run, f"{folder}/runs", [fingerprint]):
        return False
    for name, rows in children.items():
        rows.write.mode("append").parquet(f"{folder}/{name}")
    return True


def snapshot(spark: SparkSession, path: str, target: str) -> bool:
    """A copy of a database file, verified: whole, and the same bytes. A copy that is not is removed. The file systems copy, the executors verify."""
    from .files import integrity

    (fs, where), (to_fs, to) = _at(spark, path), _at(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, to_fs, to, False, spark.sparkContext._jsc.hadoopConfiguration())
    a, b = (integrity(spark, p).select("sha256", "whole").first() for p in (path, target))
    if a == b and b["whole"]:
        return True
    to_fs.delete(to, False)
    return False
