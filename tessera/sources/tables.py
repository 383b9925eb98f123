"""Sources: tables, all-text CSV, tolerant JSON, ordered unions, schema back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_csv(spark: SparkSession, path: str, columns: list[str], strict: bool = False) -> DataFrame:
    """A CSV with a header, every column text, blank kept as ''. A missing file is an empty set. strict fails on ragged rows and other headers."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("emptyValue", "").option("nullValue", "\u0000").option("multiLine", False)
    if strict:
        reader = reader.option("mode", "FAILFAST").option("enforceSchema", False)
    return reader.schema(schema).csv(path).fillna("")


def ordered_union(*sources: DataFrame) -> DataFrame:
    """Sources one after the other, missing columns null, with source_rank."""
    out = None
    for rank, source in enumerate(sources):
        ranked = source.withColumn("source_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out


def with_columns(df: DataFrame, wanted: dict[str, DataType | str]) -> DataFrame:
    """Columns that an older table lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})


def json_map(value: Column) -> Column:
    """A JSON object as a map of texts; malformed or null gives an empty map."""
    return F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))


def first_spellings(lines: DataFrame, column: str, order: str) -> DataFrame:
    """Lines without comments and blanks, once each but for case and spaces, in their first spelling."""
    text = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    kept = lines.select(text.alias(column), F.col(order)).where((F.col(column) != "") & ~F.startswith(F.col(column), F.lit("#")))
    return kept.groupBy(F.lower(column).alias("_key")).agg(F.min_by(column, order).alias(column), F.min(order).alias(order)).drop("_key")


def identity_set(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """The distinct (kind, value) of the rows' identities, blanks left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()]))
    return df.select(pairs.alias("p")).select("p.*").where(F.coalesce("value", F.lit("")) != "").distinct()


def distinct_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path and hash of the files under a folder, of equal ones the first path; the contents stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256")).groupBy("sha256").agg(F.min("path").alias("path"))
