import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import assert_same
from .helpers import frame, odd_rows
from .test_pair_operators import toxic_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = toxic_rows(300)
    rows += [(2000 + i, t) for i, t in rows[:40]] + [(3000 + r[0] if r[0] is not None else None, *r[1:]) for r in odd_rows()]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert out.columns == columns
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        if name == "quality":
            assert {0, 5, 17, 3004, 3005, 3006} <= after and not {3000, 3001, 3002, 3003} & after
        if name == "toxicity":
            gone = before - after
            assert sum(labels.get(i % 2000, 0) for i in gone if i < 3000) >= 0.9 * len([i for i in gone if i < 3000]) > 5
        if name == "near_duplicates":
            assert not [i for i in after if i is not None and 2000 <= i < 2040 and i - 2000 in before]
            assert out.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
            assert simhash.near_duplicates(out).where("doc_id <> component_id").isEmpty()
        if name == "repeated_passages":
            assert after == before and out.where(F.length("text") != F.col("n_chars")).isEmpty()
        docs = out


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).where("sequence_id = 0").agg(F.sum("length")).first()[0] == 1024
    empty = str(tmp_path / "sf")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_reads_whole_tables(spark, name):
    n = QUERIES[name](spark, SF).count()
    if name.split("_")[0] in {"op1", "op3", "op4", "op8", "op9", "op10"}:
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()
