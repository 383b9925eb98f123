import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import resolution as R
from tessera.operators.components import connected_components
from tessera.sources import sinks
from tessera.sources import tables as S
from tessera.streaming import telemetry


def test_available_sum_is_null_if_anything_is(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "k string, v int")
    assert {r.k: r.s for r in df.groupBy("k").agg(A.available_sum("v").alias("s")).collect()} == {"a": 3, "b": None}
    assert df.where("k = 'z'").agg(A.available_sum("v").alias("s")).first().s is None


def test_components_against_union_find(spark):
    random.seed(5)
    edges = [(random.randint(0, 120), random.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    wanted = {x: root(x) for x in parent}
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in found} == wanted and len(found) == len(wanted)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def lead(i, place="", domain="", name="", phone="", email="", address=""):
    return (i, place, domain, name, phone, email, address)


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "row_idx bigint, place string, domain string, name string, phone string, email string, address string")
    return {r.row_idx: (r.group_id, r.review_reasons) for r in R.group_leads(df).collect()}


def test_same_place_joins_whatever_the_name(spark):
    found = grouped(spark, [lead(0, place="p", name="a"), lead(1, place="p", name="b")])
    assert found[1] == (0, "")


def test_a_row_never_unions_two_groups(spark):
    found = grouped(spark, [lead(0, place="p1", domain="x.test", name="a"), lead(1, domain="y.test", name="b"), lead(2, place="p1", domain="y.test", name="c")])
    assert found[0][0] == 0 and found[1][0] == 1 and found[2][0] == 0
    assert all("identity bridge conflict" in found[i][1] for i in range(3))


def test_shared_domain_with_distinct_places(spark):
    found = grouped(spark, [lead(0, place="p1", domain="x.test", phone="111111"), lead(1, place="p2", domain="x.test", phone="222222")])
    assert found[0][0] == 0 and found[1][0] == 1
    assert found[1][1] == "conflicting maps identities; shared domain across distinct places"


def test_name_alone_is_vetoed_by_another_address(spark):
    found = grouped(spark, [lead(0, name="a", address="x"), lead(1, name="a", address="y"), lead(2, name="a")])
    assert found[1][0] == 1 and "conflicting location evidence" in found[1][1] and "ambiguous exact-name match" in found[1][1]
    assert found[2][0] == 2


def test_sequential_dedup_is_not_distinct(spark):
    df = spark.createDataFrame([(0, "e1", "d1"), (1, "e2", "d1"), (2, "e2", "d2"), (3, "", ""), (4, None, None)], "i bigint, e string, d string")
    assert {r.i: r.kept for r in R.sequential_dedup(df, "i", ["e", "d"]).collect()} == {0: True, 1: False, 2: True, 3: True, 4: True}


def test_known_or_new_uses_the_strongest_identity(spark):
    df = spark.createDataFrame([(0, "p", "d"), (1, "", "d"), (2, "q", "d"), (3, "", "")], "i bigint, place string, domain string")
    assert {r.i: r.status for r in R.known_or_new(df, "i", ["place", "domain"]).collect()} == {0: "new", 1: "same_run", 2: "new", 3: "none"}


def test_overlaps(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(4)] + [("c", 0), ("c", 9)], "g string, m int")
    assert [tuple(r) for r in J.overlaps(df, "g", "m").collect()] == [("a", "b", 4, 1.0)]


def test_merge_keeps_old_for_blanks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, ""), (2, "B"), (3, "c")], "k int, v string")
    assert {r.k: r.v for r in J.merge_rows(old, new, ["k"]).collect()} == {1: "a", 2: "B", 3: "c"}


def test_manifest_is_the_commit_mark(spark, tmp_path):
    df = spark.range(10).withColumn("t", F.lit("x"))
    path = str(tmp_path / "e")
    assert sinks.publish_once(df, path) is True
    assert sinks.publish_once(df, path) is False
    assert sinks.verified(spark, path)
    with pytest.raises(ValueError):
        sinks.publish_once(df.limit(3), path)
    spark.range(1).write.mode("append").parquet(path + "/data")
    assert sinks.recover(df, path) is True and sinks.verified(spark, path)


def test_text_csv_and_files(spark, tmp_path):
    assert S.text_csv(spark, str(tmp_path / "none.csv"), ["a", "b"]).count() == 0
    (tmp_path / "f").mkdir()
    for n, t in (("1.csv", "a,b\n1,\n"), ("2.csv", "a,b\n1,\n"), ("3.csv", "a,b\n2,x\n")):
        (tmp_path / "f" / n).write_text(t)
    assert [tuple(r) for r in S.text_csv(spark, str(tmp_path / "f" / "1.csv"), ["a", "b"]).collect()] == [("1", "")]
    assert S.distinct_files(spark, str(tmp_path / "f")).count() == 2


def test_stream_replay_adds_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).selectExpr("id % 12 as id").write.parquet(source)
    stream = spark.readStream.schema("id bigint").parquet(source)
    telemetry.merge_stream(stream, target, ["id"], str(tmp_path / "c1")).awaitTermination()
    telemetry.merge_stream(stream, target, ["id"], str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(target).count() == 12
