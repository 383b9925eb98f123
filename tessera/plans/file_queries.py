"""Queries: spreadsheets, SQLite files, configuration, discovery of files, and sinks with pointers, manifests, reports and logs."""

from __future__ import annotations

import json
import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..sources import files, html, sinks
from ..sources.tables import table
from ..streaming import telemetry
from .registry import query
from .storage import shared_dir


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(n_nationkey AS INT) + 2 AS row_number, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def s3_xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_path(spark, 'sheet')}.xlsx"
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    files.write_file(spark, path, files.workbook([["name", "region"], *[["" if r.n_nationkey % 4 == 0 else r.n_name, str(r.n_regionkey)] for r in rows]]))
    return files.xlsx(spark, path).select("row_number", F.col("fields")["name"].alias("name"), F.col("fields")["region"].alias("region"))


@query("SELECT name, region, size FROM (SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, '' AS size FROM nation UNION ALL SELECT r_name, '', CAST(length(r_name) AS VARCHAR) FROM region)")
def k3_xlsx_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_path(spark, 'sheet')}.xlsx"
    files.append_xlsx(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path)
    files.append_xlsx(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.length("r_name").alias("size")), path)
    return files.xlsx(spark, path).select(*[F.col("fields")[c].alias(c) for c in ("name", "region", "size")])


@query("SELECT * FROM (VALUES ('GOOGLE_MAPS', 1), ('DAILY_EXPORT', 1), ('OTHER', 1)) t(kind, files)")
def s4_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five files one is a copy of another, and one a spreadsheet that a CSV file mirrors."""
    folder = _path(spark, "found")
    sheet = files.workbook([["a"], ["1"]])
    for name, content in (("x/maps_1.csv", b"a\n1\n"), ("x/maps_1.xlsx", sheet), ("y/maps_2.csv", b"a\n1\n"), ("daily.csv", b"a\n2\n"), ("z.xlsx", files.workbook([["b"]]))):
        files.write_file(spark, f"{folder}/{name}", content)
    return files.discovered(spark, folder).groupBy("kind").agg(F.count("*").cast("int").alias("files"))


def _database(spark: SparkSession, sf_dir: str) -> str:
    """Nations in a SQLite file."""
    base = sqlite3.connect(":memory:")
    base.execute("PRAGMA user_version = 7")
    base.execute("CREATE TABLE nation (id INTEGER, name TEXT, region INTEGER)")
    base.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(r.n_nationkey, None if r.n_nationkey % 6 == 0 else r.n_name, r.n_regionkey) for r in table(spark, sf_dir, "nation").collect()])
    base.commit()
    path = f"{_path(spark, 'registry')}.sqlite3"
    files.write_file(spark, path, base.serialize())
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 6 <> 0 THEN n_name END AS name, CAST(NULL AS VARCHAR) AS added_later FROM nation")
def s11_sqlite_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sqlite_table(spark, _database(spark, sf_dir), "nation", ["id", "name", "added_later"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 6 <> 0 THEN n_name END AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def s12_sqlite_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sqlite_table(spark, _database(spark, sf_dir), "nation", ["id", "name", "region"], versions=(6, 7, 8))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\\s+', ' ', 'g') = '' AS untitled, html IS NULL AS missing FROM pages")
def s15_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    parsed = html.parse_pages(pages).select("page_id", "lang", (F.col("title") == "").alias("untitled"))
    return parsed.join(pages.select("page_id", F.col("html").isNull().alias("missing")), "page_id")


@query("""SELECT * FROM (VALUES ('limit', '20'), ('mode', '"fast"'), ('retries', '3')) t(name, value)""")
def s16_json_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_path(spark, 'config')}.json"
    files.write_file(spark, path, json.dumps({"limit": 10, "mode": "fast"}).encode())
    found = files.configuration(spark, path, {"limit": 5, "mode": "safe", "retries": 3}, {"limit": 20, "mode": None})
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(found.items())], "name string, value string")


@query("SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region, NULL::BIGINT AS size FROM nation UNION ALL SELECT r_name, NULL, length(r_name) FROM region")
def k1_append_evolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "evolving")
    sinks.append_evolving(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region")), path)
    sinks.append_evolving(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.length("r_name").cast("bigint").alias("size")), path)
    return sinks.read_evolving(spark, path).select("name", "region", "size")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_nationkey = 2")
def k4_replaced_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "replaced")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    for nation in (1, 2):
        sinks.replaced_csv(customer.where(F.col("c_nationkey") == nation).drop("c_nationkey"), path)
    return spark.read.option("header", True).schema("c_custkey string, c_name string").csv(path)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
def k5_latest_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _path(spark, "pointed")
    for name, least in (("a", 0), ("b", 2)):
        sinks.text_csv(table(spark, sf_dir, "region").where(F.col("r_regionkey") >= least).select("r_regionkey", "r_name"), f"{folder}/{name}")
        sinks.point_latest(spark, folder, name)
    return spark.read.option("header", True).schema("r_regionkey string, r_name string").csv(sinks.latest(spark, folder))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey % 20 = 3")
def k6_run_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one of twenty runs."""
    folder = _path(spark, "runs")
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    path = sinks.run_export(table(spark, sf_dir, "orders").where("o_custkey % 20 = 3"), folder, "3", "o_orderkey", columns)
    return spark.read.option("header", True).schema(", ".join(f"{c} string" for c in columns)).csv(path)


@query("SELECT count(*) AS n, true AS marked, true AS stable FROM supplier")
def k9_manifest_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest has the count of what was read back, and the same rows in another order have the same hash."""
    path, rows = _path(spark, "manifest"), table(spark, sf_dir, "supplier")
    n, h = sinks.publish(rows, path)
    held = spark.read.json(f"{path}/manifest").select("n", (F.col("hash") == F.lit(h)).alias("marked"))
    return held.withColumn("stable", F.lit(sinks.digest(rows.orderBy(F.desc("s_suppkey"))) == (n, h)))


@query("SELECT true AS written, false AS again, true AS refused")
def k10_immutable_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _path(spark, "immutable"), table(spark, sf_dir, "supplier")
    first, again, refused = sinks.publish_once(rows, path), sinks.publish_once(rows, path), False
    try:
        sinks.publish_once(rows.where("s_suppkey > 1"), path)
    except ValueError:
        refused = True
    return spark.range(1).select(F.lit(first).alias("written"), F.lit(again).alias("again"), F.lit(refused).alias("refused"))


@query("SELECT true AS verified, false AS after_a_change")
def k11_manifest_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _path(spark, "verified"), table(spark, sf_dir, "supplier")
    sinks.publish(rows, path)
    before = sinks.verified(spark, path)
    rows.limit(1).write.mode("append").parquet(f"{path}/data")
    return spark.range(1).select(F.lit(before).alias("verified"), F.lit(sinks.verified(spark, path)).alias("after_a_change"))


@query("SELECT s_suppkey, s_name, false AS rebuilt_valid, true AS rebuilt_broken FROM supplier")
def k12_export_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _path(spark, "recovered"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sinks.publish(rows, path)
    valid = sinks.recover(rows, path)
    rows.limit(1).write.mode("append").parquet(f"{path}/data")
    broken = sinks.recover(rows, path)
    return spark.read.parquet(f"{path}/data").withColumns({"rebuilt_valid": F.lit(valid), "rebuilt_broken": F.lit(broken)})


@query("""SELECT '{"customers":' || count(*) || ',"segments":' || count(DISTINCT c_mktsegment) || '}' AS report, true AS written, false AS again FROM customer""")
def k13_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "report")
    totals = table(spark, sf_dir, "customer").agg(F.count_distinct("c_mktsegment").alias("segments"), F.count("*").alias("customers")).first().asDict()
    written, again = sinks.report(spark, path, totals), sinks.report(spark, path, totals)
    return spark.read.text(f"{path}.json").select(F.col("value").alias("report"), F.lit(written).alias("written"), F.lit(again).alias("again"))


@query("SELECT rpad(o_orderpriority, 16, ' ') || ' ' || CASE WHEN sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) IS NULL THEN 'N/A' ELSE CAST(count(*) AS VARCHAR) END AS line FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'priority         orders'")
def k14_telemetry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width lines beside canonical JSON."""
    path = _path(spark, "telemetry")
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.when(F.count_if(F.col("o_orderstatus") == "P") > 0, F.count("*")).alias("orders"))
    rows = [r.asDict() for r in counted.orderBy("priority").collect()]  # a row a priority
    sinks.report(spark, path, {r["priority"]: r["orders"] for r in rows}, sinks.fixed_width(rows, {"priority": 16, "orders": 10}))
    return spark.read.text(f"{path}.txt").select(F.col("value").alias("line"))


@query("SELECT 'all' AS population, count(*) AS rows, count(*) FILTER (c_acctbal > 0) AS available FROM customer UNION ALL SELECT 'building', count(*), count(*) FILTER (c_acctbal > 0) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'home', count(*), count(*) FILTER (c_acctbal > 0) FROM customer WHERE c_nationkey = 3")
def k15_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document over three populations, read back as rows."""
    path, segment, home = _path(spark, "coverage"), F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") == 3
    has = F.col("c_acctbal") > 0
    one = lambda who: F.struct(F.count_if(who).alias("rows"), F.count_if(who & has).alias("available"))
    found = table(spark, sf_dir, "customer").agg(one(F.lit(True)).alias("all"), one(segment).alias("building"), one(home).alias("home")).first().asDict(recursive=True)
    sinks.report(spark, path, found)
    read = spark.read.schema("all struct<rows:bigint,available:bigint>, building struct<rows:bigint,available:bigint>, home struct<rows:bigint,available:bigint>").json(f"{path}.json")
    return read.select(F.inline(F.array(*[F.struct(F.lit(p).alias("population"), F.col(f"{p}.rows").alias("rows"), F.col(f"{p}.available").alias("available")) for p in ("all", "building", "home")])))


@query("SELECT o_orderstatus AS status, 2 * count(*) AS n FROM orders GROUP BY 1")
def k16_jsonl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended twice; the summary is of the whole log."""
    path = _path(spark, "log")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    sinks.log_comparisons(rows, path, "status")
    summary = sinks.log_comparisons(rows, path, "status")
    return spark.createDataFrame(sorted(summary.items()), "status string, n bigint")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, 'false' AS ok FROM lineitem WHERE l_discount > 0.09 OR l_quantity > 49")
def k17_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "validation")
    cases = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_discount") <= 0.09) & (F.col("l_quantity") <= 49)).alias("ok"))
    sinks.validation_report(cases, path, "ok")
    return spark.read.option("header", True).schema("l_orderkey string, l_linenumber string, ok string").csv(f"{path}/cases")


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def k24_monotone_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored half is merged with the other: first_seen stays unless earlier, last_seen only grows."""
    events = table(spark, sf_dir, "events")
    seen = lambda rows: rows.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    merged = seen(events.where("event_id % 2 = 0")).unionByName(seen(events.where("event_id % 2 = 1")))
    return merged.groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("SELECT user_id, event_type, bool_or(value > 100) AS accepted, bool_or(value < 1) AS duplicate, last(props ORDER BY event_id) FILTER (value > 20) AS outcome FROM events GROUP BY 1, 2")
def k26_result_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags are OR-ed; the outcome is the latest that is known."""
    known = F.when(F.col("value") > 20, F.col("props"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.bool_or(F.col("value") > 100).alias("accepted"), F.bool_or(F.col("value") < 1).alias("duplicate"), F.max_by(known, F.when(F.col("value") > 20, F.col("event_id"))).alias("outcome")
    )


@query("SELECT 'nation' AS name, 25::BIGINT AS added, 0::BIGINT AS again UNION ALL SELECT 'customer', count(*), 0 FROM customer")
def k28_entity_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _path(spark, "entities")
    tables = {"nation": (table(spark, sf_dir, "nation"), ["n_nationkey"]), "customer": (table(spark, sf_dir, "customer"), ["c_custkey"])}
    added, again = sinks.insert_entities(spark, folder, tables), sinks.insert_entities(spark, folder, tables)
    return spark.createDataFrame([(n, added[n], again[n]) for n in tables], "name string, added bigint, again bigint")


@query("SELECT p_brand AS name, count(*) AS uses, true AS new, false AS again FROM part GROUP BY p_brand")
def k29_strategy_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _path(spark, "strategy")
    advice = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("uses"))
    run = advice.agg(F.sum("uses").alias("n")).select(ids.content_hash(F.col("n").cast("string")).alias("fingerprint"), "n")
    new, again = (sinks.persist_result(run, {"recommendations": advice}, folder, "fingerprint") for _ in range(2))
    return spark.read.parquet(f"{folder}/recommendations").withColumns({"new": F.lit(new), "again": F.lit(again)})


@query("SELECT true AS verified, 25::BIGINT AS rows, true AS same")
def k30_verified_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _database(spark, sf_dir)
    verified = sinks.snapshot(spark, path, f"{path}.backup")
    read = lambda p: files.sqlite_table(spark, p, "nation", ["id", "name", "region"])
    differing = sinks.same_rows(read(path), read(f"{path}.backup")).count()
    return read(f"{path}.backup").agg(F.lit(verified).alias("verified"), F.count("*").alias("rows"), F.lit(differing == 0).alias("same"))


@query("SELECT o_orderkey AS decision_id, o_orderstatus AS decision, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS batch FROM orders")
def e8_transactional_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two micro-batches, each delivered twice, the second overlapping the first: a stored decision stays as it was."""
    path, orders = _path(spark, "decisions"), table(spark, sf_dir, "orders")
    decided = lambda rows, n: rows.select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderstatus").alias("decision"), F.lit(n).alias("batch"))
    for rows in (decided(orders.where("o_orderkey % 2 = 0"), 1), decided(orders, 2)):
        for _ in range(2):
            telemetry.append_new(rows, path, ["decision_id"])
    return telemetry.merged(spark, path)
