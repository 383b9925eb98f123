"""Queries: aggregates, joins, windows and sets over telemetry and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..sources.tables import table
from .registry import query
from .standins import RUNS_CTE, runs

METRICS = ["pages_inspected", "results_inspected", "new_jobs", "rejected_noise", "resolution_failures", "job_candidates", "duration_seconds", "shortlisted_jobs"]
_SUMS = ", ".join(f"CASE WHEN count({m}) = count(*) THEN CAST(sum({m}) AS BIGINT) END AS {m}" for m in METRICS)
_PERF = f"perf AS (SELECT source_query, count(DISTINCT run_id) AS runs_seen, {_SUMS} FROM runs GROUP BY source_query)"


@query(f"WITH {RUNS_CTE}, {_PERF} SELECT source_query, runs_seen, {', '.join(METRICS)} FROM perf")
def a1_null_poisoned_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.query_performance(runs(spark, sf_dir), METRICS)


@query(f"WITH {RUNS_CTE}, {_PERF} SELECT p.*, c.query_category FROM perf p JOIN (SELECT source_query, arg_min(query_category, run_id) AS query_category FROM runs WHERE query_category IS NOT NULL GROUP BY 1) c USING (source_query)")
def a2_query_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.query_performance(runs(spark, sf_dir), METRICS, category="query_category", order="run_id")


@query("""
WITH exp AS (SELECT o_orderpriority AS k, count(*) FILTER (o_orderkey % 3 <> 0) + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS expected FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority AS k, count(*) AS n, count(CASE WHEN o_orderkey % 3 <> 0 AND NOT (o_orderpriority = '2-HIGH' AND o_orderkey % 1000 = 1) THEN o_orderstatus END) AS decided,
  count(*) FILTER (o_orderstatus = 'O' AND NOT (o_orderpriority = '2-HIGH' AND o_orderkey % 1000 = 1)) AS pass_jobs, count(*) FILTER (o_orderstatus = 'P' AND NOT (o_orderpriority = '2-HIGH' AND o_orderkey % 1000 = 1)) AS review_jobs FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT k, expected, CASE WHEN expected = 0 THEN 0 WHEN n = expected AND decided = n THEN pass_jobs END AS pass_jobs, CASE WHEN expected = 0 THEN 0 WHEN n = expected AND decided = n THEN review_jobs END AS review_jobs FROM exp LEFT JOIN c USING (k)
""")
def a3_gated_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderpriority"))
    undecided = (F.col("k") == "2-HIGH") & (F.col("o_orderkey") % 1000 == 1)
    primary = orders.where("o_orderkey % 3 <> 0").withColumn("status", F.when(~undecided, F.col("o_orderstatus")))
    expected = orders.groupBy("k").agg((F.count_if(F.col("o_orderkey") % 3 != 0) + F.when(F.col("k") == "1-URGENT", 1).otherwise(0)).alias("expected"))
    return A.gated_outcomes(primary, expected, "k", "status", {"pass_jobs": "O", "review_jobs": "P"})


@query(f"""WITH {RUNS_CTE}, {_PERF}, cat AS (SELECT CASE WHEN source_query IN ('click', 'view') THEN 'BROWSE' ELSE 'ACT' END AS category, * FROM perf)
SELECT category, CAST(sum(runs_seen) AS BIGINT) AS runs_seen, {_SUMS} FROM cat GROUP BY category""")
def a4_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    perf = A.query_performance(runs(spark, sf_dir), METRICS).withColumn("category", F.when(F.col("source_query").isin("click", "view"), "BROWSE").otherwise("ACT"))
    return perf.groupBy("category").agg(F.sum("runs_seen").alias("runs_seen"), *[A.available_sum(m).alias(m) for m in METRICS])


@query("""
SELECT 'brand' AS axis, p_brand AS value, count(*) AS n, max(p_size) AS largest FROM part GROUP BY p_brand
UNION ALL SELECT 'type', p_type, count(*), max(p_size) FROM part GROUP BY p_type
UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*), max(p_size) FROM part GROUP BY p_size
""")
def a5_multi_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return A.multi_axis(part, ["brand", "type", "size"], [F.count("*").alias("n"), F.max("size").alias("largest")])


@query("""
SELECT 'all' AS population, count(*) AS records, count(*) FILTER (o_totalprice > 100000) AS available, count(DISTINCT o_custkey) AS companies FROM orders
UNION ALL SELECT 'open', count(*), count(*) FILTER (o_totalprice > 100000), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'urgent', count(*), count(*) FILTER (o_totalprice > 100000), count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def a6_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    populations = F.array_compact(F.array(F.lit("all"), F.when(F.col("o_orderstatus") == "O", "open"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent")))
    return table(spark, sf_dir, "orders").withColumn("population", F.explode(populations)).groupBy("population").agg(F.count("*").alias("records"), F.count_if(F.col("o_totalprice") > 100000).alias("available"), F.count_distinct("o_custkey").alias("companies"))


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'F' ) AS "F" FROM orders GROUP BY o_custkey
""")
def a7_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["O", "P", "F"]).count().fillna(0)


@query(f"""WITH {RUNS_CTE}, g AS (SELECT run_id, count(*) AS queries, count(rejected_noise) AS measured, CAST(sum(rejected_noise) AS BIGINT) AS noise FROM runs GROUP BY run_id)
SELECT run_id, queries, CASE WHEN measured = queries THEN noise END AS rejected_noise, CASE WHEN measured = queries THEN 'available' WHEN measured = 0 THEN 'not_measured' ELSE 'mixed' END AS availability FROM g""")
def a8_telemetry_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = runs(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("queries"), F.count("rejected_noise").alias("measured"), A.available_sum("rejected_noise").alias("rejected_noise"))
    state = F.when(F.col("measured") == F.col("queries"), "available").when(F.col("measured") == 0, "not_measured").otherwise("mixed")
    return measured.select("run_id", "queries", "rejected_noise", state.alias("availability"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS large, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even_users FROM events GROUP BY event_type")
def a9_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("large"), F.sum((F.col("user_id") % 2 == 0).cast("bigint")).alias("even_users"))


@query("SELECT count(*) AS parts_with_many_suppliers FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 20)")
def a10_having_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n > 20")
    return many.agg(F.count("*").alias("parts_with_many_suppliers"))


@query("""
SELECT quality AS old_class, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS new_class, count(*) AS n, CAST(sum(CASE WHEN quality = (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END) AS BIGINT) AS agreeing
FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2
""")
def a11_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("old_class"), (F.col("n_chars") > 1000).cast("int").alias("new_class"))
    return judged.groupBy("old_class", "new_class").agg(F.count("*").alias("n"), F.sum((F.col("old_class") == F.col("new_class")).cast("bigint")).alias("agreeing"))


@query("""
SELECT cause, coalesce(n, 0) AS n, coalesce(customers, 0) AS customers FROM (VALUES ('1-URGENT'), ('3-MEDIUM'), ('9-NEVER')) c(cause)
LEFT JOIN (SELECT o_orderpriority AS cause, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1) USING (cause)
""")
def a12_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    causes = spark.range(1).select(F.explode(F.array(F.lit("1-URGENT"), F.lit("3-MEDIUM"), F.lit("9-NEVER"))).alias("cause"))
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("cause")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return causes.join(found, "cause", "left").fillna(0)


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS committed, 10000 - count(*) FILTER (o_orderstatus = 'O') AS remaining, count(*) FILTER (o_orderstatus = 'O') >= 10000 AS exhausted FROM orders")
def a13_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("committed"))
    return spent.select("committed", (F.lit(10000) - F.col("committed")).alias("remaining"), (F.col("committed") >= 10000).alias("exhausted"))


@query("""
SELECT o_orderstatus, o_orderpriority, n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, min(o_orderkey)) AS k FROM orders GROUP BY 1, 2) WHERE k <= 3
""")
def a14_top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("n"), "first")))
    return ranked.where("k <= 3").select("o_orderstatus", "o_orderpriority", "n")


@query(f"WITH {RUNS_CTE}, {_PERF} SELECT source_query, CAST(job_candidates AS DOUBLE) / nullif(results_inspected, 0) AS candidate_yield, CAST(rejected_noise AS DOUBLE) / nullif(results_inspected, 0) AS noise_rate, CAST(results_inspected AS DOUBLE) / nullif(new_jobs, 0) AS results_per_new_job FROM perf")
def a16_safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    perf = A.query_performance(runs(spark, sf_dir), METRICS)
    return perf.select("source_query", A.ratio("job_candidates", "results_inspected").alias("candidate_yield"), A.ratio("rejected_noise", "results_inspected").alias("noise_rate"), A.ratio("results_inspected", "new_jobs").alias("results_per_new_job"))


@query("""
WITH f AS (SELECT p_brand, lower(p_name) AS k, min(p_partkey) AS first FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part) GROUP BY 1, 2)
SELECT f.p_brand, string_agg(CASE WHEN f.first % 2 = 0 THEN upper(p.p_name) ELSE p.p_name END, ';' ORDER BY f.first) AS names FROM f JOIN part p ON p.p_partkey = f.first GROUP BY f.p_brand
""")
def a17_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("name", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    once = part.groupBy("p_brand", F.lower("name").alias("k")).agg(F.min_by("name", "p_partkey").alias("name"), F.min("p_partkey").alias("first"))
    return once.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ";").alias("names"))


@query("""
SELECT user_id, arg_min(text, ts) AS earliest FROM (SELECT user_id, ts, CAST(event_id AS VARCHAR) || '@' || CAST(ts AS VARCHAR) AS text FROM events WHERE event_type <> 'error') GROUP BY user_id
""")
def a18_earliest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return events.groupBy("user_id").agg(F.min_by(F.concat(F.col("event_id").cast("string"), F.lit("@"), F.col("ts").cast("string")), "ts").alias("earliest"))


@query("""
SELECT o_custkey, arg_min(o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END * 1000000000 + o_orderkey) AS primary_priority, count(DISTINCT o_orderpriority) > 3 AS conflicting,
  CASE WHEN count(*) FILTER (o_totalprice > 400000) > 0 THEN 'REVIEW' ELSE 'READY' END AS status FROM orders GROUP BY o_custkey
""")
def a19_group_finalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.struct(F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("r"), F.col("o_orderkey").alias("k"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderpriority", rank).alias("primary_priority"),
        (F.count_distinct("o_orderpriority") > 3).alias("conflicting"),
        F.when(F.count_if(F.col("o_totalprice") > 400000) > 0, "REVIEW").otherwise("READY").alias("status"),
    )


@query("SELECT count(*) AS total, count(*) - count(DISTINCT text) AS merged_duplicates, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (lang = 'en') AS english FROM documents")
def a20_dataset_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.col("text"), 256).alias("text"), "n_chars", "lang")
    return docs.agg(F.count("*").alias("total"), (F.count("*") - F.count_distinct("text")).alias("merged_duplicates"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("lang") == "en").alias("english"))


@query("""
WITH t AS (SELECT * FROM (VALUES ('Brand#1'), ('Brand#2'), ('Brand#99')) x(target)), q AS (SELECT p_brand, p_type, count(*) AS runs, sum(p_size) AS yield FROM part GROUP BY 1, 2)
SELECT target, CASE WHEN count(p_type) = 0 THEN 'UNTESTED' WHEN bool_and(runs < 2) THEN 'REDUNDANT' WHEN bool_or(runs >= 2 AND yield > 0) THEN 'COVERED' ELSE 'WEAK_COVERAGE' END AS status, count(p_type) AS queries FROM t LEFT JOIN q ON p_brand = target GROUP BY target
""")
def a21_coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.range(1).select(F.explode(F.array(*map(F.lit, ("Brand#1", "Brand#2", "Brand#99")))).alias("target"))
    queries = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("runs"), F.sum("p_size").alias("yield"))
    status = F.when(F.count("p_type") == 0, "UNTESTED").when(F.bool_and(F.col("runs") < 2), "REDUNDANT").when(F.bool_or((F.col("runs") >= 2) & (F.col("yield") > 0)), "COVERED").otherwise("WEAK_COVERAGE")
    return targets.join(queries, F.col("p_brand") == F.col("target"), "left").groupBy("target").agg(status.alias("status"), F.count("p_type").alias("queries"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "events", "documents")))
def a22_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("customer", "orders", "lineitem", "events", "documents"):
        one = table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT c_custkey, CASE WHEN least(a, b, c) = 0 THEN 'ACCEPT' WHEN least(a, b, c) = 1 THEN 'REVIEW' ELSE 'REJECT' END AS best FROM (
SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 0 ELSE 2 END AS a, CASE WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 2 END AS c FROM customer)
""")
def a23_best_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lambda test, good, status: F.struct(F.when(test, good).otherwise(2).alias("rank"), F.when(test, status).otherwise("REJECT").alias("status"))
    fields = F.array(ranked(F.col("c_acctbal") > 9000, 0, "ACCEPT"), ranked(F.col("c_nationkey") < 12, 1, "REVIEW"), ranked(F.col("c_mktsegment") == "BUILDING", 0, "ACCEPT"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_min(fields)["status"].alias("best"))


#: words that speak for a segment, with weights
KEYWORDS = {"METAL": {"bolt": 3, "ring": 2, "gear": 2}, "GADGET": {"widget": 3, "small": 1}, "COLOUR": {"red": 2, "blue": 2, "green": 2}}
_SCORES = ", ".join("(" + " + ".join(f"CASE WHEN contains(p_name, '{w}') THEN {n} ELSE 0 END" for w, n in words.items()) + f") AS {k.lower()}" for k, words in KEYWORDS.items())


@query(f"SELECT p_partkey, metal, gadget, colour, CASE WHEN greatest(metal, gadget, colour) = 0 THEN 'UNKNOWN' WHEN metal >= greatest(gadget, colour) THEN 'METAL' WHEN gadget >= colour THEN 'GADGET' ELSE 'COLOUR' END AS segment FROM (SELECT p_partkey, {_SCORES} FROM part)")
def a24_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", *[sum((F.when(F.contains(F.col("p_name"), F.lit(w)), n).otherwise(0) for w, n in words.items()), F.lit(0)).alias(k.lower()) for k, words in KEYWORDS.items()])
    best = F.greatest("metal", "gadget", "colour")
    return part.withColumn("segment", F.when(best == 0, "UNKNOWN").when(F.col("metal") == best, "METAL").when(F.col("gadget") == best, "GADGET").otherwise("COLOUR"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, CAST(sum(DISTINCT l_partkey) AS BIGINT) AS key_sum FROM lineitem GROUP BY l_suppkey")
def a25_job_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return sets.groupBy("l_suppkey").agg(F.count("*").alias("n_parts"), F.sum("l_partkey").alias("key_sum"))


_R3 = """CASE WHEN runs_seen >= 2 AND coalesce(results_inspected >= 20, false) AND coalesce(new_jobs = 0, false) AND (coalesce(noise >= 0.8, false) OR coalesce(fail >= 0.5, false)) THEN 'DROP'
 WHEN runs_seen >= 2 AND coalesce(results_inspected >= 10, false) AND coalesce(new_jobs >= 2, false) AND coalesce(shortlisted_jobs > 0, false) AND coalesce(noise < 0.8 AND fail < 0.5, false) AND coalesce(cy >= 0.05, false) THEN 'KEEP' ELSE 'REVIEW' END"""


@query(f"""WITH {RUNS_CTE}, p AS (SELECT *, CAST(job_candidates AS DOUBLE) / nullif(pages_inspected, 0) AS cy, CAST(rejected_noise AS DOUBLE) / nullif(pages_inspected, 0) AS noise, CAST(resolution_failures AS DOUBLE) / nullif(pages_inspected, 0) AS fail, CAST(duration_seconds AS DOUBLE) / nullif(new_jobs, 0) AS spn
FROM (SELECT source_query, CAST(substr(run_id, 9, 2) AS INT) % 10 AS tenth, count(DISTINCT run_id) AS runs_seen, {_SUMS} FROM runs GROUP BY 1, 2)), q AS (SELECT * REPLACE (pages_inspected AS results_inspected) FROM p)
SELECT source_query, tenth, {_R3} AS recommendation, concat_ws(',', CASE WHEN cy >= 0.05 THEN 'QUERY_GOOD_JOB_YIELD' END, CASE WHEN shortlisted_jobs > 0 THEN 'QUERY_SHORTLIST_YIELD' END, CASE WHEN noise >= 0.8 THEN 'QUERY_HIGH_NOISE' END, CASE WHEN fail >= 0.5 THEN 'QUERY_HIGH_RESOLUTION_FAILURE' END,
 CASE WHEN spn >= 120 THEN 'QUERY_EXPENSIVE' END, CASE WHEN new_jobs = 0 THEN 'QUERY_NO_USEFUL_OUTCOMES' END, CASE WHEN NOT (runs_seen >= 2 AND coalesce(results_inspected >= 20, false)) AND NOT (runs_seen >= 2 AND coalesce(results_inspected >= 10, false) AND coalesce(new_jobs >= 2, false)) THEN 'QUERY_INSUFFICIENT_SAMPLE' END) AS reasons FROM q""")
def r3_query_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("tenth", F.substring("run_id", 9, 2).cast("int") % 10)
    perf = rows.groupBy("source_query", "tenth").agg(F.count_distinct("run_id").alias("runs_seen"), *[A.available_sum(m).alias(m) for m in METRICS])
    judged = A.recommend_query(perf.withColumns({"results_inspected": F.col("pages_inspected"), "pass_jobs": F.lit(None).cast("bigint"), "high_reviews": F.lit(None).cast("bigint")}))
    return judged.select("source_query", "tenth", "recommendation", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {RUNS_CTE}, p AS (SELECT * REPLACE (pages_inspected AS results_inspected) FROM (SELECT source_query, CAST(substr(run_id, 9, 2) AS INT) % 10 AS tenth, count(DISTINCT run_id) AS runs_seen, {_SUMS} FROM runs GROUP BY 1, 2)),
m AS (SELECT *, CASE WHEN runs_seen < 2 OR coalesce(results_inspected < 10, true) THEN 'INSUFFICIENT' WHEN runs_seen >= 3 AND results_inspected >= 30 AND new_jobs IS NOT NULL AND rejected_noise IS NOT NULL AND resolution_failures IS NOT NULL THEN 'MATURE' ELSE 'EARLY' END AS maturity,
 CAST(new_jobs AS DOUBLE) / nullif(results_inspected, 0) AS ny, CAST(rejected_noise AS DOUBLE) / nullif(results_inspected, 0) AS noise, CAST(resolution_failures AS DOUBLE) / nullif(results_inspected, 0) AS fail FROM p)
SELECT source_query, tenth, maturity, CASE WHEN maturity = 'INSUFFICIENT' OR ny IS NULL OR noise IS NULL OR fail IS NULL THEN 'REVIEW'
 WHEN maturity = 'MATURE' AND ny <= 0.01 AND (noise >= 0.8 OR fail >= 0.5 OR shortlisted_jobs = 0) THEN 'RETIRE_CANDIDATE'
 WHEN new_jobs >= 2 AND ny >= 0.08 AND noise < 0.8 AND fail < 0.5 AND shortlisted_jobs > 0 THEN 'EXPAND' WHEN new_jobs >= 1 AND ny >= 0.03 AND noise < 0.8 AND fail < 0.5 THEN 'KEEP' ELSE 'REVIEW' END AS recommendation FROM m""")
def r4_strategy_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("tenth", F.substring("run_id", 9, 2).cast("int") % 10)
    perf = rows.groupBy("source_query", "tenth").agg(F.count_distinct("run_id").alias("runs_seen"), *[A.available_sum(m).alias(m) for m in METRICS])
    return A.recommend_strategy(perf.withColumn("results_inspected", F.col("pages_inspected"))).select("source_query", "tenth", "maturity", "recommendation")


@query("SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 300000")
def j1_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.where("o_totalprice > 300000").join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "o_totalprice", "c_name", "n_name")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def j2_left_join_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    return table(spark, sf_dir, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 2 WHEN 'A' THEN 3 ELSE 1 END, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1
""")
def j3a_representative_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 3).otherwise(1)
    order = F.struct(flag.alias("a"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("b"), "l_linenumber", "l_partkey", "l_suppkey")
    return J.representative(items, "l_orderkey", order).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def j3b_representative_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.representative(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", F.col("o_orderkey"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P') WHERE k = 1")
def j4_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return J.latest(rows, "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def j5_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def j6_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
WITH b AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS kind FROM part),
u AS (SELECT p_name, min(kind) AS kind FROM b WHERE kind <> '' AND p_partkey % 9 = 1 GROUP BY 1 HAVING count(DISTINCT kind) = 1), v AS (SELECT p_brand, min(kind) AS kind FROM b WHERE kind <> '' AND p_partkey % 200 = 1 GROUP BY 1 HAVING count(DISTINCT kind) = 1)
SELECT p_partkey, coalesce(nullif(b.kind, ''), u.kind, v.kind, '') AS kind FROM b LEFT JOIN u USING (p_name) LEFT JOIN v USING (p_brand)
""")
def j7_unambiguous_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")).alias("kind"))
    lookups = [("p_name", J.unambiguous(base.where("p_partkey % 9 = 1"), "p_name", "kind")), ("p_brand", J.unambiguous(base.where("p_partkey % 200 = 1"), "p_brand", "kind"))]
    return J.fill_from(base, "kind", lookups).select("p_partkey", "kind")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m FROM lineitem), n AS (SELECT g, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.g AS a, b.g AS b, count(*) AS overlap FROM s a JOIN s b ON a.m = b.m AND a.g < b.g GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, overlap, CAST(overlap AS DOUBLE) / (x.n + y.n - overlap) AS rate FROM o JOIN n x ON x.g = a JOIN n y ON y.g = b WHERE CAST(overlap AS DOUBLE) / (x.n + y.n - overlap) >= 0.4
""")
def j11_pairwise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("m"))
    return J.overlaps(members, "g", "m", 2, 0.4)


@query("""
WITH h AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.o_custkey = c_custkey AND o_totalprice > 400000) THEN 0 WHEN EXISTS (SELECT 1 FROM h WHERE h.o_custkey = c_custkey) THEN 1 WHEN EXISTS (SELECT 1 FROM h WHERE h.o_orderkey = c_custkey) THEN 2 END AS guard FROM customer
""")
def j12_history_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    hits = history.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_totalprice") > 400000, 0).otherwise(1).alias("guard")).unionByName(history.select(F.col("o_orderkey").alias("c_custkey"), F.lit(2).alias("guard")))
    return table(spark, sf_dir, "customer").select("c_custkey").join(hits.groupBy("c_custkey").agg(F.min("guard").alias("guard")), "c_custkey", "left")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j13_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    blocked = table(spark, sf_dir, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    areas = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return customer.join(blocked, "c_custkey", "left_anti").join(areas, "c_nationkey", "left_anti").select("c_custkey")


@query("""
WITH h AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS k1, CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey END AS k2, s_name FROM supplier)
SELECT c_custkey, coalesce((SELECT min(s_name) FROM h WHERE k1 = c_custkey), (SELECT min(s_name) FROM h WHERE k2 = c_nationkey)) AS matched_s_name FROM customer
""")
def j14_history_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 1, F.col("s_nationkey")).alias("c_nationkey"), "s_name")
    return J.either_key(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), right, "c_custkey", "c_nationkey", "s_name").select("c_custkey", "matched_s_name")


@query("SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)")
def j15_using_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'signup')")
def j16_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "signup")).select("event_id", "event_type")


@query("""
WITH k AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), m AS (SELECT s_suppkey, c_nationkey AS g, s_name FROM supplier JOIN k ON c_custkey = s_suppkey UNION SELECT s_suppkey, s_nationkey, s_name FROM supplier)
SELECT g, min(s_name) AS carried FROM m WHERE s_suppkey IN (SELECT s_suppkey FROM m GROUP BY s_suppkey HAVING count(DISTINCT g) = 1) GROUP BY g
""")
def j18_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    one = supplier.join(customer, F.col("c_custkey") == F.col("s_suppkey")).select("s_suppkey", F.col("c_nationkey").alias("g"), "s_name")
    matches = one.unionByName(supplier.select("s_suppkey", F.col("s_nationkey").alias("g"), "s_name")).distinct()
    single = matches.groupBy("s_suppkey").agg(F.count_distinct("g").alias("n")).where("n = 1")
    return matches.join(single, "s_suppkey", "left_semi").groupBy("g").agg(F.min("s_name").alias("carried"))


@query("""
WITH a AS (SELECT o_orderkey AS id, o_custkey || '/' || CAST(floor(o_totalprice / 100000) AS BIGINT) AS url, o_orderpriority AS provider, CAST(floor(o_totalprice) AS BIGINT) % 20000 AS code, o_orderstatus AS s FROM orders),
p AS (SELECT a.id, b.s FROM a JOIN a b ON a.url = b.url AND b.id <> a.id WHERE a.s <> b.s UNION ALL SELECT a.id, b.s FROM a JOIN a b ON a.provider = b.provider AND a.code = b.code AND b.id <> a.id WHERE a.s <> b.s)
SELECT id, max(CASE WHEN s = 'F' THEN 2 ELSE 1 END) AS severity FROM p GROUP BY id
""")
def j20_duplicate_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another application with the same address, or with the same provider and code, in another state: two equi-joins with the states of each key, no pairs."""
    orders = table(spark, sf_dir, "orders")
    url = F.concat_ws("/", F.col("o_custkey").cast("string"), F.floor(F.col("o_totalprice") / 100000).cast("string"))
    rows = orders.select(F.col("o_orderkey").alias("id"), url.alias("url"), F.col("o_orderpriority").alias("provider"), (F.floor("o_totalprice") % 20000).alias("code"), F.col("o_orderstatus").alias("s"))
    return J.duplicate_severity(rows, "id", "s", [["url"], ["provider", "code"]], "F")


@query("""
SELECT o_custkey, string_agg(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, ';' ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS finished, string_agg(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, ';' ORDER BY CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS open FROM orders GROUP BY o_custkey
""")
def j22_identity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    gather = lambda s: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))), ";"), F.lit(""))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(gather("F").alias("finished"), gather("O").alias("open"))


@query("""
SELECT o_orderkey, c_name, l_partkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS l_partkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'
""")
def j23_decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = J.representative(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", F.struct("l_linenumber", "l_partkey"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "c_name", "l_partkey")


@query("SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j24_child_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(children, "o_orderkey", "left")


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k = 1")
def w1_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.representative(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size"), "p_brand", F.struct((-F.col("p_size")).alias("s"), "p_partkey")).select("p_brand", "p_partkey", "p_name")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w2_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("SELECT p_name, best, CAST(row_number() OVER (ORDER BY best DESC, p_name) AS INT) AS proposal_rank FROM (SELECT p_name, max(p_size) AS best FROM part GROUP BY p_name) ORDER BY best DESC, p_name LIMIT 20")
def w3_ranked_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "part").groupBy("p_name").agg(F.max("p_size").alias("best")).orderBy(F.desc("best"), "p_name").limit(20)
    return top.withColumn("proposal_rank", F.row_number().over(Window.orderBy(F.desc("best"), "p_name")))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def w4_priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query(f"WITH {RUNS_CTE} SELECT run_id, source_query, rejected_noise FROM runs ORDER BY coalesce(rejected_noise, -1) DESC, run_id, source_query LIMIT 25")
def w5_report_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).orderBy(F.coalesce("rejected_noise", F.lit(-1)).desc(), "run_id", "source_query").limit(25).select("run_id", "source_query", "rejected_noise")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def w6_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")))
    return ranked.where("k <= 3").select("event_type", "event_id")


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, lower(c_name), c_custkey LIMIT 40")
def w7_ordinal_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return table(spark, sf_dir, "customer").orderBy(rank, F.lower("c_name"), "c_custkey").limit(40).select("c_custkey", "c_mktsegment")


@query(f"WITH {RUNS_CTE} SELECT DISTINCT run_id FROM runs ORDER BY run_id DESC LIMIT 5")
def w8_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id").distinct().orderBy(F.desc("run_id")).limit(5)


@query("SELECT user_id, event_id FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events) WHERE seen < 3")
def w9_bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").withColumn("seen", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w)).where("seen < 3").select("user_id", "event_id")


@query("""
WITH r AS (SELECT l_orderkey, l_suppkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_tax) AS k FROM lineitem)
SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'CONFLICT' ELSE 'CONFIRMED' END AS status, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS l_suppkey FROM r WHERE k = 1 GROUP BY l_orderkey
""")
def w10_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("rank", F.struct((-F.col("l_discount")).alias("d"), "l_tax"))
    ties = items.groupBy("l_orderkey", "rank").agg(F.count_distinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("l_suppkey"))
    best = J.representative(ties, "l_orderkey", F.col("rank"))
    return best.select("l_orderkey", F.when(F.col("n") > 1, "CONFLICT").otherwise("CONFIRMED").alias("status"), F.when(F.col("n") == 1, F.col("l_suppkey")).alias("l_suppkey"))


@query("SELECT o_custkey, o_orderkey, CASE k WHEN 1 THEN 'PRIMARY' WHEN 2 THEN 'BACKUP' ELSE 'OTHER' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders)")
def w11_contact_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("k", k).select("o_custkey", "o_orderkey", F.when(F.col("k") == 1, "PRIMARY").when(F.col("k") == 2, "BACKUP").otherwise("OTHER").alias("role"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 100")
def w12_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the same 100 rows for a seed, whatever the partitions."""
    return table(spark, sf_dir, "customer").orderBy(F.md5(F.concat(F.lit("42|"), F.col("c_custkey").cast("string"))), "c_custkey").limit(100).select("c_custkey", "c_name")


@query("SELECT n_name AS name, 0 AS source_rank, n_regionkey AS extra FROM nation UNION ALL SELECT r_name, 1, NULL FROM region")
def u1_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import ordered_union

    return ordered_union(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("extra")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))).select("name", "source_rank", "extra")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
""")
def u2_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sides = orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b")).where("a or b")
    part = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "left").otherwise("right")
    parts = spark.range(1).select(F.explode(F.array(F.lit("both"), F.lit("left"), F.lit("right"))).alias("part"))
    return parts.join(sides.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "part", "left").fillna(0)


@query("""
SELECT a.o_custkey, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) > 0 AND count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) > 0 AND max(CASE WHEN o_orderstatus = 'O' AND o_orderpriority IN (SELECT b.o_orderpriority FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'F') THEN 1 ELSE 0 END) = 0 AS disjoint_sets FROM orders a GROUP BY a.o_custkey
""")
def u3_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("b"))
    return sets.select("o_custkey", ((F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b")).alias("disjoint_sets"))


@query("SELECT n_name AS name, 'left' AS side FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'right' FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 10 = 1")
def u4_projection_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import same_rows

    nation = table(spark, sf_dir, "nation")
    a = nation.where("n_regionkey <> 2 and n_nationkey % 10 <> 1 or n_regionkey = 2")
    b = nation.where("n_regionkey <> 2 or n_nationkey % 2 <> 0")
    return same_rows(a.select(F.col("n_name").alias("name")), b.select(F.col("n_name").alias("name")))
