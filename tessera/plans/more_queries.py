"""Queries: projections by purpose, stage scopes, gates, reports and the remaining scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import rules as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import resolution as E
from ..sources import tables as S
from ..sources.tables import table
from .place_queries import _add
from .registry import query
from .standins import LEADS_CTE, RUNS_CTE, leads, runs
from .storage import shared_dir


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events WHERE event_type = 'signup'")
def p2_payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns, and payload keys as columns; registry columns win a clash of names."""
    keys = ["event_type", "k", "missing"]
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("payload", S.json_map(F.col("props")))
    return rows.select("event_id", "event_type", *[F.try_element_at("payload", F.lit(k)).alias(k) for k in keys if k not in rows.columns])


@query("SELECT o_custkey, o_orderkey, o_orderpriority AS reason FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n = 1")
def p3_qualified_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    purpose = {"status": "o_orderstatus", "reason": "o_orderpriority"}
    rows = table(spark, sf_dir, "orders").where(F.col(purpose["status"]) == "O").select("o_custkey", "o_orderkey", "o_orderdate", F.col(purpose["reason"]).alias("reason"))
    return J.representative(rows, "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "reason")


@query(f"WITH {LEADS_CTE} SELECT row_idx, concat_ws(';', CASE WHEN coalesce(webpage, '') IN ('', 'Not Available') THEN 'website' END, CASE WHEN phone_number = '12-34' THEN 'phone' END, CASE WHEN site_email = '' THEN 'email' END) AS missing, CASE WHEN site_email = '' AND phone_number = '12-34' THEN 'LOW' ELSE 'NORMAL' END AS priority FROM leads")
def p4_review_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = {"website": T.clean(F.col("webpage")) == "", "phone": T.phone_key(F.col("phone_number")) == "", "email": T.clean(F.col("site_email")) == ""}
    missing = F.array_compact(F.array(*[F.when(c, n) for n, c in no.items()]))
    return leads(spark, sf_dir).select("row_idx", F.array_join(missing, ";").alias("missing"), F.when(no["email"] & no["phone"], "LOW").otherwise("NORMAL").alias("priority"))


@query("SELECT n_nationkey, n_name, '' AS city, n_regionkey FROM nation")
def p7_canonical_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_columns(table(spark, sf_dir, "nation"), {"city": "string"}).fillna("").select("n_nationkey", "n_name", "city", "n_regionkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus IN ('O', 'P')")
def p8_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "2-HIGH") & F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@query(f"WITH {RUNS_CTE} SELECT run_id, count(*) AS queries FROM runs GROUP BY run_id HAVING bool_and(rejected_noise IS NOT NULL) ORDER BY run_id DESC LIMIT 10")
def p12_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("queries"), F.bool_and(F.col("rejected_noise").isNotNull()).alias("whole")).where("whole").orderBy(F.desc("run_id")).limit(10).drop("whole")


@query(f"""WITH {LEADS_CTE}, d AS (SELECT row_idx, segment, regexp_extract(coalesce(webpage, ''), 'site[0-9]+\\.test', 0) AS domain FROM leads), f AS (SELECT DISTINCT domain FROM d WHERE domain <> '' AND segment = 'BUILDING')
SELECT row_idx, segment = 'BUILDING' OR domain = '' OR domain IN (SELECT domain FROM f) AS review FROM d""")
def p14_outreach_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is to be reviewed for itself or because its domain was flagged."""
    rows = leads(spark, sf_dir).select("row_idx", "segment", T.domain(F.col("webpage")).alias("domain"))
    flagged = rows.where("domain <> '' and segment = 'BUILDING'").select("domain").distinct().withColumn("flag", F.lit(True))
    joined = rows.join(flagged, "domain", "left")
    return joined.select("row_idx", ((F.col("segment") == "BUILDING") | (F.col("domain") == "") | F.coalesce("flag", F.lit(False))).alias("review"))


_add("p16_job_result_class", "customer", "c_custkey", "result_class", ("https://jobs.lever.co/a/1", "https://www.indeed.com/jobs?q=x", "https://a.test/blog/x", "https://a.test/careers/python-developer"), ("ACCEPT_ATS", "REJECT_AGGREGATOR", "REJECT_ARTICLE", "ACCEPT_CAREERS"), lambda u: F.when(P.provider(u) != "generic", "ACCEPT_ATS").when(P.source_quality(u) == "JOB_PLATFORM", "REJECT_AGGREGATOR").when(F.rlike(u, F.lit("/(blog|news|article)s?/")), "REJECT_ARTICLE").when(F.rlike(u, F.lit("/(careers?|jobs?)/")), "ACCEPT_CAREERS").otherwise("REJECT_UNKNOWN"))
_add("p17_goto_gate", "customer", "c_custkey", "plausible", ("Python developer - apply now", "Cat pictures", "We are hiring an engineer"), (True, False, True), lambda t: R.found(t, r"\b(?:developer|engineer|hiring|apply|careers?|jobs?)\b"))
_add("p19_maps_url", "customer", "c_custkey", "kind", ("https://www.google.com/maps/place/X/@1,2", "https://www.google.com/maps/search/web+agency", "https://x.test"), ("place", "search", "other"), lambda u: F.when(F.rlike(u, F.lit(r"//(www\.)?google\.[a-z.]+/maps/place/")), "place").when(F.rlike(u, F.lit(r"//(www\.)?google\.[a-z.]+/maps/search/")), "search").otherwise("other"))
_add("p23_individual_posting", "customer", "c_custkey", "individual", ("https://jobs.lever.co/acme/12ab", "https://jobs.lever.co/acme", "https://boards.greenhouse.io/acme/jobs/77", "https://acme.test/jobs/77"), (True, False, True, False), lambda u: (P.provider(u) != "generic") & F.rlike(u, F.lit(r"^https?://[^/]+/[^/?#]+/(?:jobs/)?[^/?#]+")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40) AND o_orderstatus = 'O' AND o_custkey % 10 IN (1, 2, 3)")
def p21_stage_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope by run membership and ids, then a status gate."""
    members = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 10).isin(1, 2, 3)).join(members, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, '{"status":"' || CASE WHEN c_acctbal > 0 THEN 'OK' ELSE 'LOW' END || '","sources":[{"kind":"name","value":"' || c_name || '"}]}' AS evidence FROM customer""")
def p22_evidence_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.struct(F.when(F.col("c_acctbal") > 0, "OK").otherwise("LOW").alias("status"), F.array(F.struct(F.lit("name").alias("kind"), F.col("c_name").alias("value"))).alias("sources"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(document).alias("evidence"))


@query("""
WITH n AS (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1 HAVING count(*) = 1), k AS (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0)
SELECT c_custkey, coalesce(k.s_name, n.s_name, '') AS prior FROM customer LEFT JOIN k ON k.s_suppkey = c_custkey LEFT JOIN n ON n.s_nationkey = c_nationkey
""")
def j8_prior_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the strong key, else by the weak key where only one has it."""
    supplier = table(spark, sf_dir, "supplier")
    strong = supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("prior"))
    weak = supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"), F.min("s_name").alias("prior")).where("n = 1").drop("n")
    return J.fill_from(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit("").alias("prior")), "prior", [("c_custkey", strong), ("c_nationkey", weak)]).select("c_custkey", "prior")


@query("SELECT l.doc_id, l.quality, d.lang, d.doc_id IS NOT NULL AS present FROM labels l LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'en') d USING (doc_id)")
def j21_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs.withColumn("here", F.lit(True)), "doc_id", "left").select("doc_id", "quality", "lang", F.coalesce("here", F.lit(False)).alias("present"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def k2_json_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tessera/json-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).write.mode("append").json(path)
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).write.mode("append").json(path)
    return spark.read.schema("key int, name string").json(path)


@query("SELECT n_name AS name, n_regionkey AS region, NULL::BIGINT AS size FROM nation UNION ALL SELECT p_name, NULL, count(*) FROM part GROUP BY p_name")
def k7_union_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_custkey, o_orderkey, coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 'NONE') AS old_state, o_orderstatus AS new_state FROM orders")
def k27_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.coalesce(before, F.lit("NONE")).alias("old_state"), F.col("o_orderstatus").alias("new_state"))


@query(f"""WITH {RUNS_CTE}, t AS (SELECT count(DISTINCT run_id) AS runs, CAST(sum(pages_inspected) AS BIGINT) AS pages, count(*) FILTER (rejected_noise IS NULL) AS unmeasured FROM runs) SELECT '{{"runs":' || runs || ',"pages":' || pages || ',"unmeasured":' || unmeasured || '}}' AS report FROM t""")
def a15_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as one JSON document."""
    totals = runs(spark, sf_dir).agg(F.count_distinct("run_id").alias("runs"), F.sum("pages_inspected").alias("pages"), F.count_if(F.col("rejected_noise").isNull()).alias("unmeasured"))
    return totals.select(F.to_json(F.struct("runs", "pages", "unmeasured")).alias("report"))


@query(f"WITH {LEADS_CTE} SELECT title, place, min(row_idx) AS row_idx FROM leads GROUP BY title, place")
def w13_stable_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).groupBy("title", "place").agg(F.min("row_idx").alias("row_idx")).orderBy("place", "title", "row_idx")




@query()
def e12_identity_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of groups, bridges and conflicts without writing anything."""
    from .lead_queries import _identities

    grouped = E.group_leads(_identities(spark, sf_dir))
    reason = lambda text: F.count_if(F.contains("review_reasons", F.lit(text)))
    return grouped.agg(F.count("*").alias("rows"), F.count_distinct("group_id").alias("groups"), reason("bridge").alias("bridged"), reason("conflicting").alias("conflicting"), reason("ambiguous").alias("ambiguous"))


@query("SELECT user_id, max(sum_value) AS best FROM (SELECT user_id, event_type, CASE WHEN count(value) = count(*) THEN CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) END AS sum_value FROM events GROUP BY 1, 2) GROUP BY user_id")
def a2_nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(A.available_sum(F.floor("value")).alias("s"))
    return inner.groupBy("user_id").agg(F.max("s").alias("best"))
