"""Queries: budgets, ledgers, leases, state machines, retries and reuse, over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import ledgers as L
from ..sources.tables import table
from .registry import query


@query("""
WITH e AS (SELECT user_id AS run, event_id AS seq, event_type = 'purchase' AS commits FROM events),
n AS (SELECT *, coalesce(sum(CASE WHEN commits THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT run, seq, commits, before < 4 AS admitted FROM n
""")
def t1_run_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("commits"))
    return L.accepted_within(attempts, "run", "seq", F.col("commits"), 4)


@query("""
WITH RECURSIVE s AS (SELECT user_id % 40 AS run, event_type AS query, event_id AS seq, value > 20 AS fresh, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n FROM events),
f AS (SELECT run, n, query, seq, fresh, fresh AS admitted, CASE WHEN fresh THEN 1 ELSE 0 END AS used, map([query], [CASE WHEN fresh THEN 1 ELSE 0 END]) AS per FROM s WHERE n = 1
 UNION ALL SELECT s.run, s.n, s.query, s.seq, s.fresh, s.fresh AND f.used < 25 AND coalesce(f.per[s.query], 0) < 6, f.used + CASE WHEN s.fresh AND f.used < 25 AND coalesce(f.per[s.query], 0) < 6 THEN 1 ELSE 0 END,
  map_concat(f.per, map([s.query], [coalesce(f.per[s.query], 0) + CASE WHEN s.fresh AND f.used < 25 AND coalesce(f.per[s.query], 0) < 6 THEN 1 ELSE 0 END])) FROM f JOIN s ON s.run = f.run AND s.n = f.n + 1)
SELECT run, query, seq, CASE WHEN fresh THEN admitted END AS admitted FROM f
""")
def t2_query_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL folds item by item."""
    items = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("run"), F.col("event_type").alias("query"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("fresh"))
    return L.admitted_new(items, "run", "query", "seq", F.col("fresh"), 25, 6).drop("fresh")


_LEDGER = "SELECT user_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS state, ts, event_id FROM events"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "click", "RUNNING").when(kind == "purchase", "SUCCESS").when(kind == "error", "FAILED").otherwise("PENDING")
    return table(spark, sf_dir, "events").select("user_id", state.alias("state"), "ts", "event_id")


@query(f"WITH e AS ({_LEDGER}) SELECT user_id, arg_max(state, event_id) AS state, count(*) FILTER (state = 'RUNNING') AS attempts, min(event_id) FILTER (state = 'RUNNING') AS first_started FROM e GROUP BY user_id")
def t3_query_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_state(_ledger(spark, sf_dir), "user_id", "state", "event_id")


@query(f"""
WITH e AS ({_LEDGER}), l AS (SELECT user_id, arg_max(state, event_id) AS state, count(*) AS next_offset FROM e GROUP BY user_id)
SELECT c_custkey AS user_id, coalesce(state, 'PENDING') AS state, CASE WHEN c_mktsegment <> 'BUILDING' THEN coalesce(next_offset, 0) END AS start_at,
 CASE WHEN c_mktsegment <> 'BUILDING' THEN 'RESUMED' ELSE 'REFUSED' END AS outcome
FROM customer LEFT JOIN l ON l.user_id = c_custkey WHERE coalesce(state, 'PENDING') IN ('PENDING', 'RUNNING', 'FAILED')
""")
def t4_checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir).groupBy("user_id").agg(F.max_by("state", "event_id").alias("state"), F.count("*").alias("next_offset"))
    plan = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") != "BUILDING", "v1").otherwise("v2").alias("config_hash"))
    return L.resumable(plan, ledger, "user_id", ("PENDING", "RUNNING", "FAILED"), "v1")


@query("""
WITH RECURSIVE b AS (SELECT user_id AS run, event_type AS owner, CAST(floor(epoch(ts)) AS BIGINT) AS seq FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq, owner) AS n FROM b),
f AS (SELECT run, n, owner AS holder, seq + 7200 AS until, 1 AS granted, 0 AS refused, 0 AS changes FROM s WHERE n = 1
 UNION ALL SELECT s.run, s.n, CASE WHEN f.holder = s.owner OR f.until <= s.seq THEN s.owner ELSE f.holder END, CASE WHEN f.holder = s.owner OR f.until <= s.seq THEN s.seq + 7200 ELSE f.until END,
  f.granted + CASE WHEN f.holder = s.owner OR f.until <= s.seq THEN 1 ELSE 0 END, f.refused + CASE WHEN f.holder = s.owner OR f.until <= s.seq THEN 0 ELSE 1 END,
  f.changes + CASE WHEN f.holder <> s.owner AND f.until <= s.seq THEN 1 ELSE 0 END FROM f JOIN s ON s.run = f.run AND s.n = f.n + 1)
SELECT run, arg_max(granted, n) AS granted, arg_max(refused, n) AS refused, arg_max(changes, n) AS changes, arg_max(holder, n) AS holder FROM f GROUP BY run
""")
def t5_writer_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL folds beat by beat."""
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("owner"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("seq"))
    return L.leases(beats, "run", "owner", "seq", 7200)


_STATES = "CASE event_type WHEN 'view' THEN 'FINALIZING' WHEN 'click' THEN 'SUCCESS' WHEN 'purchase' THEN 'PARTIAL' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END"


@query(f"""
WITH h AS (SELECT user_id, event_id, {_STATES} AS state, coalesce(lag({_STATES}) OVER (PARTITION BY user_id ORDER BY event_id), 'RUNNING') AS before FROM events),
a(x, y) AS (VALUES ('RUNNING', 'FINALIZING'), ('RUNNING', 'FAILED'), ('RUNNING', 'INTERRUPTED'), ('FINALIZING', 'SUCCESS'), ('FINALIZING', 'PARTIAL'))
SELECT user_id, event_id, state, before, EXISTS (SELECT 1 FROM a WHERE x = before AND y = state) AS valid FROM h
""")
def t6_run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "view", "FINALIZING").when(kind == "click", "SUCCESS").when(kind == "purchase", "PARTIAL").when(kind == "error", "FAILED").otherwise("RUNNING")
    return L.checked_steps(table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state")), "user_id", "state", "event_id", L.RUN_STEPS, "RUNNING")


@query("""
WITH a AS (SELECT o_orderkey AS job, o_custkey AS who, CASE o_orderstatus WHEN 'F' THEN 'APPLIED' WHEN 'P' THEN 'APPLYING' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'READY_TO_APPLY' END END AS state,
 CASE o_orderkey % 4 WHEN 0 THEN 'APPLIED' WHEN 1 THEN 'WITHDRAWN' WHEN 2 THEN 'READY_TO_APPLY' ELSE 'SKIPPED' END AS new_state FROM orders),
ok AS (SELECT *, (state = 'READY_TO_APPLY' AND new_state IN ('APPLIED', 'SKIPPED')) OR (state = 'APPLYING' AND new_state = 'APPLIED') OR (state = 'FAILED' AND new_state = 'READY_TO_APPLY') OR (state = 'APPLIED' AND new_state = 'WITHDRAWN') AS fine FROM a),
o AS (SELECT *, CASE WHEN NOT fine THEN 'INVALID' WHEN new_state = 'APPLIED' AND EXISTS (SELECT 1 FROM a b WHERE b.who = ok.who AND b.job <> ok.job AND b.state IN ('APPLIED', 'APPLYING')) THEN 'DUPLICATE' ELSE 'DONE' END AS outcome FROM ok)
SELECT job, state AS old_state, new_state, outcome, CASE WHEN outcome = 'DONE' THEN new_state ELSE state END AS state FROM o
""")
def t7_application_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "APPLIED").when(F.col("o_orderstatus") == "P", "APPLYING").when(k % 3 == 0, "FAILED").otherwise("READY_TO_APPLY")
    wanted = F.when(k % 4 == 0, "APPLIED").when(k % 4 == 1, "WITHDRAWN").when(k % 4 == 2, "READY_TO_APPLY").otherwise("SKIPPED")
    orders = table(spark, sf_dir, "orders")
    actions = orders.select(k.alias("job"), F.col("o_custkey").alias("who"), state.alias("state"))
    return L.applied_steps(actions, orders.select(k.alias("job"), wanted.alias("new_state")), "job", "who")


@query("""
WITH e AS (SELECT user_id, event_id, value > 60 AS failed FROM events),
w AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS recent, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS last3, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e),
t AS (SELECT *, CASE WHEN recent >= 3 THEN 1 WHEN last3 = 0 AND n >= 3 THEN 0 END AS turn FROM w),
s AS (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS paused FROM t)
SELECT user_id, event_id, failed, CASE WHEN paused = 1 THEN 'PAUSED' WHEN recent > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS relay FROM s
""")
def t8_network_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.col("value") > 60, F.lit(False)).alias("failed"))
    return L.relay_state(checks, "user_id", "event_id", F.col("failed"))


@query("""
WITH r AS (SELECT l_suppkey AS query, CAST(extract(year FROM l_shipdate) AS INT) AS page, l_partkey % 7 AS id FROM lineitem), p AS (SELECT DISTINCT query, page FROM r),
n AS (SELECT p.query, p.page, (SELECT count(DISTINCT id) FROM r WHERE r.query = p.query AND r.page = p.page AND NOT EXISTS (SELECT 1 FROM r q WHERE q.query = r.query AND q.id = r.id AND q.page < r.page)) AS n_new FROM p)
SELECT query, page, n_new, coalesce(page <= min(CASE WHEN n_new = 0 THEN page END) OVER (PARTITION BY query), true) AS inspected FROM n
""")
def t9_page_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query"), F.year("l_shipdate").alias("page"), (F.col("l_partkey") % 7).alias("id"))
    return L.inspected_pages(results, "query", "page", "id")


@query("""
WITH s AS (SELECT user_id % 30 AS run, CAST(floor(value) AS BIGINT) AS id, event_type AS query, event_id AS seq FROM events)
SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'NEW' ELSE 'KNOWN' END AS membership, first_value(query) OVER w AS primary_query FROM s WINDOW w AS (PARTITION BY run, id ORDER BY seq, query)
""")
def t10_run_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("run"), F.floor("value").alias("id"), F.col("event_type").alias("query"), F.col("event_id").alias("seq"))
    return L.membership(sightings, "run", "id", "query", "seq")


@query("""
WITH e AS (SELECT user_id AS run, event_id % 9 AS i, CASE WHEN event_type IN ('click', 'purchase') THEN 'COMPLETED' ELSE 'SCHEDULED' END AS kind, CASE WHEN event_type = 'error' AND value > 50 THEN 'ERROR' WHEN event_type = 'error' THEN 'NETWORK_FAILURE' WHEN value > 200 THEN 'GLOBAL_LIMIT_REACHED' END AS reason FROM events),
g AS (SELECT run, arg_max(reason, CASE reason WHEN 'ERROR' THEN 6 WHEN 'NETWORK_FAILURE' THEN 3 WHEN 'GLOBAL_LIMIT_REACHED' THEN 2 END) AS noted, coalesce(list_sort(list(DISTINCT i) FILTER (kind = 'SCHEDULED')), []) AS s, coalesce(list_sort(list(DISTINCT i) FILTER (kind = 'COMPLETED')), []) AS c FROM e GROUP BY run)
SELECT run, coalesce(noted, CASE WHEN len([x FOR x IN s IF NOT list_contains(c, x)]) = 0 THEN 'NORMAL_COMPLETION' ELSE 'ERROR' END) AS termination, array_to_string(s, ',') AS scheduled, array_to_string(c, ',') AS completed FROM g
""")
def t11_run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    reason = F.when((kind == "error") & (value > 50), "ERROR").when(kind == "error", "NETWORK_FAILURE").when(value > 200, "GLOBAL_LIMIT_REACHED")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 9).alias("i"), F.when(kind.isin("click", "purchase"), "COMPLETED").otherwise("SCHEDULED").alias("kind"), reason.alias("reason"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return L.run_fold(events, "run", "i", "kind", "reason").select("run", "termination", joined("scheduled"), joined("completed"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'FAILED' WHEN c_mktsegment = 'MACHINERY' THEN 'PENDING' ELSE 'DONE' END AS state, CAST(c_nationkey % 5 AS INT) AS attempts FROM customer WHERE (c_acctbal < 0 OR c_mktsegment = 'MACHINERY') AND c_nationkey % 5 < 3")
def t12_retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("c_acctbal") < 0, "FAILED").when(F.col("c_mktsegment") == "MACHINERY", "PENDING").otherwise("DONE")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), state.alias("state"), (F.col("c_nationkey") % 5).cast("int").alias("attempts"))
    return L.retry_queue(rows, "id", "state", "attempts", retry_failed=True)


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'stored' ELSE p_brand END AS result, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS reused FROM part
""")
def t13_fingerprint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored for every second part, of which every third still has its fingerprint."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("v1").alias("policy"), ids.content_hash(F.concat_ws("|", "p_brand", "p_type")).alias("hash"), "p_brand")
    stored = part.where("id % 2 = 0").select("id", "policy", F.when(F.col("id") % 3 == 0, F.col("hash")).otherwise("old").alias("hash"), F.lit("stored").alias("result"))
    return L.recomputed(part, stored, ["id", "policy"], "hash", lambda rows: rows.withColumn("result", F.col("p_brand"))).select("id", "result", "reused")
