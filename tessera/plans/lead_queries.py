"""Queries: sources, sinks, projections, scalar functions and entity resolution over leads, pages and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import joins as J
from ..operators import resolution as R
from ..sources import sinks
from ..sources import tables as S
from ..sources.tables import table
from .registry import query
from .standins import LEADS_CTE, leads
from .storage import shared_dir

NAMESPACE = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
_CLEAN = lambda c: f"(CASE WHEN lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))) IN ('', 'not available', 'n/a', 'none', 'null') THEN '' ELSE trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')) END)"
_HOST = "regexp_replace(regexp_extract(lower({0}), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')"


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def s1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "csv")
    nation = table(spark, sf_dir, "nation")
    sinks.text_csv(nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("n_name"), "n_regionkey"), path)
    return S.text_csv(spark, path, ["n_nationkey", "n_name", "n_regionkey"])


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def s2_strict_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "csv")
    sinks.text_csv(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    read = S.text_csv(spark, path, ["r_regionkey", "r_name"], strict=True)
    once = read.groupBy("r_regionkey").agg(F.count("*").alias("n"), F.first("r_name").alias("r_name"))
    return once.select("r_regionkey", F.when(F.assert_true(F.col("n") == 1).isNull(), F.col("r_name")).alias("r_name"))


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%/fr/%' THEN 'FRENCH' WHEN lower(url) LIKE '%page=%' THEN 'PAGED' WHEN lower(url) LIKE 'https://%' THEN 'SECURE' ELSE 'OTHER' END AS source_kind FROM pages")
def s5_source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.lower("url")
    kind = F.when(url.like("%/fr/%"), "FRENCH").when(url.like("%page=%"), "PAGED").when(url.like("https://%"), "SECURE").otherwise("OTHER")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("source_kind"))


@query(f"WITH {LEADS_CTE} SELECT row_idx, coalesce(nullif({_CLEAN('webpage')}, ''), nullif({_CLEAN('site_email')}, ''), nullif({_CLEAN('phone_number')}, ''), '') AS evidence FROM leads")
def s6_record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", T.first_filled(F.col("webpage"), F.col("site_email"), F.col("phone_number")).alias("evidence"))


@query("SELECT 'c' || c_custkey AS id, 0 AS source_rank, c_mktsegment AS segment FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 's' || s_suppkey, 1, NULL FROM supplier UNION ALL SELECT 'n' || n_nationkey, 2, NULL FROM nation")
def s7_union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string")).alias("id")
    return S.ordered_union(
        table(spark, sf_dir, "customer").where("c_nationkey = 3").select(tag("c", "c_custkey"), F.col("c_mktsegment").alias("segment")),
        table(spark, sf_dir, "supplier").select(tag("s", "s_suppkey")),
        table(spark, sf_dir, "nation").select(tag("n", "n_nationkey")),
    ).select("id", "source_rank", "segment")


@query(f"""WITH {LEADS_CTE}, k AS (SELECT 'name' AS kind, lower({_CLEAN('title')}) AS value FROM leads UNION SELECT 'domain', {_HOST.format(_CLEAN('webpage'))} FROM leads UNION SELECT 'place', place FROM leads) SELECT kind, value FROM k WHERE coalesce(value, '') <> ''""")
def s8_baseline_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.identity_set(leads(spark, sf_dir), {"name": T.lead_name_key(F.col("title")), "domain": T.domain(F.col("webpage")), "place": F.col("place")})


@query("SELECT arg_min(n, p_partkey) AS n, min(p_partkey) AS p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) ELSE p_name END AS raw, trim(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) ELSE p_name END, '\\s+', ' ', 'g')) AS n FROM part) GROUP BY lower(n)")
def s9_query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"))).otherwise(F.col("p_name")).alias("n"))
    return S.first_spellings(lines, "n", "p_partkey")


@query("SELECT p_name || chr(9) || p_brand AS spec, p_name AS query, p_brand AS country FROM part GROUP BY ALL")
def s10_query_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("\t"), "p_brand").alias("spec")).distinct()
    parts = F.split("spec", "\t")
    return spec.select("spec", parts[0].alias("query"), parts[1].alias("country"))


@query("SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS category FROM region")
def s13_schema_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_columns(table(spark, sf_dir, "region"), {"category": "string", "r_name": "string"}).select("r_regionkey", "r_name", "category")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def s14_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(S.json_map(broken), F.lit("k")).alias("k"))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1")
def k18_daily_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.to_date("ts") == F.lit("2024-01-10").cast("date")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, true AS verified FROM customer")
def k8_manifest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published with a manifest, verified, found again and not written twice."""
    path = _path(spark, "export")
    customer = table(spark, sf_dir, "customer")
    n, _ = sinks.publish(customer, path)
    again = sinks.publish_once(customer, path) or sinks.recover(customer, path)
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(sinks.verified(spark, path) and not again).alias("verified"))


@query("""
WITH o AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'New ' || c_name END AS name, 'UPDATED' AS segment FROM customer WHERE c_custkey % 3 <> 1)
SELECT k, coalesce(CASE WHEN n.name <> '' THEN n.name END, o.name, n.name) AS name, coalesce(n.segment, o.segment) AS segment FROM o FULL JOIN n USING (k)
""")
def k19_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = base.where("k % 3 <> 1").select("k", F.when(F.col("k") % 2 == 0, "").otherwise(F.concat(F.lit("New "), "name")).alias("name"), F.lit("UPDATED").alias("segment"))
    return J.merge_rows(base.where("k % 3 <> 0"), new, ["k"])


@query("SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1, 2")
def k20_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS status, min(o_orderdate) AS created_at FROM orders GROUP BY 1, 2")
def k21_decision_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.min("o_orderdate").alias("created_at"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL SELECT l_orderkey, 0, max(l_partkey) FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1")
def k22_replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = items.where("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.lit(0).alias("l_linenumber"), F.max("l_partkey").alias("l_partkey"))
    return items.join(new.select("l_orderkey"), "l_orderkey", "left_anti").unionByName(new)


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey FROM supplier")
def k23_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return have.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(have, "k", "left_anti"))


@query("SELECT user_id, max(ts) AS last_seen, arg_max(event_type, CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS state, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id")
def k25_state_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest time, highest state, flags."""
    rank = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", rank).alias("state"), F.bool_or(F.col("event_type") == "error").alias("failed"))


@query(f"WITH {LEADS_CTE} SELECT row_idx, coalesce(title, '') AS name, coalesce(webpage, '') AS website, coalesce(place, '') AS place FROM leads WHERE nation = 5")
def p1_export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = lambda c, n: T.text_value(F.col(c)).alias(n)
    return leads(spark, sf_dir).where("nation = 5").select("row_idx", blank("title", "name"), blank("webpage", "website"), blank("place", "place"))


@query("""
SELECT o_custkey, last(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS last_status, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_orderdate, o_orderkey) AS runs,
  CASE WHEN bool_or(o_orderstatus = 'F') THEN 'ACCEPT' WHEN bool_or(o_orderstatus = 'O') THEN 'REVIEW' ELSE 'REJECT' END AS email FROM orders GROUP BY o_custkey
""")
def p5_unified_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ";").alias("runs"),
        F.when(F.bool_or(state == "F"), "ACCEPT").when(F.bool_or(state == "O"), "REVIEW").otherwise("REJECT").alias("email"),
    )


@query(f"WITH {LEADS_CTE} SELECT row_idx, coalesce(nullif({_CLEAN('webpage')}, ''), nullif({_CLEAN('place')}, ''), '') AS picked FROM leads")
def p6_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", T.first_filled(F.col("webpage"), F.col("place")).alias("picked"))


@query("SELECT o_orderkey, o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND NOT o_totalprice > 300000 AS new_cohort FROM orders")
def p9_new_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT") & ~(F.col("o_totalprice") > 300000)
    return table(spark, sf_dir, "orders").select("o_orderkey", new.alias("new_cohort"))


@query(f"WITH {LEADS_CTE} SELECT row_idx, CASE WHEN site_email <> '' AND segment <> 'BUILDING' THEN 'ready' WHEN segment = 'BUILDING' THEN 'review' ELSE 'neither' END AS part FROM leads")
def p10_ready_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.col("segment") == "BUILDING"
    return leads(spark, sf_dir).select("row_idx", F.when((F.col("site_email") != "") & ~review, "ready").when(review, "review").otherwise("neither").alias("part"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderkey LIMIT 200")
def p11_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey").join(done, "o_orderkey", "left_anti").orderBy("o_orderkey").limit(200)


@query(f"WITH {LEADS_CTE} SELECT row_idx, site_email = '' AS missing_email, {_CLEAN('webpage')} <> '' AS usable_website, list_contains(string_split(site_email, '; '), 'sales@mail.test') AS has_sales FROM leads")
def p13_email_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", (T.text_value(F.col("site_email")) == "").alias("missing_email"), (T.clean(F.col("webpage")) != "").alias("usable_website"), F.array_contains(F.split("site_email", "; "), "sales@mail.test").alias("has_sales"))


@query(f"WITH h AS (SELECT page_id, {_HOST.format('url')} AS host, url FROM pages) SELECT page_id, NOT (host = 'example.com' OR host LIKE '%.blocked.com') AND NOT regexp_matches(url, '/(blog|news)/') AND NOT list_has_any(string_split(host, '.'), ['jobs', 'directory']) AS suitable FROM h")
def p15_suitable_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = T.domain(F.col("url"))
    bad = (host == "example.com") | host.like("%.blocked.com") | F.rlike("url", F.lit("/(blog|news)/")) | F.arrays_overlap(F.split(host, r"\."), F.array(F.lit("jobs"), F.lit("directory")))
    return table(spark, sf_dir, "pages").select("page_id", (~bad).alias("suitable"))


@query("""
WITH u AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'http://localhost/x' WHEN 1 THEN 'https://10.1.2.3/a' WHEN 2 THEN 'ftp://site.test/' WHEN 3 THEN 'https://site.test/a?b' WHEN 4 THEN 'http://192.168.0.9' ELSE 'https://172.20.0.1/' END AS url FROM orders)
SELECT k, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^https?://(localhost|127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|169\\.254\\.)') AS safe FROM u
""")
def p18_safe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    url = F.when(k == 0, "http://localhost/x").when(k == 1, "https://10.1.2.3/a").when(k == 2, "ftp://site.test/").when(k == 3, "https://site.test/a?b").when(k == 4, "http://192.168.0.9").otherwise("https://172.20.0.1/")
    private = F.rlike(T.host(F.col("url")), F.lit(r"^(localhost$|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.)"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), url.alias("url")).select("k", (F.rlike("url", F.lit("^https?://")) & ~private).alias("safe"))


@query(f"WITH {LEADS_CTE} SELECT row_idx, {_CLEAN('webpage')} AS webpage, {_CLEAN('address')} AS address FROM leads")
def f1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", T.clean(F.col("webpage")).alias("webpage"), T.clean(F.col("address")).alias("address"))


@query(f"WITH {LEADS_CTE} SELECT row_idx, lower({_CLEAN('address')}) AS lead_key, regexp_replace(lower(address), '[^a-z0-9]', '', 'g') AS outreach_key FROM leads")
def f2_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", T.lead_name_key(F.col("address")).alias("lead_key"), T.outreach_name_key(F.col("address")).alias("outreach_key"))


@query(f"WITH {LEADS_CTE} SELECT row_idx, CASE WHEN length(regexp_replace(phone_number, '[^0-9]', '', 'g')) >= 6 THEN regexp_replace(phone_number, '[^0-9]', '', 'g') ELSE '' END AS phone_key FROM leads")
def f4_phone_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", T.phone_key(F.col("phone_number")).alias("phone_key"))


@query(f"WITH {LEADS_CTE} SELECT row_idx, trim(regexp_replace(lower(address), '[^a-z0-9_]+', ' ', 'g')) AS address_key FROM leads")
def f5_address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", T.address_key(F.col("address")).alias("address_key"))


@query(f"SELECT page_id, {_HOST.format('url')} AS domain FROM pages")
def f6_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@query(f"WITH h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {_HOST.format('url')} ELSE 'a.b.firm.co.uk' END AS host FROM pages) SELECT page_id, CASE WHEN host LIKE '%.co.uk' THEN 'firm.co.uk' ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS registrable FROM h")
def f7_registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("page_id") % 2 == 0, T.domain(F.col("url"))).otherwise("a.b.firm.co.uk")
    return table(spark, sf_dir, "pages").select("page_id", T.registrable_domain(host).alias("registrable"))


@query(f"WITH h AS (SELECT page_id, {_HOST.format('url')} AS host FROM pages) SELECT page_id, host = 'example.com' OR host LIKE '%.example.com' AS matches FROM h")
def f8_domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.domain_matches(T.domain(F.col("url")), F.lit("example.com")).alias("matches"))


@query(f"WITH h AS (SELECT page_id, {_HOST.format('url')} AS host FROM pages) SELECT page_id, host LIKE '%.%' AND NOT (host IN ('example.com', 'example.org', 'example.net') OR host LIKE '%.example.com' OR host LIKE '%.example.org' OR host LIKE '%.example.net') AS trusted FROM h")
def f9_trustworthy_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.trustworthy_domain(T.domain(F.col("url"))).alias("trusted"))


@query("""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, array_to_string(list_sort([p for p in string_split(q, '&') if p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|source|src|gclid|fbclid)(=|$)')]), '&') AS kept FROM u)
SELECT page_id, scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS job_url FROM k
""")
def f10_job_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.job_url(F.col("url")).alias("job_url"))


@query(f"WITH {LEADS_CTE} SELECT row_idx, array_to_string(regexp_extract_all(site_email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'), ',') AS emails FROM leads")
def f19_extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", F.array_join(T.emails(F.col("site_email")), ",").alias("emails"))


@query(f"WITH {LEADS_CTE}, e AS (SELECT row_idx, unnest(regexp_extract_all(site_email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS email FROM leads) SELECT row_idx, email, NOT email LIKE 'user@%' AS valid FROM e")
def f20_valid_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("row_idx", F.explode(T.emails(F.col("site_email"))).alias("email")).select("row_idx", "email", T.valid_email(F.col("email")).alias("valid"))


@query(f"""WITH {LEADS_CTE}, e AS (SELECT row_idx, unnest(regexp_extract_all(site_email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS email, {_HOST.format(_CLEAN('webpage'))} AS web FROM leads)
SELECT row_idx, email, CASE WHEN web = '' THEN 'NO_WEBSITE' WHEN split_part(email, '@', 2) = web THEN 'MATCH' ELSE 'REVIEW' END AS status FROM e""")
def f22_email_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leads(spark, sf_dir).select("row_idx", F.explode(T.emails(F.col("site_email"))).alias("email"), T.domain(F.col("webpage")).alias("web"))
    return found.select("row_idx", "email", T.email_status(F.col("email"), F.col("web")).alias("status"))


@query("SELECT o_orderkey, CASE WHEN d < 0 THEN 'REVIEW' WHEN d <= 14 THEN 'PASS' WHEN d <= 30 THEN 'NONE' WHEN d <= 60 THEN 'REVIEW' ELSE 'REJECT' END AS verdict FROM (SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '1998-06-01 12:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS d FROM orders)")
def f32_age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.expr("cast(floor((timestampdiff(SECOND, o_orderdate, timestamp_ntz'1998-06-01 12:00:00')) / 86400) as bigint)")
    verdict = F.when(days < 0, "REVIEW").when(days <= 14, "PASS").when(days <= 30, "NONE").when(days <= 60, "REVIEW").otherwise("REJECT")
    return table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("verdict"))


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN length(regexp_replace(substr(text, 1, 61), '\\s+\\S*$', '')) > 60 THEN substr(text, 1, 60) ELSE regexp_replace(substr(text, 1, 61), '\\s+\\S*$', '') END AS short FROM documents")
def f36_trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.trimmed(F.col("text"), 60).alias("short"))


@query("""SELECT n_nationkey, '{"key":"' || n_nationkey || '","name":"' || n_name || '","region":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE '"' || n_regionkey || '"' END || '}' AS json FROM nation""")
def f37_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.when(F.col("n_regionkey") != 0, F.col("n_regionkey").cast("string"))
    entries = F.create_map(F.lit("region"), region, F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", ids.canonical_json(entries).alias("json"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def f38_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("hash"))


@query("""
WITH d AS (SELECT c_custkey, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode('company|' || c_name)) AS h FROM customer)
SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INT & 63) | 128) || h[19:20] || '-' || h[21:32] AS id FROM d
""")
def f40_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ids.uuid5(NAMESPACE, F.concat(F.lit("company|"), "c_name")).alias("id"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g') AS token FROM customer")
def f41_safe_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.safe_token(F.col("c_name")).alias("token"))


@query("SELECT event_id, greatest(0, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id WHEN event_id % 3 = 1 THEN '-4' ELSE CAST(user_id AS VARCHAR) END AS INT), 0)) AS attempts FROM events")
def f42_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "-4").otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.attempts(raw).alias("attempts"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'DNS' WHEN 2 THEN 'TLS' WHEN 3 THEN 'CONNECTION' ELSE 'HTTP_503' END AS kind FROM events")
def f43_error_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    message = F.when(k == 0, "Read timed out").when(k == 1, "getaddrinfo failed").when(k == 2, "SSL: bad certificate").when(k == 3, "Connection refused").otherwise("server said 503 again")
    return table(spark, sf_dir, "events").select("event_id", T.error_kind(message).alias("kind"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def h3_page_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, H9: title and links by patterns, without leaving the JVM."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("n_links"))


@query("SELECT page_id, link FROM (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS k FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"(/[^\"]*)\"', 1)) AS link FROM pages)) WHERE k <= 5")
def h9_internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('<a [^>]*href="(/[^"]*)"'), 1))), 1, 5).alias("links"))
    return links.select("page_id", F.explode("links").alias("link"))


@query("SELECT page_id, regexp_matches(lower(html), '(404|not found|access denied|error)') AS error_page, length(regexp_replace(html, '<[^>]*>', '', 'g')) >= 200 AS useful FROM pages")
def h10_page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.rlike(F.lower("html"), F.lit("(404|not found|access denied|error)")).alias("error_page"), (F.length(F.regexp_replace("html", "<[^>]*>", "")) >= 200).alias("useful"))


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.filter(T.emails(F.col("site_email")), lambda e: T.valid_email(e) & ~F.endswith(e, F.lit("@gmail.com")))
    return leads(spark, sf_dir).select(
        F.col("row_idx").cast("bigint").alias("row_idx"), "place", T.domain(F.col("webpage")).alias("domain"), T.lead_name_key(F.col("title")).alias("name"), T.phone_key(F.col("phone_number")).alias("phone"),
        F.coalesce(F.lower(F.regexp_extract(F.get(own, F.lit(0)), "@(.*)$", 1)), F.lit("")).alias("email"), T.address_key(F.col("address")).alias("address"),
    )


@query()
def e1_greedy_lead_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_leads(_identities(spark, sf_dir))


_OWN = f"""own AS (SELECT row_idx, coalesce(place, '') AS place, {_HOST.format(_CLEAN('webpage'))} AS domain, lower({_CLEAN('title')}) AS name,
 CASE row_idx % 4 WHEN 0 THEN 'site' || (row_idx % 350) || '.test' WHEN 1 THEN 'mail.test' ELSE '' END AS email FROM leads), ordered AS (SELECT *, row_number() OVER (ORDER BY row_idx) AS n FROM own)"""


@query(f"""
WITH RECURSIVE {LEADS_CTE}, {_OWN},
k AS (SELECT n, row_idx, list_filter(['p' || place, 'd' || domain, 'n' || name], lambda x: length(x) > 1) AS keys FROM ordered),
f AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS added, NULL::BIGINT AS row_idx, '' AS status
 UNION ALL SELECT k.n, CASE WHEN len(k.keys) > 0 AND NOT list_contains(f.added, k.keys[1]) THEN list_concat(f.added, k.keys) ELSE f.added END, k.row_idx, CASE WHEN len(k.keys) = 0 THEN 'none' WHEN list_contains(f.added, k.keys[1]) THEN 'same_run' ELSE 'new' END FROM f JOIN k ON k.n = f.n + 1)
SELECT row_idx, status FROM f WHERE n > 0
""")
def e4_known_or_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.known_or_new(_identities(spark, sf_dir), "row_idx", ["place", "domain", "name"])


@query(f"""
WITH RECURSIVE {LEADS_CTE}, {_OWN}, k AS (SELECT n, row_idx, list_filter(['e' || email, 'd' || domain], lambda x: length(x) > 1) AS keys FROM ordered),
f AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS taken, NULL::BIGINT AS row_idx, false AS kept
 UNION ALL SELECT k.n, CASE WHEN NOT list_has_any(f.taken, k.keys) THEN list_concat(f.taken, k.keys) ELSE f.taken END, k.row_idx, NOT list_has_any(f.taken, k.keys) FROM f JOIN k ON k.n = f.n + 1)
SELECT row_idx, kept FROM f WHERE n > 0
""")
def e5_sequential_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sequential_dedup(_identities(spark, sf_dir), "row_idx", ["email", "domain"])


@query(f"""WITH {LEADS_CTE}, d AS (SELECT {_HOST.format(_CLEAN('webpage'))} AS domain, row_idx, title, segment FROM leads) SELECT domain, arg_min(title, row_idx) AS title, min(row_idx) AS first_row, count(*) AS n, string_agg(DISTINCT segment, ';' ORDER BY segment) AS queries FROM d WHERE domain <> '' GROUP BY domain""")
def e6_domain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select(T.domain(F.col("webpage")).alias("domain"), "row_idx", "title", "segment").where("domain <> ''")
    return rows.groupBy("domain").agg(F.min_by("title", "row_idx").alias("title"), F.min("row_idx").alias("first_row"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("segment")), ";").alias("queries"))


@query(f"""WITH {LEADS_CTE}, r AS (SELECT title, row_idx, coalesce(webpage, '') AS webpage, coalesce(site_email, '') AS site_email, coalesce(place, '') AS place FROM leads),
k AS (SELECT *, (webpage <> '')::INT + (site_email <> '')::INT + (place <> '')::INT AS filled FROM r), o AS (SELECT *, CAST(3 - filled AS BIGINT) * 1000000000 + row_idx AS rank FROM k)
SELECT title, coalesce(arg_min(webpage, rank) FILTER (webpage <> ''), '') AS webpage, coalesce(arg_min(site_email, rank) FILTER (site_email <> ''), '') AS site_email, coalesce(arg_min(place, rank) FILTER (place <> ''), '') AS place FROM o GROUP BY title""")
def e7_duplicate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.completeness_merge(leads(spark, sf_dir), "title", ["webpage", "site_email", "place"], "row_idx")


@query("SELECT quality AS old_class, toxic AS new_class, quality + toxic = 1 AS agree, count(*) AS n FROM labels GROUP BY ALL")
def e9_shadow_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("old_class"), F.col("toxic").alias("new_class"), (F.col("quality") + F.col("toxic") == 1).alias("agree")).groupBy("old_class", "new_class", "agree").agg(F.count("*").alias("n"))


@query("SELECT 'place:' || s_suppkey AS source_key, sha256('supplier|' || s_name) AS payload_hash FROM supplier")
def e13_replay_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("place:"), F.col("s_suppkey").cast("string")).alias("source_key"), ids.content_hash(F.concat(F.lit("supplier|"), "s_name")).alias("payload_hash"))


@query(f"""WITH {LEADS_CTE}, k AS (SELECT title, row_idx, {_HOST.format(_CLEAN('webpage'))} AS domain, place FROM leads), i AS (SELECT 'name' AS kind, title AS value, s.s_suppkey AS entity FROM k JOIN supplier s ON s.s_suppkey = k.row_idx UNION SELECT 'domain', domain, s_suppkey FROM k JOIN supplier ON s_suppkey = row_idx WHERE domain <> ''),
n AS (SELECT value, list_sort(list(DISTINCT entity)) AS e FROM i WHERE kind = 'name' GROUP BY 1), d AS (SELECT value, list_sort(list(DISTINCT entity)) AS e FROM i WHERE kind = 'domain' GROUP BY 1)
SELECT row_idx, coalesce(array_to_string(list_sort(list_intersect(n.e, d.e)), ','), '') AS common FROM k LEFT JOIN n ON n.value = title LEFT JOIN d ON d.value = domain""")
def j10_candidate_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select("row_idx", F.col("title").alias("name"), T.domain(F.col("webpage")).alias("domain"))
    entities = rows.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("row_idx"))
    pairs = F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")), F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("value")))).alias("p")
    identities = entities.select(F.col("s_suppkey").alias("entity"), pairs).select("entity", "p.*").where("value <> ''").distinct()
    return J.identity_candidates(rows, identities, ["name", "domain"]).select("row_idx", F.array_join(F.transform("common", lambda x: x.cast("string")), ",").alias("common"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.telemetry import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"))
