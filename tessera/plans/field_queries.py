"""Queries: field rules, evidence rules, repairs, outreach, matches by precedence, and the registry resolvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import ids
from ..functions import text as T
from ..operators import joins as J
from ..operators import resolution as E
from ..sources import html
from ..sources.tables import table
from .place_queries import _add, _pick
from .registry import query
from .standins import LEADS_CTE, leads

_add("f3_company_identity", "customer", "c_custkey", "identity", ("Société Générale S.A.", "ACME Tools, Ltd.", "Müller GmbH", "", "Inc."), ("societegenerale", "acmetools", "muller", "", ""), X.company_identity)
_add("f17_query_role", "customer", "c_custkey", "dimensions", ("junior python developer france", "graduate engineer", "site:jobs.lever.co internship laravel", "gardener"), ("JUNIOR|Python", "ENTRY_LEVEL|", "INTERNSHIP|Laravel", "UNSPECIFIED|"), lambda q: F.concat_ws("|", X.query_dimensions(q)["seniority"], F.array_join(X.query_dimensions(q)["technologies"], ",")))
_add(
    "f21_email_verdict", "customer", "c_custkey", "verdict",
    ("info@acme.test", "john.smith@acme.test", "user@example.com", "n/a", "x@y", "no-reply@acme.test", "a..b@acme.test", "logo@2x.png", "sentry@acme.test", "x@o1.sentry.io", ".a@acme.test", None),
    ("ACCEPT business_role_address", "REVIEW uncertain_local_part", "REJECT placeholder_address", "REJECT empty_or_unavailable", "REJECT malformed_address", "REJECT automated_sender", "REJECT malformed_address", "REJECT asset_address", "REJECT telemetry_address",
     "REJECT telemetry_address", "REJECT malformed_address", "REJECT empty_or_unavailable"),
    lambda e: F.concat_ws(" ", X.email_verdict(e)["verdict"], X.email_verdict(e)["reason"]),
)
_add("f25_address_country", "customer", "c_custkey", "country", ("1 Rue X, 75001 Paris, France", "Avenue Y, Sfax, Tunisie", "nowhere", "Malta, Sliema", ""), ("France", "Tunisia", "", "Malta", ""), X.address_country)
_add("f31_time_with_offset", "customer", "c_custkey", "usable", ("2026-01-02T03:04:05Z", "2026-01-02T03:04:05", "2026-01-02T03:04:05+01:00", "yesterday"), (True, False, True, False), X.usable_time)
_add("f33_safe_title", "customer", "c_custkey", "safe", ("Python Developer", "Cookie policy", "Careers", "Senior Engineer", " "), (True, False, False, True, False), X.safe_title)
_add("f33_safe_place", "customer", "c_custkey", "safe", ("Paris", "<b>Paris</b>", "12345", "a@b.test", "Île-de-France", "", "x" * 81), (True, False, False, False, True, False, False), X.safe_place)
_add("f34_title_from_url", "customer", "c_custkey", "title", ("https://a.test/jobs/senior-python-developer-123", "https://a.test/jobs/42", "https://a.test/"), ("Senior Python Developer", "", ""), X.title_from_url)
_add("f39_config_hash", "nation", "n_nationkey", "same", ("a", "a", "b"), (True, True, False), lambda v: X.config_hash(v, F.lit("v1")) == ids.content_hash(F.lit("a|v1")))
_add("f44_company_domain", "customer", "c_custkey", "domain", ("a@acme.test; b@acme.test", "a@gmail.com", "a@acme.test; b@other.test", ""), ("acme.test", "", "", ""), X.company_domain)
_add("f45_google_host", "customer", "c_custkey", "google", ("https://www.google.fr/x", "https://maps.google.com", "https://notgoogle.com"), (True, True, False), X.google_host)


@query("""
WITH t(i, accepted) AS (VALUES (0, true), (1, true), (2, false), (3, false), (4, true), (5, false))
SELECT c_custkey, accepted FROM customer JOIN t ON i = c_custkey % 6
""")
def e11_result_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    email = _pick(k, ("info@acme.test", "info@other.test", "info@other.test", "info@other.test", "a@sub.acme.test", "info@acme.test"))
    url = _pick(k, ("https://x.test", "https://www.acme.test/contact", "https://acme.test/x", "https://x.test/contact", "https://x.test", "https://acme.test"))
    site = _pick(k, ("acme.test", "acme.test", "acme.test", "acme.test", "acme.test", ""))
    return table(spark, sf_dir, "customer").select("c_custkey", X.result_evidence(email, url, site, F.lit(False), F.contains(url, F.lit("contact"))).alias("accepted"))


_add("p20_text_value", "customer", "c_custkey", "value", ("  a b ", None, "", "0"), ("a b", "", "", "0"), T.text_value)


@query(f"""WITH {LEADS_CTE}, e AS (SELECT row_idx, regexp_extract(coalesce(webpage, ''), 'site[0-9]+\\.test', 0) AS site FROM leads)
SELECT row_idx, 'contact@site' || (row_idx % 90) || '.test' AS "primary", CASE WHEN site = 'site' || (row_idx % 90) || '.test' OR site = '' THEN 'zed@site' || (row_idx % 90) || '.test;Ann@gmail.com' ELSE 'zed@site' || (row_idx % 90) || '.test;Ann@gmail.com' END AS alternates,
 CASE WHEN site = '' THEN 'NO_WEBSITE' WHEN site = 'site' || (row_idx % 90) || '.test' THEN 'MATCH' ELSE 'REVIEW' END AS status FROM e""")
def f23_primary_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five addresses one is a placeholder and one the same in other letters."""
    at = F.concat(F.lit("@site"), (F.col("row_idx") % 90).cast("string"), F.lit(".test"))
    given = F.array(F.lit("Ann@gmail.com"), F.concat(F.lit("zed"), at), F.concat(F.lit("contact"), at), F.concat(F.lit("CONTACT"), at), F.lit("user@example.com"))
    return leads(spark, sf_dir).select("row_idx", X.primary_emails(given, T.domain(F.col("webpage"))).alias("e")).select("row_idx", "e.*")


PROSE = (
    ("Join Acme today.", "Acme", "Acme EXPLICIT_JOB_EMPLOYER_STATEMENT"),
    ("We are hiring for Blue Ocean, a startup.", "", "Blue Ocean EXPLICIT_RECRUITER_CLIENT"),
    ("Notre client Banque Verte recherche un profil.", "Acme", "Banque Verte EXPLICIT_RECRUITER_CLIENT"),
    ("Nimbus Labs is an international company in Lyon.", "", "Nimbus Labs EXPLICIT_JOB_EMPLOYER_STATEMENT"),
    ("Our client Company is great.", "", ""),
    ("", "Acme", ""),
    ("Acme is an equal opportunity employer. On behalf of Zeta, join us.", "Acme", "Acme EXPLICIT_JOB_EMPLOYER_STATEMENT|Zeta EXPLICIT_RECRUITER_CLIENT"),
)
_rows = lambda values: ", ".join("(" + ", ".join([str(i), *("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" for v in row)]) + ")" for i, row in enumerate(values))


@query(f"WITH t(i, text, company, facts) AS (VALUES {_rows(PROSE)}) SELECT c_custkey, facts FROM customer JOIN t ON i = c_custkey % {len(PROSE)}")
def h7_employer_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = X.employer_statements(_pick(F.col("c_custkey"), tuple(p[0] for p in PROSE)), _pick(F.col("c_custkey"), tuple(p[1] for p in PROSE)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(said, lambda f: F.concat_ws(" ", f["value"], f["method"])), "|").alias("facts"))


#: description, location, country, city, policy; work model, scope, country, region, city, residency, authorization, jurisdiction, visa, relocation, eligibility
PLACES = (
    ("Fully remote worldwide. Visa sponsorship available.", "", "", "", "", "REMOTE WORLDWIDE    NOT_STATED NOT_STATED  AVAILABLE NOT_STATED KNOWN"),
    ("Hybrid role, two days on site.", "Paris, France", "France", "Paris", "", "HYBRID UNKNOWN France EUROPE Paris NOT_STATED NOT_STATED  NOT_STATED NOT_STATED KNOWN"),
    ("You must be based in France. Work remotely.", "", "", "", "", "REMOTE UNKNOWN France   REQUIRED NOT_STATED  NOT_STATED NOT_STATED KNOWN"),
    ("Remote role. Office-based.", "", "", "", "", "UNKNOWN UNKNOWN    NOT_STATED NOT_STATED  NOT_STATED NOT_STATED PARTIAL"),
    ("We serve remote teams and customers worldwide.", "", "", "", "", "UNKNOWN UNKNOWN    NOT_STATED NOT_STATED  NOT_STATED NOT_STATED UNKNOWN"),
    ("Must be authorized to work in the UK. We do not sponsor.", "", "", "", "", "UNKNOWN UNKNOWN    NOT_STATED REQUIRED United Kingdom NOT_AVAILABLE NOT_STATED KNOWN"),
    ("Work remotely within the EU. No relocation support.", "", "", "", "", "REMOTE EU  EU  NOT_STATED NOT_STATED  NOT_STATED NOT_AVAILABLE KNOWN"),
    ("Visa sponsorship available. No visa sponsorship for interns.", "", "", "", "", "UNKNOWN UNKNOWN    NOT_STATED NOT_STATED  UNKNOWN NOT_STATED PARTIAL"),
    ("", "", "", "", "", "UNKNOWN UNKNOWN    NOT_STATED NOT_STATED  NOT_STATED NOT_STATED UNKNOWN"),
    ("Great job.", "", "", "", "remote", "REMOTE UNKNOWN    NOT_STATED NOT_STATED  NOT_STATED NOT_STATED PARTIAL"),
)


@query(f"WITH t(i, description, location_text, country, city, policy, said) AS (VALUES {_rows(PLACES)}) SELECT c_custkey, said FROM customer JOIN t ON i = c_custkey % {len(PLACES)}")
def r8_location_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda n: _pick(F.col("c_custkey"), tuple(p[n] for p in PLACES))
    rows = table(spark, sf_dir, "customer").select("c_custkey", of(0).alias("description"), of(1).alias("location_text"), of(2).alias("country"), F.when(of(2) != "", "EUROPE").otherwise("").alias("region"), of(3).alias("city"), of(4).alias("remote_policy"))
    told = X.location_eligibility(rows)
    return told.select("c_custkey", F.concat_ws(" ", "work_model", "remote_scope", "required_country", "required_region", "required_city", "residency", "authorization", "jurisdiction", "visa", "relocation", "eligibility").alias("said"))


#: title, company, snippet, source type, explicit, region; role, status, confidence, relationship
PEOPLE = (
    ("Technical Recruiter", "Acme Ltd", "", "LINKEDIN", False, False, "RECRUITER CANDIDATE MEDIUM COMPANY_HIRING_ROLE"),
    ("Former CTO", "Acme", "", "LINKEDIN", False, False, "TECH_LEADER REJECTED_FORMER_EMPLOYEE LOW NONE"),
    ("Engineering Manager", "Other", "", "LINKEDIN", False, True, "ENGINEERING_MANAGER REJECTED_COMPANY_MISMATCH LOW NONE"),
    ("Engineering Manager", "ACME", "Paris", "LINKEDIN", False, True, "ENGINEERING_MANAGER CANDIDATE HIGH REGION_ALIGNED_HIRING_ROLE"),
    ("Gardener", "Acme", "", "OFFICIAL_COMPANY", False, False, " REJECTED_ROLE_MISMATCH LOW NONE"),
    ("Office", "Acme", "", "JOB_POSTING", True, False, "EXPLICIT_CONTACT CANDIDATE HIGH EXPLICIT_JOB_CONTACT"),
    ("CTO", "Acme", "", "OFFICIAL_COMPANY", False, False, "TECH_LEADER CANDIDATE HIGH OFFICIAL_COMPANY_ROLE"),
)


@query(f"WITH t(i, a, b, c, d, e, f, said) AS (VALUES {_rows(PEOPLE)}) SELECT c_custkey, said FROM customer JOIN t ON i = c_custkey % {len(PEOPLE)}")
def r14_person_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("title", "company", "snippet", "source_type", "explicit", "region_match")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("Acme").alias("target_company"), *[_pick(F.col("c_custkey"), tuple(p[i] for p in PEOPLE)).alias(n) for i, n in enumerate(names)])
    return X.person_evaluation(rows).select("c_custkey", F.concat_ws(" ", "role", "person_status", "confidence", "relationship").alias("said"))


@query("""
WITH c AS (SELECT l_orderkey AS k, 'u' || (l_suppkey % 3) AS url, l_linenumber % 3 AS rank, l_quantity > 8 AS fetched, l_quantity > 8 AND l_returnflag <> 'N' AS accepted FROM lineitem),
b AS (SELECT k, min(rank) AS rank FROM c WHERE accepted GROUP BY k), t AS (SELECT c.k, count(DISTINCT url) AS n, min(url) AS url FROM c JOIN b ON b.k = c.k AND b.rank = c.rank WHERE accepted GROUP BY c.k)
SELECT s.k, CASE WHEN n = 1 THEN 'CONFIRMED' WHEN n > 1 THEN 'CONFLICT' WHEN s.unread THEN 'UNAVAILABLE' ELSE 'UNKNOWN' END AS status, CASE WHEN n = 1 THEN url ELSE '' END AS url FROM (SELECT k, bool_and(NOT fetched) AS unread FROM c GROUP BY k) s LEFT JOIN t USING (k)
""")
def r10_application_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.col("l_quantity") > 8
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("u"), (F.col("l_suppkey") % 3).cast("string")).alias("url"), (F.col("l_linenumber") % 3).alias("rank"), read.alias("fetched"), (read & (F.col("l_returnflag") != "N")).alias("accepted"))
    return X.application_destination(rows, "k")


@query("""
WITH e AS (SELECT l_orderkey AS k, CASE WHEN l_quantity > 25 THEN 'acme' || (l_suppkey % 2) || '.co.uk' END AS d FROM lineitem)
SELECT k, CASE WHEN count(DISTINCT d) = 0 THEN 'UNKNOWN' WHEN count(DISTINCT d) = 1 THEN 'CONFIRMED' ELSE 'CONFLICT' END AS status, CASE WHEN count(DISTINCT d) = 1 THEN min(d) ELSE '' END AS domain FROM e GROUP BY k
""")
def r11_company_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("https://www.shop.acme"), (F.col("l_suppkey") % 2).cast("string"), F.lit(".co.uk/x"))
    return X.company_website(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_quantity") > 25, own).otherwise("https://www.linkedin.com/company/x").alias("url")), "k")


@query("""
WITH r AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Cookie policy' ELSE 'Engineer' END AS title, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '<b>' ELSE 'Lyon' END AS city, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Login' ELSE 'Developer' END AS nt, CASE c_custkey % 2 WHEN 0 THEN 'Paris' ELSE '' END AS nc FROM customer),
f AS (SELECT *, CASE WHEN title IN ('', 'Cookie policy') AND nt = 'Developer' THEN 'title:' || title || '>Developer/JSON_LD' WHEN title = 'Cookie policy' THEN 'title:Cookie policy>/UNKNOWN' END AS ft, CASE WHEN city IN ('', '<b>') AND nc = 'Paris' THEN 'city:' || city || '>Paris/URL_INFERENCE' WHEN city = '<b>' THEN 'city:<b>>/UNKNOWN' END AS fc FROM r)
SELECT k, concat_ws(';', fc, ft) AS fixes, CASE WHEN ft IS NULL AND fc IS NULL THEN 'NO_CHANGE' WHEN (CASE WHEN ft LIKE '%>Developer%' THEN 1 ELSE 0 END) + (CASE WHEN fc LIKE '%>Paris%' THEN 1 ELSE 0 END) >= (CASE WHEN title = '' THEN 1 ELSE 0 END) + (CASE WHEN city = '' THEN 1 ELSE 0 END) THEN 'SUCCESS' ELSE 'PARTIAL' END AS status FROM f
""")
def r17_repair_chooser(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("k"), _pick(k, ("", "Cookie policy", "Engineer", "Engineer")).alias("title"), _pick(k, ("", "<b>", "Lyon")).alias("city"), _pick(k, ("", "Login", "Developer", "Developer", "Developer")).alias("new_title"),
        _pick(k, ("Paris", "")).alias("new_city"), F.lit("jsonld_title").alias("source_title"), F.lit("URL_PATTERN").alias("source_city"),
    )
    told = F.transform(F.array_sort(F.map_entries("fixes")), lambda f: F.concat(f["key"], F.lit(":"), f["value"]["old_value"], F.lit(">"), f["value"]["new_value"], F.lit("/"), f["value"]["method"]))
    return X.repairs(rows, {"title": X.safe_title, "city": X.safe_place}).select("k", F.array_join(told, ";").alias("fixes"), F.col("repair_status").alias("status"))


@query("""
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'a@b.test' ELSE 'Lyon' END AS city, CASE WHEN c_custkey % 4 = 0 THEN '12345' END AS region FROM customer)
SELECT k, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN NULL ELSE city END AS city, CASE WHEN k % 4 = 0 THEN NULL ELSE region END AS region,
 concat_ws(',', CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'city=' || CASE WHEN k % 5 = 0 THEN 'new' ELSE 'old' END END, CASE WHEN k % 4 = 0 THEN 'region=old' END) AS cleared FROM r
""")
def r18_repair_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even rows were repaired, every fifth of them twice in the city."""
    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    rows = customer.select(k.alias("k"), F.when(k % 3 == 0, "a@b.test").otherwise("Lyon").alias("city"), F.when(k % 4 == 0, "12345").alias("region"))
    first = customer.where("c_custkey % 2 = 0").select(k.alias("k"), F.lit(1).alias("at"), F.create_map(F.lit("city"), F.lit("old"), F.lit("region"), F.lit("old")).alias("filled"))
    second = customer.where("c_custkey % 10 = 0").select(k.alias("k"), F.lit(2).alias("at"), F.create_map(F.lit("city"), F.lit("new")).alias("filled"))
    cleaned = X.repair_cleanup(rows, first.unionByName(second), "k", {"city": X.safe_place, "region": X.safe_place})
    return cleaned.select("k", "city", "region", F.array_join(F.transform(F.array_sort(F.map_entries("cleared")), lambda c: F.concat(c["key"], F.lit("="), c["value"]["source"])), ",").alias("cleared"))


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'NO_WEBSITE' WHEN c_custkey % 4 = 1 AND c_custkey % 3 = 1 THEN 'SUCCESS' WHEN c_custkey % 4 = 1 OR c_custkey % 3 = 1 THEN 'PARTIAL' WHEN c_custkey % 5 = 0 THEN 'FAILED' WHEN c_custkey % 7 = 0 THEN 'PENDING' ELSE 'INCOMPLETE' END AS enrichment_status FROM customer
""")
def r19_enrichment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 6 == 0, "n/a").otherwise("https://acme.test").alias("website"), F.when(k % 4 == 1, "text").alias("description"), F.when(k % 3 == 1, "retail").otherwise("none").alias("industry"),
        F.lit("meta").alias("source_context"), F.lit(False).alias("useful"), (k % 5 == 0).alias("failed"), F.when(k % 7 == 0, "x").otherwise("2").alias("attempts"),
    )
    return X.enrichment_status(rows).select("k", "enrichment_status")


@query("""
WITH h AS (SELECT 'd' || (o_custkey % 200) || '.test' AS d, CASE o_orderkey % 4 WHEN 0 THEN 'SENT' WHEN 1 THEN 'FAILED' ELSE 'PENDING' END AS s, o_orderkey AS t, 0 AS o FROM orders WHERE o_orderstatus = 'F'),
m AS (SELECT 'd' || (o_custkey % 200) || '.test', CASE WHEN o_orderkey % 3 = 0 THEN 'SENT' ELSE 'FAILED' END, o_orderkey, 1 FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT * FROM h UNION ALL SELECT * FROM m)
SELECT d AS domain, CASE max(CASE s WHEN 'SENT' THEN 2 WHEN 'FAILED' THEN 1 ELSE 0 END) WHEN 2 THEN 'SENT' WHEN 1 THEN 'FAILED' ELSE 'PENDING' END AS send_status, arg_min(t, o * 1000000000 + t) FILTER (s = 'SENT') AS sent_at FROM b GROUP BY d
""")
def r20_outreach_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    host = F.concat(F.lit("https://www.d"), (F.col("o_custkey") % 200).cast("string"), F.lit(".test/"))
    history = orders.where("o_orderstatus = 'F'").select(host.alias("domain"), F.when(k % 4 == 0, " sent").when(k % 4 == 1, "FAILED").otherwise("??").alias("send_status"), k.alias("sent_at"))
    marks = orders.where("o_orderstatus = 'P'").select(host.alias("domain"), F.when(k % 3 == 0, "SENT").otherwise("FAILED").alias("mark"), k.alias("at"))
    return X.outreach_history(history, marks)


@query(f"""WITH {LEADS_CTE}, k AS (SELECT row_idx, place, regexp_extract(coalesce(webpage, ''), 'site[0-9]+\\.test', 0) AS domain, title AS name FROM leads), s AS (SELECT row_idx AS entity, place, domain, name FROM k WHERE row_idx % 5 = 0),
p AS (SELECT place, count(*) AS n, min(entity) AS e FROM s WHERE place <> '' GROUP BY 1), d AS (SELECT domain, count(*) AS n, min(entity) AS e FROM s WHERE domain <> '' GROUP BY 1), m AS (SELECT name, count(*) AS n, min(entity) AS e FROM s GROUP BY 1)
SELECT row_idx, CASE WHEN p.n IS NOT NULL THEN CASE WHEN p.n = 1 THEN p.e END WHEN d.n IS NOT NULL THEN CASE WHEN d.n = 1 THEN d.e END WHEN m.n = 1 THEN m.e END AS matched_entity, CASE WHEN p.n IS NOT NULL THEN 'place' WHEN d.n IS NOT NULL THEN 'domain' WHEN m.n IS NOT NULL THEN 'name' END AS matched_by,
 coalesce(p.n, d.n, m.n, 1) > 1 AS ambiguous FROM k LEFT JOIN p USING (place) LEFT JOIN d USING (domain) LEFT JOIN m USING (name)""")
def j9_precedence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select("row_idx", "place", T.domain(F.col("webpage")).alias("domain"), F.col("title").alias("name"))
    known = rows.where("row_idx % 5 = 0").withColumnRenamed("row_idx", "entity")
    return J.precedence_match(rows, known, ["place", "domain", "name"], "entity").select("row_idx", "matched_entity", "matched_by", "ambiguous")


@query("""
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'd' || (c_custkey % 50) ELSE '' END AS domain, 'n' || (c_custkey % 30) AS name, c_mktsegment = 'BUILDING' AND c_acctbal < 0 AS flagged FROM customer),
f AS (SELECT DISTINCT domain FROM r WHERE flagged AND domain <> ''), u AS (SELECT name FROM r GROUP BY name HAVING count(DISTINCT domain) FILTER (domain <> '') = 1), g AS (SELECT DISTINCT name FROM r WHERE flagged AND name IN (SELECT name FROM u))
SELECT k, flagged OR domain IN (SELECT domain FROM f) OR (domain = '' AND name IN (SELECT name FROM g)) AS excluded FROM r
""")
def j17_flag_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag goes to all rows of the domain, and by name where that leads to a single domain."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 2 == 0, F.concat(F.lit("d"), (k % 50).cast("string"))).otherwise("").alias("domain"), F.concat(F.lit("n"), (k % 30).cast("string")).alias("name"), ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0)).alias("flagged"))
    one = J.unambiguous(rows, "name", "domain").select("name")
    by_domain = rows.where("flagged and domain <> ''").select("domain").distinct().withColumn("d", F.lit(True))
    by_name = rows.where("flagged").select("name").distinct().join(one, "name", "left_semi").withColumn("n", F.lit(True))
    joined = rows.join(by_domain, "domain", "left").join(by_name, "name", "left")
    return joined.select("k", (F.col("flagged") | F.coalesce("d", F.lit(False)) | ((F.col("domain") == "") & F.coalesce("n", F.lit(False)))).alias("excluded"))


@query("""
WITH h AS (SELECT s_suppkey AS job, CASE WHEN s_suppkey % 3 = 0 THEN 'lever/' || s_suppkey END AS pid, 'https://x.test/' || (s_suppkey % 40) AS url FROM supplier)
SELECT c_custkey AS k, coalesce((SELECT min(job) FROM h WHERE pid = 'lever/' || c_custkey), (SELECT min(job) FROM h WHERE url = 'https://x.test/' || (c_custkey % 60))) AS matched_job FROM customer
""")
def j19_identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the provider's id, else by address."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    known = table(spark, sf_dir, "supplier").select(s.alias("job"), F.when(s % 3 == 0, F.concat(F.lit("lever/"), s.cast("string"))).alias("pid"), F.concat(F.lit("https://x.test/"), (s % 40).cast("string")).alias("url"))
    rows = table(spark, sf_dir, "customer").select(c.alias("k"), F.concat(F.lit("lever/"), c.cast("string")).alias("pid"), F.concat(F.lit("https://x.test/"), (c % 60).cast("string")).alias("url"))
    return J.either_key(rows, known, "pid", "url", "job").select("k", "matched_job")


def _marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made from customers: a posting in JSON-LD, in meta tags or in a heading, with people and an organisation."""
    k, name = F.col("c_custkey"), F.col("c_name")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev '), k.cast("string"), F.lit('","hiringOrganization":{"name":"'), name, F.lit('"}},{"@type":"Person","name":"Ann '), (k % 9).cast("string"), F.lit('"},{"@type":"Organization","name":"'), name, F.lit('"}]}</script>'))
    page = F.when(k % 3 == 0, ld).when(k % 3 == 1, F.concat(F.lit('<meta property="og:title" content="Meta '), k.cast("string"), F.lit('">'))).otherwise(F.concat(F.lit("<h1>Head <b>"), k.cast("string"), F.lit("</b></h1>")))
    return table(spark, sf_dir, "customer").select(k.alias("page_id"), F.concat(F.lit("<html><head><title>Page</title></head>"), page).alias("html"))


@query("SELECT c_custkey AS page_id, CASE c_custkey % 3 WHEN 0 THEN 'Dev ' ELSE CASE c_custkey % 3 WHEN 1 THEN 'Meta ' ELSE 'Head ' END END || c_custkey AS job_title, CASE c_custkey % 3 WHEN 0 THEN 'JSON_LD' WHEN 1 THEN 'META' ELSE 'HEADING' END AS title_source, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS company FROM customer")
def h2_provider_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting by structured data, meta tags or headings, with where it was found."""
    return html.parse_pages(_marked_up(spark, sf_dir)).select("page_id", "job_title", "title_source", "company")


@query("SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN 'Ann ' || (c_custkey % 9) ELSE '' END AS people FROM customer")
def h6_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parse_pages(_marked_up(spark, sf_dir)).select("page_id", F.array_join("people", ";").alias("people"))


@query("SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS organisations, 'Page' AS title FROM customer")
def h8_page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parse_pages(_marked_up(spark, sf_dir)).select("page_id", F.array_join("organisations", ";").alias("organisations"), "title")


#: a frozen registry and what is observed, read by Spark and DuckDB alike
BRANCHES = """SELECT s_suppkey AS branch, s_suppkey % 40 AS company, concat('firm ', CAST(s_suppkey % 40 AS STRING)) AS name, concat('p', CAST(s_suppkey % 90 AS STRING)) AS place,
 CAST(600000 + s_suppkey % 35 AS STRING) AS phone, concat(CAST(s_suppkey % 25 AS STRING), ' main street') AS address, concat('site', CAST(s_suppkey % 30 AS STRING), '.test') AS domain FROM {supplier}"""
OBSERVED = """SELECT c_custkey AS id, c_custkey % 53 <> 0 AS has_key, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE concat('firm ', CAST(c_custkey % 60 AS STRING)) END AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('p', CAST(c_custkey % 130 AS STRING)) ELSE '' END AS place,
 CASE WHEN c_custkey % 2 = 0 THEN concat('site', CAST(c_custkey % 45 AS STRING), '.test') ELSE '' END AS domain, CASE WHEN c_custkey % 5 < 3 THEN CAST(600000 + c_custkey % 70 AS STRING) ELSE '' END AS phone,
 CASE WHEN c_custkey % 7 < 3 THEN concat(CAST(c_custkey % 50 AS STRING), ' main street') ELSE '' END AS address FROM {customer}"""


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    flat = spark.sql(BRANCHES, supplier=table(spark, sf_dir, "supplier"))
    kind = lambda kinds: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])).alias("i")
    branches = flat.select("branch", "company", kind({"PLACE": "place", "NAME": "name", "PHONE": "phone", "ADDRESS": "address"})).select("branch", "company", "i.*")
    companies = flat.select("company", kind({"NAME": "name", "DOMAIN": "domain"})).select("company", "i.*").distinct()
    history = table(spark, sf_dir, "nation").select(F.lit("NAME").alias("kind"), F.concat(F.lit("firm "), (F.col("n_nationkey") + 40).cast("string")).alias("value"))
    return spark.sql(OBSERVED, customer=table(spark, sf_dir, "customer")), branches, companies, history


_RESOLVED = f"""b AS ({BRANCHES.format(supplier='supplier')}), o AS ({OBSERVED.format(customer='customer')}), h AS (SELECT 'firm ' || (n_nationkey + 40) AS name FROM nation),
e AS (SELECT o.*, (SELECT count(*) FROM b WHERE o.place <> '' AND b.place = o.place) AS n_place, (SELECT min(branch) FROM b WHERE o.place <> '' AND b.place = o.place) AS br, (SELECT min(company) FROM b WHERE o.place <> '' AND b.place = o.place) AS co,
 (SELECT count(*) FROM b WHERE o.name <> '' AND b.name = o.name AND ((o.phone <> '' AND b.phone = o.phone) OR (o.address <> '' AND b.address = o.address))) AS n_support,
 (SELECT count(*) FROM b WHERE o.name <> '' AND b.name = o.name AND o.phone <> '' AND b.phone = o.phone AND o.address <> '' AND b.address = o.address) AS n_both,
 (SELECT count(DISTINCT x.company) FROM b x JOIN b y ON x.company = y.company WHERE o.name <> '' AND x.name = o.name AND o.domain <> '' AND y.domain = o.domain) AS n_domain,
 EXISTS (SELECT 1 FROM b WHERE (o.name <> '' AND b.name = o.name) OR (o.domain <> '' AND b.domain = o.domain)) AS partial, o.name IN (SELECT name FROM h) AS past FROM o),
x AS (SELECT e.*, e.name <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.company = e.co AND b.name = e.name) AS name_off, e.domain <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.company = e.co AND b.domain = e.domain) AS domain_off,
 e.name <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.branch = e.br AND b.name = e.name) AS branch_name_off, e.phone <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.branch = e.br AND b.phone = e.phone) AS phone_off,
 e.address <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.branch = e.br AND b.address = e.address) AS address_off FROM e),
d AS (SELECT id, CASE WHEN NOT has_key THEN 'QUARANTINED/QUARANTINE' WHEN n_place > 1 THEN 'AMBIGUOUS/REVIEW' WHEN n_place = 1 THEN CASE WHEN name_off AND (domain_off OR (phone_off AND address_off)) THEN 'AMBIGUOUS/REVIEW' WHEN name_off OR domain_off OR branch_name_off OR phone_off OR address_off THEN 'UPDATED/UPDATE_ENTITY' ELSE 'KNOWN/MATCH_ONLY' END
 WHEN name = '' OR (place = '' AND domain = '' AND phone = '' AND address = '') THEN 'QUARANTINED/QUARANTINE' WHEN place <> '' AND n_both = 1 THEN 'UPDATED/ADD_PLACE_ALIAS' WHEN place <> '' AND n_support > 0 THEN 'AMBIGUOUS/REVIEW' WHEN n_support > 1 THEN 'AMBIGUOUS/REVIEW' WHEN n_support = 1 THEN 'KNOWN/MATCH_ONLY'
 WHEN n_domain > 1 THEN 'AMBIGUOUS/REVIEW' WHEN n_domain = 1 THEN CASE WHEN place <> '' THEN 'UPDATED/CREATE_BRANCH' ELSE 'KNOWN/MATCH_ONLY' END WHEN partial OR past THEN 'AMBIGUOUS/REVIEW' ELSE 'NEW/CREATE_COMPANY' END AS r FROM x)"""


@query(f"WITH {_RESOLVED} SELECT id, split_part(r, '/', 1) AS classification, split_part(r, '/', 2) AS action FROM d")
def e2_registry_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a registry table; the SQL asks it row by row."""
    observed, *registry = _registry(spark, sf_dir)
    return E.resolve(observed, E.registry_tables(*registry))


@query(f"WITH {_RESOLVED}, f AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'REPLAYED/' || (id % 3) ELSE r END AS r FROM d) SELECT id, CASE WHEN id % 11 = 0 THEN 'RECORDED' ELSE split_part(r, '/', 1) END AS classification, id % 11 = 0 AS replayed FROM f")
def e3_historical_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose decision is on record keep it, all others are resolved against the registry."""
    observed, *registry = _registry(spark, sf_dir)
    recorded = observed.where("id % 11 = 0").select("id", F.lit("RECORDED").alias("classification"))
    new = E.resolve(observed.join(recorded.select("id"), "id", "left_anti"), E.registry_tables(*registry)).select("id", "classification")
    return recorded.withColumn("replayed", F.lit(True)).unionByName(new.withColumn("replayed", F.lit(False)))


@query()
def e3_historical_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads imported in order into a registry that they build up; every thirteenth has a decision on record."""
    own = leads(spark, sf_dir).select(
        F.col("row_idx").cast("bigint").alias("row_idx"), T.registry_name_key(F.col("title")).alias("name"), "place", T.domain(F.col("webpage")).alias("domain"), T.phone_key(F.col("phone_number")).alias("phone"),
        F.concat_ws(" ", T.address_key(F.col("address")), (F.col("row_idx") % 97).cast("string")).alias("address"), F.when(F.col("row_idx") % 13 == 0, "IMPORTED").alias("recorded"),
    )
    return E.historical_import(own, "row_idx")


@query(f"WITH {_RESOLVED}, s(population) AS (VALUES ('history'), ('holdout')) SELECT population, split_part(r, '/', 1) AS classification, count(*) AS n, 0 AS unstable FROM d JOIN s ON population = 'history' OR id % 4 = 0 GROUP BY 1, 2")
def e10_replay_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all observations and over a holdout; each once more in another order and dealt otherwise, and the classes that differ are counted."""
    observed, branches, companies, history = _registry(spark, sf_dir)
    tables, dealt = E.registry_tables(branches, companies, history), E.registry_tables(branches.repartition("kind", "branch"), companies, history)
    out = None
    for population, rows in (("history", observed), ("holdout", observed.where("id % 4 = 0"))):
        once = E.resolve(rows, tables).select("id", "classification")
        again = E.resolve(rows.repartition("phone", "id").sortWithinPartitions(F.desc("id")), dealt).select("id", F.col("classification").alias("again"))
        counted = once.join(again, "id").groupBy("classification").agg(F.count("*").alias("n"), F.count_if(F.col("classification") != F.col("again")).cast("int").alias("unstable"))
        counted = counted.select(F.lit(population).alias("population"), "classification", "n", "unstable")
        out = counted if out is None else out.unionByName(counted)
    return out
