"""Queries: the row rules over postings made from orders, and page parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..sources import html
from ..sources.tables import table
from .registry import query

#: titles with what stands in them: target role, unwanted role, senior, junior, unwanted stack, word of such a stack
TITLES = (
    ("Senior Software Engineer", True, None, True, False, None, False), ("Junior Python Developer", True, None, False, True, None, False), ("Product Owner", False, "REJECT_ROLE_PRODUCT", False, False, None, False),
    ("Sales and Web Developer", True, "REJECT_ROLE_SALES", False, False, None, False), ("DevOps", False, "REJECT_ROLE_DEVOPS", False, False, None, False), ("Gardener", False, None, False, False, None, False),
    ("Graduate Data Analyst", False, "REJECT_ROLE_DATA", False, True, None, False), ("React Engineer", True, None, False, False, None, False), ("SAP Consultant", False, "REJECT_ROLE_CONSULTING", False, False, None, False),
    ("SAP Developer", False, "REJECT_ROLE_SAP", False, False, None, False), ("Machine Learning Researcher", False, "REJECT_ROLE_NON_SOFTWARE", False, False, None, False), ("UX Designer", False, "REJECT_ROLE_DESIGN", False, False, None, False),
    ("QA Lead", False, "REJECT_ROLE_QA", True, False, None, False), ("Site Reliability Engineer", False, "REJECT_ROLE_SRE", False, False, None, False), ("Network Engineer", False, "REJECT_ROLE_NETWORK", False, False, None, False),
    ("IT Support", False, "REJECT_ROLE_IT_SUPPORT", False, False, None, False), ("Embedded Engineer C++", False, "REJECT_ROLE_EMBEDDED", False, False, "REJECT_STACK_EMBEDDED_CPP", True),
    ("ServiceNow Developer", False, "REJECT_ROLE_SERVICENOW", False, False, "REJECT_STACK_SERVICENOW", True), ("Cybersecurity Analyst", False, "REJECT_ROLE_CYBERSECURITY", False, False, None, False),
    ("System Administrator", False, "REJECT_ROLE_SYSADMIN", False, False, None, False), ("Android Developer", False, "REJECT_ROLE_MOBILE_ONLY", False, False, None, False),
    ("Mainframe COBOL Programmer", True, None, False, False, "REJECT_STACK_MAINFRAME_COBOL", True), ("Salesforce Developer", False, None, False, False, "REJECT_STACK_SALESFORCE", True),
    ("Unity Game Developer", False, None, False, False, "REJECT_STACK_UNITY", True), ("SAP ABAP Analyst", False, None, False, False, "REJECT_STACK_SAP_ABAP", True), ("Python Developer with Salesforce", True, None, False, False, None, True),
    ("Développeuse Full Stack", True, None, False, False, None, False), ("Software Engineer I", True, None, False, True, None, False), ("Mainframe COBOL Analyst", False, None, False, False, "REJECT_STACK_MAINFRAME_COBOL", True),
    ("SOC Analyst", False, "REJECT_ROLE_NON_SOFTWARE", False, False, None, False),
)
#: texts with the years asked for, the years preferred, and what else they say
TEXTS = (
    ("", None, None, ""), ("At least 2 years of experience with Python and SQL.", 2, None, ""), ("5+ years experience required; remote worldwide.", 5, None, "worldwide"),
    ("3 years of professional experience. Hybrid.", 3, None, ""), ("No visa sponsorship. 4 years experience.", 4, None, "unsponsored"), ("Relocation is provided, Docker and Git. On-site.", None, None, "sponsors relocation"),
    ("10 years experience preferred, Node.js", None, 10, ""), ("Expérience de trois ans minimum. US only.", 3, None, "us"), ("Vous justifiez d’environ 5 ans d’expérience professionnelle.", 5, None, ""),
    ("Entre deux et quatre ans. Canada residents only.", 2, None, "canada"), ("Two to four years experience would be a plus; 6 years preferred.", None, 6, ""),
    ("You must be authorized to work in the EU. Remote in Tunisia.", None, None, "authorised tunisia"), ("Remote within the EU; 1 an minimum.", 1, None, "europe"), ("Depuis 3 ans nous grandissons.", None, None, ""),
    ("Open to candidates worldwide, this role is remote.", None, None, "worldwide"), ("Relocation is offered. 1 to 2 years experience", 1, None, "relocation"),
)
_PICK = lambda values, key: "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
JOBS = f"""
SELECT o_orderkey AS job_id, {_PICK([t[0] for t in TITLES], 'o_orderkey')} AS title, {_PICK([t[0] for t in TEXTS], 'o_custkey')} AS description, '' AS location_text,
  {_PICK(('France', 'Tunisia', 'United States', 'Poland', '', 'Canada'), '(o_orderkey + o_custkey)')} AS country, {_PICK(('EUROPE', 'TUNISIA', 'UNITED_STATES', 'EUROPE', 'UNKNOWN', 'OTHER'), '(o_orderkey + o_custkey)')} AS region,
  {_PICK(('', 'remote', ''), 'o_orderkey')} AS remote_policy, o_orderdate AS published_at, 'OPEN' AS status, {_PICK(('MISMATCH', 'UNKNOWN', 'MATCH', *['NEUTRAL'] * 8), 'o_custkey')} AS query_state, o_orderkey % 97 = 0 AS listing FROM {{orders}}
"""
NOW = "1998-06-01 00:00:00"
JOBS_CTE = "jobs AS (" + JOBS.format(orders="orders") + ")"


def jobs(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """dealt: the keys go to all cores first, as what is to be done with a row takes far longer than to read it and a small file is one task."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return spark.sql(JOBS, orders=orders.repartition("o_orderkey") if dealt else orders)


_value = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool | int) else f"'{v}'"
_table = lambda rows: ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
_FACTS = f"""titles(title, role, other, senior, junior, stack, word) AS (VALUES {_table(TITLES)}), texts(description, years, optional, says) AS (VALUES {_table(TEXTS)}),
said AS (SELECT *, contains(says, 'sponsors') AS sponsors, contains(says, 'unsponsored') AS unsponsored, contains(says, 'authorised') AS permit, contains(says, 'worldwide') AS worldwide, contains(says, 'europe') AS europe_said,
 contains(says, 'relocation') AS relocation, contains(says, 'canada') AS canada, regexp_matches(says, '(^| )us( |$)') AS us_said, contains(says, 'tunisia') AS tunisia_said FROM texts),
facts AS (SELECT jobs.*, role, other, senior, junior, stack, word, years, optional, sponsors, worldwide, relocation, region = 'TUNISIA' OR tunisia_said AS tunisia, region = 'EUROPE' OR europe_said AS europe, us_said OR region = 'UNITED_STATES' AS us, canada,
 permit OR (unsponsored AND region <> 'TUNISIA') AS unauthorised, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(published_at)) / 86400) AS BIGINT) AS days, country IN ('France', 'Belgium', 'Switzerland', 'Ireland', 'United Kingdom', 'Canada') AS preferred FROM jobs JOIN titles USING (title) JOIN said USING (description))"""
_HARD = """concat_ws(',', CASE WHEN listing THEN 'GENERIC_JOB_LISTING_PAGE' END, CASE WHEN unauthorised AND NOT sponsors THEN 'REJECT_WORK_AUTHORIZATION' END, CASE WHEN NOT role THEN other END, CASE WHEN NOT role THEN stack END, CASE WHEN senior THEN 'REJECT_SENIORITY' END,
 CASE WHEN years >= 5 THEN 'REJECT_EXPERIENCE_5_PLUS' WHEN years = 4 THEN 'REJECT_EXPERIENCE_4_PLUS' END, CASE WHEN days > 60 THEN 'REJECT_STALE_JOB' END,
 CASE WHEN sponsors OR worldwide THEN NULL WHEN us THEN 'REJECT_LOCATION_US_ONLY' WHEN canada THEN 'REJECT_LOCATION_CANADA_ONLY' END, CASE WHEN query_state = 'MISMATCH' THEN 'REJECT_QUERY_LOCATION_MISMATCH' END)"""
_REVIEW = """concat_ws(',', CASE WHEN query_state = 'UNKNOWN' THEN 'REVIEW_QUERY_LOCATION_UNKNOWN' END, CASE WHEN other IS NOT NULL AND role THEN 'REVIEW_ROLE_MIXED' WHEN other IS NULL AND NOT role THEN 'REVIEW_ROLE_UNCLEAR' END, CASE WHEN years = 3 THEN 'REVIEW_EXPERIENCE_3_YEARS' END,
 CASE WHEN optional >= 4 THEN 'REVIEW_EXPERIENCE_PREFERRED' END, CASE WHEN worldwide OR tunisia THEN NULL WHEN preferred THEN 'REVIEW_LOCATION_PREFERRED_MARKET' WHEN europe THEN 'REVIEW_LOCATION_EUROPE' WHEN relocation THEN 'REVIEW_RELOCATION_POSSIBLE'
 WHEN country = '' AND query_state <> 'UNKNOWN' THEN 'REVIEW_LOCATION_UNKNOWN' END, CASE WHEN role AND (word OR stack IS NOT NULL) THEN 'REVIEW_STACK_MIXED' END, CASE WHEN description = '' THEN 'REVIEW_DESCRIPTION_MISSING' END, CASE WHEN days < 0 THEN 'REVIEW_INVALID_PUBLISHED_DATE' WHEN days > 30 AND days <= 60 THEN 'REVIEW_OLD_JOB' END)"""
_PASS = """concat_ws(',', CASE WHEN junior AND NOT senior THEN 'PASS_JUNIOR_ROLE' END, CASE WHEN other IS NULL AND role THEN 'PASS_RELEVANT_ROLE' END, CASE WHEN years <= 2 THEN 'PASS_EXPERIENCE_0_2' END, CASE WHEN worldwide THEN 'PASS_REMOTE_WORLDWIDE' WHEN tunisia THEN 'PASS_LOCATION_TUNISIA' END, CASE WHEN days BETWEEN 0 AND 14 THEN 'PASS_FRESH_JOB' END)"""
_DECIDED = f"WITH {JOBS_CTE}, {_FACTS}, told AS (SELECT *, {_HARD} AS h, {_REVIEW} AS r, {_PASS} AS p FROM facts), decided AS (SELECT *, CASE WHEN h <> '' THEN 'REJECT' WHEN r <> '' THEN 'REVIEW' ELSE 'PASS' END AS decision, coalesce(nullif(concat_ws(',', nullif(h, ''), nullif(r, ''), nullif(p, '')), ''), 'PASS_NO_HARD_FILTER') AS reasons FROM told)"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hard_filter(jobs(spark, sf_dir, dealt=True).withColumn("published_at", F.col("published_at").cast("timestamp")), F.lit(NOW).cast("timestamp"))


@query(f"{_DECIDED} SELECT job_id, decision AS status, split_part(reasons, ',', 1) AS primary_reason, reasons FROM decided")
def r1_hard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("job_id", "status", "primary_reason", F.array_join("reasons", ",").alias("reasons"))


@query(f"""{_DECIDED}, v AS (SELECT *, string_split(r, ',') AS codes, CASE job_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END AS strength, (CASE WHEN job_id % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN country = '' THEN 1 ELSE 0 END) + (CASE WHEN description = '' THEN 1 ELSE 0 END) AS missing FROM decided WHERE decision = 'REVIEW')
SELECT job_id, CASE WHEN contains(p, 'PASS_RELEVANT_ROLE') AND len(codes) = 1 AND codes[1] IN ('REVIEW_EXPERIENCE_3_YEARS', 'REVIEW_EXPERIENCE_PREFERRED', 'REVIEW_LOCATION_PREFERRED_MARKET', 'REVIEW_LOCATION_EUROPE', 'REVIEW_RELOCATION_POSSIBLE') AND country <> '' AND length(description) >= 30 AND strength >= 3 THEN 'HIGH'
 WHEN contains(r, 'REVIEW_ROLE_UNCLEAR') OR NOT contains(p, 'PASS_RELEVANT_ROLE') OR len(codes) >= 3 OR (missing >= 3 AND strength = 0) THEN 'LOW' ELSE 'MEDIUM' END AS priority FROM v""")
def r2_review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("job_id")
    rows = _decided(spark, sf_dir).where("status = 'REVIEW'").select(
        "job_id", F.col("reasons").alias("codes"), "title", F.when(k % 4 == 0, "").otherwise("Firm").alias("company"), F.col("country").alias("location"),
        F.when(F.length("description") >= 30, F.rpad("description", 200, ".")).otherwise(F.col("description")).alias("description"), F.lit("").alias("provider"),
        F.when(k % 3 == 1, "ATS").otherwise("UNKNOWN").alias("source_type"), F.when(k % 3 == 0, "DIRECT").otherwise("UNKNOWN").alias("relationship"),
    )
    return R.review_priority(rows).select("job_id", "priority")


@query(f"""{_DECIDED}, x AS (SELECT *, CASE job_id % 7 WHEN 0 THEN 'INACTIVE' WHEN 1 THEN 'UNKNOWN' ELSE 'ACTIVE' END AS activity, CASE job_id % 5 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'UNKNOWN' ELSE 'CONFIRMED' END AS employer,
 CASE job_id % 6 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'UNKNOWN' ELSE 'CONFIRMED' END AS way, region = 'TUNISIA' OR contains(p, 'PASS_LOCATION_TUNISIA') OR contains(p, 'PASS_REMOTE_WORLDWIDE') AS eligible, job_id % 8 <> 0 AS known FROM decided),
y AS (SELECT *, listing OR query_state = 'MISMATCH' OR activity = 'INACTIVE' AS out FROM x)
SELECT job_id, CASE WHEN out THEN 'DISQUALIFIED' WHEN activity = 'ACTIVE' AND employer = 'CONFIRMED' AND way = 'CONFIRMED' AND eligible AND known THEN 'QUALIFIED' ELSE 'REVIEW' END AS qualification,
 concat_ws(',', CASE WHEN listing THEN 'DISQUALIFIED_LISTING_PAGE' END, CASE WHEN query_state = 'MISMATCH' THEN 'DISQUALIFIED_QUERY_MISMATCH' END, CASE activity WHEN 'INACTIVE' THEN 'DISQUALIFIED_POSTING_INACTIVE' WHEN 'ACTIVE' THEN 'QUALIFIED_ACTIVE_POSTING' ELSE 'REVIEW_ACTIVITY_UNKNOWN' END,
  CASE WHEN contains(p, 'PASS_RELEVANT_ROLE') THEN 'QUALIFIED_ROLE_CONFIRMED' END, CASE employer WHEN 'CONFIRMED' THEN 'QUALIFIED_EMPLOYER_CONFIRMED' WHEN 'CONFLICT' THEN 'REVIEW_EMPLOYER_CONFLICT' ELSE 'REVIEW_EMPLOYER_UNKNOWN' END,
  CASE way WHEN 'CONFIRMED' THEN 'QUALIFIED_APPLICATION_URL' WHEN 'CONFLICT' THEN 'REVIEW_APPLICATION_DESTINATION_CONFLICT' WHEN 'UNAVAILABLE' THEN 'REVIEW_APPLICATION_DESTINATION_UNAVAILABLE' ELSE 'REVIEW_APPLICATION_CHANNEL_UNKNOWN' END,
  CASE WHEN country <> '' THEN 'QUALIFIED_LOCATION_CONFIRMED' END, CASE WHEN NOT eligible THEN 'REVIEW_LOCATION_ELIGIBILITY_UNKNOWN' END, CASE WHEN NOT known THEN 'REVIEW_SOURCE_RELATIONSHIP_UNKNOWN' END) AS reasons FROM y""")
def r6_job_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("job_id")
    way = F.when(k % 6 == 0, "CONFLICT").when(k % 6 == 1, "UNAVAILABLE").when(k % 6 == 2, "UNKNOWN").otherwise("CONFIRMED")
    rows = _decided(spark, sf_dir).select(
        "job_id", F.col("reasons").alias("codes"), "listing", F.when(k % 7 == 0, "INACTIVE").when(k % 7 == 1, "UNKNOWN").otherwise("ACTIVE").alias("activity"),
        F.when(k % 5 == 0, "CONFLICT").when(k % 5 == 1, "UNKNOWN").otherwise("CONFIRMED").alias("employer"), way.alias("application"), F.when(way == "CONFIRMED", "https://apply.test/x").otherwise("").alias("application_url"),
        F.when(way == "CONFIRMED", "ATS").otherwise("UNKNOWN").alias("channel"), F.when(F.col("region") == "TUNISIA", "KNOWN").otherwise("PARTIAL").alias("location_status"), (F.col("country") != "").alias("has_location"),
        F.when(k % 8 != 0, "DIRECT").otherwise("").alias("relationship"),
    )
    return R.qualification(rows).select("job_id", "qualification", F.array_join("qualification_reasons", ",").alias("reasons"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 5 = 0 OR o_orderstatus = 'F' THEN 'INACTIVE' WHEN o_orderstatus = 'O' THEN 'ACTIVE' ELSE 'UNKNOWN' END AS activity FROM orders")
def r7_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "OPEN")
    error = F.when(F.col("o_orderkey") % 5 == 0, "HTTP 404 for page")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.activity(F.coalesce(state, F.lit("")), error, F.col("o_orderkey") % 3 != 0).alias("activity"))


@query("""
WITH e AS (SELECT l_orderkey AS k, CASE WHEN l_quantity < 5 THEN '' ELSE l_returnflag END AS v, l_linenumber AS rank FROM lineitem), b AS (SELECT k, min(rank) AS rank FROM e WHERE v <> '' GROUP BY k),
t AS (SELECT e.k, count(DISTINCT v) AS n, min(v) AS v FROM e JOIN b ON b.k = e.k AND b.rank = e.rank WHERE v <> '' GROUP BY e.k)
SELECT k, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n = 1 THEN 'CONFIRMED' ELSE 'CONFLICT' END AS status, CASE WHEN n = 1 THEN v END AS v FROM (SELECT DISTINCT k FROM e) LEFT JOIN t USING (k)
""")
def r9_employer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolvers that take the best-ranked evidence."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_quantity") < 5, "").otherwise(F.col("l_returnflag")).alias("v"), F.col("l_linenumber").alias("rank"))
    return R.agreement(rows, "k", "v", "rank")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'RECRUITER' WHEN c_custkey % 3 = 0 THEN 'UNKNOWN' WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' WHEN c_custkey % 2 = 1 THEN 'DIRECT' ELSE 'UNKNOWN' END AS resolved FROM customer
""")
def r12_source_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 0, "RECRUITER").otherwise("UNKNOWN").alias("relationship"), (k % 3 != 0).alias("is_ats"), F.when(k % 5 == 0, "").otherwise("Acme Tools Ltd").alias("company"), F.when(k % 2 == 1, "acme-tools").otherwise("other").alias("tenant"))
    return R.source_relationship(rows).select("c_custkey", "resolved")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CONTACT_REVIEW' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'EMAIL_DISCOVERY_READY' WHEN c_custkey % 3 = 1 AND c_custkey % 7 <> 0 THEN 'APPLY_ONLY' ELSE 'CONTACT_REVIEW' END AS outcome FROM customer")
def r15_contact_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (k % 5 != 0).alias("has_strategy"), (k % 2 == 0).alias("selected"), F.lit("HIGH").alias("confidence"), F.when(k % 3 == 0, "CONTACTS_SELECTED").when(k % 3 == 1, "NO_CONFIDENT_CONTACT").otherwise("PENDING").alias("discovery_status"), F.lit("CONFIRMED").alias("application_status"), F.when(k % 7 != 0, "https://x.test").alias("application_url"))
    return R.contact_outcome(rows).select("c_custkey", "outcome")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS i, o_orderstatus <> 'F' AS active, o_orderkey % 3 <> 0 AS qualified FROM orders), r AS (SELECT i, min(k) AS first FROM o WHERE active AND qualified GROUP BY i)
SELECT k, CASE WHEN NOT active THEN 'CLOSED' WHEN NOT qualified THEN 'NOT_QUALIFIED' WHEN k = first THEN 'READY' ELSE 'SKIPPED' END AS state FROM o LEFT JOIN r USING (i)
""")
def r16_application_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("i"), (F.col("o_orderstatus") != "F").alias("active"), (F.col("o_orderkey") % 3 != 0).alias("qualified"))
    return R.application_state(rows, "i", "k").select("k", "state")


QUERIES_OF = ("site:jobs.lever.co python", "site:careers.firm.test engineer", "laravel paris", "engineer france", "gardener", "  SITE:Boards.Greenhouse.io x")


@query(f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ATS_SCOPED' WHEN 1 THEN 'DIRECT_CAREERS' WHEN 2 THEN 'ROLE_TECH' WHEN 3 THEN 'ROLE_LOCATION' WHEN 4 THEN 'GENERIC' ELSE 'ATS_SCOPED' END AS query_class FROM part")
def f16_query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, QUERIES_OF)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.query_class(text).alias("query_class"))


@query(f"WITH {JOBS_CTE}, texts(description, years, optional, says) AS (VALUES {_table(TEXTS)}) SELECT job_id, years FROM jobs JOIN texts USING (description)")
def f28_required_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("job_id", R.required_years(F.col("description")).alias("years"))


@query(f"WITH {JOBS_CTE}, t AS (SELECT job_id, lower(title || ' ' || description) AS t FROM jobs) SELECT job_id, concat_ws(',', CASE WHEN t LIKE '%python%' THEN 'Python' END, CASE WHEN t LIKE '%react%' THEN 'React' END, CASE WHEN t LIKE '%node.js%' THEN 'Node.js' END, CASE WHEN t LIKE '%sql%' THEN 'SQL' END, CASE WHEN t LIKE '%docker%' THEN 'Docker' END, CASE WHEN t LIKE '%git%' THEN 'Git' END) AS technologies FROM t")
def f29_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("job_id", F.array_join(R.technologies(F.concat_ws(" ", "title", "description")), ",").alias("technologies"))


@query(f"WITH {JOBS_CTE} SELECT job_id, CASE WHEN remote_policy <> '' THEN 'REMOTE' WHEN description ILIKE '%hybrid%' THEN 'HYBRID' WHEN description ILIKE '%remote%' THEN 'REMOTE' WHEN description ILIKE '%on-site%' THEN 'ONSITE' ELSE 'UNKNOWN' END AS policy FROM jobs")
def f30_remote_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("job_id", R.remote_policy(F.col("remote_policy"), F.concat_ws(" ", "title", "description")).alias("policy"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<a [^>]*href=\"[^\"]')) AS n_links FROM pages")
def h1_page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parse_pages(table(spark, sf_dir, "pages")).select("page_id", "lang", "n_links")


@query()
def h4_page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parse_pages(table(spark, sf_dir, "pages"))


_BARE = "|".join(rf"<{e}\b.*?</{e}\s*>" for e in ("script", "style", "noscript", "template"))


@query(rf"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is){_BARE}|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages),
c AS (SELECT *, regexp_replace(t[1:401], '\s+\S*$', '') AS cut FROM t) SELECT page_id, CASE WHEN length(t) <= 400 THEN t WHEN length(cut) > 400 THEN t[1:400] ELSE cut END AS description FROM c
""")
def h5_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description of at most 400 characters, cut at a word, from the visible text."""
    from ..functions.text import trimmed

    return table(spark, sf_dir, "pages").select("page_id", trimmed(html.visible(F.col("html")), 400).alias("description"))
