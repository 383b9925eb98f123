"""Queries: geography, places, providers, contact strategy and qualification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as P
from ..sources.tables import table
from .registry import query


def _pick(key: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _case(key: str, values: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN {repr(v) if v is not None else 'NULL'}" for i, v in enumerate(values)) + " END"


def _cases(name: str, key: str, column: str, inputs: tuple, wanted: tuple, f):
    """A query over a table's keys, whose inputs and results are listed side by side."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).select(key, _pick(F.col(key), inputs).alias("_in")).select(key, f(F.col("_in")).alias(column))

    return query(f"SELECT {key}, {_case(key, wanted)} AS {column} FROM {name}"), run


def _add(title: str, *args) -> None:
    add, run = _cases(*args)
    run.__name__ = title
    add(run)


_add("f24_lead_country", "customer", "c_custkey", "country", ("Royaume-Uni", " SUISSE ", "tn", "Paris, France", "n/a", "u.k."), ("United Kingdom", "Switzerland", "Tunisia", "", "", "United Kingdom"), P.lead_country)
_add("f24_query_geography", "customer", "c_custkey", "location", ("web agency Paris France", "software France", "france or belgium", "http://x.test/france", "agence Saint-Denis, belgique", "gardener"), ("Paris, France", "France", "", "", "Saint-Denis, Belgium", ""), lambda c: P.query_geography(c)["location"])
_add("f26_job_region", "customer", "c_custkey", "region", ("Berlin, Germany", "Remote (US)", "Tunis", "Bangalore, India", "", "Zürich, Schweiz", "Brussels"), ("EUROPE", "UNITED_STATES", "TUNISIA", "OTHER", "UNKNOWN", "UNKNOWN", "EUROPE"), lambda c: P.job_geography(c, F.lit(""), F.lit(""), F.lit(""))["region"])
_add("f13_place_id", "customer", "c_custkey", "place", ("ChIJabc", "cid:9", "https://maps.test/?cid=12&x=1", "https://www.google.com/maps/place/A/data=!3m1!1s0x1:0x2!8m2", "https://g.test/?query_place_id=ChIJQ", "https://www.google.com/maps/place/B/data=!1sChIJz", "", "https://x.test/y"), ("place_id:chijabc", "cid:9", "cid:12", "data:0x1:0x2", "place_id:chijq", "place_id:chijz", "", ""), P.place_id)
_add("f14_provider", "customer", "c_custkey", "provider", ("https://jobs.lever.co/acme/1", "https://boards.greenhouse.io/acme", "https://acme.teamtailor.com/jobs/1", "https://teamtailor.com", "https://acme.test", "https://apply.workable.com/x"), ("lever", "greenhouse", "teamtailor", "generic", "generic", "workable"), P.provider)
_add("f14_tenant", "customer", "c_custkey", "tenant", ("https://jobs.lever.co/acme/1", "https://boards.greenhouse.io/acme?x", "https://acme.test"), ("acme", "acme", ""), P.tenant)
_add("f15_source_quality", "customer", "c_custkey", "quality", ("https://jobs.lever.co/acme/1", "https://www.indeed.com/x", "https://acme.test", "https://uk.linkedin.com/jobs"), ("ATS", "JOB_PLATFORM", "UNKNOWN", "JOB_PLATFORM"), P.source_quality)
_add("f35_company_size", "customer", "c_custkey", "size", ("We are 30 people", "over 12,000 employees and 10 people", "an early-stage startup", "120+ team members", ""), ("SMALL", "LARGE", "SMALL", "STANDARD", "STANDARD"), P.company_size)
_add("f12_unwrap_redirect", "customer", "c_custkey", "url", ("https://www.google.com/url?q=https%3A%2F%2Facme.test%2Fa&sa=U", "https://acme.test/url?q=x", "https://google.fr/url?sa=t&url=https%3A%2F%2Fgoogle.com%2Furl%3Fq%3Dhttps%253A%252F%252Fb.test"), ("https://acme.test/a", "https://acme.test/url?q=x", "https://b.test"), P.unwrapped)
_add("f11_origin", "customer", "c_custkey", "origin", ("HTTPS://WWW.Acme.test/a?b", "acme.test/x", ""), ("https://www.acme.test/", "https://acme.test/", ""), P.origin)

TARGET, POSSIBLE, NOISE = ("software", "web agency"), ("marketing", "consulting"), ("restaurant", "hotel")


@query(f"""
WITH c AS (SELECT c_custkey AS k, {_case('c_custkey', ('Software company', 'Restaurant', 'Marketing-agency', 'Bakery', 'Softwares'))} AS category, {_case('c_custkey // 5', ('Acme web agency', 'Acme', ''))} AS name, {_case('c_custkey', ('web agency paris', 'bakery'))} AS q FROM customer)
SELECT k, CASE WHEN category = 'Restaurant' THEN 'NOISE' WHEN category = 'Software company' OR name LIKE '%web agency' THEN 'TARGET' WHEN category = 'Marketing-agency' OR (name <> '' AND q LIKE 'web agency%') THEN 'POSSIBLE' ELSE 'NOISE' END AS relevance FROM c
""")
def f27_maps_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), _pick(k, ("Software company", "Restaurant", "Marketing-agency", "Bakery", "Softwares")).alias("category"), _pick(F.floor(k / 5), ("Acme web agency", "Acme", "")).alias("name"), _pick(k, ("web agency paris", "bakery")).alias("q"))
    return rows.select("k", P.maps_relevance(F.col("category"), F.col("name"), F.col("q"), TARGET, POSSIBLE, NOISE).alias("relevance"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, {_case('c_custkey', ('EARLY_CAREERS', 'SPECIALIZED_ENGINEERING', 'OTHER', 'SOFTWARE_ENGINEERING'))} AS family, {_case('c_custkey', ('SMALL', 'LARGE', 'STANDARD'))} AS size FROM customer)
SELECT k, CASE WHEN family = 'EARLY_CAREERS' THEN 'Early Careers Recruiter' WHEN size = 'SMALL' THEN 'CTO' WHEN size = 'LARGE' THEN 'Technical Recruiter' ELSE 'Engineering Manager' END AS primary_role,
 CASE WHEN family = 'EARLY_CAREERS' THEN 'Engineering Manager' WHEN size = 'SMALL' THEN 'VP Engineering;Technical Founder' WHEN size = 'LARGE' THEN 'Engineering Manager;Talent Acquisition Partner' WHEN family = 'SPECIALIZED_ENGINEERING' THEN 'Head of Engineering;Technical Recruiter' ELSE 'Technical Recruiter' END AS secondary FROM c
""")
def r13_contact_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    roles = P.contact_roles(_pick(k, ("EARLY_CAREERS", "SPECIALIZED_ENGINEERING", "OTHER", "SOFTWARE_ENGINEERING")), _pick(k, ("SMALL", "LARGE", "STANDARD")))
    return table(spark, sf_dir, "customer").select(k.alias("k"), roles.alias("r")).select("k", F.col("r.primary").alias("primary_role"), F.array_join("r.secondary", ";").alias("secondary"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, {_case('c_custkey', ('software house', 'hotel', 'consulting', 'bakery'))} AS about, c_custkey % 3 <> 0 AS email, c_custkey % 11 = 0 AS conflict FROM customer)
SELECT k, CASE WHEN about = 'hotel' THEN 'INELIGIBLE' WHEN conflict THEN 'REVIEW' WHEN about = 'software house' AND email THEN 'ELIGIBLE' WHEN about IN ('software house', 'consulting') THEN 'REVIEW' ELSE 'INELIGIBLE' END AS eligibility FROM c
""")
def r5_maps_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    about = _pick(k, ("software house", "hotel", "consulting", "bakery"))
    relevance = P.maps_relevance(about, F.lit(""), F.lit(""), TARGET, POSSIBLE, NOISE)
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), relevance.alias("relevance"), P.phrase_match(about, NOISE).alias("noise"), (k % 3 != 0).alias("email"), (k % 11 == 0).alias("conflict"))
    eligibility = (
        F.when(F.col("noise"), "INELIGIBLE").when(F.col("conflict"), "REVIEW").when((F.col("relevance") == "TARGET") & F.col("email"), "ELIGIBLE").when(F.col("relevance") != "NOISE", "REVIEW").otherwise("INELIGIBLE")
    )
    return rows.select("k", eligibility.alias("eligibility"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'NO_GEOGRAPHY' WHEN s_nationkey % 5 = 0 THEN 'MATCH' WHEN s_nationkey % 5 = 1 THEN 'UNKNOWN' ELSE 'MISMATCH' END AS intent FROM supplier
""")
def f18_query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any query whose country is the job's makes a match; a job without a country is unknown; queries without one are neutral."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey") % 5
    wanted = P.query_geography(F.when(k % 2 == 0, "gardener").otherwise("engineer france"))["country"]
    own = P.job_geography(F.when(n == 0, "Lyon, France").when(n == 1, "").otherwise("Berlin, Germany"), F.lit(""), F.lit(""), F.lit(""))["country"]
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(wanted == "", "NO_GEOGRAPHY").when(wanted == own, "MATCH").when(own == "", "UNKNOWN").otherwise("MISMATCH").alias("intent"))
