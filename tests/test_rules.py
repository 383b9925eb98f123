from pyspark.sql import functions as F

from tessera.functions import places as P
from tessera.functions import rules as R
from tessera.operators import aggregates as A
from tessera.sources import html

JOB = "title string, description string, location_text string, country string, region string, remote_policy string, published_at timestamp, status string"


def decided(spark, **values):
    row = {"title": "Software Engineer", "description": "Python.", "location_text": "", "country": "Brazil", "region": "OTHER", "remote_policy": "", "published_at": None, "status": "OPEN"} | values
    df = spark.createDataFrame([tuple(row.values())], JOB)
    return R.hard_filter(df, F.lit("2026-01-31 00:00:00").cast("timestamp")).first()


def test_primary_reason_follows_precedence_not_discovery(spark):
    r = decided(spark, title="Senior DevOps", description="No visa sponsorship. 6 years of experience.")
    assert r.status == "REJECT"
    assert list(r.reasons) == ["REJECT_WORK_AUTHORIZATION", "REJECT_ROLE_DEVOPS", "REJECT_SENIORITY", "REJECT_EXPERIENCE_5_PLUS"]
    assert r.primary_reason == "REJECT_WORK_AUTHORIZATION"


def test_mixed_roles_are_reviewed(spark):
    r = decided(spark, title="Sales and Web Developer")
    assert (r.status, r.primary_reason) == ("REVIEW", "REVIEW_ROLE_MIXED")


def test_preferred_experience_does_not_reject(spark):
    r = decided(spark, description="5 years experience preferred")
    assert (r.status, r.primary_reason) == ("REVIEW", "REVIEW_EXPERIENCE_PREFERRED")
    assert decided(spark, description="at least 3 years of professional experience").primary_reason == "REVIEW_EXPERIENCE_3_YEARS"


def test_null_fields_are_blank(spark):
    r = decided(spark, title=None, description=None, location_text=None, country=None, remote_policy=None)
    assert list(r.reasons) == ["REVIEW_ROLE_UNCLEAR", "REVIEW_LOCATION_UNKNOWN", "REVIEW_DESCRIPTION_MISSING"]


def test_strategy_unavailable_is_not_zero(spark):
    schema = "source_query string, runs_seen bigint, results_inspected bigint, new_jobs bigint, rejected_noise bigint, resolution_failures bigint, shortlisted_jobs bigint"
    rows = [("a", 1, 100, 5, 0, 0, 1), ("b", 3, 100, 10, None, 0, 1), ("c", 3, 100, 10, 5, 0, 1), ("d", 3, 100, 0, 90, 0, 0), ("e", 3, 100, 4, 5, 0, None)]
    found = {r.source_query: (r.maturity, r.recommendation) for r in A.recommend_strategy(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"a": ("INSUFFICIENT", "REVIEW"), "b": ("EARLY", "REVIEW"), "c": ("MATURE", "EXPAND"), "d": ("MATURE", "RETIRE_CANDIDATE"), "e": ("MATURE", "KEEP")}


def test_country_codes_only_in_structured_fields(spark):
    df = spark.createDataFrame([("Engineer in US", "", "", ""), ("", "", "us", ""), ("", "Paris", "", ""), ("x", "", "", "Great Britain")], "title string, city string, country string, location string")
    found = [r.g.country for r in df.select(P.job_geography(F.col("location"), F.col("city"), F.col("country"), F.col("title")).alias("g")).collect()]
    assert found == ["", "United States", "France", "United Kingdom"]


PAGE = """<html lang="fr"><head><title>A &amp; B</title><meta property="og:title" content="Meta title">
<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Paris", "addressCountry": "FR"}}], "datePosted": "2026-01-01"}, {"@type": "Person", "name": "Ann"}]}</script>
<style>p { color: red }</style></head><body><h1>Head <b>line</b></h1><p>Text<a href="mailto:a@b.test?subject=x">mail</a><a href="https://www.linkedin.com/company/x">in</a><a href="/p">p</a>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<h1>only"), (5, '<script type="application/ld+json">{broken</script><title>T')], "page_id bigint, html string")
    found = {r.page_id: r for r in html.parse_pages(df).collect()}
    one = found[1]
    assert (one.title, one.lang, one.heading, one.n_links, list(one.mails), list(one.people)) == ("A & B", "fr", "Head line", 2, ["a@b.test"], ["Ann"])
    assert (one.job_title, one.title_source, one.company, one.city, one.country, one.published_at) == ("Dev", "JSON_LD", "Acme", "Paris", "FR", "2026-01-01")
    assert list(one.social) == ["https://www.linkedin.com/company/x"]
    assert found[2].job_title == found[3].job_title == "" and found[4].title_source == "HEADING" and found[5].title_source == "TITLE"
    text = df.where("page_id = 1").select(html.visible(F.col("html")).alias("t")).first().t
    assert "color" not in text and "JobPosting" not in text and "Head line" in text


def test_filter_on_status_works_nothing_out_again(spark):
    titles = ["Software Engineer", "Développeuse Full Stack", "Sales and Web Developer", "Gardener", "Programmeur", "Back-End Developers", "Unity Programmer", None]
    texts = ["Remote anywhere.", "WORLDWIDE remote", "remote anywhere in the office", "3 years of professional experience", "Worldwide customers", None]
    df = spark.createDataFrame([(t, d, "", c, "OTHER", "", None, "OPEN") for t in titles for d in texts for c in ("France", "")], JOB)
    all_rows = R.hard_filter(df, F.lit("2026-01-31 00:00:00").cast("timestamp"))
    patterns = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("(?iU)")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    assert 0 < patterns(all_rows.where("status = 'REVIEW'")) <= patterns(all_rows)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    key = lambda r: (r.title or "", r.description or "", r.country, r.status, tuple(r.reasons))
    assert sorted(map(key, all_rows.where("status = 'REVIEW'").collect())) == sorted(key(r) for r in all_rows.collect() if r.status == "REVIEW")


def test_one_role_is_as_good_as_the_list_of_roles(spark):
    titles = ["Software Engineer", "Développeuse Full Stack", "DÉVELOPPEUR web", "Programmers", "Gardener", "", "Node.js engineer", "front-end UI developer"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(F.size(R.relevant_roles(F.col("t"))).alias("n"), R.is_relevant(R.plain(F.col("t"))).alias("any"))
    assert [r.n > 0 for r in df.collect()] == [r.any for r in df.collect()] == [True, True, True, True, False, False, True, True]
