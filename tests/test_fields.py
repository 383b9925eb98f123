from pyspark.sql import functions as F

from tessera.functions import fields as X
from tessera.functions import rules as R


def test_experience_in_two_languages():
    said = lambda t: [(x["minimum"], x["maximum"], x["preferred"], x["approximate"]) for x in R.read_experience(t)]
    assert said("Minimum of three years experience. 5+ years of work experience preferred.") == [(3, None, False, False), (5, None, True, False)]
    assert said("entre 2 et 4 ans d'expérience") == [(2, 4, False, False)]
    assert said("Vous avez environ dix ans") == [(10, None, False, True)]
    assert said("Une entreprise de 20 ans") == []
    assert said("20 ans, idéalement") == [(20, None, True, False)]
    assert said("2-3 years") == [(2, 3, False, False)]
    assert said("at least 4 years\nof fun; 6 years preferred") == [(4, None, False, False), (6, None, True, False)]
    assert said("") == []


def test_query_location(spark):
    schema = "intents array<struct<country:string,region_scope:string,remote:boolean,worldwide:boolean>>, country string, region string, policy string, anywhere boolean, europe boolean"
    rows = [
        ([], "France", "EUROPE", "ONSITE", False, False), ([("France", "", False, False)], "France", "EUROPE", "ONSITE", False, False), ([("France", "", True, False)], "France", "EUROPE", "ONSITE", False, False),
        ([("France", "", False, False)], "", "UNKNOWN", "UNKNOWN", False, False), ([("France", "", False, False), ("", "EUROPE", False, False)], "Poland", "EUROPE", "UNKNOWN", False, False),
        ([("Malta", "", False, False)], "Poland", "EUROPE", "UNKNOWN", True, False), (None, "", "UNKNOWN", "", False, False),
    ]
    df = spark.createDataFrame(rows, schema)
    found = [r.s for r in df.select(R.query_location(*[F.col(c) for c in df.columns]).alias("s")).collect()]
    assert found == ["NEUTRAL", "MATCH", "MISMATCH", "UNKNOWN", "MATCH", "MATCH", "NEUTRAL"]


def test_email_verdicts(spark):
    df = spark.createDataFrame([("NoReply@acme.test",), ("x" * 70 + "@acme.test",), ("Careers@acme.test",), ("a@cdn.png",)], "e string")
    assert [r.v.reason for r in df.select(X.email_verdict(F.col("e")).alias("v")).collect()] == ["automated_sender", "malformed_address", "business_role_address", "asset_address"]


def test_repairs_fill_and_clear(spark):
    df = spark.createDataFrame([(1, None, "Engineer", "x"), (2, "Cookie policy", "Login", "x"), (3, "Developer", "Engineer", "x")], "k int, title string, new_title string, source_title string")
    found = {r.k: (r.fixes, r.repair_status) for r in X.repairs(df, {"title": X.safe_title}).collect()}
    assert found[1][0]["title"].new_value == "Engineer" and found[1][1] == "SUCCESS"
    assert found[2][0]["title"].new_value == "" and found[2][0]["title"].source == "DETERMINISTIC_VALIDATION"
    assert found[3] == ({}, "NO_CHANGE")


def test_employer_statements(spark):
    df = spark.createDataFrame([("Join Acme. ACME is a company. On behalf of Client, hello.", "Acme"), (None, None), ("Join a.c+me now", "a.c+me")], "t string, c string")
    found = [[tuple(x) for x in r.f] for r in df.select(X.employer_statements(F.col("t"), F.col("c")).alias("f")).collect()]
    assert found[0][0] == ("Acme", "EXPLICIT_JOB_EMPLOYER_STATEMENT") and all(v.lower() != "client" for v, _ in found[0])
    assert found[1] == [] and found[2] == [("a.c+me", "EXPLICIT_JOB_EMPLOYER_STATEMENT")]


def test_outreach_sent_stays_sent(spark):
    history = spark.createDataFrame([("https://www.a.test/x", "sent", 5), ("b.test", "odd", None)], "domain string, send_status string, sent_at int")
    marks = spark.createDataFrame([("a.test", "FAILED", 9), ("a.test", "SENT", 9), ("b.test", "SENT", 7), ("c.test", "FAILED", 1)], "domain string, mark string, at int")
    assert {r.domain: (r.send_status, r.sent_at) for r in X.outreach_history(history, marks).collect()} == {"a.test": ("SENT", 5), "b.test": ("SENT", 7), "c.test": ("FAILED", None)}
