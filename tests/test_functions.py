import random
import uuid

from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_clean_and_keys(spark):
    assert one(spark, "  A \t b ", T.clean) == "A b"
    assert one(spark, "N/A", T.clean) == ""
    assert one(spark, None, T.clean) == ""
    assert one(spark, "unknown", T.clean) == "unknown"
    assert one(spark, "unknown", lambda v: T.clean(v, T.REGISTRY_MISSING)) == ""
    assert one(spark, "Ａcme ﬁrm", T.registry_name_key) == "acme firm"
    assert one(spark, "É & Co. 7", T.outreach_name_key) == "éco7"
    assert one(spark, "+216 71-000", T.phone_key) == "21671000"
    assert one(spark, "12-34", T.phone_key) == ""


def test_domains(spark):
    assert one(spark, "HTTPS://user@WWW.Acme.test:8080/x?y", T.domain) == "acme.test"
    assert one(spark, "acme.test./a", T.domain) == "acme.test"
    assert one(spark, None, T.domain) == ""
    assert one(spark, "a.gmail.com", T.trustworthy_domain) is False
    assert one(spark, "acme.test", T.trustworthy_domain) is True


def test_job_url(spark):
    cases = {
        "HTTP://Jobs.Test:80/a/b/?utm_x=1&b=2&A=3&a=1#f": "http://jobs.test/a/b?a=1&A=3&b=2",
        "jobs.test": "https://jobs.test/",
        "mailto:x@y": "",
        "https://jobs.test:8443/x?q=a%20b&ref=z": "https://jobs.test:8443/x?q=a+b",
        "": "",
    }
    for url, wanted in cases.items():
        assert one(spark, url, T.job_url) == wanted, url


def test_emails(spark):
    assert one(spark, "x a@b.test; c@d.test", lambda v: F.array_join(T.emails(v), ",")) == "a@b.test,c@d.test"
    for address, good in {"a@b.test": True, "user@b.test": False, "x@example.com": False, "logo@2x.png": False, "a@b": False}.items():
        assert one(spark, address, T.valid_email) is good, address


def test_uuid5_is_the_standard_one(spark):
    space = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    random.seed(3)
    names = ["".join(random.choices("abcé|7 ", k=random.randint(0, 20))) for _ in range(300)]
    rows = spark.createDataFrame([(n,) for n in names], "v string").select("v", ids.uuid5(space, F.col("v")).alias("id")).collect()
    assert all(r.id == str(uuid.uuid5(space, r.v)) for r in rows)


def test_trimmed_and_attempts(spark):
    assert one(spark, "one two three", lambda v: T.trimmed(v, 8)) == "one two"
    assert one(spark, "abcdefghij", lambda v: T.trimmed(v, 4)) == "abcd"
    assert one(spark, "-3", T.attempts) == 0
    assert one(spark, "x", T.attempts) == 0
    assert one(spark, "4", T.attempts) == 4
