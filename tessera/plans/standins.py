"""Tables of the domain made from the driver's tables, by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

#: run and query telemetry: a run is a day, a query an event type; some measures are missing
RUNS = """
SELECT CAST(d AS STRING) AS run_id, event_type AS source_query, count(*) AS pages_inspected,
  CAST(sum(user_id) AS BIGINT) AS results_inspected, count(CASE WHEN value < 2 THEN 1 END) AS new_jobs,
  CASE WHEN event_type IN ('click', 'view') AND extract(day FROM d) % 7 = 0 THEN NULL ELSE count(CASE WHEN value > 60 THEN 1 END) END AS rejected_noise,
  count(CASE WHEN value > 150 THEN 1 END) AS resolution_failures, count(CASE WHEN value < 10 THEN 1 END) AS job_candidates,
  CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS duration_seconds, count(CASE WHEN value < 1 THEN 1 END) AS shortlisted_jobs,
  CASE WHEN extract(day FROM d) % 5 = 0 THEN NULL ELSE upper(event_type) END AS query_category, CAST(extract(day FROM d) AS INT) AS position
FROM (SELECT *, CAST(ts AS DATE) AS d FROM {events}) e GROUP BY d, event_type
"""

#: raw leads: a customer is a row; places, phones, hosts and names repeat
LEADS = """
SELECT c_custkey AS row_idx, concat('Company ', CAST(c_custkey % 400 AS STRING)) AS title,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'Not Available' ELSE concat('https://www.site', CAST(c_custkey % 350 AS STRING), '.test/about?x=1') END AS webpage,
  CASE WHEN c_custkey % 3 = 0 THEN concat('+216 71 ', CAST(100000 + c_custkey % 300 AS STRING)) ELSE '12-34' END AS phone_number,
  CASE WHEN c_custkey % 4 = 0 THEN concat('info@site', CAST(c_custkey % 350 AS STRING), '.test') WHEN c_custkey % 4 = 1 THEN 'user@gmail.com; sales@mail.test' ELSE '' END AS site_email,
  CASE WHEN c_custkey % 7 = 0 THEN concat('place', CAST(c_custkey % 210 AS STRING)) ELSE '' END AS place,
  concat('  ', CAST(c_nationkey AS STRING), ' Main  Street, ', c_mktsegment) AS address, c_mktsegment AS segment, c_nationkey AS nation
FROM {customer}
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS, events=table(spark, sf_dir, "events"))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEADS, customer=table(spark, sf_dir, "customer"))


RUNS_CTE = "runs AS (" + RUNS.format(events="events") + ")"
LEADS_CTE = "leads AS (" + LEADS.format(customer="customer") + ")"
