"""Aggregates in which what was not measured never turns into zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def available_sum(column: str | Column) -> Column:
    """A1: the sum, or null if any value is null or there are no rows."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def ratio(part: str, whole: str) -> Column:
    """Null if either is null or the whole is 0."""
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def first_text(values: Column, order: Column) -> Column:
    """The first non-blank value by order."""
    return F.min_by(values, F.when(F.coalesce(values, F.lit("")) != "", order))


def ordered_distinct(values: str, order: str) -> Column:
    """Texts distinct but for case, in order of first sight and with their first spelling."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(values))))
    seen = F.transform(pairs, lambda p: p[values])
    lower = F.transform(seen, lambda v: F.lower(v))
    return F.filter(seen, lambda v, i: (F.coalesce(v, F.lit("")) != "") & (F.array_position(lower, F.lower(v)) == i + 1))


def query_performance(rows: DataFrame, metrics: list[str], key: str = "source_query", run: str = "run_id", category: str | None = None, order: str | None = None) -> DataFrame:
    """A2: per query the distinct runs and the available sums, with the first category that is not null."""
    extra = [F.min_by(category, F.when(F.col(category).isNotNull(), F.col(order))).alias(category)] if category and order else []
    return rows.groupBy(key).agg(F.count_distinct(run).alias("runs_seen"), *[available_sum(m).alias(m) for m in metrics], *extra)


def gated_outcomes(primary: DataFrame, expected: DataFrame, key: str, status: str, statuses: dict[str, str]) -> DataFrame:
    """A3: counts per status of the primary rows of a key; all null unless every row is decided and there are as many as expected. Expected 0 gives zeros."""
    counts = primary.groupBy(key).agg(F.count("*").alias("_rows"), F.count(status).alias("_decided"), *[F.count_if(F.col(status) == s).alias(n) for n, s in statuses.items()])
    joined = expected.join(counts, key, "left")
    whole = (F.col("_rows") == F.col("expected")) & (F.col("_decided") == F.col("_rows"))
    return joined.select(key, "expected", *[F.when(F.col("expected") == 0, 0).when(whole, F.col(n)).cast("bigint").alias(n) for n in statuses])


def recommend_query(df: DataFrame) -> DataFrame:
    """DROP, KEEP or REVIEW with ordered reasons from the metrics of a query."""
    good, noisy, failing, dear = 0.05, 0.80, 0.50, 120.0
    rates = {"candidate_yield": ("job_candidates", "results_inspected"), "noise_rate": ("rejected_noise", "results_inspected"), "failure_rate": ("resolution_failures", "results_inspected"), "seconds_per_new": ("duration_seconds", "new_jobs")}
    df = df.withColumns({n: ratio(*x) for n, x in rates.items()})
    is_true = lambda c: F.coalesce(c, F.lit(False))
    noise, failure = is_true(F.col("noise_rate") >= noisy), is_true(F.col("failure_rate") >= failing)
    useful = is_true(F.col("shortlisted_jobs") > 0)
    nothing = is_true(F.col("new_jobs") == 0) | is_true((F.col("pass_jobs") == 0) & (F.col("high_reviews") == 0) & (F.col("shortlisted_jobs") == 0) & F.col("new_jobs").isNotNull())
    drop_sample = (F.col("runs_seen") >= 2) & is_true(F.col("results_inspected") >= 20)
    keep_sample = (F.col("runs_seen") >= 2) & is_true(F.col("results_inspected") >= 10) & is_true(F.col("new_jobs") >= 2)
    good_yield = is_true(F.col("candidate_yield") >= good)
    cheap = is_true((F.col("noise_rate") < noisy) & (F.col("failure_rate") < failing))
    verdict = F.when(drop_sample & is_true(F.col("new_jobs") == 0) & (noise | failure), "DROP").when(keep_sample & useful & cheap & good_yield, "KEEP").otherwise("REVIEW")
    reasons = F.array_compact(
        F.array(
            F.when(good_yield, "QUERY_GOOD_JOB_YIELD"),
            F.when(useful, "QUERY_SHORTLIST_YIELD"),
            F.when(noise, "QUERY_HIGH_NOISE"),
            F.when(failure, "QUERY_HIGH_RESOLUTION_FAILURE"),
            F.when(is_true(F.col("seconds_per_new") >= dear), "QUERY_EXPENSIVE"),
            F.when(nothing, "QUERY_NO_USEFUL_OUTCOMES"),
            F.when(~drop_sample & ~keep_sample, "QUERY_INSUFFICIENT_SAMPLE"),
        )
    )
    return df.withColumns({"recommendation": verdict, "reasons": reasons})


def recommend_strategy(df: DataFrame) -> DataFrame:
    """Maturity, recommendation and ordered reasons."""
    enough = (F.col("runs_seen") >= 2) & F.coalesce(F.col("results_inspected") >= 10, F.lit(False))
    core = F.col("new_jobs").isNotNull() & F.col("rejected_noise").isNotNull() & F.col("resolution_failures").isNotNull()
    maturity = F.when(~enough, "INSUFFICIENT").when((F.col("runs_seen") >= 3) & (F.col("results_inspected") >= 30) & core, "MATURE").otherwise("EARLY")
    df = df.withColumns({"maturity": maturity, "new_job_yield": ratio("new_jobs", "results_inspected"), "noise_rate": ratio("rejected_noise", "results_inspected"), "failure_rate": ratio("resolution_failures", "results_inspected")})
    missing = F.col("new_job_yield").isNull() | F.col("noise_rate").isNull() | F.col("failure_rate").isNull()
    noisy, failing = F.col("noise_rate") >= 0.80, F.col("failure_rate") >= 0.50
    bad = noisy | failing
    known, positive = F.col("shortlisted_jobs").isNotNull(), F.coalesce(F.col("shortlisted_jobs") > 0, F.lit(False))
    retire = (F.col("maturity") == "MATURE") & (F.col("new_job_yield") <= 0.01) & (bad | (known & ~positive))
    expand = (F.col("new_jobs") >= 2) & (F.col("new_job_yield") >= 0.08) & ~bad & (~known | positive)
    keep = (F.col("new_jobs") >= 1) & (F.col("new_job_yield") >= 0.03) & ~bad
    verdict = F.when((F.col("maturity") == "INSUFFICIENT") | missing, "REVIEW").when(retire, "RETIRE_CANDIDATE").when(expand, "EXPAND").when(keep, "KEEP").otherwise("REVIEW")
    costs = F.array_compact(F.array(F.when(noisy, "STRATEGY_HIGH_NOISE"), F.when(failing, "STRATEGY_HIGH_RESOLUTION_FAILURE")))
    one = lambda *reasons: F.array(*map(F.lit, reasons))
    reasons = (
        F.when(F.col("maturity") == "INSUFFICIENT", one("STRATEGY_INSUFFICIENT_EVIDENCE"))
        .when(missing, one("STRATEGY_METRICS_UNAVAILABLE"))
        .when(retire, F.concat(costs, one("STRATEGY_MATURE_PERSISTENT_POOR_VALUE")))
        .when(expand, F.concat(costs, one("STRATEGY_PRODUCTIVE_QUERY", "STRATEGY_EXPANSION_WARRANTED")))
        .when(keep, one("STRATEGY_USEFUL_YIELD", "STRATEGY_ACCEPTABLE_COST"))
        .otherwise(F.concat(costs, one("STRATEGY_MIXED_OR_LOW_VALUE")))
    )
    return df.withColumns({"recommendation": verdict, "reasons": reasons})


def histogram(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    """A9."""
    return df.groupBy(key).agg(F.count("*").alias(count))


def multi_axis(df: DataFrame, axes: list[str], aggs: list[Column]) -> DataFrame:
    """A5: the same aggregates by each axis alone, in one pass: axis, value and the aggregates."""
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes]))
    return df.withColumn("_side", sides).groupBy(F.col("_side.axis").alias("axis"), F.col("_side.value").alias("value")).agg(*aggs)
