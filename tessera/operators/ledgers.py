"""Budgets, ledgers and state machines over ordered events.

Where the order of events decides, the fold is replaced by an equivalent over windows or minima, which is said in each docstring. What cannot be
replaced (a lease, whose holder depends on all events before) is folded per key in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted_within(events: DataFrame, run: str, order: str, commits: Column, limit: int) -> DataFrame:
    """Attempts in order; each takes a slot and gives it back unless it commits, and after ``limit`` commits of a run there is none left.

    So an attempt is let in up to the limit-th commit of its run. Only the first ``limit`` commits of a run are ranked.
    """
    ranked = events.where(commits).select(run, order, F.row_number().over(Window.partitionBy(run).orderBy(order)).alias("_n")).where(F.col("_n") <= limit)
    last = ranked.where(F.col("_n") == limit).select(run, F.col(order).alias("_last"))
    accepted = F.col("_last").isNull() | (F.col(order) <= F.col("_last"))
    return events.join(last, run, "left").withColumn("admitted", accepted).drop("_last")


def admitted_new(items: DataFrame, run: str, query: str, order: str, is_new: Column, run_limit: int, query_limit: int) -> DataFrame:
    """NEW items are admitted while both their run and their query have room; others never take any.

    A query admits its first ``query_limit`` NEW items until the run is full, and a full run stays full. So an item is admitted if it is among the
    first of its query, and among the first of its run within those.
    """
    of_query = F.row_number().over(Window.partitionBy(run, query).orderBy(order))
    of_run = F.row_number().over(Window.partitionBy(run).orderBy(order))
    first = items.where(is_new).select(run, query, order, of_query.alias("_q")).where(F.col("_q") <= query_limit)
    admitted = first.select(run, query, order, of_run.alias("_r")).where(F.col("_r") <= run_limit).select(run, query, order, F.lit(True).alias("admitted"))
    return items.join(admitted, [run, query, order], "left").withColumn("admitted", F.when(is_new, F.coalesce("admitted", F.lit(False))))


def ledger_state(events: DataFrame, key: str, state: str, order: str, running: str = "RUNNING") -> DataFrame:
    """Per key its latest state, how often it was started and when first. Ties in order go to the greater state."""
    return events.groupBy(key).agg(
        F.max_by(state, F.struct(order, state)).alias("state"), F.count_if(F.col(state) == running).alias("attempts"), F.min(F.when(F.col(state) == running, F.col(order))).alias("first_started")
    )


def resumable(plan: DataFrame, ledger: DataFrame, key: str, retryable: Iterable[str], config_hash: str) -> DataFrame:
    """T4: planned keys that are still to be run, from the offset after the last one stored; a ledger of another configuration refuses.

    plan: key, config_hash. ledger: key, state, next_offset. Keys without a ledger row start at 0.
    """
    state = F.coalesce("state", F.lit("PENDING"))
    joined = plan.join(ledger, key, "left").where(state.isin(*retryable))
    refused = F.col("config_hash") != F.lit(config_hash)
    return joined.select(key, state.alias("state"), F.when(~refused, F.coalesce("next_offset", F.lit(0))).alias("start_at"), F.when(refused, "REFUSED").otherwise("RESUMED").alias("outcome"))


def leases(beats: DataFrame, key: str, owner: str, at: str, seconds: int) -> DataFrame:
    """T5: heartbeats (at: seconds) of would-be writers. One is granted if the lease is free, its own, or run out; then it holds for ``seconds``.

    Per key: how many were granted and refused, how often the holder changed, and the last holder. A key's beats are folded in order in one place.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(owner).alias("owner"))))
    zero = F.struct(F.lit(None).cast("string").alias("holder"), F.lit(None).cast("bigint").alias("until"), F.lit(0).alias("granted"), F.lit(0).alias("refused"), F.lit(0).alias("changes"))

    def step(s, b):
        granted = s["holder"].isNull() | (s["holder"] == b["owner"]) | (s["until"] <= b["at"])
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(
            F.when(granted, b["owner"]).otherwise(s["holder"]).alias("holder"), F.when(granted, b["at"] + seconds).otherwise(s["until"]).alias("until"),
            (s["granted"] + one(granted)).alias("granted"), (s["refused"] + one(~granted)).alias("refused"),
            (s["changes"] + one(granted & s["holder"].isNotNull() & (s["holder"] != b["owner"]))).alias("changes"),
        )

    typed = beats.select(key, F.col(owner).cast("string").alias(owner), F.col(at).cast("bigint").alias(at))
    return typed.groupBy(key).agg(F.aggregate(ordered, zero, step).alias("s")).select(key, "s.granted", "s.refused", "s.changes", F.col("s.holder").alias("holder"))


# Allowed steps of a run and of an application.
RUN_STEPS = {"RUNNING": ("FINALIZING", "FAILED", "INTERRUPTED"), "FINALIZING": ("SUCCESS", "PARTIAL")}
APPLICATION_STEPS = {
    "READY_TO_APPLY": ("APPLYING", "APPLIED", "SKIPPED", "CLOSED_BEFORE_APPLY"),
    "APPLYING": ("APPLIED", "FAILED"),
    "FAILED": ("READY_TO_APPLY",),
    "APPLIED": ("WITHDRAWN",),
}


def allowed(before: Column, after: Column, steps: dict[str, tuple[str, ...]]) -> Column:
    pairs = F.lit(False)
    for state, targets in steps.items():
        pairs = pairs | ((before == state) & after.isin(*targets))
    return pairs


def checked_steps(history: DataFrame, key: str, state: str, order: str, steps: dict[str, tuple[str, ...]], start: str) -> DataFrame:
    """Each row with the state before it (``start`` for the first) and whether the step is allowed."""
    before = F.lag(state, 1, start).over(Window.partitionBy(key).orderBy(order))
    return history.withColumn("before", before).withColumn("valid", allowed(F.col("before"), F.col(state), steps))


def applied_steps(actions: DataFrame, requests: DataFrame, key: str, identity: str, steps: dict[str, tuple[str, ...]] = APPLICATION_STEPS) -> DataFrame:
    """One requested step per action (key, new_state): done, refused as not allowed, or blocked as another action of the same identity was applied.

    actions: key, identity, state. Gives the event log: key, old_state, new_state, outcome, and the state after.
    """
    taken = actions.where(F.col("state").isin("APPLIED", "APPLYING")).groupBy(identity).agg(F.min(key).alias("_least"), F.max(key).alias("_most"))
    joined = requests.join(actions, key).join(taken, identity, "left")
    another = F.col("_least").isNotNull() & ((F.col("_least") != F.col(key)) | (F.col("_most") != F.col(key)))
    outcome = F.when(~allowed(F.col("state"), F.col("new_state"), steps), "INVALID").when(F.col("new_state").isin("APPLYING", "APPLIED") & another, "DUPLICATE").otherwise("DONE")
    return joined.select(key, F.col("state").alias("old_state"), "new_state", outcome.alias("outcome"), F.when(outcome == "DONE", F.col("new_state")).otherwise(F.col("state")).alias("state"))


def relay_state(checks: DataFrame, key: str, order: str, failed: Column, window: int = 4, pause_after: int = 3, resume_after: int = 3) -> DataFrame:
    """PAUSED from the check at which ``pause_after`` of the last ``window`` failed until ``resume_after`` in a row succeeded; else DEGRADED with
    a failure among the last ones, HEALTHY without. The last check that starts or ends a pause decides."""
    w = Window.partitionBy(key).orderBy(order)
    fails = F.sum(F.when(failed, 1).otherwise(0))
    recent = fails.over(w.rowsBetween(1 - window, 0))
    calm = (fails.over(w.rowsBetween(1 - resume_after, 0)) == 0) & (F.row_number().over(w) >= resume_after)
    turn = F.when(recent >= pause_after, "PAUSED").when(calm, "RUNNING")
    paused = F.last("_turn", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) == "PAUSED"
    marked = checks.withColumn("_turn", turn).withColumn("_recent", recent)
    return marked.withColumn("relay", F.when(paused, "PAUSED").when(F.col("_recent") > 0, "DEGRADED").otherwise("HEALTHY")).drop("_turn", "_recent")


def inspected_pages(results: DataFrame, query: str, page: str, identity: str) -> DataFrame:
    """Per query its pages, how many identities each shows first, and whether it is inspected: all up to the first page that shows nothing new.

    A page repeats an earlier one only if it adds nothing, and what later pages show changes nothing for earlier ones.
    """
    first = results.groupBy(query, identity).agg(F.min(page).alias(page)).groupBy(query, page).agg(F.count("*").alias("n_new"))
    pages = results.select(query, page).distinct().join(first, [query, page], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    stop = pages.where("n_new = 0").groupBy(query).agg(F.min(page).alias("_stop"))
    return pages.join(stop, query, "left").select(query, page, "n_new", (F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).alias("inspected"))


def membership(sightings: DataFrame, run: str, identity: str, query: str, order: str) -> DataFrame:
    """The first sighting of an identity in a run is NEW, all others KNOWN; its query is the identity's primary one."""
    first = sightings.groupBy(run, identity).agg(F.min_by(F.struct(F.col(order).alias("o"), F.col(query).alias("q")), F.struct(order, query)).alias("_first"))
    state = F.when(F.col(order) == F.col("_first.o"), "NEW").otherwise("KNOWN")
    return sightings.join(first, [run, identity]).withColumn("membership", state).withColumn("primary_query", F.col("_first.q")).drop("_first")


# Why a run ended, the gravest last.
TERMINATIONS = ("NORMAL_COMPLETION", "GLOBAL_LIMIT_REACHED", "NETWORK_FAILURE", "VERIFICATION_ABORT", "CONSENT_ABORT", "ERROR")


def run_fold(events: DataFrame, run: str, index: str, kind: str, reason: str) -> DataFrame:
    """Per run the gravest reason, and the query indexes scheduled and completed (as many as a run has queries)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in TERMINATIONS]), F.col(reason))
    some = lambda k: F.array_sort(F.collect_set(F.when(F.col(kind) == k, F.col(index))))
    folded = events.groupBy(run).agg(F.max_by(reason, F.when(F.col(reason).isNotNull(), rank)).alias("noted"), some("SCHEDULED").alias("scheduled"), some("COMPLETED").alias("completed"))
    ended = F.when(F.size(F.array_except("scheduled", "completed")) == 0, "NORMAL_COMPLETION").otherwise("ERROR")
    return folded.select(run, F.coalesce("noted", ended).alias("termination"), "scheduled", "completed")


def retry_queue(rows: DataFrame, key: str, state: str, attempts: str, most: int = 3, retry_failed: bool = False) -> DataFrame:
    """Pending rows with fewer than ``most`` attempts, failed ones only on demand; fewest attempts first."""
    wanted = F.col(state) == "PENDING"
    if retry_failed:
        wanted = wanted | (F.col(state) == "FAILED")
    return rows.where(wanted & (F.coalesce(F.col(attempts), F.lit(0)) < most)).orderBy(attempts, key)


def recomputed(inputs: DataFrame, stored: DataFrame, keys: list[str], fingerprint: str, evaluate) -> DataFrame:
    """Stored results whose keys and fingerprint still hold are reused, all other rows are evaluated; column reused tells which."""
    have = stored.join(inputs.select(*keys, fingerprint), [*keys, fingerprint], "left_semi").withColumn("reused", F.lit(True))
    new = evaluate(inputs.join(stored.select(*keys, fingerprint), [*keys, fingerprint], "left_anti")).withColumn("reused", F.lit(False))
    return have.unionByName(new.select(*have.columns))
