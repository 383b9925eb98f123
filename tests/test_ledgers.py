import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import ledgers as L
from tessera.operators import resolution as R


def test_budget_of_a_run(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), i, rng.random() < 0.4) for i in range(300)]
    found = {r.at: r.admitted for r in L.accepted_within(spark.createDataFrame(rows, "run int, at int, ok boolean"), "run", "at", F.col("ok"), 7).collect()}
    taken = {}
    for run, at, ok in rows:
        assert found[at] == (taken.get(run, 0) < 7)
        taken[run] = taken.get(run, 0) + (ok and taken.get(run, 0) < 7)


def test_run_and_query_budgets(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(5), i, rng.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame(rows, "run int, query int, at int, fresh boolean")
    found = {r.at: r.admitted for r in L.admitted_new(df, "run", "query", "at", F.col("fresh"), 12, 4).collect()}
    run_used, query_used = {}, {}
    for run, query, at, fresh in rows:
        room = run_used.get(run, 0) < 12 and query_used.get((run, query), 0) < 4
        assert found[at] == ((room or False) if fresh else None)
        if fresh and room:
            run_used[run] = run_used.get(run, 0) + 1
            query_used[run, query] = query_used.get((run, query), 0) + 1


def test_leases(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice("abc"), t) for t in range(0, 3000, 13)]
    found = {r.run: r for r in L.leases(spark.createDataFrame(rows, "run int, owner string, at bigint"), "run", "owner", "at", 60).collect()}
    for run in range(3):
        holder, until, counts = None, 0, [0, 0, 0]
        for _, owner, at in (r for r in rows if r[0] == run):
            if holder in (None, owner) or until <= at:
                counts[2] += holder not in (None, owner)
                holder, until = owner, at + 60
                counts[0] += 1
            else:
                counts[1] += 1
        r = found[run]
        assert [r.granted, r.refused, r.changes, r.holder] == [*counts, holder]


def test_relay(spark):
    rows = [(1, i, c == "x") for i, c in enumerate("...x.xx....x.....")]
    states = [r.relay for r in L.relay_state(spark.createDataFrame(rows, "k int, at int, failed boolean"), "k", "at", F.col("failed")).orderBy("at").collect()]
    assert states[:3] == ["HEALTHY"] * 3 and states[3:6] == ["DEGRADED"] * 3
    assert states[6:9] == ["PAUSED"] * 3 and states[9] == "DEGRADED" and states[10] == "HEALTHY" and states[11] == "DEGRADED"


def test_pages_after_a_repeated_one_are_not_read(spark):
    rows = [("q", 0, "a"), ("q", 0, "b"), ("q", 1, "b"), ("q", 1, "c"), ("q", 2, "a"), ("q", 3, "z"), ("r", 0, "a")]
    found = {(r.query, r.page): (r.n_new, r.inspected) for r in L.inspected_pages(spark.createDataFrame(rows, "query string, page int, id string"), "query", "page", "id").collect()}
    assert found == {("q", 0): (2, True), ("q", 1): (1, True), ("q", 2): (0, True), ("q", 3): (1, False), ("r", 0): (1, True)}


def test_steps(spark):
    actions = spark.createDataFrame([(1, "a", "READY_TO_APPLY"), (2, "b", "READY_TO_APPLY"), (3, "b", "APPLIED"), (4, "c", "SKIPPED")], "k int, who string, state string")
    wanted = spark.createDataFrame([(1, "APPLIED"), (2, "APPLIED"), (3, "WITHDRAWN"), (4, "APPLIED")], "k int, new_state string")
    assert {r.k: (r.outcome, r.state) for r in L.applied_steps(actions, wanted, "k", "who").collect()} == {1: ("DONE", "APPLIED"), 2: ("DUPLICATE", "READY_TO_APPLY"), 3: ("DONE", "WITHDRAWN"), 4: ("INVALID", "SKIPPED")}


def test_empty_ledgers(spark):
    none = spark.createDataFrame([], "run int, query int, at int, ok boolean, owner string")
    assert L.accepted_within(none, "run", "at", F.col("ok"), 3).count() == 0
    assert L.admitted_new(none, "run", "query", "at", F.col("ok"), 3, 3).count() == 0
    assert L.leases(none, "run", "owner", "at", 5).count() == 0
    assert L.relay_state(none, "run", "at", F.col("ok")).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_rounds_give_what_the_fold_gives(spark, seed):
    """E4 and E5 by rounds over all rows, against the sequential fold; one key is on a third of the rows."""
    rng = random.Random(seed)
    value = lambda hot, n: rng.choice(["", "", None, hot, hot, f"{rng.randrange(n)}", f"{rng.randrange(n)}"])
    rows = [(i, value("hot", 25), value("warm", 40), value("w", 15)) for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, a string, b string, c string").repartition(3)
    kept = {r.i: r.kept for r in R.sequential_dedup(df, "i", ["a", "b", "c"]).collect()}
    status = {r.i: r.status for r in R.known_or_new(df, "i", ["a", "b", "c"]).collect()}
    taken, added = set(), set()
    for i, *values in rows:
        own = [(k, v) for k, v in enumerate(values) if v]
        assert kept[i] == (not taken & set(own))
        if kept[i]:
            taken |= set(own)
        assert status[i] == ("none" if not own else "same_run" if own[0] in added else "new")
        if status[i] == "new":
            added |= set(own)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(6)
    groups = {g: {rng.choice([0, 1, rng.randrange(30)]) for _ in range(rng.randint(1, 9))} for g in range(90)}
    df = spark.createDataFrame([(g, m) for g, own in groups.items() for m in own] + [(3, None), (None, 3)], "g int, m int")
    for least, rate in ((1, 0.3), (2, 0.5), (2, 0.75), (1, 1.0)):
        wanted = {(a, b) for a in groups for b in groups if a < b and len(groups[a] & groups[b]) >= least and len(groups[a] & groups[b]) / len(groups[a] | groups[b]) >= rate}
        assert {(r.a, r.b) for r in J.overlaps(df, "g", "m", least, rate).collect()} == wanted


def test_precedence_match(spark):
    known = spark.createDataFrame([(1, "p", "d"), (2, "", "d"), (3, "q", "e")], "entity int, place string, domain string")
    rows = spark.createDataFrame([(1, "p", "e"), (2, "", "d"), (3, "x", "e"), (4, None, "")], "i int, place string, domain string")
    found = {r.i: (r.matched_entity, r.matched_by, r.ambiguous) for r in J.precedence_match(rows, known, ["place", "domain"], "entity").collect()}
    assert found == {1: (1, "place", False), 2: (None, "domain", True), 3: (3, "domain", False), 4: (None, None, False)}


def test_overlaps_of_large_groups_and_hot_members(spark):
    """Groups below and above the size whose members travel with them, copies, rows given twice, and a member that all have."""
    rng = random.Random(8)
    groups = {g: {0} | {rng.randrange(1, 60) for _ in range(rng.choice([1, 2, 4, 9, 20, 40]))} for g in range(70)}
    groups |= {100 + g: set(groups[g]) for g in range(0, 20)} | {200 + g: set(list(groups[g])[: len(groups[g]) // 2 + 1]) for g in range(30)}
    rows = [(g, m) for g, own in groups.items() for m in own]
    df = spark.createDataFrame(rows + rows[::3] + [(3, None), (None, 3)], "g int, m int")
    for least, rate in ((1, 0.3), (2, 0.4), (3, 0.5), (2, 0.75), (1, 1.0)):
        wanted = {(a, b): (len(x & y), len(x & y) / len(x | y)) for a, x in groups.items() for b, y in groups.items() if a < b and len(x & y) >= least and len(x & y) / len(x | y) >= rate}
        for whole in (1, 5, 64):
            assert {(r.a, r.b): (r.overlap, r.rate) for r in J.overlaps(df, "g", "m", least, rate, whole).collect()} == wanted


def test_overlaps_counts_pairs_where_they_meet(spark, monkeypatch):
    """Groups that share one member each leave the join of members as no pair at all."""
    kept = []
    monkeypatch.setattr(J, "written", lambda df, name: kept.append(df.count()) or (df, ""))
    df = spark.createDataFrame([(g, m) for g in range(40) for m in (g % 4, 100 + g // 2, 1000 + g, 2000 + g)], "g int, m int")
    assert J.overlaps(df, "g", "m", 2, 0.3).count() == 0
    assert kept == [0]
