"""E1 over classes of groups: the same groups as by the rules read one by one, with work that does not grow with the number of groups."""

import random

import pytest

from tessera.operators import resolution as R
from tessera.operators.grouping import LeadGroups

from .test_lead_grouping import FIELDS, by_hand

SCHEMA = "row_idx bigint, " + ", ".join(f"{f} string" for f in FIELDS)


@pytest.mark.parametrize("seed", range(40))
def test_classes_against_the_rules(seed):
    """Few values, so that most groups have twins; and many, so that groups grow."""
    rng = random.Random(seed)
    blanks, few = rng.choice([1, 2, 5]), rng.choice([1, 3, 8, 40])
    value = lambda n, hot: rng.choice([""] * blanks + [hot] + [str(rng.randrange(max(1, n // few))) for _ in range(2)])
    rows = [(3 * i, value(40, "p") if rng.random() < 0.5 else "", value(30, "d"), value(20, "n"), value(25, ""), value(25, "e"), value(15, "")) for i in range(rng.choice([60, 300]))]
    groups = LeadGroups()
    for row in rows:
        groups.add(*row)
    assert {number: (first, reasons) for number, first, reasons in groups.placed()} == by_hand(rows)


def test_many_groups_under_one_name(spark):
    """Forty thousand rows under one name, which make nearly as many groups, are looked up in some hundred classes (group by group it took hours)."""
    n = 40_000
    rows = spark.range(n).selectExpr("id as row_idx", "'' as place", "'' as domain", "'n' as name", "cast(id % 5 as string) as phone", "cast(id % 3 as string) as email", "cast(id % 7 as string) as address")
    found = {r.row_idx: (r.group_id, r.review_reasons) for r in R.group_leads(rows).collect()}
    few = [tuple(r) for r in rows.limit(400).collect()]
    groups = LeadGroups()
    for row in few:
        groups.add(*row)
    wanted = by_hand(few)
    assert {number: (first, reasons) for number, first, reasons in groups.placed()} == wanted
    assert len(found) == n
    # what the rows after it bring can add reasons to a group only, not move its rows
    assert {i: group for i, (group, _) in found.items() if i < 400} == {i: group for i, (group, _) in wanted.items()}
    for row in ((i, "", "", "n", str(i % 5), str(i % 3), str(i % 7)) for i in range(400, n)):
        groups.add(*row)
    assert sum(map(len, groups.shapes.values())) < 100


def test_blocks_of_equal_keys(spark):
    """Rows with equal keys are one node; blank and null keys lead nowhere, however many rows have them."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["", None, "a", "b", "c", "d"]), rng.choice(["", None, None, "x", "y", f"u{i % 9}"])) for i in range(90)]
    df = spark.createDataFrame(rows, "i bigint, k string, l string").repartition(3)
    block = {i: i for i, *_ in rows}
    for _ in rows:
        for f in (1, 2):
            least = {}
            for r in rows:
                if r[f]:
                    least[r[f]] = min(least.get(r[f], r[0]), block[r[0]])
            for r in rows:
                if r[f]:
                    block[r[0]] = min(block[r[0]], least[r[f]])
    assert {r.i: r.block for r in R.with_blocks(df, "i", ["k", "l"]).collect()} == block
