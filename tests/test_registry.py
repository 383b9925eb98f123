"""E2 against the registry asked row by row, on branches with several values of a kind."""

import random

import pytest

from tessera.operators import resolution as R


def by_hand(observed, branches, companies, history):
    out = {}
    has = lambda rows, owner, kind: {r[-1] for r in rows if r[0] == owner and r[-2] == kind}
    ids, firms = {b for b, *_ in branches}, {c for c, *_ in companies}
    for i, _, name, place, domain, phone, address in observed:
        at = [r for r in branches if place and r[2:] == ("PLACE", place)]
        branch, firm = min((r[0] for r in at), default=None), min((r[1] for r in at), default=None)
        named = {b for b in ids if name and name in has(branches, b, "NAME")}
        by_phone, by_address = ({b for b in named if v and v in has(branches, b, kind)} for v, kind in ((phone, "PHONE"), (address, "ADDRESS")))
        lacks = lambda rows, owner, kind, v: bool(v) and v not in has(rows, owner, kind)
        off = lambda rows, owner, kind, v: lacks(rows, owner, kind, v) and any(r[0] == owner and r[-2] == kind for r in rows)
        conflict = off(companies, firm, "NAME", name) and (off(companies, firm, "DOMAIN", domain) or off(branches, branch, "PHONE", phone) and off(branches, branch, "ADDRESS", address))
        fresh = lacks(companies, firm, "NAME", name) or lacks(companies, firm, "DOMAIN", domain) or any(lacks(branches, branch, k, v) for k, v in (("NAME", name), ("PHONE", phone), ("ADDRESS", address)))
        both = sum(name in has(companies, c, "NAME") and domain in has(companies, c, "DOMAIN") for c in firms)
        partial = sum(bool(v) and any(r[1:] == (k, v) for r in companies) for k, v in (("NAME", name), ("DOMAIN", domain))) + len(by_phone | by_address)
        past = sum(bool(v) and (k, v) in history for k, v in (("NAME", name), ("DOMAIN", domain), ("PHONE", phone), ("ADDRESS", address)))
        out[i] = (len({r[0] for r in at}), conflict, fresh, len(by_phone | by_address), len(by_phone & by_address), both, partial, past)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_evidence_against_every_branch(spark, seed):
    rng = random.Random(seed)
    value = lambda kind, n: rng.choice(["", *(f"{kind}{rng.randrange(n)}" for _ in range(5))])
    kinds = {"PLACE": 30, "NAME": 6, "PHONE": 9, "ADDRESS": 7, "DOMAIN": 8}
    branches = [(b, b % 9, k, value(k, kinds[k])) for b in range(25) for k in ("PLACE", "NAME", "PHONE", "ADDRESS") for _ in range(rng.randrange(4))]
    companies = [(c, k, value(k, kinds[k])) for c in range(9) for k in ("NAME", "DOMAIN") for _ in range(rng.randrange(3))]
    history = [(k, value(k, 12)) for k in ("NAME", "DOMAIN", "PHONE", "ADDRESS") for _ in range(4)]
    observed = [(i, True, *(value(k, kinds[k]) for k in ("NAME", "PLACE", "DOMAIN", "PHONE", "ADDRESS"))) for i in range(200)]
    tables = R.registry_tables(spark.createDataFrame(branches, "branch bigint, company bigint, kind string, value string"), spark.createDataFrame(companies, "company bigint, kind string, value string"), spark.createDataFrame(history, "kind string, value string"))
    found = R.registry_evidence(spark.createDataFrame(observed, "id bigint, has_key boolean, name string, place string, domain string, phone string, address string"), tables).collect()
    assert {r.id: tuple(r)[7:] for r in found} == by_hand(observed, branches, companies, history)
    assert len(found) == 200


def test_no_join_lists_the_branches_of_a_name(spark):
    """Thirty thousand observations and branches of one name: their pairs (900 million) are counted, and observations are not shuffled."""
    n = 30_000
    branches = spark.range(n).selectExpr("id as branch", "0L as company", "explode(map('NAME', 'n', 'PHONE', 'p', 'PLACE', concat('q', id))) as (kind, value)")
    companies = spark.sql("select 0L as company, 'NAME' as kind, 'n' as value")
    observed = spark.range(n).selectExpr("id", "true as has_key", "'n' as name", "'' as place", "'' as domain", "'p' as phone", "'' as address")
    resolved = R.registry_evidence(observed, R.registry_tables(branches, companies, companies.select("kind", "value").limit(0)))
    assert [tuple(r) for r in resolved.groupBy("n_name_support", "n_name_both", "n_partial").count().collect()] == [(n, 0, n + 1, n)]
    assert "Exchange hashpartitioning" not in resolved._jdf.queryExecution().executedPlan().toString()
