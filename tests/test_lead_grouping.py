"""E1 against the rules read one by one, on rows whose keys chain through hot values."""

import random

import pytest

from tessera.operators import resolution as R

FIELDS = ("place", "domain", "name", "phone", "email", "address")


def by_hand(rows):
    groups = []

    def apart(g, row, field):
        return bool(g[field]) and bool(row[field]) and row[field] not in g[field]

    for i, *values in rows:
        row = dict(zip(FIELDS, values, strict=True))
        kinds = {}
        for n, g in enumerate(groups):
            if row["place"] and row["place"] in g["place"]:
                kinds[n] = 0
            elif row["domain"] and row["domain"] in g["domain"]:
                kinds[n] = 1
            elif row["name"] and row["phone"] and (row["name"], row["phone"]) in g["name_phone"]:
                kinds[n] = 2
            elif row["name"] and row["email"] and (row["name"], row["email"]) in g["name_email"]:
                kinds[n] = 3
        linked = set(kinds)
        alone = not kinds
        if alone:
            kinds = {n: 4 for n, g in enumerate(groups) if row["name"] and row["name"] in g["name"]}
        told = {}
        for n, kind in kinds.items():
            g, why = groups[n], set()
            place, domain, name, phone, email, address = (apart(g, row, f) for f in FIELDS)
            if kind == 1 and place:
                why = {"conflicting maps identities"} | ({"shared domain across distinct places"} if phone or address else set())
            elif kind == 1 and name and phone:
                why = {"conflicting strong identities"}
            elif kind >= 2:
                why = ({"conflicting maps identities"} if place else set()) | ({"conflicting strong identities"} if domain or kind == 4 and (phone or email) else set()) | ({"conflicting location evidence"} if kind == 4 and address else set())
            told[n] = why
        free = [n for n in kinds if not told[n]]
        best = min((kinds[n] for n in free), default=None)
        tied = [n for n in free if kinds[n] == best]
        if len(tied) == 1:
            own = tied[0]
        else:
            own = len(groups)
            groups.append({f: set() for f in FIELDS} | {"name_phone": set(), "name_email": set(), "rows": [], "why": set()})
        for n, why in told.items():
            groups[n]["why"] |= why
            groups[own]["why"] |= why
        if len(linked) > 1:
            for n in linked | {own}:
                groups[n]["why"].add("identity bridge conflict")
        unclear = set(tied) if len(tied) > 1 else set()
        if alone:
            unclear |= {n for n in told if told[n]}
        for n in unclear | ({own} if unclear else set()):
            groups[n]["why"].add("ambiguous exact-name match")
        g = groups[own]
        for f in FIELDS:
            if row[f]:
                g[f].add(row[f])
        if row["name"] and row["phone"]:
            g["name_phone"].add((row["name"], row["phone"]))
        if row["name"] and row["email"]:
            g["name_email"].add((row["name"], row["email"]))
        g["rows"].append(i)
    return {i: (g["rows"][0], "; ".join(sorted(g["why"]))) for g in groups for i in g["rows"]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_against_the_rules(spark, seed):
    rng = random.Random(seed)
    value = lambda n, hot: rng.choice(["", "", hot, str(rng.randrange(n)), str(rng.randrange(n))])
    rows = [(i, value(40, "p"), value(30, "d"), value(20, "n"), value(25, ""), value(25, "e"), value(15, "")) for i in range(160)]
    df = spark.createDataFrame(rows, "row_idx bigint, " + ", ".join(f"{f} string" for f in FIELDS)).repartition(3)
    assert {r.row_idx: (r.group_id, r.review_reasons) for r in R.group_leads(df).collect()} == by_hand(rows)


def imported(rows):
    """E3 by looking at every branch for every row."""
    branches, out = [], {}
    for i, name, place, domain, phone, address, recorded in rows:
        if recorded:
            out[i] = (recorded, None, None)
        elif not name or not (place or domain or phone or address):
            out[i] = ("QUARANTINED", None, None)
        else:
            if place:
                fit = [b for b in branches if place in b["place"]]
            else:
                fit = [b for b in branches if name in b["name"] and (phone and phone in b["phone"] or address and address in b["address"] or domain and domain in b["domain"])]
            firms = {c for c, pairs in ((b["company"], b["pairs"]) for b in branches) if domain and (name, domain) in pairs}
            if len(fit) > 1 or not fit and len(firms) > 1:
                out[i] = ("AMBIGUOUS", None, None)
                continue
            if not fit:
                fit = [{"first": i, "company": min(firms, default=i), "pairs": set()} | {k: set() for k in ("name", "place", "domain", "phone", "address")}]
                branches += fit
            b = fit[0]
            for k, v in (("name", name), ("place", place), ("domain", domain), ("phone", phone), ("address", address)):
                if v:
                    b[k].add(v)
            if domain:
                b["pairs"].add((name, domain))
            out[i] = ("IMPORTED", b["first"], b["company"])
    return out


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_import_against_every_branch(spark, seed):
    rng = random.Random(seed)
    value = lambda n, hot: rng.choice(["", "", hot, str(rng.randrange(n)), str(rng.randrange(n)), None])
    rows = [(i, value(9, "n"), value(60, ""), value(20, ""), value(40, ""), value(30, "a"), rng.choice([None] * 9 + ["AMBIGUOUS"])) for i in range(220)]
    df = spark.createDataFrame(rows, "i bigint, name string, place string, domain string, phone string, address string, recorded string").repartition(3)
    found = {r.i: (r.outcome, r.branch, r.company) for r in R.historical_import(df, "i").collect()}
    assert found == imported([tuple(v or "" if k else v for k, v in enumerate(r)) for r in rows])
    assert len({v[0] for v in found.values()}) == 3
