"""Entity resolution with sequential semantics, exact but distributed.

Rows that share no key, directly or through others, cannot influence each other. So rows are first put into blocks, the connected components over all
their keys, and only within a block is the order of the input replayed by a fold. Blocks are as small as the keys are selective; keys that say nothing
(free mail hosts, weak domains) must not be handed over as keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, small, written
from .components import connected_components
from .grouping import LeadGroups


def with_blocks(rows: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """rows with block: the least row number that the keys' values lead to. Blank and null keys lead nowhere.

    Rows with the same keys are one node of the components.
    """
    base, _ = written(rows, "blocks")
    blank = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")) == ""
    none = reduce(lambda a, b: a & b, map(blank, keys))
    nodes, _ = written(base.where(~none).groupBy(*keys).agg(F.min(row).alias("_row")), "block-keys")
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys]))
    postings = nodes.select("_row", pair.alias("_key")).where(F.coalesce(F.col("_key.value"), F.lit("")) != "")
    first = postings.groupBy("_key").agg(F.min("_row").alias("_first"))
    edges = postings.join(first, "_key").select(F.col("_row").alias("a"), F.col("_first").alias("b"))
    found = connected_components(edges)
    blocks, _ = written(nodes.join(found, nodes["_row"] == found["node"], "left").select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce("component", "_row").alias("block")), "block-nodes")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    met = base.where(~none).join(small(blocks, 200_000), same).select(*base.columns, "block")
    return met.unionByName(base.where(none).withColumn("block", F.col(row)))


def fold_blocks(rows: DataFrame, order: str, fold: Callable[[pd.DataFrame], Iterator[tuple]], schema: str) -> DataFrame:
    """Applies a sequential fold to each block (column block) in order. The fold yields tuples of the schema."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(fold(frame.sort_values(order, kind="stable"))), columns=names)

    return rows.groupBy("block").applyInPandas(run, schema)


def _postings(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """row and key (kind and value, as one text) of all keys that are not blank."""
    pair = F.explode(F.array(*[F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}\x00"), F.col(k).cast("string"))) for k in keys])).alias("key")
    return rows.select(F.col(order).cast("bigint").alias("row"), pair).where("key is not null")


def sequential_dedup(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """E5: rows in order are kept if none of their key values was kept before; blank keys count for nothing.

    By rounds over all rows: a row that is the first of the undecided ones for each of its keys is kept, and undecided rows that have a key of a kept one are
    not. Each round decides at least the first undecided row of every group of rows that keys link, and no group is ever gathered in one place.
    """
    spark = rows.sparkSession
    open_, path = written(_postings(rows, order, keys).distinct(), "dedup")
    dropped, paths = [], []
    while not open_.isEmpty():
        first = open_.groupBy("key").agg(F.min("row").alias("first"))
        wins = open_.join(first, "key").groupBy("row").agg(F.bool_and(F.col("row") == F.col("first")).alias("wins")).where("wins").select("row")
        taken, taken_path = written(open_.join(wins, "row", "left_semi"), "dedup-kept")
        lost, lost_path = written(open_.join(taken.select("key").distinct(), "key", "left_semi").join(taken.select("row").distinct(), "row", "left_anti").select("row").distinct(), "dedup-dropped")
        rest = open_.join(lost, "row", "left_anti").join(taken.select("row").distinct(), "row", "left_anti")
        left, left_path = written(rest, "dedup")
        discard(spark, path, taken_path)
        dropped.append(lost)
        paths.append(lost_path)
        open_, path = left, left_path
    out = rows.select(F.col(order).cast("bigint").alias(order))
    for lost in dropped:
        out = out.join(lost.select(F.col("row").alias(order)), order, "left_anti")
    kept = out.distinct().withColumn("kept", F.lit(True))
    return rows.select(F.col(order).cast("bigint").alias(order)).join(kept, order, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def known_or_new(rows: DataFrame, order: str, ranked_kinds: list[str]) -> DataFrame:
    """Each row is looked up by the strongest kind that it has; an accepted (new) row adds all its identities, another none. status: new, same_run or none.

    By rounds over all rows, as in sequential_dedup: a row is new once no undecided or new row before it has the identity that it is looked up by.
    """
    spark = rows.sparkSession
    postings = _postings(rows, order, ranked_kinds)
    strongest = F.coalesce(*[F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}\x00"), F.col(k).cast("string"))) for k in ranked_kinds])
    looked = rows.select(F.col(order).cast("bigint").alias("row"), strongest.alias("lookup"))
    open_, path = written(postings.join(looked, "row").distinct(), "known")
    same, paths = [], []
    while not open_.isEmpty():
        first = open_.groupBy("key").agg(F.min("row").alias("first"))
        wins = open_.where("key = lookup").join(first, "key").where("row = first").select("row")
        new, new_path = written(open_.join(wins, "row", "left_semi"), "known-new")
        added = new.groupBy(F.col("key").alias("lookup")).agg(F.min("row").alias("by"))
        met, met_path = written(open_.where("key = lookup").join(added, "lookup").where("by < row").select("row").distinct(), "known-same")
        left, left_path = written(open_.join(met, "row", "left_anti").join(new.select("row").distinct(), "row", "left_anti"), "known")
        discard(spark, path, new_path)
        same.append(met)
        paths.append(met_path)
        open_, path = left, left_path
    status = looked.withColumn("status", F.when(F.col("lookup").isNull(), "none"))
    for i, met in enumerate(same):
        status = status.join(met.withColumn(f"_m{i}", F.lit(True)), "row", "left")
    known = F.coalesce(*[F.col(f"_m{i}") for i in range(len(same))], F.lit(False)) if same else F.lit(False)
    return status.select(F.col("row").alias(order), F.coalesce("status", F.when(known, "same_run").otherwise("new")).alias("status"))


def group_leads(rows: DataFrame) -> DataFrame:
    """row_idx, place, domain, name, phone, email (domain of a company address), address: the group of each row and the group's review reasons.

    A row joins the one compatible group of its strongest kind of match. Several such make a group of its own to review; links to more than one group are a
    bridge conflict on all of them. Name alone matches only where nothing else does. group_id is the row_idx of the group's first row.
    """
    evidence = ("place", "domain", "name", "phone", "email", "address")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, groups = None, LeadGroups()
        for batch in batches:
            for block, number, *values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if block != at:
                    yield from out(groups)
                    at, groups = block, LeadGroups()
                groups.add(number, *(v or "" for v in values))
        yield from out(groups)

    def out(groups: LeadGroups) -> Iterator[pa.RecordBatch]:
        for part in batched(groups.placed(), 10_000):
            row, group, reasons = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(group, pa.int64()), pa.array(reasons, pa.string())], ["row_idx", "group_id", "review_reasons"])

    blocked = with_blocks(rows.select("row_idx", *evidence), "row_idx", ["place", "domain", "name"])
    # by ranges, so that large blocks are not dealt to one task by chance; rows stream through the fold and are never gathered
    dealt = blocked.select("block", "row_idx", *evidence).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "row_idx")
    return dealt.mapInArrow(fold, "row_idx bigint, group_id bigint, review_reasons string")


def registry_decision(df: DataFrame) -> DataFrame:
    """E2 against a frozen registry: from counts of matching entities per rule the classification and action of each observation.

    Columns: has_key, name, place, domain, phone, address (texts), n_place (branches with the place id), place_conflict, place_new_evidence (booleans),
    n_name_support (branches by name and phone or address), n_name_both (by name, phone and address), n_name_domain (companies by name and trusted domain),
    n_partial (entities with any partial overlap), n_history (unresolved history overlaps).
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [
        (~F.col("has_key"), "QUARANTINED", "QUARANTINE"),
        (~blank("place") & (F.col("n_place") > 1), "AMBIGUOUS", "REVIEW"),
        (~blank("place") & (F.col("n_place") == 1) & F.col("place_conflict"), "AMBIGUOUS", "REVIEW"),
        (~blank("place") & (F.col("n_place") == 1) & F.col("place_new_evidence"), "UPDATED", "UPDATE_ENTITY"),
        (~blank("place") & (F.col("n_place") == 1), "KNOWN", "MATCH_ONLY"),
        (blank("name"), "QUARANTINED", "QUARANTINE"),
        (blank("place") & blank("domain") & blank("phone") & blank("address"), "QUARANTINED", "QUARANTINE"),
        (~blank("place") & (F.col("n_name_both") == 1), "UPDATED", "ADD_PLACE_ALIAS"),
        (~blank("place") & (F.col("n_name_support") > 0), "AMBIGUOUS", "REVIEW"),
        (F.col("n_name_support") > 1, "AMBIGUOUS", "REVIEW"),
        (F.col("n_name_support") == 1, "KNOWN", "MATCH_ONLY"),
        (F.col("n_name_domain") > 1, "AMBIGUOUS", "REVIEW"),
        (~blank("place") & (F.col("n_name_domain") == 1), "UPDATED", "CREATE_BRANCH"),
        (F.col("n_name_domain") == 1, "KNOWN", "MATCH_ONLY"),
        (F.col("n_partial") > 0, "AMBIGUOUS", "REVIEW"),
        (F.col("n_history") > 0, "AMBIGUOUS", "REVIEW"),
    ]
    classification = action = None
    for test, c, a in rules:
        classification = F.when(test, c) if classification is None else classification.when(test, c)
        action = F.when(test, a) if action is None else action.when(test, a)
    return df.withColumns({"classification": classification.otherwise("NEW"), "action": action.otherwise("CREATE_COMPANY")})


def registry_tables(branches: DataFrame, companies: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """A frozen registry as tables to look observations up in, one row a key (a, b, c), so that no join lists what it only counts.

    branches: branch, company, kind (PLACE, NAME, PHONE, ADDRESS), value. companies: company, kind (NAME, DOMAIN), value. history: kind (NAME, DOMAIN, PHONE,
    ADDRESS), value of unresolved rows. Written once; those of at most 100,000 rows are broadcast.
    """
    of = lambda df, kind, owner: df.where(F.col("kind") == kind).select(F.col(owner).cast("string").alias(owner), "value").distinct()
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    columns = ["t", "a", "b", "c", "n", "m"]
    row = lambda df, t, **has: df.select(F.lit(t).alias("t"), *[F.expr(has[c]).cast("string" if c in "abc" else "bigint").alias(c) if c in has else F.lit(None).cast("string" if c in "abc" else "bigint").alias(c) for c in columns[1:]])
    parts = []
    # branches by name with phone, with address, and with both: a branch counts once
    name, phone, address = (of(branches, kind, "branch").where(filled("value")).withColumnRenamed("value", kind.lower()) for kind in ("NAME", "PHONE", "ADDRESS"))
    for t, df, keys in (("phone", name.join(phone, "branch"), ["name", "phone"]), ("address", name.join(address, "branch"), ["name", "address"]), ("both", name.join(phone, "branch").join(address, "branch"), ["name", "phone", "address"])):
        parts.append(row(df.groupBy(*keys).agg(F.count("*").alias("n")), f"name_{t}", n="n", **dict(zip("abc", keys))))
    # companies by name and domain; names and domains by whether a company (1) or unresolved history (2) has them
    names, domains = of(companies, "NAME", "company").withColumnRenamed("value", "name"), of(companies, "DOMAIN", "company").withColumnRenamed("value", "domain")
    parts.append(row(names.join(domains, "company").groupBy("name", "domain").agg(F.count("*").alias("n")), "name_domain", a="name", b="domain", n="n"))
    seen = companies.select("kind", "value", F.lit(1).alias("by")).unionByName(history.select("kind", "value", F.lit(2).alias("by"))).where(filled("value"))
    seen = seen.groupBy("kind", "value").agg(F.bit_or("by").alias("n"))
    parts += [row(seen.where(F.col("kind") == kind), f"seen_{kind.lower()}", a="value", n="n") for kind in ("NAME", "DOMAIN", "PHONE", "ADDRESS")]
    # the one branch of a place, its company, which kinds these have at all (m), and what they have
    has = lambda df, owner, bits: df.groupBy(F.col(owner).cast("string").alias(owner)).agg(F.bit_or(sum((F.when(F.col("kind") == k, bit).otherwise(0) for k, bit in bits.items()), F.lit(0))).alias(f"_{owner}"))
    place = branches.where(F.col("kind") == "PLACE").groupBy(F.col("value").alias("place")).agg(F.count_distinct("branch").alias("n"), F.min("branch").cast("string").alias("branch"), F.min("company").cast("string").alias("company"))
    place, _ = written(place.where(filled("place")), "registry-places")
    held = place.join(has(branches, "branch", {"NAME": 1, "PHONE": 2, "ADDRESS": 4}), "branch", "left").join(has(companies, "company", {"NAME": 8, "DOMAIN": 16}), "company", "left")
    parts.append(row(held, "place", a="place", b="branch", c="company", n="n", m="coalesce(_branch, 0) | coalesce(_company, 0)"))
    for df, owner, kinds in ((companies, "company", ("NAME", "DOMAIN")), (branches, "branch", ("NAME", "PHONE", "ADDRESS"))):
        at_places = place.select(owner).distinct()
        parts += [row(of(df, kind, owner).where(filled("value")).join(at_places, owner, "left_semi"), f"{owner}_{kind.lower()}", a=owner, b="value", n="1") for kind in kinds]
    all_, _ = written(reduce(DataFrame.unionByName, parts), "registry", "t")
    sizes = {r.t: r.n for r in all_.groupBy("t").agg(F.count("*").alias("n")).collect()}  # one row a table
    tables = {f"{k}": all_.where(F.col("t") == k).drop("t") for k in REGISTRY}
    return {k: F.broadcast(df) if sizes.get(k, 0) <= 100_000 else df for k, df in tables.items()}


#: tables of a registry, by the columns of an observation that they are asked by
REGISTRY = {
    "place": ["place"], "company_name": ["company", "name"], "company_domain": ["company", "domain"], "branch_name": ["branch", "name"], "branch_phone": ["branch", "phone"], "branch_address": ["branch", "address"],
    "name_phone": ["name", "phone"], "name_address": ["name", "address"], "name_both": ["name", "phone", "address"], "name_domain": ["name", "domain"],
    "seen_name": ["name"], "seen_domain": ["domain"], "seen_phone": ["phone"], "seen_address": ["address"],
}


def registry_evidence(observations: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """What registry_decision asks for, by equi-joins with the tables of a frozen registry, each of at most one row an observation.

    observations: id, has_key, name, place, domain (trusted or ''), phone, address.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    out = observations.select("id", "has_key", "name", "place", "domain", "phone", "address")
    for t, keys in REGISTRY.items():
        values = [F.col("n").alias(f"_{t}")] + ([F.col("b").alias("branch"), F.col("c").alias("company"), F.col("m").alias("_kinds")] if t == "place" else [])
        out = out.join(tables[t].select(*[F.col(c).alias(k) for c, k in zip("abc", keys)], *values), keys, "left")
    n = lambda t: F.coalesce(F.col(f"_{t}"), F.lit(0)).cast("bigint")
    held = lambda t: F.col(f"_{t}").isNotNull()
    against = lambda t, bit: filled(t.split("_")[1]) & (F.coalesce(F.col("_kinds"), F.lit(0)).bitwiseAND(F.lit(bit)) != 0) & ~held(t)
    name_against = against("company_name", 8)
    conflict = (name_against & against("company_domain", 16)) | (name_against & against("branch_phone", 2) & against("branch_address", 4))
    fresh = reduce(lambda a, b: a | b, [filled(t.split("_")[1]) & ~held(t) for t in ("company_name", "company_domain", "branch_name", "branch_phone", "branch_address")])
    seen = lambda bit, *kinds: sum((n(f"seen_{k}").bitwiseAND(F.lit(bit)).cast("boolean").cast("bigint") for k in kinds), F.lit(0).cast("bigint"))
    support = n("name_phone") + n("name_address") - n("name_both")  # branches with both are in both counts
    return out.select(
        "id", "has_key", "name", "place", "domain", "phone", "address", n("place").alias("n_place"), conflict.alias("place_conflict"), fresh.alias("place_new_evidence"),
        support.alias("n_name_support"), n("name_both").alias("n_name_both"), n("name_domain").alias("n_name_domain"), (seen(1, "name", "domain") + support).alias("n_partial"), seen(2, "name", "domain", "phone", "address").alias("n_history"),
    )


def resolve(observations: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Classification and action of each observation against a frozen registry (registry_tables)."""
    return registry_decision(registry_evidence(observations, tables)).select("id", "classification", "action")


def historical_import(rows: DataFrame, order: str) -> DataFrame:
    """Rows (name, place, domain, phone, address: keys; recorded: the outcome on record, or null) imported in order into a registry that they build up.

    A row with an outcome on record keeps it and adds nothing. Without a name, or without any other key, it is QUARANTINED. A known place is that place's branch;
    a new one makes a branch. Without a place it is the branch that has its name together with its phone, address or domain; several are AMBIGUOUS, none makes a
    branch. A new branch belongs to the company that has its name and domain, if one has. Rows add what they have to their branch. branch and company are the numbers of the rows that
    made them. Rows that share no place, phone, address or domain, directly or through others, do not meet: these make the blocks.
    """
    fields = ["name", "place", "domain", "phone", "address", "recorded"]

    def fold(frame):
        has: list[dict[str, set]] = []  # of each branch
        where: dict[tuple, set[int]] = {}  # branches by (kind, value)
        owner: dict[tuple[str, str], set[int]] = {}  # companies by name and domain
        made: list[tuple[int, int]] = []

        def learn(b, row):
            for kind in ("name", "place", "domain", "phone", "address"):
                if row[kind]:
                    has[b][kind].add(row[kind])
                    where.setdefault((kind, row[kind]), set()).add(b)
            if row["domain"]:
                owner.setdefault((row["name"], row["domain"]), set()).add(made[b][1])

        for number, *values in frame[[order, *fields]].itertuples(index=False):
            row = {f: v if isinstance(v, str) else "" for f, v in zip(fields, values, strict=True)}
            if row["recorded"]:
                yield number, row["recorded"], "RECORDED", None, None
                continue
            others = [k for k in ("phone", "address", "domain") if row[k]]
            if not row["name"] or not (others or row["place"]):
                yield number, "QUARANTINED", "NO_NAME" if not row["name"] else "NO_EVIDENCE", None, None
                continue
            if row["place"]:
                found, how = where.get(("place", row["place"]), set()), "PLACE"
            else:
                named = where.get(("name", row["name"]), set())
                found, how = set().union(*(named & where.get((k, row[k]), set()) for k in others)), "SUPPORT"
            companies = owner.get((row["name"], row["domain"]), set()) if row["domain"] else set()
            if len(found) > 1 or not found and len(companies) > 1:
                yield number, "AMBIGUOUS", "BRANCHES" if found else "COMPANIES", None, None
                continue
            if not found:
                how = "CREATED"
                has.append({k: set() for k in ("name", "place", "domain", "phone", "address")})
                made.append((number, next(iter(companies), number)))
                found = {len(has) - 1}
            (b,) = found
            learn(b, row)
            yield number, "IMPORTED", how, *made[b]

    blocked = with_blocks(rows.select(order, *fields), order, ["place", "phone", "address", "domain"])
    return fold_blocks(blocked, order, fold, f"{order} bigint, outcome string, how string, branch bigint, company bigint")


def completeness_merge(rows: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """Rows of a key ranked by how many values they fill (then order); each value is the first filled down that ranking."""
    filled = sum(F.when(F.coalesce(F.col(v), F.lit("")) != "", 1).otherwise(0) for v in values)
    ranked = rows.withColumn("_rank", F.struct((-filled).alias("f"), F.col(order).alias("o")))
    pick = lambda v: F.coalesce(F.min_by(v, F.when(F.coalesce(F.col(v), F.lit("")) != "", F.col("_rank"))), F.lit("")).alias(v)
    return ranked.groupBy(key).agg(*[pick(v) for v in values])
