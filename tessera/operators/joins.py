"""Joins by evidence: representatives, latest versions, unambiguous lookups, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written


def representative(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Per key the row that is least by order; pre-aggregated, no sort."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Per key the row that is greatest by order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct non-blank value, and that value."""
    filled = rows.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(value).cast("string"), F.lit("")) != ""))
    return filled.groupBy(key).agg(F.min(value).alias("_least"), F.max(value).alias("_most")).where("_least = _most").select(key, F.col("_least").alias(value))


def fill_from(rows: DataFrame, value: str, lookups: list[tuple[str, DataFrame]]) -> DataFrame:
    """Blanks in value are filled from the lookups (key, table of key and value), the first that has one."""
    columns = rows.columns
    for i, (key, table) in enumerate(lookups):
        rows = rows.join(table.select(F.col(key), F.col(value).alias(f"_fill{i}")), key, "left")
    return rows.select(*[F.coalesce(F.nullif(F.col(value), F.lit("")), *[F.col(f"_fill{i}") for i in range(len(lookups))], F.lit("")).alias(value) if c == value else c for c in columns])


def overlaps(members: DataFrame, group: str, member: str, least: int = 2, rate: float = 0.75, whole: int = 64) -> DataFrame:
    """Pairs of groups a < b that share at least ``least`` members with a Jaccard similarity of ``rate`` or more.

    Members are ordered by how few groups have them. Of two groups of n and m members that are so similar, the first member in common is among the first
    n - max(least, ceil(rate x n)) + 1 (and as many by m) of each, so only those are joined: a member of very many groups comes last in each and makes pairs
    only for groups that have hardly any others. A row that is joined has the members of its group that follow, so the overlap is counted where two rows
    meet, and no pair leaves the join that is not similar enough; where two groups meet again, at a later member, the count is less, and the greatest holds.

    Groups of over ``whole`` members would send too much in that way. Their pairs are listed if sizes and places allow the rate, and counted from whole sets.
    """
    pairs = members.select(F.col(group).alias("_g"), F.col(member).alias("_m")).where("_g is not null and _m is not null")
    spread = pairs.groupBy("_m").agg(F.count("*").alias("_f"))
    order = Window.partitionBy("_g").orderBy("_f", "_m")
    size = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    behind = F.collect_list("_m").over(order.rowsBetween(1, whole - 1))
    # rows that say the same are one only here, where a group is together: any count puts the members in an order
    placed = pairs.join(spread, "_m").repartition("_g").distinct().select("_m", "_g", "_f", size.alias("_n"), F.row_number().over(order).alias("_p"), behind.alias("_rest"))
    need = F.greatest(F.lit(max(least, 1)), F.ceil(F.col("_n") * rate - 1e-9))
    # a member of one group alone meets nothing
    first = placed.where((F.col("_f") > 1) & (F.col("_p") <= F.col("_n") - need + 1)).select("_m", "_g", "_n", (F.col("_n") - F.col("_p")).alias("_left"), F.when(F.col("_n") <= whole, F.col("_rest")).alias("_rest"))
    side = lambda x: first.select("_m", F.col("_g").alias(x), *[F.col(c).alias(c + x) for c in ("_n", "_left", "_rest")])
    similar = lambda n: (n >= least) & (n / (F.col("_na") + F.col("_nb") - n) >= rate)
    large, shared = (F.col("_na") > whole) | (F.col("_nb") > whole), 1 + F.size(F.array_intersect("_resta", "_restb"))
    met = side("a").join(side("b"), "_m").where((F.col("a") < F.col("b")) & similar(1 + F.least("_lefta", "_leftb")) & (large | similar(shared)))
    found, _ = written(met.groupBy("a", "b", "_na", "_nb").agg(F.max(F.when(~large, shared)).alias("overlap")), "overlaps")
    unsure = found.where("overlap is null").drop("overlap")
    if not unsure.isEmpty():
        ids = unsure.select(F.col("a").alias("_g")).union(unsure.select("b")).distinct()
        sets = pairs.join(ids, "_g").groupBy("_g").agg(F.collect_set("_m").alias("_s"))
        both = unsure.join(sets.toDF("a", "_sa"), "a").join(sets.toDF("b", "_sb"), "b")
        found = found.where("overlap is not null").unionByName(both.select("a", "b", "_na", "_nb", F.size(F.array_intersect("_sa", "_sb")).alias("overlap")))
    return found.where(similar(F.col("overlap"))).select("a", "b", F.col("overlap").cast("long").alias("overlap"), (F.col("overlap") / (F.col("_na") + F.col("_nb") - F.col("overlap"))).alias("rate"))


def duplicate_severity(rows: DataFrame, key: str, state: str, identities: list[list[str]], grave: str) -> DataFrame:
    """Rows that share an identity (any of the lists of columns) with another row in another state: 2 if that state is the grave one, else 1.

    Per identity only its least and greatest state and whether the grave one occurs are joined back, so a shared identity makes no pairs.
    """
    found = []
    for columns in identities:
        known = rows.where(" and ".join(f"`{c}` is not null" for c in columns))
        states = known.groupBy(*columns).agg(F.min(state).alias("_least"), F.max(state).alias("_most"), F.bool_or(F.col(state) == grave).alias("_grave")).where("_least <> _most")
        severity = F.when(F.col("_grave") & (F.col(state) != grave), 2).otherwise(1)
        found.append(known.join(states, columns).select(key, severity.alias("severity")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(F.max("severity").alias("severity"))


def precedence_match(rows: DataFrame, known: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """The entity that a row's keys lead to: by the first of the keys that some entity has. If that key is one of several entities, the match is ambiguous.

    Columns matched_entity, matched_by, ambiguous. Blank keys lead nowhere.
    """
    joined, hits = rows, []
    for i, key in enumerate(keys):
        filled = known.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.min(entity).alias(f"_least{i}"), F.max(entity).alias(f"_most{i}"))
        joined = joined.join(filled, key, "left")
        hits.append(F.when(F.col(f"_least{i}").isNotNull(), F.struct(F.col(f"_least{i}").alias("e"), F.lit(key).alias("by"), (F.col(f"_least{i}") != F.col(f"_most{i}")).alias("several"))))
    best = F.coalesce(*hits)
    return joined.select(*rows.columns, F.when(~best["several"], best["e"]).alias("matched_entity"), best["by"].alias("matched_by"), F.coalesce(best["several"], F.lit(False)).alias("ambiguous"))


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer merge in which non-blank incoming values win and blanks keep the old."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in values]), new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    pick = lambda c: F.coalesce(F.when(F.col(f"_new_{c}").cast("string") != "", F.col(f"_new_{c}")), F.col(f"_old_{c}"), F.col(f"_new_{c}"))
    return a.join(b, keys, "full").select(*keys, *[pick(c).alias(c) for c in values])


def either_key(left: DataFrame, right: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Left with the right's value by the first key, else by the second; two equi-joins, never an OR."""
    one = right.where(F.col(first).isNotNull()).groupBy(first).agg(F.min(value).alias("_by_first"))
    two = right.where(F.col(second).isNotNull()).groupBy(second).agg(F.min(value).alias("_by_second"))
    return left.join(one, first, "left").join(two, second, "left").select(*left.columns, F.coalesce("_by_first", "_by_second").alias(f"matched_{value}"))


def identity_candidates(observations: DataFrame, identities: DataFrame, kinds: list[str]) -> DataFrame:
    """Observation (columns id and the kinds) with the entities that each of its identities has, and their intersection."""
    out = observations
    for kind in kinds:
        table = identities.where(F.col("kind") == kind).groupBy("value").agg(F.array_sort(F.collect_set("entity")).alias(f"{kind}_entities"))
        out = out.join(table.withColumnRenamed("value", kind), kind, "left").withColumn(f"{kind}_entities", F.coalesce(f"{kind}_entities", F.array().cast(table.schema[f"{kind}_entities"].dataType)))
    common = F.col(f"{kinds[0]}_entities")
    for kind in kinds[1:]:
        common = F.array_intersect(common, F.col(f"{kind}_entities"))
    return out.withColumn("common", F.array_sort(common))
