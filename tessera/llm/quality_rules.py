r"""Operator 9: quality rules with adaptive thresholds, in DataFrame functions only.

Measures are whole numbers (per mille, or hundredths of a code point), so that the counts per value and group are
a mergeable quantile sketch of fixed resolution: partial counts of any rows add up, and its size per group is
bounded by the number of values (1,001 a rate; word lengths end in one open bin). A document is rejected if a
measure lies beyond its group's fence. The fence is the group's tail quantile q, moved outwards by reach x (q - median); a floor
keeps it off q where most values are ties (as of rates that are 0 in nine of ten documents). It lies at most ``WIDER`` times as far from the
group's median as the fence of all documents lies from theirs, so that a source full of junk does not switch its rules off. The
group is (lang, source) where it has min_docs documents, else lang, else all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
#: measure: (tail quantile in per mille, reach, floor upwards, floor downwards or None: no lower fence), floors in the measure's unit
MEASURES = {
    "symbol_rate": (900, 4, 30, None),
    "dup_line_rate": (990, 2, 100, None),
    "repeat_rate": (990, 2, 50, None),
    "echo_rate": (900, 4, 5, None),
    "capital_rate": (900, 4, 5, None),
    "mark_rate": (900, 4, 20, None),
    "mean_word": (900, 4, 20, 20),
}
WIDER = 2
MIN_DOCS = 200
TOP_WORD = 4000


def _rate(part: str, whole: str) -> Column:
    """Per mille, rounded down; 0 where there is nothing."""
    return F.expr(f"cast(least(1000, {part} * 1000 div greatest({whole}, 1)) as int)")


def measure(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the measures.

    Null texts have no words, thus fail the base rules. Repeated rows are measured each. Null lang and source are
    groups of their own ('').
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    # hashes of windows of two, four and eight words, each from two of half its length
    neighbours = lambda c, n: F.zip_with(F.expr(f"slice({c}, 1, greatest(size({c}) - {n}, 0))"), F.expr(f"slice({c}, {n + 1}, greatest(size({c}) - {n}, 0))"), lambda x, y: F.xxhash64(x, y))
    order = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    again = F.filter(
        "ordered",
        lambda x, i: (F.get("ordered", i + 1)["g"] == x["g"]) & F.get("ordered", i + 1).isNotNull() | (F.get("ordered", i - 1)["g"] == x["g"]) & F.get("ordered", i - 1).isNotNull(),
    )
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    count = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("bigint")
    own = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_echoes", "n_capitals", "n_marks"]
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
        .select("*", words.alias("words"), lines.alias("lines"))
        .select(
            "doc_id", "lang", "source", "words",
            F.size("words").cast("bigint").alias("n_words"),
            F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
            count(r"[^#*$%&|<>]+").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).alias("n_echoes"),
            count(r"[^A-Z]+").alias("n_capitals"),
            count(r"[^!?]+").alias("n_marks"),
            F.size("lines").alias("n_lines"),
        )
        .select(*own, "n_lines", F.transform("words", lambda w: F.xxhash64(w)).alias("ones"))
        .select(*own, "n_lines", neighbours("ones", 1).alias("twos"))
        .select(*own, "n_lines", neighbours("twos", 2).alias("fours"))
        .select(*own, "n_lines", neighbours("fours", 4).alias("grams"))
        .select(*own, "n_lines", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), order).alias("ordered"))
        .select(*own, "n_lines", F.when(F.col("ordered").isNotNull(), F.array_sort(F.transform(again, lambda x: x["i"]))).alias("places"))
        .select(*own, "n_lines", F.when(F.col("places").isNotNull(), covered).otherwise(0).cast("bigint").alias("n_repeat_words"))
        .select(
            "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
            _rate("n_symbols", "word_chars").alias("symbol_rate"),
            _rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
            _rate("n_repeat_words", "n_words").alias("repeat_rate"),
            _rate("n_echoes", "n_words").alias("echo_rate"),
            _rate("n_capitals", "word_chars").alias("capital_rate"),
            _rate("n_marks", "word_chars").alias("mark_rate"),
            F.expr(f"cast(least({TOP_WORD}, word_chars * 100 div greatest(n_words, 1)) as int)").alias("mean_word"),
        )
    )


def fences(measured: DataFrame) -> DataFrame:
    """Per level (2: lang and source, 1: lang, 0: all), lang and source: n_docs and the fences of each measure as a struct (most, least, by_floor).

    Only documents that pass the base rules count. The first aggregation has one row per group and value. by_floor tells that the floor set most.
    """
    values = F.expr("stack(" + str(len(MEASURES)) + ", " + ", ".join(f"'{m}', {m}" for m in MEASURES) + ") as (measure, value)")
    sketch = measured.where(~F.col("base_failed")).select("lang", "source", values).groupBy("lang", "source", "measure", "value").agg(F.count("*").alias("n"))
    levels = F.expr("explode(array(struct(2 as level, lang as lang, source as source), struct(1 as level, lang as lang, '' as source), struct(0 as level, '' as lang, '' as source))) as at")
    merged = sketch.select("measure", "value", "n", levels).groupBy("at", "measure", "value").agg(F.sum("n").alias("n"))
    # the values of one group and measure: a bounded number (see above), whatever the number of documents
    ranked = merged.groupBy("at", "measure").agg(F.sum("n").alias("n_docs"), F.array_sort(F.collect_list(F.struct("value", "n"))).alias("counts"))
    of = lambda i: F.create_map(*[x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v[i]).cast("int"))])[F.col("measure")]

    def quantile(per_mille: Column) -> Column:
        """The least value that so many documents, rounded up, do not exceed."""
        need = F.floor((F.col("n_docs") * per_mille + 999) / 1000)
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("value"))
        return F.aggregate("counts", start, lambda a, c: F.struct((a["seen"] + c["n"]).alias("seen"), F.when(a["value"].isNull() & (a["seen"] + c["n"] >= need), c["value"]).otherwise(a["value"]).alias("value")))["value"]

    points = ranked.select("at", "measure", "n_docs", quantile(1000 - of(0)).alias("low"), quantile(F.lit(500)).alias("median"), quantile(of(0)).alias("high"))
    up, down = of(1) * (F.col("high") - F.col("median")), of(1) * (F.col("median") - F.col("low"))
    raw = points.select("*", (F.col("high") + F.greatest(up, of(2))).alias("most"), F.when(of(3).isNotNull(), F.col("low") - F.greatest(down, of(3))).alias("least"), (up < of(2)).alias("by_floor"))
    every = raw.where("at.level = 0").select("measure", (WIDER * (F.col("most") - F.col("median"))).alias("farthest"), (WIDER * (F.col("median") - F.col("least"))).alias("farthest_down"))
    bounded = raw.join(F.broadcast(every), "measure")  # a row a measure
    fence = F.struct(F.least("most", F.col("median") + F.col("farthest")).alias("most"), F.greatest("least", F.col("median") - F.col("farthest_down")).alias("least"), "by_floor")
    return bounded.groupBy("at").agg(F.max("n_docs").alias("n_docs"), F.map_from_entries(F.collect_list(F.struct("measure", fence.alias("fence")))).alias("fence")).select("at.level", "at.lang", "at.source", "n_docs", "fence")


def judge(measured: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """measured with kept: the base rules hold and no measure is beyond its group's fence.

    measured is read twice; hand over a written table.
    """
    found = fences(measured).where((F.col("n_docs") >= min_docs) | (F.col("level") == 0))
    level = lambda n, *keys: found.where(F.col("level") == n).select(*keys, F.col("fence").alias(f"fence{n}"))
    joined = measured.join(level(2, "lang", "source"), ["lang", "source"], "left").join(level(1, "lang"), ["lang"], "left").join(F.broadcast(level(0)), F.lit(True), "left")
    fence = F.coalesce("fence2", "fence1", "fence0")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col("fence")[m]["most"]) & (F.col(m) >= F.coalesce(F.col("fence")[m]["least"], F.lit(0)))
    return joined.withColumn("fence", fence).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).select(*measured.columns, "kept")


def judged_documents(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The measures and the verdict of every document. An empty table gives no rows."""
    measured, _ = written(measure(docs), "quality-rules")
    return judge(measured, min_docs)
