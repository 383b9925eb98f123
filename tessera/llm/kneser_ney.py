"""Operator 3: quality by the perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, of order ``ORDER``, with an open vocabulary of grams: its tables grow with the text, live in shards and are never gathered in one place.
Everything is sharded by the two bytes before a gram's last one, so that a gram, its suffixes and their contexts (of order 3 or more) meet in one shard. Only
orders 1 and 2 are shared by shards: 65,536 numbers at most, which are broadcast.

1. Counts: each scan partition sends the distinct grams of its trusted texts with their counts, in blobs of sorted differences; shards add them, count
   continuations for the lower orders, and say how many grams have counts 1 to 4 (for the discounts).
2. Blocks: all texts are written once, a few megabytes in a row, in buckets by block.
3. Count joins: each block sends its distinct grams to the shards, where they are joined with the tables of all orders; the logarithms of their probabilities
   come back to the block, in the order in which the grams were sent.
4. Each document's perplexity is the sum over its grams. Per language, the threshold is a high quantile of the trusted texts' perplexity, from counts per
   value that merge.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, discard, shared_dir, slices, text_bytes, written

ORDER = 5
QUANTILE_PER_MILLE = 995
SLACK = 20  # thousandths of the logarithm
MIN_DOCS = 100
BROADCAST_IDS = 2_000_000
BATCH_BYTES = 2 << 20
#: bytes of text in a block and documents in a batch of it, whose numbers take the bits that a gram leaves
BLOCK_BYTES, DOCS = 8 << 20, 1 << 16
MERGE = 3_000_000
_COUNTS = "shard int, kind int, gram bigint, n bigint, data binary"


def grams_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte, its last byte lowest; before a text there are zero bytes."""
    symbols = data.astype(np.uint64)
    grams = symbols.copy()
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(1, min(ORDER, len(data))):
        grams[back:] |= np.where(place[back:] >= back, symbols[:-back] << np.uint64(8 * back), np.uint64(0))
    return grams


def shard_of(grams: np.ndarray, n_shards: int) -> np.ndarray:
    return (((grams >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B1) % np.uint64(1 << 32) % np.uint64(n_shards)).astype(np.int32)


def packed(grams: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted grams as differences, compressed, with further arrays; read by unpacked."""
    parts = [np.diff(grams, prepend=np.uint64(0)), *others]
    shuffled = b"".join(p.view(np.uint8).reshape(len(p), p.dtype.itemsize).T.tobytes() for p in parts)  # bytes of one rank together
    return zstandard.compress(shuffled, 1)


def unpacked(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    for kind in ("u8", *kinds):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind)[:, 0])
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and their summed counts."""
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(grams), 1), bool), grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _by_shard(grams: np.ndarray, n_shards: int):
    """(shard, places) of sorted grams, whose order stays."""
    shard = shard_of(grams, n_shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
    return [(s, order[cuts[s] : cuts[s + 1]]) for s in range(n_shards) if cuts[s] < cuts[s + 1]]


def _batch(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in kinds.split(", ")]
    return pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], types[kind]) for i, (name, kind) in enumerate(names)})


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with doc_id, lang, text whose label says good quality. The labels are broadcast only up to BROADCAST_IDS of them."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return docs.join(F.broadcast(good) if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else good, "doc_id", "left_semi")


def count_grams(docs: DataFrame, n_shards: int) -> DataFrame:
    """Rows of shards: their grams of order ORDER with counts in a blob (kind 0); of each lower order and count from 1 to 4 how many grams have it
    (kind order, gram: the count); and of the pairs of last bytes in how many grams of order 3 they are (kind -1)."""

    def send(batches):
        kept = []
        for batch in slices(batches, BATCH_BYTES):
            grams, counts = np.unique(grams_of(*text_bytes(batch.column("text"))), return_counts=True)
            kept.append((grams, counts))
            if sum(len(g) for g, _ in kept) > MERGE:
                kept = [_counted(kept)]
                if len(kept[0][0]) > MERGE // 2:
                    yield rows(*kept.pop())
        if kept:
            yield rows(*_counted(kept))

    def rows(grams, counts):
        return _batch(_COUNTS, [(s, 0, 0, len(at), packed(grams[at], counts[at].astype(np.int64))) for s, at in _by_shard(grams, n_shards)])

    def add(batches):
        blobs: dict[int, list] = {}
        for batch in batches:
            for shard, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "data")), strict=True):
                blobs.setdefault(shard, []).append(tuple(unpacked(data, n, "i8")))
                if len(blobs[shard]) >= 16:
                    blobs[shard] = [_counted(blobs[shard])]
        for shard, parts in blobs.items():
            grams, counts = _counted(parts)
            out = [(shard, 0, 0, len(grams), packed(grams, counts))]
            for order, (_, n) in zip(range(ORDER, 2, -1), lower_orders(grams, counts), strict=True):
                out += [(shard, order, i, int((n == i).sum()), None) for i in range(1, 5)]
            pairs, n = np.unique(np.unique(grams & np.uint64(0xFFFFFF)) & np.uint64(0xFFFF), return_counts=True)
            out += [(shard, -1, int(p), int(k), None) for p, k in zip(pairs, n, strict=True)]
            yield _batch(_COUNTS, out)

    sent = arrow_map(docs.select("text"), send, _COUNTS).repartitionById(n_shards, F.col("shard"))
    return arrow_map(sent, add, _COUNTS)


def lower_orders(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams (sorted) and counts of orders ORDER down to 3: those of lower orders are continuation counts, of distinct symbols before."""
    out = [(grams, counts)]
    for order in range(ORDER - 1, 2, -1):
        out.append(tuple(x.astype(kind) for x, kind in zip(np.unique(out[-1][0] & np.uint64((1 << 8 * order) - 1), return_counts=True), ("u8", "i8"), strict=True)))
    return out


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """For counts 1, 2 and 3 or more (Chen and Goodman); fallbacks where a count of counts is 0."""
    n1, n2, n3, n4 = (counts_of_counts.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [i - (i + 1) * y * b / a if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), raw, strict=True))


def interpolated(grams: np.ndarray, counts: np.ndarray, d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of grams (sorted) of one order with their counts: the terms, and the contexts (sorted) with their back-off weights."""
    first = np.flatnonzero(np.concatenate([np.ones(min(len(grams), 1), bool), grams[1:] >> np.uint64(8) != grams[:-1] >> np.uint64(8)]))
    if not len(first):
        return np.zeros(0), grams, np.zeros(0)
    discount = np.array([0.0, *d])[np.minimum(counts, 3)]
    totals = np.add.reduceat(counts, first)
    terms = (counts - discount) / np.repeat(totals, np.diff(np.append(first, len(grams))))
    return terms, grams[first] >> np.uint64(8), np.add.reduceat(discount, first) / totals


def pair_probabilities(pairs: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """P(last byte | byte before), by pair: orders 2 and 1, from the continuation counts of pairs."""
    order = np.argsort(pairs)
    pairs, ns = pairs[order].astype(np.uint64), ns[order].astype(np.int64)
    lower = np.full(256, 1 / 256)
    singles, n1 = np.unique(pairs & np.uint64(0xFF), return_counts=True)
    for grams, counts in ((singles.astype(np.uint64), n1.astype(np.int64)), (pairs, ns)):
        terms, contexts, weights = interpolated(grams, counts, discounts({i: int((counts == i).sum()) for i in range(1, 5)}))
        back = np.ones(256)
        back[contexts.astype(np.int64)] = weights
        table = lower * back[0] if len(lower) == 256 and grams is not pairs else (back[:, None] * lower[None, :]).ravel()
        table[grams.astype(np.int64)] += terms
        lower = table
    return lower


def log_probabilities(grams: np.ndarray, tables: list[tuple], pair: np.ndarray) -> np.ndarray:
    """Of grams of order ORDER; tables: grams, terms, contexts and weights of orders 3 to ORDER."""
    p = pair[(grams & np.uint64(0xFFFF)).astype(np.int64)]
    for order, (known, terms, contexts, weights) in zip(range(3, ORDER + 1), tables, strict=True):
        own = grams & np.uint64((1 << 8 * order) - 1)
        for keys, at, values, add in ((contexts, own >> np.uint64(8), weights, False), (known, own, terms, True)):
            if len(keys):
                place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
                found = keys[place] == at
                p = p + np.where(found, values[place], 0.0) if add else p * np.where(found, values[place], 1.0)
    return np.log(p)


def model(counts: DataFrame) -> tuple[DataFrame, dict[int, tuple], np.ndarray]:
    """The shards' blobs, the discounts of orders 3 to ORDER, and the probabilities of pairs: what the driver gets is bounded by 65,536 rows."""
    some = counts.where("kind <> 0").groupBy("kind", "gram").agg(F.sum("n").alias("n")).collect()
    by_order = {order: discounts({r.gram: r.n for r in some if r.kind == order}) for order in range(3, ORDER + 1)}
    pairs = [(r.gram, r.n) for r in some if r.kind == -1]
    pair = pair_probabilities(np.array([p for p, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64))
    return counts.where("kind = 0"), by_order, pair


_BLOCKS = "block string, n int, data binary, bounds binary, doc_id array<bigint>, lang array<string>"


def blocks(docs: DataFrame, n_parts: int) -> str:
    """The name of a table of all texts, a block in a row, in n_parts buckets by block."""
    spark = docs.sparkSession

    def run(batches):
        place, at, kept, size = TaskContext.get(), 0, [], 0

        def row():
            nonlocal at
            at += 1
            parts = [text_bytes(b.column("text")) for b in kept]
            sizes = np.concatenate([np.diff(b) for _, b in parts])
            data = zstandard.compress(b"".join(d.tobytes() for d, _ in parts), 3)
            ids, langs = ([x for b in kept for x in b.column(c).to_pylist()] for c in ("doc_id", "lang"))
            kinds = {"doc_id": pa.list_(pa.int64()), "lang": pa.list_(pa.string())}
            name = f"{place.partitionId()}-{at}"
            return pa.RecordBatch.from_pydict({"block": pa.array([name]), "n": pa.array([len(ids)], pa.int32()), "data": pa.array([data], pa.binary()), "bounds": pa.array([np.cumsum(sizes, dtype=np.int64).tobytes()], pa.binary()), "doc_id": pa.array([ids], kinds["doc_id"]), "lang": pa.array([langs], kinds["lang"])})

        for batch in slices(batches, BATCH_BYTES):
            if kept and size + batch.column("text").nbytes > BLOCK_BYTES:
                yield row()
                kept, size = [], 0
            kept.append(batch)
            size += batch.column("text").nbytes
        if kept:
            yield row()

    name = f"tessera_blocks_{uuid.uuid4().hex}"
    arrow_map(docs.select("doc_id", "lang", "text"), run, _BLOCKS).write.bucketBy(n_parts, "block").option("path", f"{shared_dir(spark)}/tessera/{name}").option("compression", "uncompressed").saveAsTable(name)
    return name


def _texts(data: bytes, bounds: bytes):
    """Batches of a block: first document, bytes and bounds, of BATCH_BYTES and DOCS documents at most (a longer text is one)."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    ends = np.concatenate([np.zeros(1, np.int64), np.frombuffer(bounds, np.int64)])
    at = 0
    while at < len(ends) - 1:
        upto = max(at + 1, min(at + DOCS, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, "right")) - 1))
        yield at, raw[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at]
        at = upto


def _distinct(data: bytes, bounds: bytes) -> np.ndarray:
    parts = [np.unique(grams_of(d, b)) for _, d, b in _texts(data, bounds)]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


_ASKED = "shard int, kind int, block string, n int, data binary"


def perplexities(docs: DataFrame, counts: DataFrame, n_shards: int) -> tuple[DataFrame, str]:
    """Per document: doc_id, lang, n_bytes, log_ppl (the mean negative log probability; null for empty texts); and the table of blocks, to be dropped when it is read."""
    spark = docs.sparkSession
    shards, by_order, pair = model(counts)
    shared = spark.sparkContext.broadcast((by_order, pair))
    name = blocks(docs, n_shards)

    def ask(batches):
        for batch in batches:
            for block, data, bounds in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "bounds")), strict=True):
                grams = _distinct(data, bounds)
                yield _rows([(s, 1, block, len(at), packed(grams[at])) for s, at in _by_shard(grams, n_shards)])

    def _rows(rows):
        kinds = {"shard": pa.int32(), "kind": pa.int32(), "block": pa.string(), "n": pa.int32(), "data": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())})

    def answer(batches):
        by_order, pair = shared.value
        tables, own = None, None
        for batch in batches:
            out = []
            for shard, kind, block, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "block", "n", "data")), strict=True):
                if own != shard:
                    own, tables = shard, [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))] * (ORDER - 2)
                if kind == 0:
                    orders = lower_orders(*unpacked(data, n, "i8"))
                    tables = [(g, *interpolated(g, c, by_order[o])) for o, (g, c) in zip(range(3, ORDER + 1), reversed(orders), strict=True)]
                else:
                    out.append((shard, kind, block, n, log_probabilities(unpacked(data, n)[0], tables, pair).astype(np.float32).tobytes()))
            yield _rows(out)

    def score(batches):
        for batch in batches:
            for data, bounds, ids, langs, answers in zip(*(batch.column(c).to_pylist() for c in ("data", "bounds", "doc_id", "lang", "answers")), strict=True):
                grams = _distinct(data, bounds)
                logs = np.zeros(len(grams), np.float32)
                found = {a["shard"]: a["data"] for a in answers or []}
                for shard, at in _by_shard(grams, n_shards):
                    logs[at] = np.frombuffer(found[shard], np.float32)
                for first, d, b in _texts(data, bounds):
                    n = np.diff(b)
                    keys = np.sort(grams_of(d, b) << np.uint64(16) | np.repeat(np.arange(len(n), dtype=np.uint64), n))
                    terms = logs[np.searchsorted(grams, keys >> np.uint64(16))].astype(np.float64)
                    mean = -np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), terms, len(n)) / np.maximum(n, 1)
                    own = slice(first, first + len(n))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[own], pa.int64()), "lang": pa.array(langs[own], pa.string()), "n_bytes": pa.array(n.astype(np.int64)), "log_ppl": pa.array(mean, mask=n == 0)})

    table = spark.table(name)
    asked = arrow_map(table.select("block", "data", "bounds"), ask, _ASKED)
    met = asked.unionByName(shards.select("shard", "kind", F.lit(None).cast("string").alias("block"), F.col("n").cast("int").alias("n"), "data"))
    answers = arrow_map(met.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "kind"), answer, _ASKED)
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("answers"))  # a row a shard
    joined = table.hint("merge").join(per_block, "block", "left").select("data", "bounds", "doc_id", "lang", "answers")
    return arrow_map(joined, score, "doc_id bigint, lang string, n_bytes bigint, log_ppl double"), name


def thresholds(scored: DataFrame, per_mille: int = QUANTILE_PER_MILLE, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per lang (null: all languages): threshold of log_ppl, from rows of trusted texts. Languages with fewer texts than min_docs are left out."""
    counts = scored.where("log_ppl is not null").groupBy("lang", F.floor(F.col("log_ppl") * 1000).alias("value")).agg(F.count("*").alias("n"))
    level = F.explode(F.array(F.struct(F.lit(1).alias("level"), F.coalesce("lang", F.lit("")).alias("lang")), F.struct(F.lit(0).alias("level"), F.lit("").alias("lang")))).alias("at")
    merged = counts.select("value", "n", level).groupBy("at", "value").agg(F.sum("n").alias("n"))
    lists = merged.groupBy("at").agg(F.sum("n").alias("docs"), F.array_sort(F.collect_list(F.struct("value", "n"))).alias("counts"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("value"))
    reached = lambda a, c: a["value"].isNull() & ((a["seen"] + c["n"]) * 1000 >= F.col("docs") * per_mille)
    walked = F.aggregate("counts", start, lambda a, c: F.struct((a["seen"] + c["n"]).alias("seen"), F.when(reached(a, c), c["value"]).otherwise(a["value"]).alias("value")))
    return lists.where((F.col("at.level") == 0) | (F.col("docs") >= min_docs)).select("at.level", "at.lang", ((walked["value"] + 1 + SLACK) / 1000).alias("threshold"))


def judge_documents(docs: DataFrame, labels: DataFrame, per_mille: int = QUANTILE_PER_MILLE, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: doc_id, lang, n_bytes, perplexity, threshold, kept.

    kept: the perplexity is at most the language's threshold (that of all languages where there are few trusted texts; none without trusted text, then
    all but empty texts are kept). Null texts are empty: perplexity null, not kept. Null lang is a language. Repeated rows are judged each. Other columns are
    not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    trusted = _trusted(docs, labels)
    counts, _ = written(count_grams(trusted, n_shards), "gram-counts")
    found, blocks_name = perplexities(docs, counts, n_shards)
    scored, _ = written(found, "perplexity")
    spark.sql(f"DROP TABLE {blocks_name}")
    discard(spark, f"{shared_dir(spark)}/tessera/{blocks_name}")
    limits, _ = written(thresholds(_trusted(scored, labels), per_mille, min_docs), "perplexity-thresholds")
    own = limits.where("level = 1").select(F.col("lang").alias("_lang"), F.col("threshold").alias("_own"))
    every = F.broadcast(limits.where("level = 0").select(F.col("threshold").alias("_all")))  # one row
    joined = scored.join(own, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left").join(every, F.lit(True), "left")
    limit = F.coalesce("_own", "_all", F.lit(float("inf")))
    return joined.select("doc_id", "lang", "n_bytes", F.exp("log_ppl").alias("perplexity"), F.exp(limit).alias("threshold"), F.coalesce(F.col("log_ppl") <= limit, F.lit(False)).alias("kept"))
