"""Operator 8: toxicity by the nearest labelled examples under exact TF-IDF cosine.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows of the training folds (those first in hash order of doc_id). A text's
terms are its words (words.LETTERS), the runs of ``GRAM`` bytes in them, and their first ``OPENINGS`` bytes. The vocabulary is the at most ``VOCABULARY`` terms whose
rates in toxic and clean fitted rows differ by ``LEAST_Z`` standard errors or more. In it a text is the vector (1 + ln tf) x idf with
idf = ln((N + 1) / (df + 1)) + 1 over all N documents, of length 1.

The index holds up to ``PER_CLASS`` examples of each class as postings in blocks of ``BLOCK`` examples, each with its largest weight.
Queries add the products of their weights with the blocks' largest, take the blocks in order of that bound, and leave out blocks whose
bound does not reach the k-th best cosine so far, so the k nearest are exact. Rows with one text are one example, with the share of toxic among
their labels. The example with the query's very text does not vote, as it may be the query itself; the k nearest of the others do.

A vote is the share of toxic among the nearest, weighted by cosine. The votes of the fitted rows give the calibration, a logistic curve
through the counts per vote and label; texts without a vote score the rate of toxic among fitted rows without one. What a text gets
depends on nothing but its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, discard, slices, text_bytes, written
from .words import LETTERS, mix, word_hashes

FIT_ROWS = 65_536
VOCABULARY = 4096
LEAST_Z = 5.0
LEAST_DOCS = 5
LEAST_RATIO = 3.0
GRAM = 5
OPENINGS = (6, 7, 8)
PER_CLASS = 1024
BLOCK = 64
NEAREST = 100
ROWS = 128
BATCH_BYTES = 1 << 20
THRESHOLD = 0.3
BINS = 256


def terms_of(data: np.ndarray, bounds: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each row: row, hash, count; sorted by row and hash. Only those in known (sorted), if given."""
    hashes, rows, starts, ends = word_hashes(data, bounds)
    letters = LETTERS[data]
    opening = []
    for n in OPENINGS:
        long = np.flatnonzero(ends - starts > n)
        codes = np.full(len(long), n, np.uint64)
        for i in range(n):
            codes = codes * np.uint64(0x9E3779B97F4A7C15) + letters[starts[long] + i]
        opening.append((mix(codes), rows[long]))
    codes = letters[: max(len(data) - GRAM + 1, 0)].copy()
    whole = codes != 0
    for i in range(1, GRAM):
        more = letters[i : len(codes) + i]
        whole &= more != 0
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + more
    for cut in bounds[1:-1]:  # runs over the end of a row
        whole[max(cut - GRAM + 1, 0) : cut] = False
    at = np.flatnonzero(whole)
    hashes = np.concatenate([hashes, mix(codes[at]), *(h for h, _ in opening)])
    rows = np.concatenate([rows, np.searchsorted(bounds, at, "right") - 1, *(r for _, r in opening)])
    if known is not None:
        seen = np.zeros(1 << 16, bool)
        seen[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        some = np.flatnonzero(seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        hashes, rows = hashes[some], rows[some]
        if len(known):
            some = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
            hashes, rows = hashes[some], rows[some]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    return rows[first], hashes[first], np.diff(np.append(first, len(hashes)))


class BlockMaxIndex:
    """Postings of examples by term, cut in blocks of examples with their largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        # neighbours share their commonest term (thus mostly a language), so that blocks differ and bounds bite
        order = sorted(range(len(vectors)), key=lambda j: (vectors[j][0][np.argmin(vectors[j][1])] if len(vectors[j][0]) else 0, j))
        self.order, self.n, self.block = np.array(order, np.int64), len(vectors), block
        self.n_blocks = -(-self.n // block)
        hashes = np.concatenate([np.zeros(0, np.int64), *(vectors[j][0] for j in order)])
        weights = np.concatenate([np.zeros(0), *(vectors[j][1] for j in order)])
        examples = np.repeat(np.arange(self.n), [len(vectors[j][0]) for j in order])
        by = np.lexsort((examples, hashes))
        hashes, self.examples, self.weights = hashes[by], examples[by].astype(np.int32), weights[by]
        self.terms, starts = np.unique(hashes, return_index=True)
        blocks = self.examples // block
        term_of = np.repeat(np.arange(len(self.terms)), np.diff(np.append(starts, len(hashes))))
        first = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (term_of[1:] != term_of[:-1])])) if len(hashes) else np.zeros(0, np.int64)
        self.entry_block, self.entry_from, self.entry_to = blocks[first], first, np.append(first[1:], len(hashes))
        self.entry_most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_entries = np.searchsorted(term_of[first], np.arange(len(self.terms) + 1))

    def nearest(self, rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of n_rows queries the k largest cosines and their examples (places in the given vectors); short of k, cosine 0."""
        k = min(k, self.n)
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        known = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        rows, at, weights = rows[known], at[known], weights[known]
        pair, entry = _ranges(self.term_entries[at], self.term_entries[at + 1])
        entry_row = rows[pair]
        bound = np.bincount(entry_row * self.n_blocks + self.entry_block[entry], weights[pair] * self.entry_most[entry], n_rows * self.n_blocks).reshape(n_rows, self.n_blocks)
        ranked = np.argsort(-bound, axis=1, kind="stable")
        scores = np.zeros(n_rows * self.n)
        kth = np.zeros(n_rows)
        step = -(-k // self.block) + 1
        done = 0
        while done < self.n_blocks:
            wanted = ranked[:, done : done + step]
            bounds = np.take_along_axis(bound, wanted, 1)
            active = np.zeros((n_rows, self.n_blocks), bool)
            np.put_along_axis(active, wanted, (bounds > 0) & (bounds >= kth[:, None] - 1e-9), 1)
            use = active[entry_row, self.entry_block[entry]]
            if not use.any():
                break
            which, posting = _ranges(self.entry_from[entry[use]], self.entry_to[entry[use]])
            scores += np.bincount(entry_row[use][which] * self.n + self.examples[posting], weights[pair[use]][which] * self.weights[posting], n_rows * self.n)
            kth = np.partition(scores.reshape(n_rows, self.n), self.n - k, axis=1)[:, self.n - k]
            done += step
        table = scores.reshape(n_rows, self.n)
        best = np.argsort(-table, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(table, best, 1), self.order[best]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of all ranges one after the other, each with its range's place."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which]


def fit_rows(labels: DataFrame, most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids (sorted) and toxic of at most ``most`` labelled rows outside the held-out fold; of repeated rows the higher label. Null ids and labels are left out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    train = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = sorted((r.doc_id, r.toxic) for r in train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect())
    return np.array([i for i, _ in rows], np.int64), np.array([t for _, t in rows], np.int64)


def vocabulary(docs: DataFrame, ids: np.ndarray, toxic: np.ndarray, most: int | None = VOCABULARY, least_z: float = LEAST_Z) -> np.ndarray:
    """The hashes (sorted) of the terms that tell the fitted rows' classes apart, at most ``most`` of them (None: all)."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, toxic))

    def count(batches):
        ids, toxic = shared.value
        kept, n = [], 0
        for batch in slices(batches, BATCH_BYTES):
            given = batch.column("doc_id")
            own = pc.fill_null(given, 0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            found = (ids[at] == own) & given.is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(batch.num_rows, bool)
            if not found.any():
                continue
            rows, hashes, _ = terms_of(*text_bytes(batch.column("text").filter(pa.array(found))))
            kept.append(_added([(hashes, toxic[at[found]][rows], 1 - toxic[at[found]][rows])]))
            n += len(kept[-1][0])
            if n > 500_000:
                kept = [_added(kept)]
                n = len(kept[0][0])
                if n > 250_000:
                    yield _counts(*kept[0])
                    kept, n = [], 0
        if kept:
            yield _counts(*_added(kept))

    counts = arrow_map(docs, count, "term bigint, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n1, n0 = max(int(toxic.sum()), 1), max(int(len(toxic) - toxic.sum()), 1)
    rate = (F.col("a") + F.col("b")) / (n1 + n0)
    z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    higher, lower = F.greatest(F.col("a") / n1, F.col("b") / n0), F.least(F.col("a") / n1, F.col("b") / n0)
    telling = counts.where((F.col("a") + F.col("b") >= LEAST_DOCS) & (higher >= LEAST_RATIO * lower)).withColumn("z", z).where(F.col("z") >= least_z)
    found = (telling if most is None else telling.orderBy(F.desc("z"), "term").limit(most)).select("term").collect()
    return np.sort(np.array([r.term for r in found], np.int64).view(np.uint64))


def _added(parts):
    terms, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return terms, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(terms)).astype(np.int64) for i in (1, 2))


def _counts(terms, toxic, clean):
    return pa.RecordBatch.from_pydict({"term": pa.array(terms.view(np.int64)), "toxic": pa.array(toxic), "clean": pa.array(clean)})


def vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Per document: doc_id, text_key (the hash of its text), terms (places in the vocabulary) and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known, ints = shared.value, pa.list_(pa.int32())
        for batch in slices(batches, BATCH_BYTES):
            rows, hashes, counts = terms_of(*text_bytes(batch.column("text")), known)
            places, cuts = np.searchsorted(known, hashes), np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (places, counts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "terms": lists[0].cast(ints), "counts": lists[1].cast(ints)})

    return arrow_map(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")), run, "doc_id bigint, text_key bigint, terms array<int>, counts array<int>")


def frequencies(table: DataFrame, n_terms: int) -> np.ndarray:
    """How many rows of vectors() have each term: each partition counts its own, so that no row is sent for a term of a document."""

    def count(batches):
        seen = np.zeros(n_terms, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some.astype(np.int32)), "n": pa.array(seen[some])})

    out = np.zeros(n_terms)
    for r in arrow_map(table.select("terms"), count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a row a term of the vocabulary
        out[r.term] = r.n
    return out


def unit_weights(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, n_rows: int) -> np.ndarray:
    weights = (1 + np.log(np.maximum(counts, 1))) * idf[terms]
    return weights / np.sqrt(np.bincount(rows, weights**2, n_rows))[rows]


def build_index(rows: list, idf: np.ndarray) -> BlockMaxIndex:
    """rows: terms and counts of each example."""
    found = [(np.array(t, np.int64), unit_weights(np.zeros(len(t), np.int64), np.array(t, np.int64), np.array(c, float), idf, 1)) for t, c in rows]
    return BlockMaxIndex(found)


def votes(table: DataFrame, index: BlockMaxIndex, idf: np.ndarray, examples: list, nearest: int = NEAREST) -> DataFrame:
    """Per row of vectors(): doc_id, vote (null without neighbours), evidence: the three nearest (doc_id, cosine, toxic). examples, one a text: (doc_id, text_key, toxic, from 0 to 1)."""
    k = int(np.clip(len(examples) // 20, min(5, len(examples)), nearest))
    shared = table.sparkSession.sparkContext.broadcast((index, idf, examples))

    def run(batches):
        index, idf, examples = shared.value
        ids, keys, labels = (np.array([x[i] for x in examples], kind) for i, kind in enumerate((np.int64, np.int64, float)))
        evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = [x or [] for x in batch.column("terms").to_pylist()]
                rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
                terms = np.array([t for x in lists for t in x], np.int64)
                counts = np.array([c for x in batch.column("counts").to_pylist() for c in x or []], float)
                best, who = index.nearest(rows, terms, unit_weights(rows, terms, counts, idf, batch.num_rows), batch.num_rows, k + 1) if k else (np.zeros((batch.num_rows, 0)), np.zeros((batch.num_rows, 0), np.int64))
                own = keys[who] == batch.column("text_key").to_numpy()[:, None]
                others = np.argsort(own, axis=1, kind="stable")[:, :k]
                weight, voters = (np.take_along_axis(x, others, 1) for x in (np.where(own, 0, best), who))
                sums = weight.sum(1)
                vote = (weight * labels[voters]).sum(1) / np.where(sums > 0, sums, 1)
                evidence = [[{"doc_id": int(ids[j]), "cosine": float(c), "toxic": int(labels[j] >= 0.5)} for c, j in zip(b[:3], w[:3], strict=True) if c > 0] for b, w in zip(best, who, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "vote": pa.array([float(v) if x > 0 else None for v, x in zip(vote, sums, strict=True)], pa.float64()), "evidence": pa.array(evidence, evidence_type)})

    return arrow_map(table, run, "doc_id bigint, vote double, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>")


def fit_curve(values: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Offset and slope (never negative) of the logistic curve through the counts of toxic and clean rows at the values."""
    a, b = np.log((toxic.sum() + 1) / (clean.sum() + 1)), 0.0
    x, n = np.stack([np.ones(len(values)), values], 1), toxic + clean
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * values, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(hessian, x.T @ (toxic - n * p) - np.array([0, 1e-3]) * b)
        a, b = a + np.clip(step[0], -4, 4), b + np.clip(step[1], -8, 8)
        if abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if b >= 0 else (float(np.log((toxic.sum() + 1) / (clean.sum() + 1))), 0.0)


def _labelled(spark: SparkSession, ids: np.ndarray, toxic: np.ndarray) -> DataFrame:
    """The fitted rows as a small table: at most FIT_ROWS rows."""
    return F.broadcast(spark.createDataFrame(list(zip(ids.tolist(), toxic.tolist(), strict=True)), "doc_id bigint, toxic int"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit: int = FIT_ROWS, per_class: int = PER_CLASS, terms: int | None = VOCABULARY) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence.

    The model is fitted on at most ``fit`` labelled rows, ``per_class`` examples of each class and ``terms`` terms (None: every telling term).
    Null texts are empty; texts without a term of the vocabulary score the fitted rows' rate of toxic among such texts. Repeated rows
    are scored each. Without labelled rows every score is 0.5. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids, toxic = fit_rows(labels, fit)
    terms = vocabulary(docs, ids, toxic, terms)
    table, table_path = written(vectors(docs, terms), "toxicity-vectors")
    total = table.count()
    idf = np.log((total + 1) / (frequencies(table, len(terms)) + 1)) + 1
    fitted = table.join(_labelled(spark, ids, toxic), "doc_id")
    first = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id")
    grouped = fitted.where(F.size("terms") > 0).groupBy("text_key").agg(F.min(first).alias("first"), F.avg("toxic").alias("share"), F.min_by("terms", first).alias("terms"), F.min_by("counts", first).alias("counts"))
    texts, texts_path = written(grouped.select("first.*", "text_key", "share", "terms", "counts"), "toxicity-texts")
    examples = []
    for label in (True, False):
        some = texts.where((F.col("share") >= 0.5) == label).orderBy("hash", "doc_id", "text_key").limit(per_class)
        examples += some.collect()
    index = build_index([(r.terms, r.counts) for r in examples], idf)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    voted, _ = written(votes(table.repartition(n), index, idf, [(r.doc_id, r.text_key, r.share) for r in examples]), "toxicity-votes")
    discard(spark, table_path, texts_path)
    counts, silent = np.zeros((2, BINS + 1)), np.zeros(2)
    for r in voted.join(_labelled(spark, ids, toxic), "doc_id").groupBy(F.floor(F.col("vote") * BINS).alias("bin"), "toxic").count().collect():
        if r.bin is None:
            silent[int(r.toxic > 0)] += r["count"]
        else:
            counts[int(r.toxic > 0), r.bin] += r["count"]
    offset, slope = fit_curve((np.arange(BINS + 1) + 0.5) / BINS, counts[1], counts[0])
    prior = float((silent[1] + 1) / (silent.sum() + 2))
    score = F.coalesce(1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * F.col("vote")))), F.lit(prior))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return voted.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "evidence")
