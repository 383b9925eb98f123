"""Operator 10: SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most four bits share at least four of them (the guaranteed
minimum), thus all bytes of at least one of the 70 sets of four positions. The index therefore posts every distinct fingerprint under each
set and its bytes; a posting list holds what shares four bytes, not one, and stays short on any input that is not itself of near
copies. In a list the shared positional bytes of a pair are tallied and the rest is verified by the differing bits; as a list's members share the
minimum by their key, the tally can reject none. Lists of many near copies yield the edges of a spanning forest, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import arrow_map, slices, written

SHINGLE = 4
SEED = 42
MOST_BITS = 4
BYTES = 8
BATCH_BYTES = 1 << 20


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Unsigned fingerprints of the UTF-8 texts."""
    hashes, cuts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()
        cuts.append(len(hashes))
        if len(words) < SHINGLE:
            if words:
                hashes.append(digest(b" ".join(words), SEED))
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: -SHINGLE]]).tolist()
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    cuts.append(len(hashes))
    out = np.zeros(len(texts), np.uint64)
    values, cuts = np.array(hashes, "<u8"), np.array(cuts)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits = np.add.reduceat(bits, cuts[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * set_bits > np.diff(cuts)[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Null texts have no words."""

    def run(batches):
        for batch in slices(batches, BATCH_BYTES):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fingerprints_of(texts).view(np.int64))})

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, fp bigint")


def _masks(shared: int) -> list[int]:
    masks = []
    for positions in combinations(range(BYTES), shared):
        mask = sum(255 << 8 * p for p in positions)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def linked(a: np.ndarray, b: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """Which pairs pass the count filter and the verification."""
    differing = a ^ b
    tally = (np.ascontiguousarray(differing).view(np.uint8).reshape(*differing.shape, 8) == 0).sum(-1)
    return (tally >= BYTES - most_bits) & (np.bitwise_count(differing) <= most_bits)


def forest(members: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Edges between linked members that connect whatever the links connect. At most len(members) - 1.

    Each member is held once against those that nothing has reached yet, which become its branches.
    """
    edges, reached = [], []
    left, values = np.arange(len(members)), members
    while len(left):
        if not reached:
            reached.append(int(left[0]))
            left, values = left[1:], values[1:]
        i = reached.pop()
        near = np.bitwise_count(values ^ members[i]) <= most_bits
        if near.any():
            found = left[near].tolist()
            edges += [(i, j) for j in found]
            reached += found
            left, values = left[~near], values[~near]
    return edges


def _lists_to_edges(batches, most_bits):
    """Rows (place, shared, fp) sorted, in runs of equal place and shared. The last run of a batch may go on in the next ones."""
    key, parts = None, []

    def whole():
        fp = np.concatenate(parts)
        return _edges(fp.view(np.uint64), np.zeros(1, np.int64), len(fp), most_bits)

    for batch in batches:
        place, shared, fp = (batch.column(c).to_numpy() for c in ("place", "shared", "fp"))
        if not len(fp):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (shared[1:] != shared[:-1])]))
        if key == (place[0], shared[0]):
            parts.append(fp[: starts[1]] if len(starts) > 1 else fp)
            starts = starts[1:]
            if not len(starts):
                continue
        if parts:
            yield whole()
        first, last = starts[0], starts[-1]
        if first < last:
            yield _edges(fp[first:last].view(np.uint64), starts[:-1] - first, last - first, most_bits)
        key, parts = (place[last], shared[last]), [fp[last:]]
    if parts:
        yield whole()


def _edges(fp, starts, end, most_bits):
    sizes = np.diff(np.append(starts, end)) if len(starts) else np.zeros(0, np.int64)
    pairs = starts[sizes == 2]
    a, b = fp[pairs], fp[pairs + 1]
    ok = linked(a, b, most_bits)
    found = [(a[ok], b[ok])]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        members = np.unique(fp[start : start + size])
        edges = np.array(forest(members, most_bits), np.int64).reshape(-1, 2)
        found.append((members[edges[:, 0]], members[edges[:, 1]]))
    a, b = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that connect all pairs with at most most_bits differing bits."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(_masks(BYTES - most_bits))])).alias("posting")
    lists = distinct.select("fp", postings).select("posting.place", "posting.shared", "fp").repartition(n, "place", "shared").sortWithinPartitions("place", "shared")
    return arrow_map(lists, lambda batches: _lists_to_edges(batches, most_bits), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links lead to).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows have one fingerprint and one component.
    Texts of any length are hashed whole. An empty table gives no rows. Other columns are not read.
    """
    table, _ = written(fingerprint_documents(docs), "simhash")
    distinct, _ = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = links(distinct.select("fp"), most_bits)
    found, _ = written(connected_components(edges), "simhash-components")
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    component = named.groupBy("component").agg(F.min("least").alias("component_id"))
    members = named.join(component, "component").select("fp", "component_id")
    return table.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
