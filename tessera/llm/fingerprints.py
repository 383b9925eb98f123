"""Operator 4: document fingerprints as quartile bucket digests.

Byte triplets at the spacings ``SPACINGS`` are hashed and counted in ``BUCKETS`` buckets. The digest has each bucket's quartile among
the counts (2 bits) and the logarithm of the length (one byte). The difference of two digests is the sum of the buckets' quartile
steps and a capped penalty per step of length; it is at most ``MOST``, and likeness is 1 - difference / MOST.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, slices, texts_of, written

SPACINGS = ((0, 4, 9), (0, 3, 7))
BUCKETS = 256
LENGTH_WEIGHT, LENGTH_MOST = 4, 128
MOST = 3 * BUCKETS + LENGTH_MOST
BATCH_BYTES = 4 << 20


def quartile_codes(text: bytes) -> np.ndarray:
    """The length byte and the buckets' quartiles (0 to 3)."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for k, (i, j, last) in enumerate(SPACINGS):
        n = len(data) - last
        if n > 0:
            h = data[i : i + n] * np.uint32(0x9E3779B1) + data[j : j + n] * np.uint32(0x85EBCA6B) + data[last:] * np.uint32(0xC2B2AE35) + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    ranked = np.sort(counts)
    codes = sum((counts > ranked[q * BUCKETS // 4 - 1]).astype(np.uint8) for q in (1, 2, 3))
    length = min(255, int(8 * np.log2(1 + len(text))))
    return np.concatenate([[np.uint8(length)], codes])


def as_text(codes: np.ndarray) -> str:
    four = codes[1:].reshape(-1, 4)
    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return f"{codes[0]:02x}" + packed.astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests."""
    steps = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return 1 - (int(steps[1:].sum()) + min(LENGTH_MOST, LENGTH_WEIGHT * int(steps[0]))) / MOST


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare(text: str, codes: np.ndarray, following: str, next_codes: np.ndarray) -> tuple:
    edited = edited_text(text, following).encode()
    edited_codes = quartile_codes(edited)
    return len(text), hashlib.sha256(edited).hexdigest(), as_text(codes), as_text(edited_codes), likeness(codes, edited_codes), likeness(codes, next_codes)


_OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_OUT_DDL = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow each other by doc_id (null first), then text, and the first follows the last. They are dealt out by ranges of doc_id
    once, and each range is read in order, a row at a time. A range's last row needs the next range's first: these boundary records (two a
    range) are written and joined. Null texts are empty. Repeated rows are rows of their own. A single document follows itself; an empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")

    def walk(batches):
        part, before = TaskContext.get().partitionId(), None
        kinds, parts, ids, texts, rows = [], [], [], [], []

        def add(kind, doc_id, text, row):
            for values, x in ((kinds, kind), (parts, part), (ids, doc_id), (texts, text), (rows, row)):
                values.append(x)

        def batch_of():
            columns = list(zip(*rows, strict=True)) or [[]] * len(_OUT)
            out = {"kind": pa.array(kinds, pa.int32()), "part": pa.array(parts, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}
            out |= {name: pa.array(list(column), kind) for (name, kind), column in zip(_OUT, columns, strict=True)}
            for values in (kinds, parts, ids, texts, rows):
                values.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in slices(batches, BATCH_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                codes = quartile_codes(text.encode())
                if before is None:
                    add(1, doc_id, text, (None,) * len(_OUT))
                else:
                    add(0, before[0], None, compare(before[1], before[2], text, codes))
                before = doc_id, text, codes
            yield batch_of()
        if before is not None:
            add(2, before[0], before[1], (None,) * len(_OUT))
            yield batch_of()

    table, _ = written(arrow_map(dealt, walk, f"kind int, part int, doc_id bigint, text string, {_OUT_DDL}"), "fingerprints")
    filled = sorted(r.part for r in table.where("kind = 1").select("part").collect())  # one row a range
    follows = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "part int, next int")
    first = table.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    edges = table.where("kind = 2").select("doc_id", "part", "text").join(follows, "part").join(first, "next").select("doc_id", "text", "following")

    def close(batches):
        for batch in batches:
            rows = []
            for text, following in zip(texts_of(batch.column("text")), texts_of(batch.column("following")), strict=True):
                rows.append(compare(text, quartile_codes(text.encode()), following, quartile_codes(following.encode())))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_OUT)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {name: pa.array(list(column), kind) for (name, kind), column in zip(_OUT, columns, strict=True)})

    return table.where("kind = 0").select("doc_id", *(n for n, _ in _OUT)).unionByName(arrow_map(edges, close, f"doc_id bigint, {_OUT_DDL}"))
