"""Operator 2: packing by concatenate and cut.

All documents, each ended by id 0, are one long stream of ids that is cut every ``length`` ids, so that only
the last sequence is not full. Pass 1 encodes each partition and writes its ids with their place in the
partition to the shared folder. The partitions' totals (one row each) give by a prefix sum where each partition
starts in the stream. Pass 2 reads the ids, adds the start and cuts; a document over a cut leaves one
boundary record on either side. Nothing is shuffled but the totals. Once written, places cannot change if an
executor is lost.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import BATCH_BYTES, codec
from .shared import arrow_map, slices, texts_of, written

END_ID = 0


@lru_cache(maxsize=4)
def added_tokens(ranks_path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The added tokens of the JSON beside the ranks, which the ``tokenizers`` library matches inside texts: a pattern and their ids."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return None, {}
    with open(path, encoding="utf-8") as lines:
        ids = {x["content"]: x["id"] for x in json.load(lines)["added_tokens"]}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None, ids


def ids_of(bpe, ranks_path: str, text: str) -> list[int]:
    """The ids of a text as the ``tokenizers`` library has them at its default settings, without special tokens around it."""
    pattern, added = added_tokens(ranks_path)
    if pattern is None or not pattern.search(text):
        return bpe.encode(text)
    return [i for x in pattern.split(text) for i in ([added[x]] if x in added else bpe.encode(x))]


def pack(docs: DataFrame, ranks_path: str, pattern: str, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if with_ids).

    Null or empty texts are one piece of one id. Repeated rows are packed as often as they come. Other columns are
    not read. No documents: no pieces. A text of any length is cut over as many sequences as it needs.
    """

    def encode(batches):
        bpe, pid, before = codec(ranks_path, pattern), TaskContext.get().partitionId(), 0
        for batch in slices(batches, BATCH_BYTES):
            ids = [np.array([*x, END_ID], np.uint16 if max(bpe.leaf.n_vocab, *(i + 1 for i in added_tokens(ranks_path)[1].values()), 0) <= 1 << 16 else np.uint32) for x in (ids_of(bpe, ranks_path, t) for t in texts_of(batch.column("text")))]
            counts = np.array([len(x) for x in ids], np.int64)
            places = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            wide = np.full(len(ids), ids[0].itemsize if ids else 2, np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "part": pa.array(np.full(len(ids), pid, np.int32)), "place": pa.array(places), "n": pa.array(counts), "wide": pa.array(wide), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})

    encoded = arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), encode, "doc_id bigint, part int, place bigint, n bigint, wide int, ids binary")
    stream, _ = written(encoded, "packing")
    totals = sorted(stream.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each partition of the scan
    starts = dict(zip([r.part for r in totals], accumulate((r.n for r in totals), initial=0), strict=False))
    fields = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")

    def cut(batches):
        for batch in batches:
            rows, doc_ids = [], batch.column("doc_id").to_pylist()
            for doc, part, place, wide, raw in zip(doc_ids, *(batch.column(c).to_pylist() for c in ("part", "place", "wide", "ids")), strict=True):
                ids = np.frombuffer(raw, np.uint16 if wide == 2 else np.uint32).astype("<u4")
                at, total = starts[part] + place, len(ids)
                start = 0
                while start < total:
                    n = min(total - start, length - (at + start) % length)
                    piece = ids[start : start + n]
                    rows.append((doc, start, n, zlib.crc32(piece.tobytes()), total, (at + start) // length, (at + start) % length, *([piece.astype(np.int32)] if with_ids else [])))
                    start += n
            columns = list(zip(*rows, strict=True)) or [[]] * (7 + with_ids)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            out = {k: pa.array(v, pa.int64()) for k, v in zip(names, columns, strict=False)}
            if with_ids:
                out["ids"] = pa.array(list(columns[7]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return arrow_map(stream.select("doc_id", "part", "place", "wide", "ids"), cut, fields)
