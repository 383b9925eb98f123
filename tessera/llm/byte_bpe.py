"""Operator 1: byte-level BPE encoding and decoding as a monoid tree reduction.

The elements are encoded segments ``(text, ids)``; the join of two neighbours is associative and gives
the encoding of the joined text. A text is halved until a segment is a leaf, leaves are encoded, and
neighbours are joined upwards. A join re-encodes a window around the boundary and keeps all ids outside.

Why the ids outside the window stand. Both window ends are *anchors*: a space that a non-space character
follows. No match of the pattern has a space after a non-space character, and a run of white space before
a non-space character gives up its last character, so a match starts at every anchor, whatever the rest of
the text is. Matches are found left to right from a match start without looking back, and an anchor ends all
lookahead before it (a run of white space looks no further than the first non-space character). Thus the text
left of an anchor and the text from it on are encoded independently. The window doubles until it has an anchor
on either side of the boundary or reaches the segment's end.

Inside one match (a "piece") the same tree runs on bytes: the window is the last and first ids of the halves.
A sequence of ids is the encoding of its bytes if and only if each adjacent pair re-encodes to itself, so once
the re-encoded window starts and ends with the ids that it had, all pairs are valid and the rest stands.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .shared import arrow_map, slices, texts_of

LEAF_CHARS = 2048
LEAF_BYTES = 512
LEAF_IDS = 4096
FIRST_WINDOW = 32
BATCH_BYTES = 2 << 20
#: white space on which libraries disagree
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"
_ANCHOR = re.compile(rf" (?=[^\s{ODD_SPACE}])")


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


class ByteBpe:
    """Encodes and decodes by the ranks in a file of lines "base64-token rank"."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.leaf = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self.leaf.encode_ordinary(text)
        if not _ANCHOR.search(text, 1):
            return self.encode_unanchored(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        start, end = _anchor_before(left), _anchor_after(right)
        redone = self.leaf.encode_ordinary(left[start:] + right[:end])
        from_left = len(left_ids) - len(self.leaf.encode_ordinary(left[start:]))
        from_right = len(self.leaf.encode_ordinary(right[:end]))
        return left_ids[:from_left] + redone + right_ids[from_right:]

    def encode_unanchored(self, text: str) -> list[int]:
        """A segment in which the text's tree finds no place to join: each match by the tree on bytes. Libraries may differ on what is a letter
        beyond ASCII, so other segments are one leaf."""
        if not text.isascii() or any(c in text for c in ODD_SPACE[:4]):
            return self.leaf.encode_ordinary(text)
        return [i for m in self.matches.finditer(text) for i in self.encode_piece(m[0].encode())]

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the pattern, by the tree on bytes."""
        if len(piece) <= LEAF_BYTES:
            return self.leaf._encode_single_piece(piece)
        middle = len(piece) // 2
        return self.join_ids(self.encode_piece(piece[:middle]), self.encode_piece(piece[middle:]))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            redone = self.leaf._encode_single_piece(self.leaf.decode_bytes(a + b))
            if (len(left) <= k or redone[0] == a[0]) and (len(right) <= k or redone[-1] == b[-1]):
                return left[: len(left) - len(a)] + redone + right[len(b) :]
            k *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.leaf.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _anchor_before(text: str) -> int:
    """The last anchor in a growing window at the end, or 0."""
    window = FIRST_WINDOW
    while True:
        least = max(0, len(text) - window)
        at = text.rfind(" ", least, len(text) - 1)
        while at >= 0:
            if not text[at + 1].isspace() and not _space_like(text[at + 1]):
                return at
            at = text.rfind(" ", least, at)
        if least == 0:
            return 0
        window *= 2


def _anchor_after(text: str) -> int:
    """The first anchor after the first character in a growing window at the start, or the length."""
    window = FIRST_WINDOW
    while True:
        most = min(len(text), window)
        at = text.find(" ", 1, most)
        while 0 <= at < len(text) - 1:
            if not text[at + 1].isspace() and not _space_like(text[at + 1]):
                return at
            at = text.find(" ", at + 1, most)
        if most == len(text):
            return len(text)
        window *= 2


def _space_like(char: str) -> bool:
    """Characters on which libraries disagree whether they are white space are no anchors' ends."""
    return char in ODD_SPACE


@lru_cache(maxsize=2)
def _decimals(count: int) -> list[str]:
    return [str(i) for i in range(count)]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, decoded (the bytes from the ids) if with_ids, and the digests of both.

    Null texts are empty: no ids, digests of the empty string. Repeated rows give repeated results; other columns
    of docs are not read. A row is worked on alone, so no group is gathered and nothing is shuffled.
    """
    fields = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for batch in slices(batches, BATCH_BYTES):
            decimals = _decimals(bpe.leaf.n_vocab)
            counts, id_hashes, byte_hashes, all_ids, all_bytes = [], [], [], [], []
            for text in texts_of(batch.column("text")):
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(" ".join([decimals[i] for i in ids]).encode()).hexdigest())
                byte_hashes.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
                    all_bytes.append(decoded)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_hashes, pa.string()), "decoded_sha256": pa.array(byte_hashes, pa.string())}
            if with_ids:
                out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_bytes, pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, fields)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and text from doc_id and ids; bytes that are no UTF-8 become U+FFFD. Null ids: null text."""

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return arrow_map(encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids"), run, "doc_id bigint, text string")
