import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, packing

from .helpers import frame, odd_rows

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'re", "'", "r", "l", "1", "²", ".", "!!", "é", "ß", "中", "\x1c", "\x85", "'ll", "😀", "<|endoftext|>", "​", "ing", "ver"]


@pytest.fixture
def tiny(monkeypatch):
    for name, value in (("LEAF_CHARS", 7), ("FIRST_WINDOW", 2), ("LEAF_BYTES", 5), ("LEAF_IDS", 3)):
        monkeypatch.setattr(byte_bpe, name, value)
    return byte_bpe.codec(RANKS, P.PATTERN)


def test_the_tree_gives_the_librarys_ids(tiny):
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 60)))
        wanted = tiny.leaf.encode_ordinary(text)
        assert tiny.encode(text) == wanted == other.encode(text, add_special_tokens=False).ids
        assert tiny.decode(wanted) == text.encode()


def test_the_tree_on_the_bytes_of_a_piece(tiny):
    rng = random.Random(3)
    for _ in range(3000):
        piece = "".join(rng.choices("abthingerv", k=rng.randint(1, 60))).encode()
        assert tiny.encode_piece(piece) == tiny.leaf._encode_single_piece(piece)


def test_encode_documents(spark):
    rows = odd_rows()
    leaf = byte_bpe.codec(RANKS, P.PATTERN).leaf
    found = byte_bpe.encode_documents(frame(spark, rows), RANKS, P.PATTERN).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for doc_id, text, *_ in rows:
        ids = leaf.encode_ordinary(text or "")
        assert by[doc_id].n_tokens == len(ids) and list(by[doc_id].ids) == ids
        assert by[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = byte_bpe.decode_documents(spark.createDataFrame([(r.doc_id, r.ids) for r in found], "doc_id bigint, ids array<int>"), RANKS, P.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {r[0]: r[1] or "" for r in rows}
    assert byte_bpe.encode_documents(frame(spark, []), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("length", [16, 1024])
def test_pack(spark, length):
    rows = odd_rows()
    leaf = byte_bpe.codec(RANKS, P.PATTERN).leaf
    pieces = [r.asDict() for r in packing.pack(frame(spark, rows).repartition(3), RANKS, P.PATTERN, length, with_ids=True).collect()]
    total = sum(len(leaf.encode_ordinary(r[1] or "")) + 1 for r in rows)
    assert sum(p["length"] for p in pieces) == total
    filled = {}
    for p in pieces:
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    for sequence, spans in filled.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == (length if sequence < total // length else total % length)
    for doc_id, text, *_ in rows:
        own = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: (p["sequence_id"], p["offset"]))
        wanted = [*leaf.encode_ordinary(text or ""), packing.END_ID] * (2 if doc_id == 6 else 1)
        assert [i for p in own for i in p["ids"]] == wanted
        if doc_id != 6:
            assert [p["start"] for p in own] == list(np.cumsum([0, *(p["length"] for p in own)])[:-1])
            assert {p["doc_tokens"] for p in own} == {len(wanted)}
    assert packing.pack(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_pack_matches_added_tokens_inside_texts(spark):
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    rows = [(0, "end of text <|endoftext|> next"), (1, "<|endoftext|>"), (2, "a<|endoftext|><|endoftext|> b"), (3, "<|endoftext|"), (4, "word " * 1000 + "<|endoftext|>" + " word" * 1000)]
    rows += [(10 + i, "".join(rng.choices(PIECES, k=rng.randint(0, 60)))) for i in range(200)]
    pieces = packing.pack(frame(spark, rows), RANKS, P.PATTERN, 64, with_ids=True).collect()
    for doc_id, text in rows:
        own = sorted((p.sequence_id, p.offset, p.ids) for p in pieces if p.doc_id == doc_id)
        assert [i for *_, ids in own for i in ids] == [*other.encode(text, add_special_tokens=False).ids, packing.END_ID]
