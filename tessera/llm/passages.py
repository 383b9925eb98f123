"""Operator 6: near-duplicate passages by compact windows.

A text's tokens are its shingles of ``SHINGLE`` words (words.LETTERS). For each of ``HASHES`` orders of the tokens, the Cartesian tree of
the order's values gives for every token c the largest window [l, r] in which it is the minimum; all subsequences of l..r that hold c share the
signature c. Only windows of ``TOKENS`` tokens or more matter (about 2 in every TOKENS + 1 tokens), and those are the minima of the sliding windows
of that length, among which the tree is built.

0. Equal texts are one document, that of their least doc_id; each other one has a single passage, its whole text.
1. Windows meet by signature. A window is linked to the first document (by doc_id) that has its signature, and to the first ones that also have the
   ``CONTEXT`` or the ``NEAR`` tokens after its minimum, before it, or on both sides. So earlier texts that are not alike enough do not stand between two copies:
   what TOKENS tokens of two texts have in common has CONTEXT tokens on one side of the minimum in common, and NEAR of them mostly even with an edit. Each
   scan partition sends on the windows of one document only where several have a window in the same TOKENS tokens at the same place.
2. Interval join: links of one pair of documents at about one distance, whose aligned windows overlap, are one candidate; at least
   ``NEEDED`` of the hashes must take part.
3. Verification: the tokens of both candidate regions are read from the texts, and the passages are the stretches covered by runs of TOKENS
   tokens that share so many with the other region that their Jaccard similarity to as long a run reaches ``SIMILARITY``.

Windows and links are dealt as blobs: the arrays of all windows of a partition's scan that go to one place are one row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, discard, slices, small, text_bytes, written
from .words import mix, word_hashes

SHINGLE = 5
TOKENS = 46  # 50 words
HASHES = 6
NEEDED = 2
SIMILARITY = 0.8
#: of TOKENS tokens, for a Jaccard similarity of SIMILARITY between runs of TOKENS tokens
LEAST_SHARED = math.ceil(2 * TOKENS * SIMILARITY / (1 + SIMILARITY))
#: a run of TOKENS tokens has so many on one side of any of its tokens
CONTEXT = TOKENS // 2
#: and so many on one side even with an edit in it
NEAR = CONTEXT // 2
SHIFT = 16
MARGIN = 48
ROUND = 32
#: how far a window counts on either side of its minimum: any run of TOKENS tokens has another minimum
REACH = 255
BATCH_BYTES = 1 << 20
FLUSH = 300_000
#: windows of a part that are sorted together
MEETING = 250_000
#: bytes of text whose windows meet in one partition, and partitions at most
PART_BYTES, MOST_PARTS = 24 << 20, 50_000
#: pairs of one earlier document that one task verifies
PAIRS = 256
_STEP = np.uint64(0xBF58476D1CE4E5B9)
_ODD = 0xD1342543DE82EF95
_BACK = pow(_ODD, -1, 1 << 64)
_WINDOW = {"key": "u8", "doc": "i8", "variant": "i4", "c": "i4", "prior": "u4", "next": "u4", "near_prior": "u4", "near_next": "u4", "before": "u1", "after": "u1", "k": "u1"}
#: the first document of each of these classes of a signature's windows is linked to
_CLASSES = ((), ("near_next",), ("near_prior",), ("near_prior", "near_next"), ("next",), ("prior",), ("prior", "next"))
_LINK = {"doc": "i8", "o_doc": "i8", "variant": "i4", "o_variant": "i4", "c": "i4", "o_c": "i4", "before": "u1", "after": "u1", "k": "u1"}
_BLOBS = "part int, kind int, n int, data binary"


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hash and row of each shingle, each row's first shingle (and the end), and the first byte and end of all words."""
    hashes, rows, starts, ends = word_hashes(data, bounds)
    n = max(len(hashes) - SHINGLE + 1, 0)
    tokens = hashes[:n].copy()
    for i in range(1, SHINGLE):
        tokens = tokens * _STEP + hashes[i : i + n]
    whole = rows[:n] == rows[SHINGLE - 1 :] if n else np.zeros(0, bool)
    kept = np.flatnonzero(whole)
    rows_kept = rows[kept]
    return mix(tokens[kept]), rows_kept, np.searchsorted(rows_kept, np.arange(len(bounds))), starts, ends


def minima(values: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """Places that are the leftmost minimum of some run of length values within one row."""
    if len(values) < length:
        return np.zeros(0, np.int64)
    best, place, span = values, np.arange(len(values), dtype=np.int32), 1

    def joined(best, place, shift):
        left, right = best[: len(best) - shift], best[shift:]
        take = right < left
        return np.where(take, right, left), np.where(take, place[shift:], place[: len(place) - shift])

    while span * 2 <= length:
        best, place = joined(best, place, span)
        span *= 2
    if span < length:
        best, place = joined(best, place, length - span)
    place = place[rows[: len(place)] == rows[length - 1 :]]
    return place[np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))].astype(np.int64) if len(place) else np.zeros(0, np.int64)


def _nearest(centres, value, row, before: bool):
    """Of each centre the place (among the centres) of the nearest one before it with a value that is not greater, or after it with a smaller one; -1 or the length where its row has none.

    All look at once one step further, over what those they stand on have passed already, so that the steps halve what is left.
    """
    n = len(centres)
    at = np.arange(n) - 1 if before else np.arange(n) + 1
    open_ = np.arange(n)
    while len(open_):
        to = at[open_]
        inside = (to >= 0) & (to < n)
        open_, to = open_[inside], to[inside]
        over = (row[to] == row[open_]) & ((value[to] > value[open_]) if before else (value[to] >= value[open_]))
        open_ = open_[over]
        at[open_] = at[to[over]]
    other = (at < 0) | (at >= n)
    other[~other] = row[at[~other]] != row[~other]
    at[other] = -1 if before else n
    return at


def compact_windows(values: np.ndarray, rows: np.ndarray, firsts: np.ndarray, length: int = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c, l, r (places in values, inclusive) of the windows of length or more: a Cartesian tree over the sliding minima."""
    centres = minima(values, rows, length)
    if not len(centres):
        return centres, centres, centres
    row, value = rows[centres], values[centres]
    left, right = _nearest(centres, value, row, True), _nearest(centres, value, row, False)
    left = np.where(left < 0, firsts[row], centres[np.maximum(left, 0)] + 1)
    right = np.where(right >= len(centres), firsts[row + 1] - 1, centres[np.minimum(right, len(centres) - 1)] - 1)
    return centres, left, right


class RunHashes:
    """Hashes of any runs of the tokens, from one running sum."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens) + 1
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK, np.uint64)]), dtype=np.uint64)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * powers[: len(tokens)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _dealt(w: dict, kind: int, layout: dict, part: np.ndarray) -> pa.RecordBatch:
    """The rows of w as one blob a part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    arrays = [w[n].astype(t, copy=False)[order] for n, t in layout.items()]
    cuts = np.flatnonzero(np.concatenate([np.ones(min(len(part), 1), bool), part[1:] != part[:-1]]))
    ends = np.append(cuts, len(part))[1:]
    blobs = [b"".join(x[a:b].tobytes() for x in arrays) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_pydict({"part": pa.array(part[cuts].astype(np.int32)), "kind": pa.array(np.full(len(cuts), kind, np.int32)), "n": pa.array((ends - cuts).astype(np.int32)), "data": pa.array(blobs, pa.binary())})


def _read(blobs: list[tuple[int, bytes]], layout: dict) -> dict:
    parts = {name: [] for name in layout}
    for n, data in blobs:
        at = 0
        for name, kind in layout.items():
            parts[name].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate([np.zeros(0, kind), *parts[name]]) for name, kind in layout.items()}


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows, the mask of those that differ from the row before."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for x in columns:
        first[1:] |= x[1:] != x[:-1]
    return first


def _links(w: dict, at: np.ndarray, owner: np.ndarray) -> dict:
    """Links of the windows at to the windows owner."""
    link = {n: w[n][at] for n in ("doc", "variant", "c", "k")} | {f"o_{n}": w[n][owner] for n in ("doc", "variant", "c")}
    return link | {n: np.minimum(w[n][at], w[n][owner]) for n in ("before", "after")}


def _pair_part(link: dict, n: int) -> np.ndarray:
    pair = mix(link["doc"].astype(np.int64).view(np.uint64) + link["variant"].astype(np.uint64) * _STEP) ^ mix(link["o_doc"].astype(np.int64).view(np.uint64) * _STEP + link["o_variant"].astype(np.uint64))
    return (mix(pair) % np.uint64(n)).astype(np.int32)


def _windows(batches, n_parts):
    """Per scan partition: windows to be sent to their signature's part (kind 0), and links between its own documents (kind 1)."""
    kept, n = [], 0

    def flush():
        w = {c: np.concatenate([x[c] for x in kept]) for c in (*_WINDOW, "home")}
        order = np.argsort(w["home"], kind="stable")
        home = w["home"][order]
        first = _heads(home)
        alone = first & np.append(first[1:], True)
        some = order[~alone]
        some = some[np.lexsort((w["c"][some], w["variant"][some], w["doc"][some], w["home"][some]))]
        same = {c: w[c][some] for c in w}
        once = _heads(same["home"], same["doc"], same["variant"], same["c"])
        some, same = some[once], {c: v[once] for c, v in same.items()}
        head = np.flatnonzero(_heads(same["home"]))
        owner = head[np.cumsum(_heads(same["home"])) - 1]
        other = (same["doc"] != same["doc"][owner]) | (same["variant"] != same["variant"][owner])
        onward = np.concatenate([order[alone], some[~other]])
        forward = {c: w[c][onward] for c in _WINDOW}
        yield _dealt(forward, 0, _WINDOW, (forward["key"] % np.uint64(n_parts)).astype(np.int32))
        links = _links(same, np.flatnonzero(other), owner[other])
        yield _dealt(links, 1, _LINK, _pair_part(links, n_parts))

    for batch in slices(batches, BATCH_BYTES):
        doc_ids = batch.column("doc_id").to_numpy()
        variants = batch.column("variant").to_numpy()
        tokens, rows, firsts, _, _ = tokens_of(*text_bytes(batch.column("text")))
        runs = RunHashes(tokens)
        for k in range(HASHES):
            values = mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF))
            c, left, right = compact_windows(values, rows, firsts)
            row = rows[c]
            base, end = firsts[row], firsts[row + 1]
            start = np.clip(c - CONTEXT, base, end - TOKENS)
            home = mix((runs.of(start, start + TOKENS) + (c - start).astype(np.uint64) * _STEP) ^ values[c])
            # of one run of tokens that follows itself (a word or line said over and over) a window in every CONTEXT tokens
            some = np.flatnonzero(_heads(home, row, (c - base) // CONTEXT))
            c, row, base, end, home, left, right = (x[some] for x in (c, row, base, end, home, left, right))
            before = lambda n: (runs.of(np.maximum(c - n, base), c) >> np.uint64(32)).astype(np.uint32)  # noqa: B023, E731
            after = lambda n: (runs.of(c + 1, np.minimum(c + 1 + n, end)) >> np.uint64(32)).astype(np.uint32)  # noqa: B023, E731
            kept.append({
                "key": values[c], "doc": doc_ids[row], "variant": variants[row], "c": (c - base).astype(np.int32), "home": home,
                "prior": before(CONTEXT), "next": after(CONTEXT), "near_prior": before(NEAR), "near_next": after(NEAR),
                "before": np.minimum(c - left, REACH).astype(np.uint8), "after": np.minimum(right - c, REACH).astype(np.uint8), "k": np.full(len(c), k, np.uint8),
            })
            n += len(c)
        if n >= FLUSH:
            yield from flush()
            kept, n = [], 0
    if kept:
        yield from flush()


def meeting_links(w: dict) -> dict:
    """Links of all windows to the first documents of their classes: those with the signature, and with the tokens near it as well."""
    order = np.argsort(w["key"], kind="stable")
    first = _heads(w["key"][order])
    order = order[~(first & np.append(first[1:], True))]
    w = {n: v[order] for n, v in w.items()}
    order = np.lexsort((w["c"], w["variant"], w["doc"], w["key"]))
    w = {n: v[order] for n, v in w.items()}
    new_key = _heads(w["key"])
    starts = np.flatnonzero(new_key)
    run = np.cumsum(new_key) - 1
    if len(starts):
        other = (w["doc"] != w["doc"][starts][run]) | (w["variant"] != w["variant"][starts][run])
        met = np.logical_or.reduceat(other, starts)[run]
        w, run = {n: v[met] for n, v in w.items()}, run[met]
    owners: list[np.ndarray] = []
    found = []
    for columns in _CLASSES:
        order = np.lexsort((*(w[n] for n in columns), run)) if columns else np.arange(len(run))  # stable: by document and place in each class
        head = _heads(run[order], *(w[n][order] for n in columns))
        owner = np.empty(len(run), np.int64)
        owner[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        linked = (w["doc"] != w["doc"][owner]) | (w["variant"] != w["variant"][owner])
        for earlier in owners:
            linked &= owner != earlier
        owners.append(owner)
        at = np.flatnonzero(linked)
        found.append(_links(w, at, owner[at]))
    return {n: np.concatenate([x[n] for x in found]) for n in _LINK}


def _meet(batches, n_parts):
    windows = []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        through = batch.filter(pa.array(kind == 1))
        if through.num_rows:
            yield through
        windows += zip(batch.column("n").filter(pa.array(kind == 0)).to_pylist(), batch.column("data").filter(pa.array(kind == 0)).to_pylist(), strict=True)
    w = _read(windows, _WINDOW)
    rounds = len(w["key"]) // MEETING + 1
    turn = (w["key"] >> np.uint64(32)) % np.uint64(rounds)
    for i in range(rounds):  # all windows of a signature have one turn
        links = meeting_links({n: v[turn == i] for n, v in w.items()})
        if len(links["doc"]):
            yield _dealt(links, 1, _LINK, _pair_part(links, n_parts))


def regions(link: dict) -> list[tuple]:
    """(doc, variant, o_doc, o_variant, lo, hi, o_lo, o_hi), in token places, for which enough hashes take part.

    One token that both texts have can be the minimum of several orders, so NEEDED different tokens must take part as well. Distances are looked at
    in two rows of bins that overlap by half, so that any two that are SHIFT apart or nearer are in one bin.
    """
    names = ("doc", "variant", "o_doc", "o_variant")
    order = np.lexsort([link[n] for n in reversed(names)])
    link = {n: v[order] for n, v in link.items()}
    pair_head = _heads(*(link[n] for n in names))
    pair, pair_at = np.cumsum(pair_head) - 1, np.flatnonzero(pair_head)
    c, shift = link["c"].astype(np.int64), link["o_c"].astype(np.int64) - link["c"]
    lo, hi = c - link["before"], c + link["after"]
    segments = []
    for offset in (0, SHIFT):
        bins = (shift + offset) // (2 * SHIFT)
        order = np.lexsort((lo, bins, pair))
        head = _heads(pair[order], bins[order])
        group = np.cumsum(head) - 1
        span = int(hi.max(initial=0)) + 2 * TOKENS
        reached = np.maximum.accumulate(hi[order] + group * span) - group * span
        head[1:] |= lo[order][1:] > reached[:-1] + TOKENS
        at = np.flatnonzero(head)
        if not len(at):
            continue
        least, most = (lambda x: np.minimum.reduceat(x[order], at)), (lambda x: np.maximum.reduceat(x[order], at))
        ks = np.bitwise_or.reduceat((1 << link["k"].astype(np.int64))[order], at)
        good = (np.bitwise_count(ks) >= NEEDED) & (least(c) != most(c))
        segments.append(np.stack([pair[order][at], least(lo), most(hi), least(lo + shift), most(hi + shift)], 1)[good])
    found = np.concatenate([np.zeros((0, 5), np.int64), *segments])
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    out, open_, now = [], [], -1
    heads = [link[n][pair_at] for n in names]

    def close(groups):
        out.extend((*(int(x[now]) for x in heads), *g) for g in groups)

    for p, a, b, o_a, o_b in found.tolist():
        if p != now:
            close(open_)
            now, open_ = p, []
        close([g for g in open_ if g[1] + TOKENS < a])  # nothing to come starts before a
        open_ = [g for g in open_ if g[1] + TOKENS >= a]
        for g in open_:
            if o_a <= g[3] + TOKENS and o_b + TOKENS >= g[2]:
                g[1], g[2], g[3] = max(g[1], b), min(g[2], o_a), max(g[3], o_b)
                break
        else:
            open_.append([a, b, o_a, o_b])
    close(open_)
    return out


def _candidates(batches):
    blobs = [x for batch in batches for x in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True)]
    found = regions(_read(blobs, _LINK))
    if found:
        doc, variant, o_doc, o_variant, lo, hi, o_lo, o_hi = (np.array(x, np.int64) for x in zip(*found, strict=True))
        lower, upper = lambda x: np.maximum(x - MARGIN, 0) // ROUND * ROUND, lambda x: -(-(x + MARGIN + 1) // ROUND) * ROUND
        columns = {"doc": doc, "variant": variant.astype(np.int32), "o_doc": o_doc, "o_variant": o_variant.astype(np.int32), "lo": lower(lo), "hi": upper(hi), "o_lo": lower(o_lo), "o_hi": upper(o_hi)}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


_PAIRS = "doc bigint, variant int, o_doc bigint, o_variant int, lo bigint, hi bigint, o_lo bigint, o_hi bigint"


def candidates(docs: DataFrame, n_parts: int) -> DataFrame:
    """docs: doc_id, variant, text. Pairs of regions (doc, lo, hi) and (o_doc, o_lo, o_hi), in token places, widened and rounded outwards."""
    windows = arrow_map(docs.select("doc_id", "variant", "text"), lambda b: _windows(b, n_parts), _BLOBS)
    met = arrow_map(windows.repartitionById(n_parts, F.col("part")), lambda b: _meet(b, n_parts), _BLOBS)
    return arrow_map(met.repartitionById(n_parts, F.col("part")), _candidates, _PAIRS)


_REGIONS = "o_doc bigint, o_variant int, salt int, side int, doc bigint, variant int, text_key bigint, lo bigint, o_lo bigint, o_hi bigint, tokens binary, starts binary, ends binary"


def _short(tokens: np.ndarray) -> bytes:
    """32 bits a token: enough to tell the tokens of two regions apart."""
    return (tokens >> np.uint64(32)).astype(np.uint32).tobytes()


def _regions(batches):
    """Rows of the regions asked for: of the later document each region with its words' places, of the earlier one its regions joined, once a salt."""
    kinds = {f.split()[0]: {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in _REGIONS.split(", ")}
    for batch in slices(batches, BATCH_BYTES):
        data, bounds = text_bytes(batch.column("text"))
        tokens, _, firsts, starts, ends = tokens_of(data, bounds)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        word_first = np.searchsorted(starts, bounds)
        out = {c: [] for c in kinds}

        def add(**values):
            for c in kinds:
                out[c].append(values.get(c))

        for i, (doc, variant, key, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "variant", "text_key", "asks")), strict=True)):
            own, n = tokens[firsts[i] : firsts[i + 1]], int(firsts[i + 1] - firsts[i])
            at, joined = chars[bounds[i]], []
            for a in sorted(asks, key=lambda a: a["lo"]):
                lo, hi = min(a["lo"], n), min(a["hi"], n)
                if a["side"] == 0:
                    if joined and lo <= joined[-1][1]:
                        joined[-1][1], joined[-1][2] = max(joined[-1][1], hi), max(joined[-1][2], a["salt"])
                    else:
                        joined.append([lo, hi, a["salt"]])
                    continue
                words = word_first[i] + np.arange(lo, hi)
                first = (chars[starts[words]] - at).astype(np.int32)
                last = (chars[ends[words + SHINGLE - 1]] - at).astype(np.int32)
                add(o_doc=a["o_doc"], o_variant=a["o_variant"], salt=a["salt"], side=1, doc=doc, variant=variant, text_key=key, lo=lo, o_lo=a["o_lo"], o_hi=a["o_hi"], tokens=_short(own[lo:hi]), starts=np.diff(first, prepend=np.int32(0)).tobytes(), ends=(last - first).tobytes())
            for lo, hi, salts in joined:
                for salt in range(salts):
                    add(o_doc=doc, o_variant=variant, salt=salt, side=0, lo=lo, tokens=_short(own[lo:hi]))
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})


def similar_stretches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """Stretches [i, j) of a, from matched token to matched token, that runs of TOKENS tokens cover of which so many are in b that as
    long a run of b has Jaccard similarity SIMILARITY; and the stretch's own similarity by the same measure."""
    if len(a) < TOKENS or len(b) < TOKENS:
        return []
    found = np.isin(a, b)
    sums = np.concatenate([[0], np.cumsum(found)])
    good = np.flatnonzero(sums[TOKENS:] - sums[:-TOKENS] >= LEAST_SHARED)
    change = np.zeros(len(a) + 1, np.int64)
    np.add.at(change, good, 1)
    np.add.at(change, good + TOKENS, -1)
    inside = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    out = []
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        hits = np.flatnonzero(found[i:j])
        i, j = i + int(hits[0]), i + int(hits[-1]) + 1
        out.append((i, j, len(hits) / (2 * (j - i) - len(hits))))
    return out


_FOUND = "doc_id bigint, text_key bigint, other_doc_id bigint, start bigint, end bigint, n_words bigint, similarity double"


def _found_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {f.split()[0]: pa.float64() if f.endswith("double") else pa.int64() for f in _FOUND.split(", ")}
    return pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in zip(kinds, zip(*rows, strict=True) if rows else [[]] * len(kinds), strict=True)})


def _verified(batches):
    """Rows sorted by earlier document, salt and side: its regions, then those of the later documents."""
    owner, known = None, []
    for batch in batches:
        rows = []
        for o_doc, o_variant, salt, side, doc, key, lo, o_lo, o_hi, tokens, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("o_doc", "o_variant", "salt", "side", "doc", "text_key", "lo", "o_lo", "o_hi", "tokens", "starts", "ends")), strict=True):
            if owner != (o_doc, o_variant, salt):
                owner, known = (o_doc, o_variant, salt), []
            tokens = np.frombuffer(tokens, np.uint32)
            if side == 0:
                known.append((lo, tokens))
                continue
            first = np.cumsum(np.frombuffer(starts, np.int32))
            last = first + np.frombuffer(ends, np.int32)
            for at, other in known:
                if at <= o_lo < at + len(other):
                    for i, j, similarity in similar_stretches(tokens, other[o_lo - at : o_hi - at]):
                        rows.append((doc, key, o_doc, int(first[i]), int(last[j - 1]), j - i + SHINGLE - 1, similarity))
        yield _found_rows(rows)


def stretches(docs: DataFrame, pairs: DataFrame, n_parts: int) -> DataFrame:
    """The passages within pairs of regions. An earlier document with many pairs is dealt to several tasks."""
    spark = docs.sparkSession
    pairs, pairs_path = written(pairs, "passage-pairs")
    # only documents with more pairs than a task is to verify have salts: of the pairs a 256th at most
    hot, hot_path = written(pairs.groupBy("o_doc", "o_variant").count().where(F.col("count") > PAIRS).select("o_doc", "o_variant", F.ceil(F.col("count") / PAIRS).cast("int").alias("_salts")), "passage-salts")
    salted = pairs.join(small(hot), ["o_doc", "o_variant"], "left").withColumn("salts", F.coalesce("_salts", F.lit(1)))
    later = salted.select("doc", "variant", F.lit(1).alias("side"), "o_doc", "o_variant", "lo", "hi", "o_lo", "o_hi", F.expr("pmod(hash(doc, variant, lo), salts)").alias("salt"))
    earlier = salted.select("o_doc", "o_variant", "o_lo", "o_hi", "salts").distinct().select(F.col("o_doc").alias("doc"), F.col("o_variant").alias("variant"), F.lit(0).alias("side"), "o_doc", "o_variant", F.col("o_lo").alias("lo"), F.col("o_hi").alias("hi"), "o_lo", "o_hi", F.col("salts").alias("salt"))
    asks, asks_path = written(later.unionByName(earlier), "passage-asks")
    fields = ["side", "o_doc", "o_variant", "lo", "hi", "o_lo", "o_hi", "salt"]
    few = asks.limit(BROADCAST_ASKS + 1).count() <= BROADCAST_ASKS
    grouped = asks.groupBy(F.col("doc").alias("doc_id"), "variant").agg(F.collect_list(F.struct(*fields)).alias("asks"))  # as many as a text has regions
    asked = docs.join(F.broadcast(grouped) if few else grouped, ["doc_id", "variant"]).select("doc_id", "variant", F.xxhash64("text").alias("text_key"), "asks", "text")
    read = arrow_map(asked, _regions, _REGIONS)
    met = read.repartition(n_parts, "o_doc", "o_variant", "salt").sortWithinPartitions("o_doc", "o_variant", "salt", "side")
    found, _ = written(arrow_map(met, _verified, _FOUND).distinct(), "passages")
    discard(spark, pairs_path, asks_path, hot_path)
    return found


#: rows of regions asked for that are broadcast to the texts; more are joined by a shuffle
BROADCAST_ASKS = 1_000_000


def _whole(batches):
    """The one passage of a copy: from its first word to its last."""
    for batch in slices(batches, BATCH_BYTES):
        data, bounds = text_bytes(batch.column("text"))
        _, rows, starts, ends = word_hashes(data, bounds)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first, n = np.searchsorted(rows, np.arange(batch.num_rows)), np.bincount(rows, minlength=batch.num_rows)
        found = []
        for i, (doc, key, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "copy_of")), strict=True)):
            if n[i] >= TOKENS + SHINGLE - 1:
                found.append((doc, key, other, int(chars[starts[first[i]]] - chars[bounds[i]]), int(chars[ends[first[i] + n[i] - 1]] - chars[bounds[i]]), int(n[i]), 1.0))
        yield _found_rows(found)


def _marked(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with variant (0, or from 1 for further texts of one doc_id) and copy_of (the least doc_id with the very text, if that is another one); and the texts' bytes."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.hash("text").alias("also"), F.octet_length("text").alias("size"))
    narrow, _ = written(narrow.groupBy("doc_id", "text_key", "also").agg(F.sum("size").alias("size")), "passage-texts")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    first = narrow.groupBy("text_key", "also").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = narrow.join(first, ["text_key", "also"]).where("doc_id <> first").select("doc_id", "text_key", "also", F.lit(0).alias("variant"), F.col("first").alias("copy_of"))
    several = narrow.groupBy("doc_id").count().where("count > 1").select("doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text_key", "also")) - 1
    variants = narrow.join(several, "doc_id").select("doc_id", "text_key", "also", place.alias("variant"), F.lit(None).cast("bigint").alias("copy_of")).where("variant > 0")
    marks, _ = written(copies.unionByName(variants).groupBy("doc_id", "text_key", "also").agg(F.max("variant").alias("variant"), F.max("copy_of").alias("copy_of")), "passage-marks")
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("also").alias("_also"), F.col("variant").alias("_variant"), "copy_of")
    same = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_key")) & (F.hash("text") == F.col("_also"))
    return docs.join(small(marks), same, "left").select("doc_id", "text", F.coalesce("_variant", F.lit(0)).alias("variant"), "copy_of"), total


def _passages(docs: DataFrame) -> DataFrame:
    """near_duplicate_passages with text_key, the hash of the text that the passage is in."""
    spark = docs.sparkSession
    marked, total = _marked(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(total // PART_BYTES, MOST_PARTS))
    own = marked.where("copy_of is null").drop("copy_of")
    found = stretches(own, candidates(own, n_parts), n_parts)
    whole = arrow_map(marked.where("copy_of is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "copy_of", "text"), _whole, _FOUND).distinct()
    return found.unionByName(whole)


def near_duplicate_passages(docs: DataFrame) -> DataFrame:
    """Passages that an earlier document (by doc_id) has nearly alike: doc_id, other_doc_id, start, end (code points), n_words, similarity.

    A passage has 50 words or more. Each is listed with the earlier documents that its signatures lead to, not with all that have it; the
    earliest document of a passage has no row for it. A text that an earlier document has as well has one row, for all of it. Repetitions within one
    document are not listed. Null and short texts have no passages; rows without doc_id are left out. Equal rows count as one; different texts of one
    doc_id are different documents, in the order of their hashes. Empty tables give no rows. Other columns are not read.
    """
    return _passages(docs).drop("text_key").distinct()


def without_passages(docs: DataFrame) -> DataFrame:
    """docs with the passages cut from all documents but the earliest one, and n_chars (if there) of what is left. Rows and columns stay.

    Rows are told apart by doc_id and text, so rows with one doc_id and other texts are cut at their own passages only.
    """
    flat, _ = written(_passages(docs).select("doc_id", "text_key", "start", "end").distinct(), "passage-spans")
    few = flat.limit(BROADCAST_SPANS + 1).count() <= BROADCAST_SPANS
    spans = flat.groupBy(F.col("doc_id").alias("_passage_doc"), F.col("text_key").alias("_passage_text")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    # what is left between the ends so far and each span's start
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # its columns may have any names
    text = F.col("_row.text")
    walked = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("kept")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] > acc["at"], F.concat(acc["kept"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")))).otherwise(acc["kept"]).alias("kept"),
        ),
    )
    same = (F.col("_row.doc_id").cast("bigint") == F.col("_passage_doc")) & (F.xxhash64(text) == F.col("_passage_text"))
    joined = row.join(F.broadcast(spans) if few else spans, same, "left")
    left = joined.withColumn("_walked", F.when(F.col("_spans").isNotNull(), walked))
    new = {"text": F.when(F.col("_spans").isNull(), text).otherwise(F.concat(F.col("_walked.kept"), F.substr(text, (F.col("_walked.at") + 1).cast("int"))))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast("bigint"))
    left = left.withColumn("_text", new["text"])
    return left.select(*[(F.col("_text") if c == "text" else new.get(c, F.col(f"_row.`{c}`"))).alias(c) for c in docs.columns])


#: rows of spans (24 bytes) that are broadcast to the texts; more are joined by a shuffle
BROADCAST_SPANS = 1_000_000
