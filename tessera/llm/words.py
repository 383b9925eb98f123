"""Words of many texts at once, as 64-bit hashes, from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF97 & ~np.uint64(2) | np.uint64(1))


def _random(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(letters: bool) -> np.ndarray:
    """Per byte a random value, 0 for separators; ASCII letters of either case have one value."""
    values = _random(256, 7)
    values[65:91] = values[97:123]
    for b in range(128):
        if b in (32, *range(9, 14)) or letters and not chr(b).isalnum():
            values[b] = 0
    return values


#: runs of ASCII letters and digits and of all other characters beyond ASCII; runs without ASCII white space
LETTERS, NON_SPACE = _table(True), _table(False)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256), _BASE)]), dtype=np.uint64)
    return _powers


#: bytes that are looked at together: a text of any length takes some 40 bytes for each of these, and 32 for each of its words
PIECE = 1 << 20


def word_hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all rows, in order: hash, row, first byte, byte after the last (in data). Case of ASCII letters is ignored."""
    if len(data) <= PIECE:
        return _word_hashes(data, bounds, table)
    inside, parts, at = table != 0, [], 0
    while at < len(data):
        upto = min(at + PIECE, len(data))
        gaps = np.flatnonzero(~inside[data[at:upto]]) if upto < len(data) else None
        if gaps is None or len(gaps):
            upto = upto if gaps is None else at + int(gaps[-1]) + 1
            hashes, _, starts, ends = _word_hashes(data[at:upto], np.clip(bounds, at, upto) - at, table)
            parts.append((hashes, starts + at, ends + at))
        else:  # one word, or several without a gap between their rows
            upto = next((a + int(g[0]) for a in range(upto, len(data), PIECE) if len(g := np.flatnonzero(~inside[data[a : a + PIECE]]))), len(data))
            cuts = np.unique(np.concatenate([[at, upto], bounds[(bounds > at) & (bounds < upto)]]))
            own = [_long_word(data[a:b], table) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            parts.append((np.array(own, np.uint64), cuts[:-1], cuts[1:]))
        at = upto
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, np.searchsorted(bounds, starts, "right") - 1, starts, ends


def _long_word(data: np.ndarray, table: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(data), PIECE):
        piece = table[data[at : at + PIECE]]
        with np.errstate(over="ignore"):
            part = int((piece * _powers_to(len(piece))[: len(piece)]).sum(dtype=np.uint64))
        total += part * pow(int(_BASE), at, 1 << 64)
    return mix(np.array([(total + len(data) * int(_ODD)) % (1 << 64)], np.uint64))[0]


def _word_hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values = table[data]
    inside = values != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    row_starts = bounds[:-1][bounds[:-1] < len(data)]
    opens[row_starts] = inside[row_starts]
    starts = np.flatnonzero(opens)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    spans = np.diff(np.append(starts, len(data)))
    skip = starts[0]
    within = np.arange(len(data) - skip, dtype=np.int64) - np.repeat(starts - skip, spans)
    lengths = np.add.reduceat(inside[skip:].astype(np.int64), starts - skip)
    np.minimum(within, lengths.max(), out=within)
    hashes = np.add.reduceat(values[skip:] * _powers_to(int(lengths.max()) + 1)[within], starts - skip)
    rows = np.searchsorted(bounds, starts, "right") - 1
    return mix(hashes + lengths.astype(np.uint64) * _ODD), rows, starts, starts + lengths
