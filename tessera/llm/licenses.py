"""Operator 7: license scans by MinHash bands over overlapping windows, verified by exact shingle containment.

Tokens are the shingles of five words of passages.tokens_of. For each length that a template has, windows of that many tokens slide over a text with a stride of
at most an eighth of it, so some window holds all of a notice but that part. A window's ``BANDS`` x ``ROWS`` minima make its bands; a window that agrees
with a template in one band retrieves it. At Jaccard similarity s that happens with probability 1 - (1 - s^ROWS)^BANDS: over 0.9999 at 0.7. A minimum can
agree only if it is a token of the template (up to collisions of 64-bit hashes), so windows without a template's token are not hashed. A retrieved template matches
if the window, widened to its neighbours, contains at least ``CONTAINMENT`` of its tokens.

The templates are a parameter of bounded size (a table of notices, not data), sent with the code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import SHINGLE, tokens_of
from .shared import arrow_map, slices, text_bytes
from .words import mix

BANDS, ROWS = 24, 2
CONTAINMENT = 0.8
BATCH_BYTES = 2 << 20

#: The notices' own wording.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0-header": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    # whole texts
    "BSD-2-Clause-text": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ],
    "ISC-text": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "MIT-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "Zlib-text": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
}


class Templates:
    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.tokens = [], []
        for name, texts in sorted(templates.items()):
            for text in texts:
                tokens = np.unique(tokens_of(*text_bytes(pa.array([text])))[0])
                if len(tokens):
                    self.names.append(name)
                    self.tokens.append(tokens)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.tokens]))
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.by_length: dict[int, dict[int, list[int]]] = {}
        for i, tokens in enumerate(self.tokens):
            bands = self.by_length.setdefault(len(tokens), {})
            for key in band_keys(tokens[None, :])[0].tolist():
                bands.setdefault(key, []).append(i)

    def marks(self, tokens: np.ndarray) -> np.ndarray:
        """Places of tokens that some template has."""
        some = np.flatnonzero(self.bitmap[(tokens & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, tokens[some]), max(len(self.known) - 1, 0))
        return some[self.known[at] == tokens[some]] if len(self.known) else some[:0]

    def scan(self, tokens: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Of one text: (template, first token, end, containment) of the best window of each stretch that matches."""
        found: dict[tuple[int, int], tuple] = {}
        marks = self.marks(tokens)
        if not len(marks):
            return []
        for length, bands in self.by_length.items():
            stride = max(1, length // 8)
            starts = np.unique(np.concatenate([np.arange(max(m - length + 1, 0) // stride, m // stride + 1) for m in marks.tolist()])) * stride
            starts = np.unique(np.minimum(starts, max(len(tokens) - length, 0)))
            for part in range(0, len(starts), 4096):
                own = starts[part : part + 4096]
                windows = tokens[np.minimum(own[:, None] + np.arange(length), len(tokens) - 1)]
                keys = band_keys(windows)
                for start, row in zip(own.tolist(), keys.tolist(), strict=True):
                    for i in {i for key in row for i in bands.get(key, ())}:
                        lo, hi = max(0, start - stride), min(len(tokens), start + length + stride)
                        at = np.flatnonzero(np.isin(tokens[lo:hi], self.tokens[i]))
                        contained = len(np.unique(tokens[lo:hi][at])) / len(self.tokens[i])
                        if contained >= CONTAINMENT:
                            a, b = lo + int(at[0]), lo + int(at[-1]) + 1
                            key = i, a // max(length, 1)
                            if key not in found or found[key][3] < contained:
                                found[key] = i, a, b, contained
        return _apart(sorted(found.values(), key=lambda m: (m[0], -m[3], m[1])))


def _apart(matches: list[tuple]) -> list[tuple]:
    """Of matches of one template that overlap, the first."""
    out: list[tuple] = []
    for m in matches:
        if not any(o[0] == m[0] and m[1] < o[2] and o[1] < m[2] for o in out):
            out.append(m)
    return out


def band_keys(windows: np.ndarray) -> np.ndarray:
    """The band keys of each row of tokens."""
    keys = np.empty((len(windows), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(windows), band + 1, np.uint64)
        for row in range(ROWS):
            seed = np.uint64(0x9E3779B97F4A7C15 * (band * ROWS + row + 1) & 0xFFFFFFFFFFFFFFFF)
            key = mix(key) + mix(windows ^ seed).min(1)
        keys[:, band] = key
    return keys


def scan_documents(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Notices found: doc_id, license, start, end (code points), containment.

    A document has a row for each notice, none if it has none. Null and empty texts have none. Repeated rows give repeated matches. Texts are scanned whole and alone,
    nothing is shuffled. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in slices(batches, BATCH_BYTES):
                known = shared.value
                data, bounds = text_bytes(batch.column("text"))
                tokens, rows, firsts, starts, ends = tokens_of(data, bounds)
                hit = np.unique(rows[known.marks(tokens)])
                word_first = np.searchsorted(starts, bounds)
                out = []
                doc_ids = batch.column("doc_id")
                for i in hit.tolist():
                    text = data[bounds[i] : bounds[i + 1]]
                    chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                    for template, a, b, contained in known.scan(tokens[firsts[i] : firsts[i + 1]]):
                        first, last = word_first[i] + a, word_first[i] + b - 1 + SHINGLE - 1
                        out.append((doc_ids[i].as_py(), known.names[template], int(chars[starts[first] - bounds[i]]), int(chars[ends[last] - bounds[i]]), contained))
                doc_id, name, start, end, contained = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "license": pa.array(name, pa.string()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()), "containment": pa.array(contained, pa.float64())})

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, license string, start bigint, end bigint, containment double")
