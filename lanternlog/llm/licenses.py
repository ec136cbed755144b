"""Licence scans: passages compared with licence templates by the Dice coefficient of their word bigrams.

A passage is a line, a paragraph (lines up to a blank one) or the whole text; words are lower-cased
runs of letters and digits. Only passages that share a bigram with some template are measured, and a
passage of A distinct bigrams meets a template of B only if min(A, B) / max(A, B) leaves room for the
threshold: 2 min / (A + B) >= threshold. A passage whose size leaves room for no template goes before its bigrams
are looked up, and no other pair is counted. The templates are a parameter of bounded size and travel to the
tasks; each document is judged where it lies, without a shuffle.

Defined cases: null and empty texts, and passages of one word, match nothing; repeated rows each give
their rows; of equally good passages the first counts, lines before paragraphs before the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lanternlog.llm import bytes as B

THRESHOLD = 0.8
#: Bound on the templates' text, which every task holds.
MAX_TEMPLATE_BYTES = 16 << 20

# Notices in the wording their licences or stewards give.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0-header": 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    "AGPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    "MIT-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_BREAK, _BLANK = 10, np.array([b in (9, 11, 12, 13, 32) for b in range(256)])


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return B.mix(hashes[:-1] * np.uint64(3) + B.mix(hashes[1:]))


class Index:
    """Bigrams of the templates."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        own: dict[str, np.ndarray] = {}
        for name in sorted(templates):
            buf, at = B.utf8(pa.array([templates[name]], pa.large_string()))
            pairs = np.unique(_pairs(B.word_hashes(buf, at, B.ALNUM)[0]))
            if len(pairs):
                own[name] = pairs
        self.names = list(own)
        self.sizes = np.array([len(x) for x in own.values()], np.int64)
        self.ordered = np.sort(self.sizes)
        both = np.concatenate(list(own.values())) if own else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(own)), self.sizes)
        order = np.argsort(both, kind="stable")
        self.pairs, self.which = both[order], which[order]  # a pair once for each template that has it


def _units(buf: np.ndarray, at: np.ndarray, start: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """For each word the number of its line, of its paragraph and of its text."""
    breaks = buf == _BREAK
    line = np.cumsum(breaks)
    solid = np.where(_BLANK[buf], -1, np.arange(len(buf)))
    before = np.maximum.accumulate(np.concatenate([[-1], solid[:-1]]))
    empty = breaks & (before >= 0) & (buf[np.maximum(before, 0)] == _BREAK)
    return [line[start] + row, np.cumsum(empty)[start] + row, row]


def _room(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of a and b bigrams can reach the threshold at all: if the smaller lies in the larger."""
    return 2 * np.minimum(a, b) >= threshold * (a + b)


def find(buf: np.ndarray, at: np.ndarray, index: Index, threshold: float) -> list[tuple[int, int, float, int]]:
    """(row, template, Dice, kind of passage) of the best passage for each row and template."""
    low = B.LOWER[buf]
    start, end, first = B.words(low, at, B.ALNUM)
    if len(start) < 2 or not len(index.pairs):
        return []
    pairs = _pairs(B.hashes(low, start, end))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    slot = np.minimum(np.searchsorted(index.pairs, pairs), len(index.pairs) - 1)
    known = index.pairs[slot] == pairs
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for kind, unit in enumerate(_units(low, at, start, row)):
        inside = unit[1:] == unit[:-1]
        inside &= row[1:] == row[:-1]
        touched = np.unique(unit[:-1][inside & known])
        if not len(touched):
            continue
        k = np.flatnonzero(inside)
        place = np.minimum(np.searchsorted(touched, unit[k]), len(touched) - 1)
        k = k[touched[place] == unit[k]]
        own = np.rec.fromarrays([unit[k], pairs[k]], names="unit,pair")
        own, at_first = np.unique(own, return_index=True)
        rows = row[k[at_first]]
        units, begin, sizes = np.unique(own["unit"], return_index=True, return_counts=True)
        # the templates nearest in size decide whether any leaves room
        near = np.searchsorted(index.ordered, sizes)
        nearest = [index.ordered[np.clip(near + d, 0, len(index.ordered) - 1)] for d in (-1, 0)]
        fits = _room(sizes, nearest[0], threshold) | _room(sizes, nearest[1], threshold)
        if not fits.any():
            continue
        kept = np.repeat(fits, sizes)
        own, rows = own[kept], rows[kept]
        units, begin, sizes = np.unique(own["unit"], return_index=True, return_counts=True)
        lo, hi = np.searchsorted(index.pairs, own["pair"]), np.searchsorted(index.pairs, own["pair"], "right")
        n = hi - lo
        of = np.repeat(np.searchsorted(units, own["unit"]), n)
        template = index.which[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        some = _room(sizes[of], index.sizes[template], threshold)
        cell, common = np.unique((of * len(index.sizes) + template)[some], return_counts=True)
        of, template = np.divmod(cell, len(index.sizes))
        dice = 2 * common / (sizes[of] + index.sizes[template])
        for j in np.flatnonzero(dice >= threshold).tolist():
            key = (int(rows[begin[of[j]]]), int(template[j]))
            if dice[j] > best.get(key, (0.0, 0))[0]:
                best[key] = (float(dice[j]), kind)
    return [(r, t, d, kind) for (r, t), (d, kind) in sorted(best.items())]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (of its best passage) and passage (line, paragraph or text), matches only."""
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError("the templates exceed MAX_TEMPLATE_BYTES: scan with a part of them at a time")
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates))
    kinds = ("line", "paragraph", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            buf, at = B.utf8(batch.column(1))
            found = []
            for i, j in B.slices(at):
                got = find(buf[at[i] : at[j]], at[i : j + 1] - at[i], index, threshold)
                found += [(i + r, *rest) for r, *rest in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([index.names[f[1]] for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.float64()),
                    pa.array([kinds[f[3]] for f in found], pa.string()),
                ],
                names=["doc_id", "license", "dice", "passage"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, dice double, passage string")
