"""Licence scans: Dice coefficient over word bigrams.

A text is cut into passages: each line, each paragraph (lines between blank ones),
the whole, and for each template every run of as many words as it has. A passage
is normalised (A-Z lower-cased, words are runs of ASCII letters and digits or
non-ASCII characters) and compared with each template:

    dice = 2 |A and B| / (|A| + |B|), A and B the sets of word bigrams

Only templates that can reach the threshold are compared: dice <= 2 min(a, b) /
(a + b) bounds the sizes, and a passage needs enough bigrams that any template
holds. Runs count for licences that no line, paragraph or whole text reaches. A
run needs theta / (2 - theta) of the template's bigrams; runs that have them are
compared one and all. Of a document's passages the best per template counts; ties
go to the first passage, then to the first template. A text of one word has that
word as its only bigram. Null or empty text matches nothing. Repeated rows each
get a result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .common import U64

THRESHOLD = 0.8
LONG = 60  # bigrams from which a template is long

TEXTS = Path(__file__).parent / "license_texts"


def _text(name: str) -> str:
    return (TEXTS / f"{name}.txt").read_text(encoding="utf-8")


def _gnu(kind: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


_GNU_TAIL = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} General Public License for more details."

#: Notices, short forms, complete headers and full texts of well-known licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        _text("Apache-2.0"),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        _gnu("", "3") + _GNU_TAIL.format(""),
        _text("GPL-3"),
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        _text("BSD"),
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", _text("CC0-1.0")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        _text("MPL-2.0"),
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _gnu("", "2"), _gnu("", "2") + _GNU_TAIL.format(""), _text("GPL-2")],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("Lesser", "2.1"), _gnu("Lesser", "2.1") + _GNU_TAIL.format("Lesser"), _text("LGPL-2.1")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("Lesser", "3"), _gnu("Lesser", "3") + _GNU_TAIL.format("Lesser"), _text("LGPL-3")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _gnu("Affero", "3"), _gnu("Affero", "3") + _GNU_TAIL.format("Affero")],
}

BREAK = np.ones(256, bool)
BREAK[48:58] = BREAK[97:123] = False
BREAK[65:91] = BREAK[128:] = False
NEWLINE = 10


def bigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram hashes with the byte at which each begins and its row; a row of one word has it as its bigram."""
    data = C.LOWER[data]
    s, e, at = C.words(data, off, BREAK)
    h, row, pos = C.shingles(C.span_hash(data, s, e), at, 2)
    return h, s[pos], row


@dataclass
class Template:
    name: str
    grams: np.ndarray
    words: int


def compile_templates(templates: dict[str, list[str]]) -> list[Template]:
    out = []
    for name, texts in templates.items():
        for text in texts:
            b = np.frombuffer(text.encode(), np.uint8)
            off = np.array([0, len(b)])
            out.append(Template(name, np.unique(bigrams(b, off)[0]), len(C.words(C.LOWER[b], off, BREAK)[0])))
    return out


def dice(grams: np.ndarray, template: Template) -> float:
    both = len(np.intersect1d(grams, template.grams, assume_unique=True))
    return 2 * both / (len(grams) + len(template.grams))


def passages(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, rows) of lines, of paragraphs of two lines or more, and of whole texts of more than one line."""
    feeds = np.flatnonzero(data == NEWLINE)
    s = np.unique(np.concatenate([off[:-1], feeds + 1]))
    s = s[s < len(data)]
    row = np.searchsorted(off, s, "right") - 1
    e = np.r_[s[1:], len(data)]
    inked = np.r_[0, np.cumsum(~C.SPACE[data])]
    blank = inked[e] == inked[s]
    group = np.cumsum(blank | np.r_[True, row[1:] != row[:-1]])
    keep = ~blank
    ps = np.flatnonzero(np.r_[True, group[keep][1:] != group[keep][:-1]]) if keep.any() else np.zeros(0, np.int64)
    pe = np.r_[ps[1:], int(keep.sum())] if len(ps) else ps
    many = pe - ps > 1
    first, last = ps[many], pe[many] - 1
    n = np.bincount(row[keep], minlength=len(off) - 1)
    whole = np.flatnonzero(n > 1)
    return [(s[keep], e[keep], row[keep]), (s[keep][first], e[keep][last], row[keep][first]), (off[whole], off[whole + 1], whole)]


def dice_of_runs(grams: np.ndarray, hit: np.ndarray, length: int, size: int) -> np.ndarray:
    """Dice of every run of ``length`` bigrams with a template of ``size``; ``hit`` marks its bigrams.

    A bigram counts for the runs that hold it and not its occurrence before.
    """
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    before = np.full(n, -1)
    same = grams[order[1:]] == grams[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    begin = np.maximum(before + 1, np.maximum(np.arange(n) - length + 1, 0))
    runs = n - length + 1

    def distinct(j: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(begin[j], minlength=n + 1) - np.bincount(j + 1, minlength=n + 1))[:runs]

    return 2 * distinct(np.flatnonzero(hit)) / (distinct(np.arange(n)) + size)


def scan_runs(data: np.ndarray, off: np.ndarray, templates: list[Template], threshold: float) -> Iterator[tuple[int, str, float, int, int]]:
    """(row, licence, dice, first byte, last byte): the best runs of a template's length, where they reach the threshold."""
    low = C.LOWER[data]
    s, e, at = C.words(low, off, BREAK)
    h, _, pos = C.shingles(C.span_hash(low, s, e), at, 2)
    known = np.unique(np.concatenate([t.grams for t in templates]))
    gram = np.searchsorted(known, h)
    gram[gram == len(known)] = 0
    hit = known[gram] == h
    grams = np.zeros(len(s), U64)  # by word
    grams[pos] = h
    gram, pos = gram[hit], pos[hit]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for t in templates:
        length, size = t.words - 1, len(t.grams)
        if length < 1:
            continue
        mine = np.zeros(len(known), bool)
        mine[np.searchsorted(known, t.grams)] = True
        p = pos[mine[gram]]
        need = max(1, int(np.ceil(threshold * size / (2 - threshold) - 1e-9)))
        a, z = p[: max(0, len(p) - need + 1)], p[need - 1 :]
        close = (z - a < length) & (row[a] == row[z])
        a, z = a[close], z[close]
        # starts of runs that hold the bigrams from a to z
        r = row[a]
        first, last = np.maximum(z - length + 1, at[r]), np.minimum(a, at[r + 1] - t.words)
        fits = first <= last
        r, first, last = r[fits], first[fits], last[fits]
        new = np.flatnonzero(np.r_[True, (first[1:] > last[:-1] + 1) | (r[1:] != r[:-1])]) if len(r) else np.zeros(0, np.int64)
        for i, j in zip(new.tolist(), [*new[1:].tolist(), len(r)], strict=False):
            x, y = int(first[i]), int(last[j - 1])
            g = grams[x : y + length]
            d = dice_of_runs(g, np.isin(g, t.grams), length, size)
            best = int(d.argmax())
            if d[best] >= threshold:
                yield int(r[i]), t.name, float(d[best]), int(s[x + best] - off[r[i]]), int(e[x + best + length] - off[r[i]])


def scan_batch(data: np.ndarray, off: np.ndarray, templates: list[Template], threshold: float) -> dict[int, dict[str, tuple[float, int, int]]]:
    """Per row: licence -> (dice, first byte, last byte) of its best passage."""
    # bigrams of long templates are common, but a passage near one of them has many
    brief = [t for t in templates if len(t.grams) < LONG]
    long = [t for t in templates if len(t.grams) >= LONG]
    none = np.zeros(1, U64)
    known, known_long = (np.unique(np.concatenate([t.grams for t in x])) if x else none for x in (brief, long))
    least, least_long = (min((len(t.grams) for t in x), default=1 << 62) for x in (brief, long))
    found: dict[int, dict[str, tuple[float, int, int]]] = {}
    # a line's only word counts as a bigram of the line, but not of the text around it
    for starts, ends, rows in passages(data, off):
        if not len(starts):
            continue
        order = np.argsort(starts, kind="stable")
        starts, ends, rows = starts[order], ends[order], rows[order]
        bounds = np.stack([starts, ends], 1).ravel()
        h, at, seg = bigrams(data, np.r_[bounds, len(data)] if bounds[0] == 0 else np.r_[0, bounds, len(data)])
        seg = seg - (0 if bounds[0] == 0 else 1)
        mine = seg % 2 == 0
        h, seg = h[mine], seg[mine] // 2
        inside = (seg >= 0) & (seg < len(starts))
        h, seg = h[inside], seg[inside]
        p = np.searchsorted(known, h)
        p[p == len(known)] = 0
        hits = np.bincount(seg[known[p] == h], minlength=len(starts))
        total = np.bincount(seg, minlength=len(starts))
        # hits are counted with repeats, so they bound the overlap from above
        able = 2 * hits >= threshold * (np.minimum(total, hits) + least) * 0.999999
        if (total >= threshold * least_long / (2 - threshold) * 0.999999).any():
            p = np.searchsorted(known_long, h)
            p[p == len(known_long)] = 0
            able |= np.bincount(seg[known_long[p] == h], minlength=len(starts)) >= threshold * least_long / (2 - threshold) * 0.999999
        able = np.flatnonzero(able)
        first = np.searchsorted(seg, able)
        last = np.searchsorted(seg, able, "right")
        for i, a, z in zip(able.tolist(), first.tolist(), last.tolist(), strict=True):
            grams = np.unique(h[a:z])
            for t in templates:
                x, y = len(grams), len(t.grams)
                if not x or 2 * min(x, y) < threshold * (x + y):
                    continue
                d = dice(grams, t)
                if d >= threshold:
                    own = found.setdefault(int(rows[i]), {})
                    if t.name not in own or d > own[t.name][0]:
                        own[t.name] = (d, int(starts[i] - off[rows[i]]), int(ends[i] - off[rows[i]]))
    within: dict[int, dict[str, tuple[float, int, int]]] = {}
    for i, name, d, a, z in scan_runs(data, off, templates, threshold):
        own = within.setdefault(i, {})
        if name not in own or d > own[name][0]:
            own[name] = (d, a, z)
    for i, own in within.items():
        found[i] = own | found.get(i, {})
    return found


def scan(docs: DataFrame, *, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_licenses, license (the best), dice, licenses (array of name, dice, first and last byte)."""
    compiled = compile_templates(templates or TEMPLATES)
    order = {t.name: i for i, t in enumerate(compiled)}
    kind = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in C.slices(batches):
            found = scan_batch(data, off, compiled, threshold)
            each = [sorted(((d, n, a, z) for n, (d, a, z) in found.get(i, {}).items()), key=lambda x: (-x[0], order[x[1]])) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(x) for x in each], pa.int64()),
                    pa.array([x[0][1] if x else None for x in each], pa.string()),
                    pa.array([x[0][0] if x else 0.0 for x in each]),
                    pa.array([[{"name": n, "dice": d, "first": a, "last": z} for d, n, a, z in x] for x in each], kind),
                ],
                ["doc_id", "n_licenses", "license", "dice", "licenses"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(C.lean(run), "doc_id long, n_licenses long, license string, dice double, licenses array<struct<name:string,dice:double,first:long,last:long>>")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir))
