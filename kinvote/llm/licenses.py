"""License scans: windows that share MinHash bands with templates, then exact containment.

Words are lower-cased letters and digits; a shingle is ``SHINGLE`` consecutive words (a text
of fewer has one). Templates are grouped by size: class c has the templates of more than
2**(c-1) and at most 2**c shingles, and texts are looked at through windows of 2**c shingles
that overlap: each begins ``step`` shingles after the last, where a step is an eighth of the
window (one for the smallest). A window's signature is the minimum of ``HASHES`` hash
functions over its shingles; a band is ``ROWS`` of them.

How likely a copy is found: some window of w shingles begins less than w / 8 before a copy of a
template of m > w / 2 shingles. If the copy holds ``MIN_CONTAINMENT`` of the template, window and
template have a Jaccard similarity of 0.36 or more (0.4 w shared of 1.1 w for the smallest m, 0.67 w
of 1.33 w for the largest), and all 32 bands of one row miss with a chance below
(1 - 0.36) ** 32 < 0.000001. ``hit_chance`` computes it.

A template is a match where a window that a band retrieved, widened by the template's own
size to both sides, holds at least ``MIN_CONTAINMENT`` of its distinct shingles, counted
exactly. The best window of a text and template is the match (the first, if several are).

Edge cases: null and empty texts have no matches; ids may be null and rows may repeat, each
row is scanned on its own; templates without words are refused; an empty table gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.llm.common import ALNUM_WORDS, fold, mix, slices, window_starts, word_hashes, words_of

SHINGLE = 3
HASHES = 32
ROWS = 1
MIN_CONTAINMENT = 0.8
MAX_TEMPLATES = 10_000
"""Templates travel with the function to every task, so their number is checked."""

# Short license notices and the opening of the licenses' standard texts.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer."
    ),
}


def hit_chance(similarity: float, hashes: int = HASHES, rows: int = ROWS) -> float:
    """The chance that two sets of a Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** (hashes // rows)


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in order, and the texts' bounds."""
    words = words_of(texts, ALNUM_WORDS)
    hashes, counts = word_hashes(words), np.diff(words.starts)
    at, owner = window_starts(words.starts, SHINGLE)
    values = fold(hashes, at, SHINGLE)
    for m in range(1, SHINGLE):
        short = np.flatnonzero(counts == m)
        values, owner = np.concatenate([values, fold(hashes, words.starts[short], m)]), np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    return values[order], np.searchsorted(owner, np.arange(len(counts) + 1))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the hash functions on 32 bits."""
    drawn = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (drawn[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[HASHES:] >> np.uint64(32)).astype(np.uint32)


class _Class:
    """Templates of one size class and the minima of their shingles."""

    def __init__(self, window: int, members: list[tuple[str, np.ndarray]]):
        self.window, self.step, self.members = window, max(1, window // 8), members
        a, b = _functions()
        low = [(s >> np.uint64(32)).astype(np.uint32) for _, s in members]
        self.minima = np.array([[(s * a[i] + b[i]).min() for i in range(HASHES)] for s in low], dtype=np.uint32)


def template_classes(templates: Mapping[str, str]) -> list[_Class]:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    sized: dict[int, list] = {}
    for name, text in templates.items():
        values, _ = _shingles(pa.array([text]))
        if not len(values):
            raise ValueError(f"template {name} has no words")
        window = 1 << int(np.ceil(np.log2(len(values))))
        sized.setdefault(max(4, window), []).append((name, np.unique(values)))
    return [_Class(window, members) for window, members in sorted(sized.items())]


def _candidates(values: np.ndarray, classes: list[_Class]) -> list[np.ndarray]:
    """For each class, (window start, template) of the windows that share a band with a template.

    The minima over 2, 4, 8, ... shingles are built from each other, so one pass over the hash
    values serves all classes. Windows may reach into the next text; containment is counted
    inside the text, so that only makes candidates.
    """
    a, b = _functions()
    widest = max(c.window for c in classes)
    low = (values >> np.uint64(32)).astype(np.uint32)
    found: list[list[np.ndarray]] = [[] for _ in classes]
    for band in range(0, HASHES, ROWS):
        agree: dict[tuple[int, int], np.ndarray] = {}
        for i in range(band, band + ROWS):
            table = np.concatenate([low * a[i] + b[i], np.full(widest, 0xFFFFFFFF, np.uint32)])
            size = 1
            for c, held in enumerate(classes):
                while size < held.window:
                    table = np.minimum(table[:-size], table[size:])
                    size *= 2
                minima = table[: len(values) : held.step]
                for t, wanted in enumerate(held.minima[:, i]):
                    same = minima == wanted
                    agree[c, t] = same if i == band else agree[c, t] & same
        for (c, t), same in agree.items():
            at = np.flatnonzero(same) * classes[c].step
            if len(at):
                found[c].append(np.column_stack([at, np.full(len(at), t)]))
    return [np.unique(np.concatenate(f), axis=0) if f else np.zeros((0, 2), np.int64) for f in found]


def scan(values: np.ndarray, bounds: np.ndarray, classes: list[_Class], least: float) -> list[tuple]:
    """(text, template, containment, first shingle, windows) of the best window of each match."""
    best: dict[tuple[int, str], tuple] = {}
    if not len(values):
        return []
    for held, pairs in zip(classes, _candidates(values, classes)):
        texts = np.searchsorted(bounds, pairs[:, 0], "right") - 1
        for (start, which), text in zip(pairs.tolist(), texts.tolist()):
            name, shingles = held.members[which]
            low = max(int(bounds[text]), start - len(shingles))
            high = min(int(bounds[text + 1]), start + held.window + len(shingles))
            around = values[low:high]
            containment = len(np.intersect1d(around, shingles)) / len(shingles)
            if containment >= least:
                inside = np.flatnonzero(np.isin(around, shingles))
                at = low + int(inside[0]) - int(bounds[text])
                old = best.get((text, name))
                if old is None or (containment, -at) > (old[0], -old[1]):
                    best[text, name] = (containment, at, (old[2] if old else 0) + 1)
                else:
                    best[text, name] = (old[0], old[1], old[2] + 1)
    return [(text, name, *rest) for (text, name), rest in sorted(best.items())]


def license_matches(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    least: float = MIN_CONTAINMENT,
) -> DataFrame:
    """(key, license, containment, first_word, n_windows): one row for each text and template found."""
    classes = template_classes(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4 << 20):
            rows = scan(*_shingles(batch.column("_text")), classes, least)
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], pa.string()),
                    pa.array(columns[2], pa.float64()),
                    pa.array(columns[3], pa.int64()),
                    pa.array(columns[4], pa.int64()),
                ],
                ["_key", "license", "containment", "first_word", "n_windows"],
            )

    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    made = slim.mapInArrow(run, f"_key {kind}, license string, containment double, first_word bigint, n_windows bigint")
    return made.withColumnRenamed("_key", key)
