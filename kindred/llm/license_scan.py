"""License scans by patience alignment.

Words that belong to a template mark the places where enough of them stand
close together; each such place is aligned with the template: words unique to
both sides are anchors, the longest increasing subsequence of them is kept, and
the gaps between are aligned again in the same way (with their common first
and last words), until no anchor is left.  Coverage is the share of the
template's words that were aligned.

All work is done where a text is read; nothing is shuffled.  Words are runs of
letters and digits of the lower-cased text.  Null and empty texts give
nothing; templates without words match nothing; very long texts are scanned
whole; a place is as long as the template and a quarter, so a copy with more
than that inserted is not seen; places of several templates may overlap, each
is a row (of equal templates too); a text that holds a license twice
gives two rows; repeated rows are judged each on their own, and a null id stays
null.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .decontaminate import word_runs

U = np.uint64
MIN_COVERAGE = 0.8
#: Public license notices and texts; fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with increasing second parts; first parts increase."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before[k] = last[at - 1] if at else -1
        tops[at:at + 1] = [y]
        last[at:at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences."""
    out: list[tuple[int, int]] = []
    open_gaps = [(0, len(a), 0, len(b))]
    while open_gaps:
        i, n, j, m = open_gaps.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        ca, cb = Counter(a[i:n]), Counter(b[j:m])
        where = {b[k]: k for k in range(j, m) if cb[b[k]] == 1}
        anchors = _increasing([(k, where[a[k]]) for k in range(i, n) if ca[a[k]] == 1 and a[k] in where])
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (n, m)]
            open_gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def _scan(templates: dict[str, str], min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worded = {name: word for name in sorted(templates) for _, word, _ in word_runs([templates[name]]) if len(word)}
        names, parts = list(worded), list(worded.values())
        if not names:
            return
        known = np.unique(np.concatenate(parts))
        marks = np.zeros((len(names), len(known)), dtype=bool)
        for t, part in enumerate(parts):
            marks[t, np.searchsorted(known, part)] = True
        lists = [p.tolist() for p in parts]
        for b in spans.slim(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for row, word, first in word_runs([t or "" for t in b.column(1).to_pylist()]):
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                some = np.flatnonzero(known[at] == word)
                which = at[some]
                for t, name in enumerate(names):
                    n = len(lists[t])
                    need, reach = int(np.ceil(min_coverage * n)), n + n // 4
                    hits = some[marks[t, which]]
                    if len(hits) < need:
                        continue
                    text = np.searchsorted(first, hits, side="right") - 1
                    ends = need - 1
                    close = np.flatnonzero((hits[ends:] - hits[: len(hits) - ends] < reach) & (text[ends:] == text[: len(hits) - ends]))
                    done = -1
                    for k in close.tolist():
                        begin = int(hits[k])
                        if begin < done:
                            continue
                        stop = min(begin + reach, int(first[text[k] + 1]))
                        pairs = patience(word[begin:stop].tolist(), lists[t])
                        if len(pairs) >= need:
                            done = begin + pairs[-1][0] + 1
                            lo = int(first[text[k]])
                            for c, v in zip(out, (row + int(text[k]), name, len(pairs) / n, begin + pairs[0][0] - lo, done - lo), strict=True):
                                c.append(v)
            ids = b.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["doc_id", "license", "coverage", "start_word", "end_word"])

    return run


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per place of a license in a document: doc_id, license, coverage, and its words [start_word, end_word)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(TEMPLATES if templates is None else templates, min_coverage), "doc_id long, license string, coverage double, start_word long, end_word long")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
