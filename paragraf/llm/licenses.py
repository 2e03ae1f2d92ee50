"""License scans: MinHash bands retrieve templates for overlapping windows, exact containment verifies them.

Templates are put in classes by their number of words w; the windows of a class have S words, the least power of two
of at least 2 w, and begin at every multiple of S / 2, so each occurrence of a template lies whole in some window.
A window's MinHash values are banded; every template that shares a band is verified: the share of its distinct word
bigrams that the window has must be at least THRESHOLD. bands() gives the number of bands by which a window that
passes, even the most diluted one, is retrieved with probability RECALL. Windows that hold none of a template's
anchors (patterns.py) cannot pass and are not looked at.

Licenses of which one template has that share of another's bigrams (versions of one license, or one that the other
goes on from) are rivals: of rivals, those of greatest containment in the document are reported. "BSD" is the head
that all BSD licenses have; where their clauses follow, it is reported beside the license that they make.

Null and empty texts hold no license. A doc_id that repeats is reported once per license, with its best window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents
from .patterns import Lookup, anchors, pattern_words, row_grams
from .textvec import Words, column_bytes, slices

N, THRESHOLD, RECALL = 2, 0.8, 0.999

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_FREE = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version"


def _bsd(first: str, second: str, third: str) -> str:
    clauses = f"{first} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {second} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    return f"{_BSD_HEAD}: {clauses} {third} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"


_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: License -> the names by which short notices grant it.
_NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License Version 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "Unlicense": ["Unlicense License"],
}
_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: (license, template): the notices by which the licenses are commonly granted.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("BSD", _BSD_HEAD),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("proprietary", "All rights reserved"),
    ("GPL-2.0", _FREE.format("This program", "General Public License", "2")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("LGPL-2.0", _FREE.format("This library", "Library General Public License", "2")),
    ("LGPL-2.1", _FREE.format("This library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _FREE.format("This program", "Lesser General Public License", "3")),
    ("AGPL-3.0", _FREE.format("This program", "Affero General Public License", "3")),
    *(("BSD-2-Clause", _bsd(*marks, "")) for marks in (("", ""), ("1.", "2."))),
    *(("BSD-3-Clause", _bsd(*marks, _NEITHER)) for marks in (("", ""), ("1.", "2."))),
    ("BSD-3-Clause", _bsd("1.", "2.", "3. " + _NEITHER)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    *((license, start + name) for license, names in _NAMES.items() for name in names for start in ("Licensed under the ", "Released under the ", "Licensed under ")),
    *((f"CC-{k}-{v}", text) for v in ("4.0", "3.0") for k, name in _CREATIVE.items() for text in (f"Licensed under CC {k} {v}", f"Licensed under a Creative Commons {name} {v} {'International' if v == '4.0' else 'Unported'} License", f"SPDX-License-Identifier: CC-{k}-{v}")),
    *((license, f"SPDX-License-Identifier: {license}") for license in [*_NAMES, "LGPL-2.0", "0BSD"]),
]


def window_size(words: int) -> int:
    return 1 << (2 * max(words, 1) - 1).bit_length()


def bands(grams: int, size: int, threshold: float, recall: float) -> int:
    """Bands of one row by which a window of at most size words with threshold of a template's grams is retrieved with that probability."""
    least = threshold * grams / (grams + size - 1 - threshold * grams)
    return 1 if least >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-least)))


def _factors(k: int) -> np.ndarray:
    return np.random.RandomState(31).randint(1, 1 << 62, k).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Class:
    """Templates whose windows have the same size."""

    def __init__(self, size: int) -> None:
        self.size, self.templates = size, []

    def close(self, threshold: float, recall: float) -> None:
        self.bands = max(bands(len(g), self.size, threshold, recall) for _, g, _ in self.templates)
        self.factors = _factors(self.bands)
        self.index: dict[tuple[int, int], list[int]] = {}
        for t, (_, g, _) in enumerate(self.templates):
            for band, value in enumerate((g[:, None] * self.factors).min(0).tolist()):
                self.index.setdefault((band, value), []).append(t)
        self.lookup = Lookup(np.concatenate([a for _, _, a in self.templates]))

    def match(self, window: np.ndarray, threshold: float) -> Iterator[tuple[str, float]]:
        """(license, containment) of templates that the window's grams verify."""
        seen = set()
        for key in enumerate((window[:, None] * self.factors).min(0).tolist()):
            seen.update(self.index.get(key, ()))
        for t in seen:
            license, g, _ = self.templates[t]
            share = float(np.isin(g, window).sum()) / len(g)
            if share >= threshold:
                yield license, share


def index(templates: list[tuple[str, str]], n: int, threshold: float, recall: float) -> list[Class]:
    words, classes = Words(), {}
    for license, text in templates:
        hashes, lengths = pattern_words(text, words)
        if len(hashes) < n:
            raise ValueError(f"template of fewer than {n} words: {text!r}")
        grams, weights = row_grams(hashes, lengths, np.array([0, len(hashes)]), n)
        known, first = np.unique(grams[: len(grams) - n + 1], return_index=True)
        c = classes.setdefault(window_size(len(hashes)), Class(window_size(len(hashes))))
        c.templates.append((license, known, anchors(known, np.ones(len(known)), weights[first], threshold)))
    for c in classes.values():
        c.close(threshold, recall)
    return list(classes.values())


def families(classes: list[Class], threshold: float) -> dict[str, str]:
    """The least of each license's rivals, itself among them."""
    root = {license: license for c in classes for license, _, _ in c.templates}
    every = [(license, g) for c in classes for license, g, _ in c.templates]
    for x, g in every:
        for y, h in every:
            both = np.isin(g, h).sum()
            if both >= threshold * min(len(g), len(h)) and root[x] != root[y]:
                least, old = sorted((root[x], root[y]))
                root = {k: least if v == old else v for k, v in root.items()}
    return root


def _scan(classes: list[Class], n: int, threshold: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, every = Words(), Lookup(np.concatenate([c.lookup.known for c in classes]))
        for batch in batches:
            ids, (data, offsets), out = batch.column(0), column_bytes(batch.column(1)), []
            for lo, hi in slices(offsets):
                hashes, first, end, rows = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                grams, _ = row_grams(hashes, end - first, rows, n)
                hits = every(grams)
                for c in classes if len(hits) else ():
                    own = hits[c.lookup(grams[hits])]
                    row = np.searchsorted(rows, own, "right") - 1
                    half, at = c.size // 2, own - rows[row]
                    place = at // half * half
                    before = (place >= half) & (at + n <= place + half)
                    found = np.unique(np.concatenate([np.stack([row, place]), np.stack([row, place - half])[:, before]], axis=1), axis=1)
                    for r, s in found.T:
                        a, b = rows[r] + s, min(rows[r] + s + c.size, rows[r + 1])
                        out += [(ids[int(lo + r)].as_py(), x, int(s), float(v)) for x, v in c.match(grams[a : b - n + 1], threshold)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.float64()))], names=["doc_id", "license", "window_word", "containment"])

    return each


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, license, containment (6 digits), window_word: each license that a document holds, with its best window (the first of the best)."""
    classes = index(templates, n, threshold, recall)
    family = F.create_map(*[F.lit(x) for pair in families(classes, threshold).items() for x in pair])
    found = documents(docs).withColumn("text", F.lower("text")).mapInArrow(_scan(classes, n, threshold), "doc_id BIGINT, license STRING, window_word INT, containment DOUBLE")
    best = found.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("window_word")).alias("w"))).alias("m"))
    best = best.withColumn("top", F.max("m.containment").over(Window.partitionBy("doc_id", family[F.col("license")]))).where("m.containment = top")
    return best.select("doc_id", "license", F.round("m.containment", 6).alias("containment"), (-F.col("m.w")).alias("window_word"))
