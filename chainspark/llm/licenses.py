"""License scans: MinHash bands over overlapping windows, then exact shingle containment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chainspark.llm.text import LOWER, Chunk, Ranges, _lut, chunks, map_arrow, mix, shingles

#: Words of a shingle.
K = 3
_BREAK = _lut(bytes(range(0, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 128)))

# Notices of public licenses, by SPDX name. The opening of the BSD licenses is common to all of them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    *((f"{short}-{v}.0", f"This work is licensed under the GNU {name}, version {v}.")
      for short, name, versions in (("GPL", "General Public License", (2, 3)), ("AGPL", "Affero General Public License", (3,)),
                                    ("LGPL", "Lesser General Public License", (3,))) for v in versions),
    *((f"{short}-{v}", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU "
                       f"{name} as published by the Free Software Foundation, either version {v} of the License, "
                       "or (at your option) any later version.")
      for short, what, name, v in (("GPL", "program", "General Public License", "2"), ("GPL", "program", "General Public License", "3"),
                                   ("AGPL", "program", "Affero General Public License", "3"), ("LGPL", "library", "Lesser General Public License", "2.1"),
                                   ("LGPL", "library", "Lesser General Public License", "3"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
             "alter it and redistribute it freely"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission"),
    *((f"CC-BY{short}-4.0", f"This work is licensed under a Creative Commons Attribution{name} 4.0 International License.")
      for short, name in (("", ""), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC", "-NonCommercial"),
                          ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))),
    *((f"CC-BY{short}-4.0", f"Licensed under CC BY{short} 4.0.") for short in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
]
#: SPDX writes these two without a minor version where it is zero in the notice.
_NAMES = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "AGPL-3": "AGPL-3.0", "LGPL-3": "LGPL-3.0"}
TEMPLATES = [(_NAMES.get(name, name), text) for name, text in TEMPLATES]
#: Templates of other licenses that hold this share of a template's shingles are near: what tells them apart is asked for.
NEAR = 0.5


def _words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = chunk.words(_BREAK)
    return Ranges(LOWER[chunk.data]).hash(starts, ends), bounds


class Templates:
    """Shingle sets of templates in size classes, and an index of their MinHash bands.

    A template of a class has at most ``step`` words, and more than half of that. Windows are two
    steps long and begin at every step, so some window holds any stretch of a step's length, and
    with it any template. A window with the share ``contained`` of a template's shingles has at
    least the Jaccard similarity ``worst`` with it; the number of bands, of one row each, makes the
    probability that they collide in some band at least ``sure``.
    """

    def __init__(self, templates: list[tuple[str, str]], contained: float, sure: float):
        self.names = [n for n, _ in templates]
        self.contained = contained
        column = pa.array([t for _, t in templates], pa.string())
        self.sets: list[np.ndarray] = []
        self.steps: list[int] = []
        for chunk in chunks(column):
            words, bounds = _words(chunk)
            values, first = shingles(words, bounds, K)
            for i in range(chunk.n):
                n = int(bounds[i + 1] - bounds[i])
                if n < K:
                    raise ValueError(f"a template needs {K} words or more")
                self.sets.append(np.unique(values[first[i]:first[i + 1]]))
                self.steps.append(max(8, 1 << (n - 1).bit_length()))
        # of each template, what near templates of other licenses don't hold
        self.marks = [[m for j, other in enumerate(self.sets) if self.names[j] != self.names[i]
                       and len(m := np.setdiff1d(own, other)) <= (1 - NEAR) * len(own)] for i, own in enumerate(self.sets)]
        worst = min((contained * len(s) / (2 * step + (1 - contained) * len(s))
                     for s, step in zip(self.sets, self.steps)), default=1.0)
        self.bands = max(1, math.ceil(math.log(1 - sure) / math.log(1 - worst))) if worst < 1 else 1
        self.seeds = mix(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.classes = {}
        for step in sorted(set(self.steps)):
            own = [i for i, s in enumerate(self.steps) if s == step]
            low = np.array([[mix(self.sets[i] ^ seed).min() for i in own] for seed in self.seeds], np.uint64)
            self.classes[step] = (np.array(own), low)

    def scan(self, chunk: Chunk) -> list[tuple[int, int, int, int, float]]:
        """(document, template, first word, words, containment) of all windows that hold a template."""
        words, bounds = _words(chunk)
        values, first = shingles(words, bounds, K)
        counts = np.diff(first)
        if not len(values):
            return []
        found: set[tuple[int, int, int]] = set()
        blocks = {}
        for step in self.classes:
            per = -(-counts // step)
            block_first = np.concatenate([[0], np.cumsum(per)])
            starts = (np.arange(block_first[-1]) - np.repeat(block_first[:-1], per)) * step + np.repeat(first[:-1], per)
            doc = np.repeat(np.arange(chunk.n), per)
            blocks[step] = (starts, doc, np.append(doc[1:] == doc[:-1], False))
        for band, seed in enumerate(self.seeds):
            hashed = mix(values ^ seed)
            for step, (own, low) in self.classes.items():
                starts, doc, paired = blocks[step]
                least = np.minimum.reduceat(hashed, starts)
                window = least.copy()
                window[:-1] = np.where(paired[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
                order = np.argsort(low[band], kind="stable")
                sorted_low = low[band][order]
                a = np.searchsorted(sorted_low, window, "left")
                b = np.searchsorted(sorted_low, window, "right")
                for w in np.flatnonzero(b > a):
                    for t in own[order[a[w]:b[w]]]:
                        found.add((step, int(w), int(t)))
        out = []
        for step, w, t in found:
            starts, doc, _ = blocks[step]
            d = int(doc[w])
            end = min(int(starts[w]) + 2 * step, int(first[d + 1]))
            held = values[int(starts[w]):end]
            share = float(np.isin(self.sets[t], held).mean())
            if share >= self.contained and all(np.isin(m, held).mean() >= self.contained for m in self.marks[t]):
                n_words = min(2 * step + K - 1, int(bounds[d + 1] - bounds[d]) - (int(starts[w]) - int(first[d])))
                out.append((d, t, int(starts[w] - first[d]), n_words, share))
        return sorted(out)


def license_windows(docs: DataFrame, templates: list[tuple[str, str]] | None = None, contained: float = 0.8,
                    sure: float = 0.999) -> DataFrame:
    """Licenses named in every document (doc_id, text): doc_id, n_words, licenses, found.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased, of the whole
    text. ``templates`` are (name, notice) pairs, a bounded parameter; a notice is present where a
    window holds at least the share ``contained`` of its 3-word shingles, and that share of those that tell it
    from each near notice of another license (version, clause). ``licenses`` are the sorted names; ``found`` has the name, first word, words and containment of the best windows.
    Windows cover every word; a candidate window is missed with probability 1 - ``sure`` at most.

    Null and empty texts, and texts of fewer than 3 words, name nothing. Null ids and repeated rows
    are scanned like all others; an empty table gives an empty table; other columns are not read.
    """
    chosen = list(TEMPLATES if templates is None else templates)
    span = pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()),
                      ("containment", pa.float64())])
    kept: dict[str, Templates] = {}

    def run(batch):
        if "t" not in kept:
            kept["t"] = Templates(chosen, contained, sure)
        index = kept["t"]
        for chunk in chunks(batch.column("text")):
            best: list[dict] = [{} for _ in range(chunk.n)]
            for d, t, at, n, share in index.scan(chunk):
                # of overlapping windows with the same notice the one that holds most, the first of equal ones
                key = (index.names[t], t)
                rows = best[d].setdefault(key, [])
                if rows and at < rows[-1][0] + rows[-1][1]:
                    if share > rows[-1][2]:
                        rows[-1] = (at, n, share)
                else:
                    rows.append((at, n, share))
            found = [sorted(({"license": key[0], "first_word": at, "words": n, "containment": share}
                             for key, rows in b.items() for at, n, share in rows),
                            key=lambda r: (r["first_word"], r["license"])) for b in best]
            _, _, bounds = chunk.words(_BREAK)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first_row, chunk.n), pa.array(np.diff(bounds).astype(np.int64)),
                 pa.array([sorted({r["license"] for r in f}) for f in found], pa.list_(pa.string())),
                 pa.array(found, pa.list_(span))], ["doc_id", "n_words", "licenses", "found"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words bigint, licenses array<string>, "
                     "found array<struct<license:string,first_word:bigint,words:bigint,containment:double>>")
