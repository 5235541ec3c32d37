"""License scan: sparse TF-IDF cosine of notices to templates, then inheritance along directories.

Words are runs of ASCII letters, digits and non-ASCII bytes, in lower case. A template word weighs
its inverse document frequency, counted over all texts, plus its inverse frequency among the
licences, which still tells licences apart where one notice is in most texts. Which passages
are compared does not depend on frequencies: windows of the templates' lengths from every
template word, and stretches of template words at most ``GAP`` words apart, with and without
``FUNCTION_WORDS`` (a header, a footer, a whole licence file). A passage is compared with
each template by cosine, where a bound on the cosine from running sums reaches
``THRESHOLD``; words that no template has weigh as much as the median template word. The best
passage at ``THRESHOLD`` or more names the text's licence.

A licence file is a text named like one (LICENSE, LICENCE, COPYING, NOTICE, with any
extension) or one where the passage, or a stretch between content words that fits the same
licence, holds four fifths of its words or more. It licenses its
directory: a text without a licence of its own takes that of its nearest ancestor
directory that has one, its own directory first. Several files in a directory: the highest cosine,
then the first by path.

Cases: null and empty texts have no notice but inherit. A null path has no directory. Ties between
templates go to the first name. Repeated rows each get a result. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, pieces, text_bytes, token_bounds, token_hashes

# Notices and opening words of public licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
}
THRESHOLD = 0.7
GAP = 8
#: Licensed directories that are broadcast; more are joined by shuffle, the texts of a directory dealt over ``SALTS`` tasks.
BROADCAST_DIRS, SALTS = 100_000, 32
# Words too common in prose to bound a stretch of a notice.
FUNCTION_WORDS = frozenset("a an and any are as at by for from if in is it not of on or that the this to with you your".split())
# Words of passages compared at once.
_BLOCK = 1 << 16
#: Words over which running sums are held at once: 8 bytes a word and template.
_RANGE = 1 << 16
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[^/]*)?$"
_BETWEEN = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), text))


def _hash(words: list[str]) -> np.ndarray:
    data, off = text_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = token_bounds(data, off)
    return token_hashes(data, starts, ends)


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.names = [n for n in sorted(templates) for _ in templates[n]]
        bags = [Counter(_words(t)) for n in sorted(templates) for t in templates[n]]
        self.words = sorted(set().union(*bags))
        h = _hash(self.words)
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.tf = np.array([[b[w] for w in self.words] for b in bags], dtype=float)
        self.lengths = sorted({sum(b.values()) for b in bags})
        named = [set().union(*(b for b, m in zip(bags, self.names) if m == n)) for n in sorted(templates)]
        self.rare = np.log((1 + len(named)) / np.array([1 + sum(w in x for x in named) for w in self.words]))
        self.content = np.array([w not in FUNCTION_WORDS for w in self.words])

    def index(self, th: np.ndarray) -> np.ndarray:
        """Index of each hashed word among the template words, -1 for others."""
        at = np.minimum(np.searchsorted(self.hash, th), len(self.hash) - 1)
        return np.where(self.hash[at] == th, self.order[at], -1)

    def weigh(self, df: dict[int, int], n: int) -> None:
        count = np.array([df.get(i, 0) for i in range(len(self.words))])
        self.idf = np.log((1 + n) / (1 + count)) + self.rare + 1e-3
        self.other = float(np.median(self.idf))
        x = self.tf * self.idf
        self.unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def best(self, index: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest cosine of each passage index[begin:end] (template word indexes, -1 for others) and its template."""
        score, which = np.zeros(len(begin)), np.zeros(len(begin), np.int64)
        cost = np.cumsum(end - begin + len(self.words))
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + _BLOCK * 16, side="right")))
            size = end[i:j] - begin[i:j]
            row = np.repeat(np.arange(j - i), size)
            at = np.arange(len(row)) + np.repeat(begin[i:j] - np.cumsum(size) + size, size)
            width = len(self.words) + 1
            n = np.bincount(row * width + np.where(index[at] >= 0, index[at], width - 1), minlength=(j - i) * width).reshape(-1, width)
            x = n[:, :-1] * self.idf
            cos = x @ self.unit.T / np.sqrt((x * x).sum(axis=1) + n[:, -1] * self.other**2)[:, None]
            score[i:j], which[i:j] = cos.max(axis=1), cos.argmax(axis=1)
            i = j
        return score, which

    def passages(self, index: np.ndarray, tok_off: np.ndarray, threshold: float, gap: int) -> tuple[np.ndarray, ...]:
        """Document, begin, end, cosine and template of every passage at threshold or more, and whether it is a stretch between content words."""
        at = np.flatnonzero(index >= 0)
        doc = np.searchsorted(tok_off, at, side="right") - 1
        last = tok_off[doc + 1]
        out: list[list] = [[] for _ in range(len(self.lengths) + 2)]

        def keep(k: int, d: np.ndarray, a: np.ndarray, b: np.ndarray, norm: np.ndarray, dots: Iterable[np.ndarray], whole: bool) -> None:
            """Adds the passages a to b that fit, of those whose bound (norm and dots of each) allows it."""
            slack = 1e-12 * (1 + np.abs(norm).max(initial=0))
            least, may = threshold * np.sqrt(np.maximum(norm - slack, 0.0)) - slack, np.zeros(len(a), bool)
            for x in dots:
                may |= x >= least
            d, a, b = d[may], a[may], b[may]
            score, best = self.best(index, a, b)
            fits = score >= threshold
            out[k].append((d[fits], a[fits], b[fits], score[fits], best[fits], np.full(int(fits.sum()), whole)))

        # Passages of a template's length: sums run over the words of a block only.
        i = 0
        while i < len(at):
            j = max(i + 1, min(i + _BLOCK, int(np.searchsorted(at, at[i] + _RANGE))))
            lo, hi = int(at[i]), int(min(at[j - 1] + self.lengths[-1], len(index)))
            norm, dots = self._running(index[lo:hi])
            for k, n in enumerate(self.lengths):
                a1, b1 = at[i:j], np.minimum(at[i:j] + n, last[i:j])
                keep(k, doc[i:j], a1, b1, norm[b1 - lo] - norm[a1 - lo], (c[b1 - lo] - c[a1 - lo] for c in dots), False)
            i = j
        # Stretches, however long: sums are kept at their ends only.
        for k, (some, whole) in enumerate(((np.ones(len(at), bool), False), (self.content[index[at]], True)), len(self.lengths)):
            a, d = at[some], doc[some]
            if not len(a):
                continue
            cuts = np.flatnonzero((np.diff(a) > gap + 1) | (np.diff(d) > 0)) + 1
            first, final = np.r_[0, cuts], np.r_[cuts, len(a)] - 1
            d, a, b = d[first], a[first], a[final] + 1
            for i in range(0, len(a), _BLOCK):
                a1, b1 = a[i : i + _BLOCK], b[i : i + _BLOCK]
                norm, dots = self._sums(index, a1, b1)
                keep(k, d[i : i + _BLOCK], a1, b1, norm, dots, whole)
        found = [x for one in out for x in one]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(6))

    def _running(self, index: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Running sums over words, 0 first: of what bounds the norm, and of each template's products. With c times a word in a passage, c * c is at least c, so sums over the words bound the norm from below."""
        known = index >= 0
        w = np.where(known, self.idf[index], 0.0)
        norm = np.r_[0.0, np.cumsum(np.where(known, w * w, self.other**2))]
        return norm, [np.r_[0.0, np.cumsum(np.where(known, w * u[index], 0.0))] for u in self.unit]

    def _sums(self, index: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same sums over index[begin:end] of each passage, added up block by block of words; passages are disjoint and in order."""
        norm, dots = np.zeros(len(begin)), np.zeros((len(self.unit), len(begin)))
        for lo in range(int(begin[0]), int(end[-1]), _RANGE):
            hi = min(lo + _RANGE, int(end[-1]))
            i, j = int(np.searchsorted(end, lo, side="right")), int(np.searchsorted(begin, hi))
            if i < j:
                a, b = np.maximum(begin[i:j], lo) - lo, np.minimum(end[i:j], hi) - lo
                n, c = self._running(index[lo:hi])
                norm[i:j] += n[b] - n[a]
                for k, x in enumerate(c):
                    dots[k, i:j] += x[b] - x[a]
        return norm, dots


def _index(piece: pa.RecordBatch, t: Templates) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(piece.column(piece.schema.get_field_index("text")))
    starts, ends, tok_off = token_bounds(data, off, _BETWEEN)
    return t.index(token_hashes(data, starts, ends, lower=True)), tok_off


def detect(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, gap: int = GAP) -> DataFrame:
    """files: id, path, text. A row for each: id, path, license, score, first_word, n_words of the best passage (nulls without one), share (of the text's words in it, or in the longest stretch between content words that fits the same licence)."""
    t = Templates(templates)

    def count(batches):
        df, n = np.zeros(len(t.words), np.int64), 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                index, tok_off = _index(piece, t)
                doc = np.repeat(np.arange(piece.num_rows), np.diff(tok_off))
                seen = np.unique(doc[index >= 0] * len(t.words) + index[index >= 0])
                df += np.bincount(seen % len(t.words), minlength=len(t.words))
                n += piece.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(t.words)), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], names=["i", "n"])

    counts = {r[0]: r[1] for r in files.select("text").mapInArrow(count, "i int, n bigint").groupBy("i").agg(F.sum("n")).collect()}
    t.weigh(counts, counts.get(-1, 0))
    shared = files.sparkSession.sparkContext.broadcast(t)
    id_type = files.schema["id"].dataType.simpleString()

    def scan(batches):
        m = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                index, tok_off = _index(piece, m)
                found: list[tuple | None] = [None] * piece.num_rows
                doc, begin, end, score, k, whole = m.passages(index, tok_off, threshold, gap)
                # The best passage first: by cosine, then the earliest, then the shortest.
                order = np.lexsort((end, begin, -np.round(score, 12), doc))
                for i in order.tolist():
                    d, name, n = int(doc[i]), m.names[k[i]], int(end[i] - begin[i])
                    if found[d] is None:
                        found[d] = (name, min(1.0, float(score[i])), int(begin[i] - tok_off[d]), n, n)
                    elif whole[i] and found[d][0] == name and n > found[d][4]:
                        found[d] = (*found[d][:4], n)
                words = np.maximum(1, np.diff(tok_off))
                col = lambda i, kind: pa.array([f[i] if f else None for f in found], kind)
                share = pa.array([f[4] / int(w) if f else 0.0 for f, w in zip(found, words)], pa.float64())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), col(0, pa.string()), col(1, pa.float64()), col(2, pa.int64()), col(3, pa.int64()), share], names=["id", "path", "license", "score", "first_word", "n_words", "share"])

    return files.select("id", "path", "text").mapInArrow(scan, f"id {id_type}, path string, license string, score double, first_word bigint, n_words bigint, share double")


def inherit(found: DataFrame, file_share: float = 0.8) -> DataFrame:
    """found: as from detect. Adds effective_license and how: 'notice', 'file', 'inherited' or 'none', and license_dir of an inherited one."""
    is_file = F.col("license").isNotNull() & (F.col("path").rlike(LICENCE_FILE) | (F.col("share") >= file_share))
    found = found.withColumns({"__dir": F.regexp_replace("path", "/?[^/]*$", ""), "__file": F.coalesce(is_file, F.lit(False))})
    licensed = found.filter("__file and __dir is not null").groupBy("__dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("x"))
    licensed = licensed.select(F.col("__dir").alias("at"), F.col("x.license").alias("dir_license"))
    parts = F.split("__dir", "/")
    depths = F.when(F.col("__dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    dirs = found.select("__dir").filter("__dir is not null").distinct().select("__dir", parts.alias("p"), F.explode(depths).alias("depth"))
    dirs = dirs.select("__dir", "depth", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("at"))
    nearest = dirs.join(licensed, "at").groupBy("__dir").agg(F.max(F.struct("depth", "at", "dir_license")).alias("x"))
    nearest = nearest.select(F.col("__dir").alias("d2"), F.col("x.at").alias("license_dir"), F.col("x.dir_license").alias("dir_license"))
    nearest = materialize(nearest, "directories")
    if nearest.count() <= BROADCAST_DIRS:
        out = found.join(F.broadcast(nearest), F.col("__dir") == F.col("d2"), "left")
    else:
        nearest = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = found.withColumn("salt2", F.pmod(F.xxhash64("path", F.col("id").cast("string")), F.lit(SALTS)))
        out = salted.join(nearest, (F.col("__dir") == F.col("d2")) & (F.col("salt2") == F.col("salt")), "left")
    own = F.col("license").isNotNull()
    how = F.when(F.col("__file"), "file").when(own, "notice").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", "license", "score", "first_word", "n_words", F.coalesce("license", "dir_license").alias("effective_license"), how.alias("how"), F.when(~own, F.col("license_dir")).alias("license_dir"))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    return inherit(materialize(detect(files, templates, threshold), "licenses"))
