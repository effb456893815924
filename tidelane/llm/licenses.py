"""License scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines without a blank one between. Each line, and each paragraph of several lines, is scored whole if it has up to
``WINDOW`` words, else in windows of so many, one every ``STRIDE``; so a notice broken over lines, or inside a long line, is scored by itself.
Multinomial logistic regression on hashed word uni-, bi- and trigrams gives each window probabilities of licence families, of other
licences (``unknown``) and of none. A family is confirmed by a template, if the two have enough word uni- and bigrams in common of the
template's (or of the window's, if it has fewer): by number, and by weight, where what few families say weighs more and numbers next to nothing -
"Licensed under the" is like many templates, and it is the name that decides; and if the family is likely enough beside the likeliest other class of licences.
What names a licence but isn't confirmed is reported as unconfirmed ``unknown``. Of overlapping findings that with most in common stays.

Positives are the templates below and variants of them, with names, years and versions exchanged, words dropped and the sentence embedded in
invented words; the class of other licences has notices of some, and sentences about licences of invented names. Negatives are all windows of ``WINDOW`` words, end to end, of all lines
of all documents, but for lines with a word of licences and windows that a template confirms; and prose that speaks of licences and grants none, which has ``PROSE`` of their weight.

N-grams that two or more of the built-in texts have are features; others have no weight, but count in a window's length. So a window is its few features, and
all windows are stored as such (once, repeated ones too). Each step of the descent is by the gradient over all of them: tasks add up theirs in fixed point, so sums don't depend on partitions,
and the driver receives one gradient, whose size is that of the model.

Calibration: a family's least share beside the class of other licences is the least that at most ``FALSE_SHARE`` of held-out other licences reach, within 0.3 and 0.8. On
all negative windows, counted by their scores to 1 / ``BINS``, and on held-out prose about licences, the thresholds are the least probabilities that at most ``FALSE_SHARE``
(for what a template confirms; within 0.5 and 0.6) and ``FALSE_UNKNOWN`` (for the unknown class) of them reach, counted with one false one more than seen. All
documents, whole, are scanned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import textops
from tidelane.storage import materialize

# Well-known licence notices, by family.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Available under the CC BY 3.0 license."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Shared under the CC BY-NC-SA 4.0 license."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under the Creative Commons Zero waiver."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL v2.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU GPL, version 2 or later."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Licensed under the MIT license.", "This project is available under the MIT license."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. Do not distribute.", "Copyright 2020 Example Corporation. All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released into the public domain under the Unlicense."],
}
# Notices of other licences, the names of which aren't told apart.
OTHERS = [
    "Licensed under the EUPL, Version 1.2 or later.",
    "Licensed under the European Union Public Licence",
    "This package is licensed under the Artistic License 2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Released under the ISC License.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Licensed under the zlib license.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: EPL-2.0",
]
_OTHER_FRAMES = [
    "Licensed under the {} License, Version {}.0.", "Released under the {} License.", "Licensed under the {}, version {} or later.", "This work is licensed under the {} License.", "Distributed under the {} license.", "SPDX-License-Identifier: {}-{}.0", "This program is available under the terms of the {} Public License, version {}",
    "{} License {}.0", "This project is available under the {} license.", "You may use this software under the {} Licence.", "This file is governed by the {} Software License.", "Available under the {} {}.0 license.",
]
_LEADS = ["", "The code is", "This file", "Source code of the project, ", "Copyright (c) 2019 the authors.", "Note:", "* ", "# ", "// "]
_TAILS = ["", "See the LICENSE file for details.", "All contributions are welcome.", "http://example.org/"]

#: Prose about licences that grants nothing, to learn from; {} is the name of one.
ABOUT = [
    "The committee discussed whether the {} was suitable for a project of that size.",
    "A lawyer explained what the {} means and why companies avoid it.",
    "In his talk he compared the {} with other licenses and their history.",
    "Many developers have never read the {} from beginning to end.",
    "Does the {} allow commercial use? That question comes up every week.",
    "She wrote a long article on the origins of the {} and of free software.",
    "Until last year the library was under the {}, but nobody knows what it will be next.",
    "The court had to decide whether the {} is a contract or a bare promise.",
    "Choosing between the {} and something simpler took the team a month.",
    "Version two of the {} was published long before the web became common.",
    "His driving license and her fishing license expired in the same week.",
    "The city council granted a license to sell drinks to three new restaurants.",
    "Copyright law differs between countries and changes slowly.",
    "Permission to build the house was granted after a long dispute with the neighbours.",
    "The right to copy was reserved to the king, and all printers knew it.",
    "The public domain is a subject that historians of law like to argue about.",
    "Software that you can redistribute freely was a new idea at the time.",
    "Without warranty of any kind, the old car was sold for a few hundred.",
    "They talked about open source, about {} and about money.",
    "Nobody at the meeting had heard of the {} before.",
]
_SPOKEN = ["MIT License", "GPL", "Apache License", "BSD license", "GNU General Public License", "Mozilla Public License", "Creative Commons licenses", "LGPL", "Affero GPL", "Unlicense", "CC BY license", "zlib license", "Eclipse Public License", "EUPL"]

NONE, UNKNOWN = "none", "unknown"
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SHORT = 6  # counts as so many more n-grams, so that a few words are little evidence
WINDOW, STRIDE = 32, 8
VARIANTS, OTHER_ROWS = 24, 400
INVENTED, PROSE = 2000, 0.4
STEPS, RATE = 30, 0.7
FEW_PAIRS = 3  # bigrams of one family alone from which a window is compared with templates before it is a negative
BINS, UNIT = 1 << 16, 1 << 24  # of score counts; of sums in fixed point
BLOCK, SLABS = 1 << 14, 16  # windows of a stored block; parts of a gradient
FALSE_SHARE, FALSE_UNKNOWN = 0.01, 0.0002
CONFIRM, FEW = 0.6, 5  # share of n-grams in common of a confirmed family; fewer n-grams count as FEW
NAMED, FEW_NAMED, NUMBER = 0.55, 1.5, 0.05  # the same by weight; a number's weight
CHUNK_BYTES = 1 << 19
FINDING = "paragraph int, start long, end long, family string, probability double, similarity double, confirmed boolean"
_KINDS = pa.struct([("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])


def _grams(hashes: np.ndarray, line: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, 64-bit n-grams) of each order, of words in the same line."""
    out, held = [(np.arange(len(hashes)), hashes)], hashes
    for k in (1, 2):
        n = max(0, len(hashes) - k)
        held = textops.mix64(held[:n] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        own = np.flatnonzero(line[:n] == line[k:])
        out.append((own, held[own]))
    return out


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (textops.mix64(grams) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _cuts(head: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the runs of words that begin at ``head``, of ``n`` words in all."""
    size = np.diff(head, append=n)
    k = np.where(size <= WINDOW, 1, -(-(size - WINDOW) // STRIDE) + 1)
    run = np.repeat(np.arange(len(head)), k)
    step = np.arange(len(run)) - np.repeat(np.cumsum(k) - k, k)
    begin = head[run] + np.minimum(step * STRIDE, np.maximum(0, size[run] - WINDOW))
    return begin, begin + np.minimum(size[run], WINDOW)


def _windows(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of windows in words, ascending, and the text row and the paragraph of each word."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(starts)
    base = int(starts[0])
    feeds = np.cumsum(data[base : int(starts[-1]) + 1] == 10)[starts - base]
    new = np.diff(row, prepend=-1) != 0
    lines = np.flatnonzero(new | (np.diff(feeds, prepend=-1) != 0))
    edge = new | (np.diff(feeds, prepend=-2) > 1)
    paragraphs = np.flatnonzero(edge)
    several = np.diff(np.searchsorted(lines, np.append(paragraphs, n))) > 1
    begin, end = _cuts(lines, n)
    more, till = _cuts(paragraphs, n)
    own = several[np.searchsorted(paragraphs, more, "right") - 1]
    both = np.unique(np.append(begin, more[own]) * (n + 1) + np.append(end, till[own]))
    return both // (n + 1), both % (n + 1), row, np.cumsum(edge) - 1


def _vectors(texts: list[str]) -> list[np.ndarray]:
    """Buckets of each single paragraph."""
    data, offsets = textops.utf8(pa.array(texts, pa.string()))
    hashes, _, _, first = textops.words(data, offsets, textops.NOT_ALNUM)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    parts = _grams(hashes, row)
    at = np.concatenate([row[p] for p, _ in parts])
    bucket = np.concatenate([_bucket(g) for _, g in parts])
    order = np.argsort(at, kind="stable")
    return np.split(bucket[order], np.searchsorted(at[order], np.arange(1, len(texts))))


@dataclass
class Model:
    families: list[str]  # the last two are UNKNOWN and NONE
    weights: np.ndarray  # buckets x families
    bias: np.ndarray
    least: float  # probability of not being NONE from which a window is compared with templates
    unsure: float  # and from which it is reported though it resembles none
    templates: list[tuple[int, np.ndarray]]  # family and distinct word uni- and bigrams
    numbers: np.ndarray  # of these n-grams those with a number
    margin: float = 0.5  # what a family's probability must be of its own and UNKNOWN's
    strange: float = 0.5  # probability of UNKNOWN from which a window is reported as such
    seen: int = 0  # windows of the documents that it learnt from

    def __post_init__(self):
        sizes = [len(g) for _, g in self.templates]
        grams = np.concatenate([g for _, g in self.templates])
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner = grams[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        self.sizes, self.kinds = np.array(sizes), np.array([k for k, _ in self.templates])
        pairs = np.unique(np.stack([self.grams, self.kinds[self.owner].astype(np.uint64)]), axis=1)
        said, by = np.unique(pairs[0], return_counts=True)  # how many families say it
        self.weight = 1 / by[np.searchsorted(said, self.grams)]
        self.weight[np.isin(self.grams, self.numbers)] = NUMBER
        self.heavy = np.bincount(self.owner, self.weight, len(sizes))

    def closest(self, hashes: np.ndarray, p: np.ndarray) -> tuple[float, float, int, int]:
        """Share by number and by weight, n-grams in common and family of the closest template: of those with a share of CONFIRM that of most weight in common, else that of the greatest share; ties to the likelier family."""
        own = _template_grams(hashes)
        i, j = np.searchsorted(self.grams, own), np.searchsorted(self.grams, own, "right")
        at = np.arange((j - i).sum()) + np.repeat(i - (np.cumsum(j - i) - (j - i)), j - i)
        common, heavy = np.bincount(self.owner[at], minlength=len(self.sizes)), np.bincount(self.owner[at], self.weight[at], len(self.sizes))
        share = common / np.maximum(np.minimum(self.sizes, len(own)), FEW)
        whole = (i == j).sum() + self.weight[i[i < j]].sum()  # what no template says weighs most
        named = heavy / np.maximum(np.minimum(self.heavy, whole), FEW_NAMED)
        fit = (share >= CONFIRM) & (named >= NAMED)
        k = int(np.lexsort((p[self.kinds], common, share, np.where(fit, heavy, 0), fit))[-1])
        return float(share[k]), float(named[k]), int(common[k]), int(self.kinds[k])

    def beside_others(self, p: np.ndarray, family: int) -> float:
        """The probability of ``family`` as a share of its own and that of other licences."""
        return float(p[family]) / max(float(p[family] + p[-2]), 1e-12)

    def names(self, p: np.ndarray, alike: float) -> bool:
        """Whether a window that no template confirms names a licence: it is likely to, more so to name another one, or has the words of a notice without a known name."""
        return bool(1 - p[-1] >= self.unsure or p[-2] >= self.strange or alike >= CONFIRM and 1 - p[-1] >= self.least and p[-2] >= self.strange / 2)

    def of_distinct(self, hashes: np.ndarray) -> np.ndarray:
        """Probabilities of a window by its distinct n-grams, so that a word said over and over is little evidence."""
        buckets = np.unique(np.concatenate([_bucket(g) for _, g in _grams(hashes, np.zeros(len(hashes), np.int64))]))
        return _softmax(self.bias + self.weights[buckets].sum(axis=0) / np.sqrt(len(buckets) + SHORT))

    def probabilities(self, hashes: np.ndarray, part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each window [begin, end) of words; n-grams don't cross parts."""
        sums, count = np.zeros((len(begin), len(self.families))), np.zeros(len(begin))
        for k, (own, grams) in enumerate(_grams(hashes, part)):
            at = np.zeros((len(own) + 1, len(self.families)))
            np.cumsum(self.weights[_bucket(grams)], axis=0, out=at[1:])
            i, j = np.searchsorted(own, begin), np.searchsorted(own, np.maximum(begin, end - k))
            sums += at[j] - at[i]
            count += j - i
        return _softmax(self.bias + sums / np.sqrt(count + SHORT)[:, None])

    def scan(self, column: pa.Array):
        """(row, findings) of each row with any."""
        data, offsets = textops.utf8(column)
        for a, b in textops.chunks(offsets, CHUNK_BYTES):
            hashes, starts, ends, first = textops.words(data, offsets[a : b + 1], textops.NOT_ALNUM)
            if not len(hashes):
                continue
            begin, end, row, part = _windows(data, starts, first)
            p = self.probabilities(hashes, part, begin, end)
            found: dict[int, list] = {}
            for k in np.flatnonzero((1 - p[:, -1] >= self.least) | (p[:, -2] >= self.strange)).tolist():
                i, j = int(begin[k]), int(end[k])
                alike, named, common, family = self.closest(hashes[i:j], p[k])
                sure = alike >= CONFIRM and named >= NAMED and self.beside_others(p[k], family) >= self.margin
                if sure or self.names(p[k], alike) and self.names(self.of_distinct(hashes[i:j]), alike):
                    found.setdefault(int(row[i]), []).append((sure, common, alike, float(p[k, family] if sure else 1 - p[k, -1]), i - j, -i, family))
            for r, own in found.items():
                chosen: list = []
                for x in sorted(own, reverse=True):
                    i, j = -x[5], -x[5] - x[4]
                    if all(j <= y[0] or i >= y[1] for y in chosen):
                        chosen.append((i, j, x))
                base, out = int(offsets[a + r]), []
                for i, j, (sure, _, alike, probability, _, _, family) in sorted(chosen):
                    number = int((data[base : int(starts[i])] == 10).sum())
                    x, y = (len(data[base:z].tobytes().decode()) for z in (int(starts[i]), int(ends[j - 1])))
                    out.append({"paragraph": number, "start": x, "end": y, "family": self.families[family] if sure else UNKNOWN, "probability": probability, "similarity": alike, "confirmed": bool(sure)})
                yield a + r, out


def _template_grams(hashes: np.ndarray) -> np.ndarray:
    parts = _grams(hashes, np.zeros(len(hashes), np.int64))
    return np.unique(np.concatenate([parts[0][1], parts[1][1]]))


def _told(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word uni- and bigrams of a text, and those of them with a number."""
    data, offsets = textops.utf8(pa.array([text]))
    hashes, starts, ends, _ = textops.words(data, offsets, textops.NOT_ALNUM)
    number = np.array([data[a:b].tobytes().isdigit() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], bool)
    parts = _grams(hashes, np.zeros(len(hashes), np.int64))
    return _template_grams(hashes), np.concatenate([hashes[number], parts[1][1][(number[:-1] | number[1:])]])


def _confident(model: Model, text: str):
    """How sure the family is that templates would confirm in a text, if any."""
    hashes = textops.words(*textops.utf8(pa.array([text])), textops.NOT_ALNUM)[0]
    p = _probabilities(model, [text])[0]
    alike, named, _, family = model.closest(hashes, p)
    if alike >= CONFIRM and named >= NAMED:
        yield model.beside_others(p, family)


def variants(rng: np.random.Generator, text: str, fill: list[str]) -> str:
    """A template with a word dropped, a number changed, and words around it, now and then."""
    words = text.split(" ")
    if len(words) > 6 and rng.random() < 0.3:
        words.pop(int(rng.integers(len(words))))
    words = [str(rng.integers(1, 5)) if w.strip(".,").isdigit() and rng.random() < 0.3 else w for w in words]
    lead, tail = _LEADS[rng.integers(len(_LEADS))], _TAILS[rng.integers(len(_TAILS))]
    around = [" ".join(fill[i] for i in rng.integers(0, len(fill), int(rng.integers(0, 12)))) if fill and rng.random() < 0.4 else "" for _ in range(2)]
    return " ".join(x for x in (around[0], lead, " ".join(words), tail, around[1]) if x)


def _other(rng: np.random.Generator, number: int, fill: list[str]) -> str:
    """A notice of a licence that no template has: a known one, or one of an invented name."""
    if number % 3 == 0:
        return variants(rng, OTHERS[number // 3 % len(OTHERS)], fill)
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = " ".join("".join(letters[i] for i in rng.integers(0, 26, int(rng.integers(3, 9)))) for _ in range(int(rng.integers(1, 3))))
    if fill and rng.random() < 0.5:
        name = fill[rng.integers(len(fill))]
    return variants(rng, _OTHER_FRAMES[number % len(_OTHER_FRAMES)].format(name.title(), int(rng.integers(1, 5))), fill)


def _about(rng: np.random.Generator, sentence: str, fill: list[str]) -> str:
    around = [" ".join(fill[i] for i in rng.integers(0, len(fill), int(rng.integers(0, 8)))) if fill and rng.random() < 0.5 else "" for _ in range(2)]
    return " ".join(x for x in (around[0], sentence.format(_SPOKEN[rng.integers(len(_SPOKEN))]), around[1]) if x)


def _share(scores: np.ndarray, share: float) -> float:
    """The least threshold that at most ``share`` of the scores reach, counted with one more than do; just over all of them if there are too few to tell."""
    some = np.sort(scores)[::-1]
    n = int(share * (len(some) + 1)) - 1
    return float(np.nextafter(some[n], 2)) if 0 <= n < len(some) else float(np.nextafter(some[0], 2)) if len(some) else 0.5


def _counted_share(counts: np.ndarray, share: float) -> float:
    """_share of scores that are counted in equal bins of 0 to 1: the least bound of a bin."""
    down, total = np.cumsum(counts[::-1]), int(counts.sum())
    most = max(1, int(share * (total + 1)))
    return 1 - int(np.searchsorted(down, most)) / len(counts) if total else 0.5


def _invented(rng: np.random.Generator) -> list[str]:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ["".join(letters[i] for i in rng.integers(0, 26, int(rng.integers(2, 10)))) for _ in range(INVENTED)]


class Builtin:
    """The built-in texts, by class, their features, and what is held apart of them."""

    def __init__(self, templates: dict[str, list[str]] | None = None, seed: int = 11):
        self.templates = templates or TEMPLATES
        rng = np.random.default_rng(seed)
        self.families = [*sorted(self.templates), UNKNOWN, NONE]
        fill = _invented(rng)
        texts, target = [], []
        for k, family in enumerate(self.families[:-2]):
            for t in self.templates[family]:
                made = [t, *(variants(rng, t, fill) for _ in range(VARIANTS))]
                texts += made
                target += [k] * len(made)
        others = [_other(rng, i, fill) for i in range(OTHER_ROWS)]
        self.apart, others = others[::4], [t for i, t in enumerate(others) if i % 4]
        prose = [_about(rng, t, fill) for i, t in enumerate(ABOUT) if i % 4 for _ in range(20)]
        self.spoken = [_about(rng, t, fill) for t in ABOUT[::4] for _ in range(20)]
        texts += others + prose
        self.target = np.array(target + [len(self.families) - 2] * len(others) + [len(self.families) - 1] * len(prose))
        vectors = _vectors(texts)
        said = np.bincount(np.concatenate([np.unique(v) for v in vectors]), minlength=BUCKETS)
        said[np.concatenate(_vectors(fill))] = 0
        self.used = np.flatnonzero(said > 1)
        self.feature = np.zeros(BUCKETS, np.uint16)  # of each bucket; 0, without a weight, if none
        self.feature[self.used] = np.arange(1, len(self.used) + 1)
        own = [self.feature[v] for v in vectors]
        known = [f[f > 0] for f in own]
        self.rows = np.concatenate(known), np.array([len(f) for f in known]), np.array([(f == 0).sum() for f in own])

    def model(self, w: np.ndarray, b: np.ndarray) -> Model:
        weights = np.zeros((BUCKETS, len(w)), np.float32)
        weights[self.used] = w[:, 1:].T
        known = [(k, t) for k, family in enumerate(self.families[:-2]) for t in self.templates[family]]
        made = [_told(t) for _, t in known]
        return Model(self.families, weights, b.ravel(), 0.5, 0.5, [(k, g) for (k, _), (g, _) in zip(known, made, strict=True)], np.unique(np.concatenate([n for _, n in made])))


def _likely(w: np.ndarray, b: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, a class in each line, and the weight of an n-gram of windows: their features one after another, how many each has, and its other n-grams."""
    features, hits, rest = rows
    value = 1 / np.sqrt(hits + rest + SHORT)
    some = np.flatnonzero(hits)
    head = (np.cumsum(hits) - hits)[some]
    score = np.zeros((len(w), len(hits)))
    for own, x in zip(score, w, strict=True):
        if len(some):
            own[some] += np.add.reduceat(x[features], head, dtype=np.float64)
    score = score * value + b
    p = np.exp(score - score.max(axis=0))
    return p / p.sum(axis=0), value


def _gradient(pull: np.ndarray, value: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, whole: bool = False) -> np.ndarray:
    """Sums by class of ``pull`` for each of ``n`` features, and for the bias behind them; ``whole`` rounds each window's part, so that sums are exact."""
    features, hits, _ = rows
    out = np.zeros((len(pull), n + 1))
    at = np.repeat(np.arange(len(hits)), hits)
    part = np.rint(pull * value) if whole else pull * value
    for own, x in zip(out, part, strict=True):
        own[:n] = np.bincount(features, x[at], n)
    out[:, n] = (np.rint(pull) if whole else pull).sum(axis=1)
    return out


def descend(built: Builtin, windows: int, whole, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights, by class and feature, and biases; ``whole(w, b)`` sums the gradient over all ``windows``."""
    k, n = len(built.families), len(built.used) + 1
    size = np.bincount(built.target, minlength=k)
    share = np.ones(k)
    share[-1] = PROSE if windows else 1
    weight = (share / size / k)[built.target]
    w, b = np.zeros((k, n), np.float32), np.zeros((k, 1))
    grad2, bias2 = np.full(w.shape, 1e-6), np.full(b.shape, 1e-6)
    hot = np.eye(k)[:, built.target]
    for _ in range(steps):
        p, value = _likely(w, b, built.rows)
        g = _gradient((p - hot) * weight, value, built.rows, n)
        if windows:
            g += whole(w, b) * ((1 - PROSE) / windows / k)
        own = g[:, :n] + 1e-5 * w
        grad2 += own**2
        w -= (RATE * own / np.sqrt(grad2)).astype(np.float32)
        bias2 += g[:, n:] ** 2
        b -= RATE * g[:, n:] / np.sqrt(bias2)
    return w, b


def calibrate(model: Model, built: Builtin, plain: np.ndarray, strange: np.ndarray) -> None:
    """Sets the thresholds of a model, by counts of all windows' probabilities of naming a licence, and an other one."""
    model.margin = min(0.8, max(0.3, _share(np.array([x for t in built.apart for x in _confident(model, t)]), FALSE_SHARE)))
    p = _probabilities(model, built.spoken)
    model.strange = min(0.9, max(0.3, _counted_share(strange, FALSE_UNKNOWN), _share(p[:, -2], FALSE_SHARE)))
    model.least = min(0.6, max(0.5, _counted_share(plain, FALSE_SHARE)))
    model.unsure = min(0.999, max(0.5, model.least, _counted_share(plain, FALSE_UNKNOWN), _share(1 - p[:, -1], FALSE_SHARE)))


def _softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _probabilities(model: Model, texts: list[str]) -> np.ndarray:
    """Of each text as one window, by all of its n-grams."""
    out = [np.zeros((0, len(model.families)))]
    for a in range(0, len(texts), 1024):
        own = _vectors(texts[a : a + 1024])
        n = np.array([len(v) for v in own])
        sums = np.zeros((len(own), len(model.families)))
        if n.any():
            sums[n > 0] = np.add.reduceat(model.weights[np.concatenate(own)], (np.cumsum(n) - n)[n > 0], axis=0)
        out.append(_softmax(model.bias + sums / np.sqrt(n + SHORT)[:, None]))
    return np.concatenate(out)


_NAMES = r"(?i)licen[sc]e|copyright|spdx|\bgpl\b|\bcc by\b|public domain|all rights reserved"
_BLOCK = pa.schema([("windows", pa.int64()), ("features", pa.binary()), ("hits", pa.binary()), ("rest", pa.binary())])


def _line_windows(column: pa.Array, pieces: int = BLOCK * WINDOW):
    """Word hashes, and the window of each word, of lines without a word of licences; ``pieces`` words at most at once."""
    lines = pc.list_flatten(pc.split_pattern(column.cast(pa.large_string()).drop_null(), "\n"))
    lines = lines.filter(pc.invert(pc.match_substring_regex(lines, _NAMES)))
    data, offsets = textops.utf8(lines)
    for a, b in textops.chunks(offsets, 4 * CHUNK_BYTES):
        hashes, _, _, first = textops.words(data, offsets[a : b + 1], textops.NOT_ALNUM)
        size = np.diff(first)
        n = -(-size // WINDOW)
        begin = np.repeat(first[:-1], n) + WINDOW * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        cut = np.append(begin, len(hashes))
        for i in range(0, len(begin), pieces // WINDOW):
            own = cut[i : i + pieces // WINDOW + 1]
            yield hashes[own[0] : own[-1]], np.repeat(np.arange(len(own) - 1), np.diff(own))


def _features(shared):
    """Blocks of windows as features, as _likely takes them; ``shared``, broadcast: features of buckets, and a model for its templates."""

    def blocks(hashes, window):
        feature, model, pairs = shared.value
        n = int(window[-1]) + 1
        parts = _grams(hashes, window)
        at, own = np.concatenate([window[p] for p, _ in parts]), [_bucket(g) for _, g in parts]
        near = np.bincount(window[parts[1][0]], pairs[own[1]], n)
        kept = np.ones(n, bool)
        cut = np.searchsorted(window, np.arange(n + 1))
        even = np.zeros(len(model.families))
        for k in np.flatnonzero(near >= FEW_PAIRS).tolist():
            alike, named, _, _ = model.closest(hashes[cut[k] : cut[k + 1]], even)
            kept[k] = alike < CONFIRM or named < NAMED
        own = feature[np.concatenate(own)]
        order = np.argsort(at, kind="stable")
        at, own = at[order], own[order]
        known = (own > 0) & kept[at]
        hits = np.bincount(at[known], minlength=n)
        rest = np.bincount(at, minlength=n) - hits
        if kept.any():
            yield int(kept.sum()), own[known].astype("<u2").tobytes(), hits[kept].astype("u1").tobytes(), rest[kept].astype("u1").tobytes()

    def run(batches):
        for batch in batches:
            for hashes, window in _line_windows(batch.column(0)):
                for block in blocks(hashes, window):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(block, _BLOCK, strict=True)], schema=_BLOCK)

    return run


def _stored(batch: pa.RecordBatch):
    for features, hits, rest in zip(*(batch.column(c).to_pylist() for c in ("features", "hits", "rest")), strict=True):
        yield np.frombuffer(features, "<u2"), np.frombuffer(hits, "u1").astype(np.int64), np.frombuffer(rest, "u1").astype(np.int64)


def _add_up(measure):
    """Adds up arrays of int64, one for each block, in a task; they leave it in slabs."""

    def run(batches):
        total = None
        for batch in batches:
            for rows in _stored(batch):
                own = measure(rows)
                total = own if total is None else total + own
        if total is not None:
            for k, part in enumerate(np.array_split(total, SLABS)):
                yield pa.RecordBatch.from_pydict({"slab": pa.array([k], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})

    return run


def _add_slabs(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(x, np.int64)
            total[k] = total[k] + own if k in total else own
    for k, x in total.items():
        yield pa.RecordBatch.from_pydict({"slab": pa.array([k], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})


def total(blocks: DataFrame, measure) -> np.ndarray:
    """The sum over all blocks of the int64 arrays that ``measure`` makes of them."""
    parts = blocks.mapInArrow(_add_up(measure), "slab int, sums binary").repartition(SLABS, "slab").mapInArrow(_add_slabs, "slab int, sums binary")
    return np.concatenate([np.frombuffer(r["sums"], np.int64) for r in sorted(parts.collect(), key=lambda r: r["slab"])])


def _template_pairs(templates: dict[str, list[str]]) -> np.ndarray:
    """The buckets of word bigrams that the templates of one family alone have."""
    by = np.zeros(BUCKETS, np.int64)
    for own in templates.values():
        hashes = [textops.words(*textops.utf8(pa.array([t])), textops.NOT_ALNUM)[0] for t in own]
        by[np.unique(np.concatenate([_bucket(_grams(h, np.zeros(len(h), np.int64))[1][1]) for h in hashes]))] += 1
    return by == 1


def windows(docs: DataFrame, built: Builtin) -> DataFrame:
    """Blocks of all negative windows of ``docs`` (text), stored."""
    model = built.model(np.zeros((len(built.families), len(built.used) + 1), np.float32), np.zeros(len(built.families)))
    model.weights = model.weights[:0]
    shared = docs.sparkSession.sparkContext.broadcast((built.feature, model, _template_pairs(built.templates)))
    made = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(_features(shared), "windows long, features binary, hits binary, rest binary")
    return materialize(made, "license-windows")


def whole_gradient(blocks: DataFrame, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The gradient of all windows' log loss as no licence, by class and feature, with the bias behind."""
    shared = blocks.sparkSession.sparkContext.broadcast((w, b))

    def measure(rows):
        w, b = shared.value
        p, value = _likely(w, b, rows)
        p[-1] -= 1
        return _gradient(p * UNIT, value, rows, w.shape[1], True).astype(np.int64).ravel()

    found = total(blocks, measure)
    shared.unpersist()
    return found.reshape(len(w), -1) / UNIT


def score_counts(blocks: DataFrame, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many windows have which probability of naming a licence, and which of an other licence, in BINS equal bins."""
    shared = blocks.sparkSession.sparkContext.broadcast((w, b))

    def measure(rows):
        p, _ = _likely(*shared.value, rows)
        at = [np.minimum((x * BINS).astype(np.int64), BINS - 1) for x in (1 - p[-1], p[-2])]
        return np.concatenate([np.bincount(x, minlength=BINS) for x in at]).astype(np.int64)

    found = total(blocks, measure)
    return found[:BINS], found[BINS:]


def train(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> Model:
    """A model whose negatives are all windows of ``docs`` (text) that name no licence."""
    built = Builtin(templates)
    blocks = windows(docs, built)
    seen = int(blocks.agg(F.sum("windows")).first()[0] or 0)
    w, b = descend(built, seen, lambda w, b: whole_gradient(blocks, w, b))
    model = built.model(w, b)
    model.seen = seen
    calibrate(model, built, *(score_counts(blocks, w, b) if seen else (np.zeros(BINS, np.int64),) * 2))
    return model


def _scan(model, text: int = 1):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for row, found in model.value.scan(batch.column(text)):
                out[row] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_KINDS))], names=["doc_id", "found"])

    return run


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each window of ``docs`` (doc_id, text) in which a licence is found: doc_id and FINDING.

    paragraph counts line feeds before it; start and end bound its words, in characters. Null and empty texts have none; repeated rows are
    each scanned; a null doc_id stays null. Empty tables give empty results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "struct<" + ",".join(x.replace(" ", ":") for x in FINDING.split(", ")) + ">"
    found = rows.mapInArrow(_scan(shared), f"doc_id long, found array<{kind}>")
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan of all documents by a model of all of them: doc_id and FINDING."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
