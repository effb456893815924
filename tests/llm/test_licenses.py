import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidelane.llm import licenses, textops

FIELDS = "doc_id long, text string, family string, found int"


def say(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "tion"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    rows, truth = [], set()
    names = sorted(licenses.TEMPLATES)
    for d in range(260):
        lines = [say(rng, rng.randrange(1, 20)) for _ in range(rng.randrange(0, 6))]
        if d % 5 == 0:
            family = names[d // 5 % len(names)]
            at = rng.randrange(len(lines) + 1)
            lines.insert(at, rng.choice(licenses.TEMPLATES[family]))
            truth.add((d, at, family))
        rows.append((d, "\n".join(lines), None, 1))
    return rows, truth


@pytest.fixture(scope="module")
def model(spark, case):
    return licenses.train(spark.createDataFrame(case[0], FIELDS))


def test_planted_notices_are_found_in_place(spark, case, model):
    rows, truth = case
    found = licenses.scan(spark.createDataFrame(rows, FIELDS), model).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in found if r["confirmed"]} == truth
    assert not [r for r in found if not r["confirmed"]]
    texts = dict((r[0], r[1]) for r in rows)
    for r in found:
        line = texts[r["doc_id"]].split("\n")[r["paragraph"]]
        assert texts[r["doc_id"]][r["start"] : r["end"]] in line and 0 < r["probability"] <= 1


def test_held_out_wordings(spark, model):
    said = {"mit": "This software is released under the MIT License", "apache": "licensed under Apache License, version 2.0", "gpl": "under the terms of the GNU General Public License, version 2", "cc-by-nc": "Licensed under CC BY-NC 3.0"}
    docs = spark.createDataFrame([(i, f"Thererone an.\n{t}\ntion re") for i, t in enumerate(said.values())], "doc_id long, text string")
    assert [r["family"] for r in licenses.scan(docs, model).orderBy("doc_id").collect()] == list(said)


#: Wordings that are no templates, and prose that grants nothing.
SAID = [
    ("mit", "This software and its documentation are made available by their authors under the MIT license, see below."),
    ("mit", "permission is hereby granted , free of charge to anyone obtaining a copy of this software and associated files"),
    ("mit", "MIT License"),
    ("mit", "The library is available under the MIT License."),
    ("mit", "this module is licensed under MIT license"),
    ("mit", "(The MIT License) Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("apache", "You may use this file only in compliance with the License; it is licensed under the Apache License, Version 2.0."),
    ("apache", "This product is released under the Apache License, Version 2.0"),
    ("apache", "distributed under the apache 2.0 licence"),
    ("apache", "Licensed to you under the Apache License Version 2.0"),
    ("apache", "code in this folder is under Apache License, Version 2.0"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License, as published by the FSF, either version 3 or later"),
    ("gpl", "This file is licensed under the GNU General Public License, version 2."),
    ("gpl", "Released under the GPL v3."),
    ("gpl", "licensed under the GNU GPL version 3 or later"),
    ("gpl", "This script is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library may be redistributed under the terms of the GNU Lesser General Public License, version 3."),
    ("lgpl", "licensed under the GNU Lesser General Public License version 2.1 or later"),
    ("lgpl", "You can redistribute this module and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "licensed to you under the GNU Affero General Public License version 3 only"),
    ("agpl", "This server is free software: you can redistribute it under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without changes, are permitted provided that these conditions are met"),
    ("bsd", "use of this source code is governed by a BSD style license"),
    ("bsd", "Released under the BSD 2-Clause License."),
    ("bsd", "licensed under the BSD 3 clause license"),
    ("cc-by-sa", "All of this text is licensed under a Creative Commons Attribution-ShareAlike 3.0 license"),
    ("cc-by-sa", "Licensed under CC BY-SA 3.0."),
    ("cc-by-sa", "Content is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc-by", "this work is licensed under a Creative Commons Attribution 3.0 International License"),
    ("cc-by", "Images are licensed under CC BY 4.0"),
    ("cc-by-nc", "This photo is licensed under a Creative Commons Attribution-NonCommercial 3.0 License."),
    ("cc-by-nc", "Shared under CC BY-NC-SA 3.0 license."),
    ("cc0", "To the extent possible under law the person has waived all copyright and related rights to this work"),
    ("cc0", "this data is released under CC0 1.0 universal"),
    ("mpl", "Subject to the terms of the Mozilla Public License, v. 2.0, is this Source Code Form"),
    ("mpl", "this add-on is licensed under the Mozilla Public License, version 2.0"),
    ("unlicense", "it is free and unencumbered software that was released into the public domain"),
    ("unlicense", "released into the public domain, under the Unlicense"),
    ("proprietary", "(c) 2021 Some Company. All rights reserved. Unauthorized copying is strictly prohibited."),
    ("proprietary", "Copyright 2019 Acme Inc. All rights reserved."),
    ("proprietary", "proprietary and confidential, do not distribute"),
]
#: Licences that no family has; the second half has none of the texts that the class of other licences is trained on.
FOREIGN = [
    "Licensed under the EUPL, Version 1.2 or later.",
    "This program is free software under the Artistic License 2.0",
    "Released under the ISC License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Licensed under the zlib license.",
    "Distributed under the Boost Software License, Version 1.0.",
    "made available under the terms of the Eclipse Public License v2.0",
    "Licensed under the PostgreSQL License.",
    "This file is distributed under the University of Illinois Open Source License.",
    "Released under the CeCILL license, version 2.1.",
    "Licensed under the Open Software License version 3.0",
    "SPDX-License-Identifier: NCSA",
    "This package is available under the PHP License, version 3.01.",
    "Licensed under the Ruby License.",
    "This database is made available under the Open Database License",
    "Distributed under the terms of the Sleepycat License.",
]
PROSE = [
    "We compared the MIT License with the GPL and found few differences in practice.",
    "My brother has no driving license and never will.",
    "Which license should a small company choose, she asked.",
    "The article describes how the Apache License came to be written.",
    "Copyright was invented long before computers were.",
    "The old songs are in the public domain, said the singer.",
    "Rights of way were reserved for the farmers of the village.",
    "They were granted permission to cross the bridge, free of charge.",
]


def test_precision_and_recall_on_other_wordings_and_on_prose_about_licences(spark, model):
    rng = random.Random(14)
    rows = [(i, "\n".join([say(rng, 12), t, say(rng, 9)])) for i, (_, t) in enumerate(SAID)] + [(100 + i, "\n".join([say(rng, 7), t])) for i, t in enumerate(PROSE)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).where("confirmed").collect()
    right = {r["doc_id"] for r in found if r["doc_id"] < 100 and r["family"] == SAID[r["doc_id"]][0]}
    wrong = [(r["doc_id"], r["family"]) for r in found if r["doc_id"] >= 100 or r["family"] != SAID[r["doc_id"]][0]]
    assert len(SAID) > 40 and len(right) >= 0.9 * len(SAID) and len(wrong) <= 1, ([SAID[i] for i in sorted(set(range(len(SAID))) - right)], wrong)


def test_other_licences_are_not_taken_for_known_ones(spark, model):
    rng = random.Random(18)
    rows = [(i, "\n".join([say(rng, 12), t, say(rng, 9)])) for i, t in enumerate(FOREIGN)] + [(100 + i, t) for i, t in enumerate(FOREIGN)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert not [(FOREIGN[r.doc_id % 100], r.family) for r in found if r.confirmed]
    named = {r.doc_id for r in found if r.family == licenses.UNKNOWN}
    missed = [FOREIGN[i % 100] for i, _ in rows if i not in named]
    assert len(missed) <= 0.3 * len(rows), missed


def test_notices_over_lines_and_inside_long_lines(spark, model):
    rng = random.Random(15)
    wrapped = "Permission is hereby granted, free\nof charge, to any person obtaining\na copy of this software and associated\ndocumentation files"
    long = " ".join([say(rng, 500), "This work is licensed under the GNU General Public License, version 3.", say(rng, 500)])
    rows = [(1, say(rng, 10) + "\n\n" + wrapped + "\n\n" + say(rng, 10)), (2, long), (3, say(rng, 5) + "\nReleased under the MIT License.\nLicensed under CC BY 4.0.\n" + say(rng, 5)), (4, "enaue " * 300)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == [(1, "mit"), (2, "gpl"), (3, "cc-by"), (3, "mit")]
    texts = dict(rows)
    for r in got:
        assert ("granted" if r["doc_id"] == 1 else "icense") in texts[r["doc_id"]][r["start"] : r["end"]] or r["doc_id"] == 3


def test_few_windows_of_prose_are_taken_for_licences(spark, model):
    rng = random.Random(16)
    rows = [(i, "\n".join(say(rng, rng.randrange(1, 60)) for _ in range(20))) for i in range(500)]
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).count() <= 3


def test_the_closest_template_is_that_of_a_plain_search(model):
    rng = random.Random(17)
    words = sorted({w for t in licenses.TEMPLATES.values() for x in t for w in x.split()}) + ["other", "words"]
    said_by, fits = {}, 0
    for k, g in model.templates:
        for x in g.tolist():
            said_by.setdefault(x, set()).add(k)
    weight = {x: licenses.NUMBER if x in set(model.numbers.tolist()) else 1 / len(own) for x, own in said_by.items()}
    for n in range(120):
        said = " ".join(rng.choices(words, k=rng.randrange(2, 20))) if n % 2 else licenses.variants(np.random.default_rng(n), rng.choice(rng.choice(list(licenses.TEMPLATES.values()))), words)
        hashes = textops.words(*textops.utf8(pa.array([said])), textops.NOT_ALNUM)[0]
        share, named, common, family = model.closest(hashes, np.full(len(model.families), 0.1))
        grams = set(licenses._template_grams(hashes).tolist())
        whole, of = sum(weight.get(x, 1.0) for x in grams), []
        for k, g in model.templates:
            both = set(g.tolist()) & grams
            heavy = sum(weight[x] for x in both)
            a, b = len(both) / max(min(len(g), len(grams)), licenses.FEW), heavy / max(min(sum(weight[x] for x in g.tolist()), whole), licenses.FEW_NAMED)
            fit = a >= licenses.CONFIRM and b >= licenses.NAMED
            of.append((fit, round(heavy, 9) if fit else 0, a, len(both), round(b, 9)))
        best = max(of)
        fits += best[0]
        assert (share, common) == best[2:4] and round(named, 9) in {x[4] for x in of if x[:4] == best[:4]} and 0 <= family < len(model.families) - 2
    assert fits > 30


def test_nulls_repeats_long_texts_and_empty_tables(spark, model):
    notice = "Released under the MIT License."
    docs = spark.createDataFrame([(1, None), (2, ""), (None, notice), (3, "the re\n" * 30000 + notice), (4, notice), (4, notice)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["paragraph"], r["family"]) for r in licenses.scan(docs, model).collect()))
    assert got == [(-1, 0, "mit"), (3, 30000, "mit"), (4, 0, "mit"), (4, 0, "mit")]
    assert licenses.scan(docs.limit(0), model).count() == 0
    assert licenses.train(docs.limit(0)).families[-1] == licenses.NONE


def test_every_window_of_every_document_counts_in_gradients_and_thresholds(spark):
    rng = random.Random(19)
    texts = ["\n".join(rng.choice(["", say(rng, rng.randrange(1, 80)), "the old boats may be distributed freely " + say(rng, 3), "Under the MIT license " + say(rng, 2)]) for _ in range(3)) for _ in range(1300)]
    texts += ["Permission is hereby granted, free of charge, to any person obtaining a copy", None, "", "caf\xe9 \n\n x"]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    built = licenses.Builtin()
    blocks = licenses.windows(docs.repartition(5), built)
    plain = []
    for line in "\n".join(x or "" for x in texts[:1300] + texts[1301:]).split("\n"):
        words = [] if re.search(licenses._NAMES, line) else re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", line)
        plain += [" ".join(words[i : i + licenses.WINDOW]) for i in range(0, len(words), licenses.WINDOW)]
    k, n = len(built.families), len(built.used) + 1
    w, b = np.random.default_rng(4).normal(0, 0.3, (k, n)).astype(np.float32), np.linspace(-1, 1, k)[:, None]
    want, naming = np.zeros((k, n + 1)), []
    for v in licenses._vectors(plain):
        x = np.bincount(built.feature[v], minlength=n) / np.sqrt(len(v) + licenses.SHORT)
        x[0] = 0  # what no built-in text says
        p = licenses._softmax(w @ x + b[:, 0])
        want += np.outer(p - np.eye(k)[-1], np.append(x, 1))
        naming.append((1 - p[-1], p[-2]))
    got = licenses.whole_gradient(blocks, w, b)
    assert np.allclose(got, want, atol=len(plain) * 100 / licenses.UNIT)
    assert (got == licenses.whole_gradient(licenses.windows(docs.repartition(2), built), w, b)).all()
    for counts, scores in zip(licenses.score_counts(blocks, w, b), np.array(naming).T, strict=True):
        assert counts.sum() == len(plain)
        for share in (0.5, 0.01, 0.0002):
            assert abs(licenses._counted_share(counts, share) - licenses._share(scores, share)) < 2 / licenses.BINS
    model = licenses.train(docs)
    assert model.seen == len(plain) > 2000
    assert not list(model.scan(pa.array(["the old boats may be distributed freely", "th er on an"])))
