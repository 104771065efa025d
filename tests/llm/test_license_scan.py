from __future__ import annotations

import re
import textwrap

import numpy as np
import pytest

from feedspark.llm import license_scan as L
from feedspark.llm.license_templates import ORDINARY, TEMPLATES


@pytest.fixture(scope="module")
def model():
    return L.train()


def brute(m, text):
    parts = [x.lower() for x in re.split(L.PARAGRAPH, text or "") if x.strip(" \n\r\t")]
    out = []
    for i, line in enumerate(parts):
        p = m.probabilities(line)
        k = int(p.argmax())
        if k < len(m.families) - 1 and p[k] >= L.SURE:
            mine = L.trigrams(L.tokens(line))
            agree = max(len(set(mine) & set(t)) / min(len(mine), len(t)) for t in m.templates[k])
            out.append((i, m.families[k], p[k], agree, agree >= L.AGREE))
    return len(parts), out


def check(spark, m, texts):
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_paragraphs int")
    got = {r.doc_id: r for r in L.scan(rows, m).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, want = brute(m, t)
        r = got[i]
        assert r.n_paragraphs == n
        assert [(x.paragraph, x.family, x.confirmed) for x in r.notices] == [(a, b, e) for a, b, _, _, e in want]
        assert np.allclose([x.probability for x in r.notices], [w[2] for w in want]) and np.allclose([x.agreement for x in r.notices], [w[3] for w in want])
        sure = [w for w in want if w[4]]
        assert (r.n_notices, r.n_unconfirmed, r.families) == (len(sure), len(want) - len(sure), ",".join(sorted({w[1] for w in sure})))
        assert r.best == pytest.approx(max((w[2] for w in sure), default=0.0))


def test_matches_brute_force(spark, model):
    rng = np.random.default_rng(5)
    filler = sorted({w for s in ORDINARY for w in L.tokens(s)})
    texts = [None, "", "\n\n", "one", "the of\n \nLicensed", *ORDINARY[:6], "x " * 60_000 + "\nReleased under the MIT License."]
    texts += ["\n".join(TEMPLATES[f]) for f in TEMPLATES]
    texts += ["\n".join(" ".join(L._altered(L.tokens(t), rng, filler)) for t in TEMPLATES[f]) for f in TEMPLATES]
    check(spark, model, texts)


def test_wrapped_notices_are_one_paragraph(spark, model):
    long = {f: max(t, key=len) for f, t in TEMPLATES.items()}
    texts = [f"Some words of prose\n\n{textwrap.fill(long[f], 40)}\nAnd more." for f in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause")]
    texts += [" * Licensed under the Apache\r\n * License, Version 2.0\r\n *\r\n", "a\n \t\n# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: MIT\nb"]
    texts += ["A line without an end\nReleased under the MIT License.\nLicensed under CC BY 4.0"]
    check(spark, model, texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_notices, r.families) for r in L.scan(rows, model).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 6)] == [(1, "MIT"), (1, "Apache-2.0"), (1, "GPL-3.0"), (1, "BSD-3-Clause"), (1, "Apache-2.0"), (2, "CC-BY-4.0,MIT")]


#: Notices as they are written elsewhere: no altered copies of the templates.
UNSEEN = [
    ("MIT", "Distributed under the MIT license, see the file LICENSE for details."),
    ("MIT", "The software is available to all under the terms of the MIT License (MIT)."),
    ("Apache-2.0", "Use of this source is governed by the Apache License, Version 2.0, found in the root folder."),
    ("Apache-2.0", "We publish all our code under the Apache License 2.0."),
    ("GPL-3.0", "You may copy and share it as the GNU General Public License, version 3 or later, allows."),
    ("GPL-2.0", "Our kernel module is covered by version 2 of the GNU General Public License."),
    ("LGPL", "The client is provided on the terms of the GNU Lesser General Public License."),
    ("BSD-3-Clause", "The code of the parser comes with a 3-Clause BSD License."),
    ("CC-BY-4.0", "Photographs by our members, Creative Commons Attribution 4.0 International."),
    ("CC-BY-SA-4.0", "You can reuse our articles on the terms of Creative Commons Attribution-ShareAlike 4.0."),
    ("CC-BY-NC-4.0", "The lessons may be shared as Creative Commons Attribution-NonCommercial 4.0 International says."),
    ("MPL-2.0", "The extension is subject to the Mozilla Public License, v. 2.0."),
    ("Public-Domain", "We hereby release the map into the public domain under CC0 1.0 Universal."),
    ("Proprietary", "Copyright 2019 by the publisher, all rights reserved worldwide."),
    ("unknown", "Please read the terms before you buy a ticket for the show."),
    ("unknown", "Our library lends books to all members of the public."),
    ("unknown", "Apache tribes lived in the south west for a long time."),
    ("unknown", "The second version of the plan was published by the city in May."),
    ("unknown", "He got his pilot license at the age of nineteen."),
    ("unknown", "All guests must leave their rooms before noon."),
    ("unknown", "A source close to the general confirmed the report."),
    ("unknown", "The copyright of the song belongs to the heirs of the singer."),
]


def test_unseen_notices(model):
    p = [model.probabilities(t) for _, t in UNSEEN]
    found = [model.families[int(x.argmax())] if x.max() >= L.SURE else "unknown" for x in p]
    right = np.array([f == w for f, (w, _) in zip(found, UNSEEN, strict=True)])
    notice = np.array([w != "unknown" for w, _ in UNSEEN])
    assert right[notice].mean() >= 0.7, [x for x in zip(found, UNSEEN, strict=True) if x[0] != x[1][0]]
    assert right[~notice].all(), found
    # Calibration: what the model is sure of is right about as often as it says.
    sure = np.array([x.max() for x in p])
    assert right.mean() >= sure.mean() - 0.2


def test_templates_are_found(model):
    for f, ts in TEMPLATES.items():
        for t in ts:
            p = model.probabilities(t)
            assert model.families[int(p.argmax())] == f and p.max() >= L.SURE, t


def test_held_out(model):
    xs, y = L._examples(6, 99, model.families)
    z = np.array([np.array(model.bias) + sum((np.array(model.weights[g]) for g in x if g in model.weights), np.zeros(len(model.bias))) for x in xs])
    found = z.argmax(axis=1)
    assert (found == y).mean() > 0.9
    unknown = y == len(model.families) - 1
    assert (found[unknown] == y[unknown]).mean() > 0.97
    assert len(model.weights) < 900


def test_rows(spark, model):
    rows = [(None, "Released under the MIT License."), (3, "Released under the MIT License."), (3, "Released under the MIT License.")]
    got = L.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    assert [r.families for r in got] == ["MIT"] * 3
    assert L.scan(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0
