import re

import numpy as np
import pytest

from pagemill.llm import licenses

MIT = """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
BOOST = 'Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware.'
POSTGRES = "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."

LINES = [
    ("Released under the MIT License.", "mit"), ("  LICENSED under the apache license, version 2.0!", "apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("GNU Lesser General Public License.", "lgpl"), ("He got his license yesterday.", "unknown"), ("licen.", "unknown"), ("the warranty.", "unknown"), ("nothing to see.", None), ("All rights reserved.", "all-rights-reserved"),
    ("This program is free software: you can redistribute it and/or modify.", "gpl"), ("Distributed under the terms of the Apache 2.0.", "apache-2.0"), ("Available under CC BY-SA 4.0.", "cc-by-sa"), ("Released under GPLv3.", "gpl"), ("GNU/GPL.", "gpl"), ("Er kam mit dem Zug.", None), ("All of them were there.", None),
    ("An apache helicopter landed by the river.", "unknown"), ("The software is yours under the PostgreSQL License.", "unknown"),
]
SCHEMA = "doc_id long, text string, family string, row int"


def brute(text):
    """(paragraph, family, probability, similarity) of the rows of a text."""
    model = licenses.train()
    at = {g: i for i, g in enumerate(model["grams"])}
    out = []
    for k, line in enumerate(licenses.paragraphs(text)):
        grams = licenses.n_grams(line, 3) & at.keys()
        x = sum((model["weights"][at[g]] for g in grams), np.zeros(len(model["names"])))
        z = model["scale"] * (x / np.sqrt(max(1, len(grams))) + model["bias"])
        z[0] += model["shift"]
        p = np.exp(z - z.max())
        p /= p.sum()
        family = model["names"][int(p.argmax())] if p.max() >= 0.6 else "unknown"
        n = max(1, len(licenses.tokens(line)) - 1)
        like = max((len(licenses.pairs(line) & licenses.pairs(t)) / min(len(licenses.pairs(t)), n) for t in licenses.TEMPLATES.get(family, [])), default=0.0)
        if family != "unknown" or (line and any(c in line for c in licenses.CUES)):
            out.append((k, family, round(float(p.max()), 4), round(like, 6)))
    return out


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    out = {i: [] for i in range(len(texts))}
    for r in licenses.scanned(df).orderBy("doc_id", "paragraph").collect():
        out[r.doc_id].append((r.paragraph, r.family, round(r.probability, 4), round(r.similarity, 6)))
        assert r.confirmed == (r.similarity >= 0.5)
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    text = "\n".join(x for x, _ in LINES)
    data = [(1, text), (1, text), (2, None), (3, ""), (4, "zq " * 30_000 + "Released under the MIT License."), (None, "Released under the MIT License."), (5, "one\n" * 50_000 + "\n\nAll rights reserved.")]
    return licenses.scanned(spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)).collect()


def test_families(scanned):
    got = sorted((r.paragraph, r.family) for r in scanned if r.doc_id == 1)
    assert got == sorted([(i, f) for i, (_, f) in enumerate(LINES) if f] * 2)
    assert [(r.paragraph, r.family) for r in scanned if r.doc_id == 4] == [(0, "mit")]
    assert [r.family for r in scanned if r.doc_id == 5] == ["all-rights-reserved"]
    assert sum(r.doc_id is None for r in scanned) == 1
    assert not any(r.doc_id in (2, 3) for r in scanned)


def test_against_brute_force(spark):
    words = sorted({w for t in (MIT, ISC, BOOST, *licenses.OTHERS) for w in t.split()})
    rng = np.random.default_rng(2)
    mixed = [" ".join(rng.choice(words, 60)) for _ in range(10)]
    parts = ["\n".join(rng.permutation(MIT.split("\n"))) for _ in range(5)]
    texts = [MIT, ISC, BOOST, POSTGRES, *mixed, *parts, *(t for ts in licenses.TEMPLATES.values() for t in ts), "a\n \nb licence\r\n\r\nc MIT license", ". \nMIT License"]
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        assert [x[:2] for x in got[i]] == [x[:2] for x in brute(t)], t
        for a, b in zip(got[i], brute(t), strict=True):
            assert a[2] == pytest.approx(b[2], abs=2e-4) and a[3] == pytest.approx(b[3], abs=1e-5)


def test_wrapped_licences(spark):
    mit, isc, boost, postgres = (rows(spark, [MIT, ISC, BOOST, POSTGRES])[i] for i in range(4))
    assert [f for _, f, _, _ in mit if f != "unknown"] == ["mit", "mit"]
    assert [f for _, f, _, _ in isc] == ["isc"]
    assert [f for _, f, _, _ in boost] == ["bsl-1.0"]
    assert [f for _, f, _, _ in postgres] == ["unknown"]


def test_left_out_templates():
    """Families of whole templates and phrases that the fit had not seen."""
    model = licenses.train()
    z, y = model["held"]
    z = z * model["scale"]
    z[:, 0] += model["shift"]
    p = licenses.softmax(z)
    top = p.argmax(1)
    named = (top > 0) & (p.max(1) >= 0.6)
    right = y[np.arange(len(y)), top] > 0
    assert right[named].mean() > 0.97
    assert (right & named).sum() > 0.6 * (y[:, 0] == 0).sum()


def test_templates_are_never_another_family():
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            found = {f for _, f, _, _ in brute(t.replace("\n", " "))}
            assert found <= {family, "unknown"}
    for t in [*licenses.OTHERS, *licenses.PLAIN]:
        assert {f for _, f, _, _ in brute(t)} <= {"unknown"}


def test_native_and_empty(spark):
    df = spark.createDataFrame([(1, "MIT license")], "doc_id long, text string")
    plan = licenses.scanned(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "monotonically" not in plan
    assert licenses.scanned(df.limit(0)).count() == 0


def test_order_and_division_of_rows_do_not_matter(spark):
    texts = [MIT, ISC, BOOST, MIT, None, "", *(x for x, _ in LINES)]
    df = spark.createDataFrame([(i % 5, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    key = lambda d: sorted((r.doc_id, r.paragraph, r.family, round(r.probability, 9), r.similarity) for r in licenses.scanned(d).collect())
    assert key(df) == key(df.repartition(7, "text")) == key(df.orderBy("text"))


def test_paragraph_breaks():
    assert licenses.paragraphs("A b\nc.\nD\n\nE.\r\nf") == ["a b\nc.", "d", "e.", "f"]
    assert re.split(licenses.BREAK, "x; \ny") == ["x;", "y"]
