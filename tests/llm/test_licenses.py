import random
import re

from gradespark.llm import licenses

RULES = licenses.rules()


def brute(text):
    text = text or ""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))
    places, base = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    joined = "".join(f" {w} " for w in words) if words else "  "
    found = []
    for order, r in enumerate(RULES):
        found += [(m.start(), m.end(), r["rank"], order, r["label"]) for m in re.finditer(r["pattern"], joined)]
    kept = [d for d in found if not any(e is not d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and (e[0], e[1]) != (d[0], d[1])) for e in found)]
    # Of equal intervals of one priority the label that sorts first stays.
    first = {}
    for d in kept:
        key = (d[0], d[1], d[2])
        first[key] = min(first.get(key, d[4]), d[4])
    kept = [d for d in kept if first[(d[0], d[1], d[2])] == d[4]]
    best = min((d[2] for d in kept), default=len(licenses.SURE))
    score = [*licenses.SURE, 0.0][best]
    if base:
        score = max(score, licenses.SURE[licenses.NAME])
    labels = ",".join(sorted(base | {d[4] for d in kept}))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), labels, score)


def test_there_are_hundreds_of_rules_and_keywords_hold():
    assert len(RULES) > 300
    assert [r["rank"] for r in RULES] == sorted(r["rank"] for r in RULES)
    for r in RULES:
        # What a pattern must contain, its keyword stands in.
        must = re.sub(r"\(\?:[^()]*(\(\?:[^()]*\)[^()]*)?\)\?", "", r["pattern"])
        assert r["keyword"] in must or re.search(r"\(\?:[^()]*" + r["keyword"], must), r


def texts():
    rng = random.Random(7)
    pieces = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved.",
              "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later", "cc by", "CC-BY-SA 3.0",
              "general public license", "GNU Lesser General Public License v2.1", "in the public domain", "Copyright (c) 2020", "two-clause BSD",
              "without any warranty", "ccs by", "rights reserved", "été licence", "the Unlicense", "Keep 0bsd", "permission is hereby granted, free of charge",
              "governed by the terms of the Mozilla Public License 2.0", "wörds", "12", "--", "accent"]
    out = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    return out + pieces + [None, "", " .,", "all rights reserved " * 300, "x " * 60000 + "CC/BY", "All-rights\nreserved...cc\tby", "acc by", "cc byte"]


def test_scan_equals_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "cc by"), (1, "cc by")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, labels string").repartition(4)
    got = sorted((tuple(r) for r in licenses.scan_licenses(df).collect()), key=str)
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert got == want
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_suppression(spark):
    def labels(text):
        return licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()

    assert labels("Licensed under CC BY-NC 4.0.").labels == "cc-by,cc-by-nc"  # the base label stays
    assert labels("Released under the Apache License, Version 2.0.").labels == "apache-2.0"
    assert labels("GNU Lesser General Public License 2.1").labels == "gpl,lgpl-2.1"
    assert labels("no word of it").score == 0.0


def test_plan_has_no_python(spark):
    plan = licenses.scan_licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
