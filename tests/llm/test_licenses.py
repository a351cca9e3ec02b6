import random
import re

from velar.llm import licenses
from .data import DOCS, corpus


def places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    out = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def test_base_places_against_brute_force(spark):
    rng = random.Random(1)
    bits = ["MIT", "License", "license,", "CC", "by", "Apache-", "gnu", "General", "PUBLIC", "x", "éMIT", "cc.by cc", "GNU General Public License"]
    rows = corpus() + [(2000 + i, " ".join(rng.choices(bits, k=rng.randint(1, 40))), None, None, None) for i in range(80)]
    rows += [(None, "MIT license", None, None, None), (2000, "mit license mit license", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_words", "'x' as spans")
    got = sorted(((r.doc_id, r.n_words, [(p.word, p.label) for p in r.places]) for r in licenses.scanned(docs).collect()), key=str)
    assert got == sorted(((r[0], *places(r[1])) for r in rows), key=str)
    assert licenses.scanned(docs.limit(0)).count() == 0


def test_order_and_containment():
    ordered = licenses.rules()
    assert len(ordered) >= 200 and [r.priority for r in ordered] == sorted((r.priority for r in ordered), reverse=True)
    labels = lambda t: [x[2] for x in licenses.detections(t.lower(), ordered)]
    assert labels(b"Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels(b"SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0"]
    assert labels(b"see https://www.gnu.org/licenses/gpl-3.0.html and the MIT license") == ["gpl-3.0", "mit"]
    assert labels(b"GNU General Public License version 3") == ["gpl-3.0"]
    assert labels(b"the smith license and admit license; nothing") == []
    assert labels(b"Permission is hereby granted, free of charge, to any person obtaining\na copy") == ["mit"]


def test_containment_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        spans = [(s, s + rng.randint(1, 12), rng.choice("ab"), rng.choice([50, 70])) for s in rng.choices(range(30), k=rng.randint(0, 14))]
        ranked = sorted(spans, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2]))
        want = []
        for x in ranked:
            if not any(y[0] <= x[0] and x[1] <= y[1] for y in want):
                want.append(x)
        assert licenses._uncontained(ranked) == want


def sample(parsed, rng):
    """A text that a parsed expression of the rules matches; alternatives and repeats are drawn."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "ANY":
            out += "x"
        elif name == "IN":
            kind, what = rng.choice(value)
            out += {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "k"}[str(what)] if str(kind) == "CATEGORY" else chr(rng.randint(*what)) if str(kind) == "RANGE" else chr(what)
        elif name == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        elif name == "SUBPATTERN":
            out += sample(value[-1], rng)
        elif name == "MAX_REPEAT":
            out += "".join(sample(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
    return out


def test_gate_never_changes_detections():
    rng, ordered, alone = random.Random(5), licenses.rules(), 0
    bare = [licenses.Rule(r.label, (), r.pattern, r.priority) for r in ordered]
    assert all(r.literals and not any(b" " in w for w in r.literals) for r in ordered)
    for rule in ordered:
        for _ in range(6):
            text = sample(licenses.parser.parse(rule.pattern.pattern.decode()), rng).encode()
            alone += bool(rule.pattern.search(text))
            assert licenses.detections(text, ordered) == licenses.detections(text, bare), text
    assert alone > 5 * len(ordered)
    labels = lambda t: [x[2] for x in licenses.detections(t, ordered)]
    assert labels(b"spdx-license-identifier: mpl-2.0") == ["mpl-2.0"]
    assert labels(b"https://creativecommons.org/licenses/by/4.0") == ["cc-by-4.0"]
    assert labels(b"gnu\ngeneral\tpublic  license") == ["gpl"]
