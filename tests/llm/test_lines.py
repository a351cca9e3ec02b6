import random
from collections import Counter

import pytest

from velar.llm import lines
from .data import DOCS, corpus
from .test_edits import distance, edited


def brute(rows, most, least):
    found = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").encode().split(b"\n")):
            if line.strip():
                found.append((i, k, line.strip().decode()))
    first, root = {}, {}
    for i, k, s in found:
        first.setdefault(s, (i, k))
        root.setdefault(s, s)

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    names = list(first)
    bags = {x: Counter(x) for x in names}
    for x in names:
        for y in names:
            if x < y and min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= most:
                if (bags[x] - bags[y]).total() <= most and distance(x, y) <= most:
                    root[find(x)] = find(y)
    best = {}
    for s in names:
        best[find(s)] = min(best.get(find(s), first[s]), first[s])
    gone = {(i, k) for i, k, s in found if best[find(s)] != (i, k)}
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = None
        else:
            parts = t.split("\n")
            out[i] = "\n".join(p for k, p in enumerate(parts) if (i, k) not in gone)
    return out


def tables(seed):
    rng = random.Random(seed)
    rows = corpus(n=40, seed=seed)
    base = "".join(rng.choices("abcdefgh é", k=60)).strip()
    crowd = [edited(rng, base, rng.randint(0, 3), "xyz") for _ in range(60)] + [base[:20] + f" page {i}" for i in range(40)]
    return [r[:2] for r in rows] + [(1000 + i, f"{c}\n{rng.choice(crowd)}") for i, c in enumerate(crowd)]


@pytest.mark.parametrize("most,dense,block", [(1, 64, 2000), (1, 4, 2000), (2, 64, 2000), (2, 4, 2000), (2, 4, 15), (3, 1, 40), (0, 64, 2000)])
def test_against_brute_force(spark, monkeypatch, most, dense, block):
    monkeypatch.setattr(lines, "BLOCK_LINES", block)
    rows = tables(most + 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.deduplicated(docs, most, 16, dense).collect()}
    assert got == brute(rows, most, 16)


def test_odd_rows(spark):
    rows = [
        (1, "same line\n\n other ", "a", 1),
        (1, "same line\nother", "b", 2),
        (2, "same line\r\nother\nnew", None, 3),
        (None, "new\nsame line", "c", 4),
        (3, None, "d", 5),
        (4, "", "e", 6),
        (5, "x" * 300000 + "\n" + "x" * 300001, "f", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, h long")
    clash = docs.selectExpr("*", "'old' as _lines", "7 as _removed")
    got = sorted((tuple(r) for r in lines.deduplicated(clash).collect()), key=lambda r: r[3])
    assert got == [
        (1, "", "a", 1, 2, 2),
        (1, "other", "b", 2, 2, 1),
        (2, "", None, 3, 3, 3),
        (None, "new\nsame line", "c", 4, 2, 0),
        (3, None, "d", 5, 0, 0),
        (4, "", "e", 6, 0, 0),
        (5, "x" * 300000, "f", 7, 2, 1),
    ]
    assert lines.deduplicated(docs.limit(0)).count() == 0
