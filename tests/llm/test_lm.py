import math
import random
from collections import Counter

import pytest

from velar.llm import lm
from .data import DOCS, corpus


def spelled(words, low):
    """For each word the byte trigrams of its bytes and of the space behind it."""
    data, at, out = b"  " + low + b" ", 2, []
    for w in words:
        at = data.index(w, at)
        out.append([data[k - 2 : k + 1] for k in range(at, at + len(w) + 1)])
        at += len(w)
    return out


def brute(rows, targets, weight):
    docs = []
    for i, t in rows:
        low = (t or "").encode().translate(lm.LOWERED)
        words = low.split()
        docs.append((i, words, spelled(words, low)))
    counts, grams = [Counter(), Counter()], [Counter(), Counter()]
    for i, words, spelling in docs:
        for side in range(2 if i in targets else 1):
            counts[side].update(words)
            for s in spelling:
                for g in s:
                    grams[side].update([(3, g), ("c3", g[:2]), (2, g[1:]), ("c2", g[1:2]), (1, g[2:]), "all"])
    out = []
    for i, words, spelling in docs:
        own, losses = Counter(words), []
        for side in (1, 0):
            mine = side == 0 or i in targets
            n = counts[side].total() - (len(words) if mine else 0)
            g, loss = grams[side], 0.0
            for w, s in zip(words, spelling):
                p = 1.0
                for x in s:
                    one = (g[1, x[2:]] + weight / 256) / (g["all"] + weight)
                    two = (g[2, x[1:]] + weight * one) / (g["c2", x[1:2]] + weight)
                    p *= (g[3, x] + weight * two) / (g["c3", x[:2]] + weight)
                loss -= math.log((counts[side][w] - (own[w] if mine else 0) + weight * p) / (n + weight))
            losses.append(loss / len(words) if words else None)
        out.append((i, len(words), *losses))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 2000])
def test_against_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(lm, "KNOWN", 20)
    rows = corpus(n=20, seed=6, vocabulary=15) + [(3, "again", None, None, None), (None, "no id", None, None, None), (None, "\vA\fa  é b", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as mark", "'x' as chunk")
    ids = spark.createDataFrame([(i,) for i in (0, 2, 3, 3, 5, 9, None, 12345)], "doc_id long")
    got = sorted(((r.doc_id, r.n_tokens, r.ce_target, r.ce_background) for r in lm.scored(docs, ids, 4.0, chunk_bytes).collect()), key=str)
    want = brute([r[:2] for r in rows], {0, 2, 3, 5, 9}, 4.0)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == (None, None) if w[2] is None else g[2:] == pytest.approx(w[2:], rel=1e-9)


def test_copies_and_topics_are_told_apart(spark):
    rng = random.Random(4)
    sides = [[f"{side}{k}" for k in range(60)] for side in "xy"]
    text = lambda k: " ".join(rng.choices(sides[k % 2], k=40)) + f" only{k} here{k} there{k} now{k}"
    rows = [(i, text(i)) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scored(docs, docs.where("doc_id % 2 = 0 and doc_id < 60")).collect()}
    assert all((got[i].score > got[j].score) for i in range(100, 200, 2) for j in range(101, 200, 2))
    assert max(got[1000 + i].ce_background for i in range(20)) < min(got[i].ce_background for i in range(20, 200))


def test_nothing(spark):
    docs = spark.createDataFrame(corpus(n=8), DOCS)
    assert lm.scored(docs.limit(0), docs).count() == 0
    same = spark.createDataFrame([(1, "ab cd"), (2, "ef"), (3, "gh ij kl")], "doc_id long, text string")
    got = [r.ce_target for r in lm.scored(same, docs.limit(0)).collect()]
    assert got == pytest.approx([3 * math.log(256)] * 3)
