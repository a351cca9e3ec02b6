import random
import re

import numpy as np
import pytest

from velar.llm import decontaminate
from velar.llm.fm_index import FMIndex
from .data import DOCS, corpus


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width):
    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(name)
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), ",".join(sorted(x for x in names if x is not None))))
    return sorted(out, key=str)


def tables(spark):
    rows = corpus(seed=4, vocabulary=25)
    rng = random.Random(2)
    items = []
    for k in range(25):
        w = words(rng.choice(rows)[1] or "x")
        at = rng.randrange(len(w))
        items.append((k, " ".join(w[at : at + rng.choice([3, 8, 14, 30])]).upper()))
    items += [(90, ""), (91, None), (None, items[0][1]), (92, "zz yy"), (0, items[1][1])]
    return rows, items, spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, block_bytes):
    rows, items, docs, bench = tables(spark)
    found = decontaminate.occurrences(docs, bench, block_bytes=block_bytes).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), ",".join(r["items"])) for r in found), key=str)
    named = [(None if a is None else str(a), b) for a, b in items]
    want = brute([r[:2] for r in rows], named, 10)
    assert got == want and sum(r[2] for r in want) > 0


def test_cleaned_texts(spark):
    docs = spark.createDataFrame(
        [(1, "Say: Alpha, beta GAMMA! End.", 7), (1, "nothing", 8), (None, None, 9), (2, "alpha beta gamma", 1), (3, "é alpha\nbeta-gamma alpha beta gamma x", 2)],
        "doc_id long, text string, spans long",
    )
    bench = spark.createDataFrame([(5, "alpha beta gamma")], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.cleaned(docs, bench).collect()]
    assert got == [(1, "Say: ! End.", 7), (1, "nothing", 8), (None, None, 9), (2, "", 1), (3, "é  x", 2)]
    assert decontaminate.cleaned(docs, bench).schema == docs.schema
    assert [tuple(r) for r in decontaminate.cleaned(docs, bench.limit(0)).collect()] == [tuple(r) for r in docs.collect()]
    assert decontaminate.cleaned(docs.limit(0), bench).count() == 0


def test_index_finds_all_positions():
    rng = np.random.default_rng(1)
    for n, symbols in [(1, 3), (200, 3), (500, 20), (300, 2)]:
        values = rng.integers(1, symbols, n)
        index = FMIndex(values, symbols, sample=4)
        patterns = [values[i : i + k] for i in range(0, n, 7) for k in (1, 2, 5)] + [np.array([1, 1, 1, 1, 1, 1, 1, 1, 1])]
        low, high = index.search(patterns)
        for p, lo, hi in zip(patterns, low, high):
            want = [i for i in range(n - len(p) + 1) if (values[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want
