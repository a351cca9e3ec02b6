import random

import pytest

from velar.llm import spans
from .data import DOCS, corpus


def brute(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if least[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def rows_of(seed, vocabulary):
    rng = random.Random(seed)
    rows = corpus(n=40, seed=seed, vocabulary=vocabulary)
    long = " ".join(rng.choices([f"u{i}" for i in range(900)], k=500)).split()
    for i in range(40):  # overlapping pieces of one text, joined anew: branches, partial paths, loops
        parts = [long[a : a + rng.randint(5, 90)] for a in rng.choices(range(450), k=rng.randint(1, 4))]
        rows.append((2000 + i * 7 % 40, " ".join(w for p in parts for w in p), None, None, None))
    loop = " ".join(["a b c d e"] * 20)
    rows += [(3000, loop, None, None, None), (3001, loop + " z", None, None, None), (None, loop, None, None, None), (None, " ".join(long), None, None, None)]
    rows += [(2000, " ".join(long[7:60]), None, None, None), (2000, "x y " + " ".join(long[100:160]), None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("vocabulary,chunk", [(40, 8 << 20), (3, 8 << 20), (40, 3000)])
def test_against_brute_force(spark, monkeypatch, vocabulary, chunk):
    monkeypatch.setattr(spans, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(spans, "FEWEST_CHUNKS", 5)
    rows = rows_of(vocabulary, vocabulary)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as id", "'x' as row", "1 as gone")
    got = sorted(((r.doc_id, r._words, r._removed, r.text or "") for r in spans.deduplicated(docs).collect()), key=str)
    want = brute([r[:2] for r in rows], 13)
    stays = {(w[0], w[1]): w for w in want}
    for g in got:  # texts that lose no word are compared word by word as well
        assert (g[0], g[1], g[2], " ".join(g[3].split())) in want or g[:2] not in stays, g
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert sum(w[2] for w in want) > 500


def test_other_seed_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(spans, "FEWEST_CHUNKS", 3)
    rows = rows_of(5, 30)
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r._words, r._removed) for r in spans.deduplicated(docs).collect()), key=str)
    assert got == [w[:3] for w in brute([r[:2] for r in rows], 13)]
    assert spans.deduplicated(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, " ".join("abcdefghijklmnop"))] * 2 + [(2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r._removed) for r in spans.deduplicated(same).collect()) == [(1, " ".join("abcdefghijklmnop"), 0)] * 2 + [(2, None, 0), (3, "", 0)]
