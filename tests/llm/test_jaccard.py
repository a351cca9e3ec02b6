import random

import numpy as np
import pytest

import corpus_pipeline
from velar.llm import jaccard
from .data import DOCS, corpus


def grams(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, similarity=0.8):
    """(row, smallest id of its group) by comparing all pairs of sets; and the number of pairs that are not equal."""
    sets = [grams(r[1]) for r in rows]
    root, n = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or (x & sets[j] and len(x & sets[j]) >= similarity * len(x | sets[j]) - 1e-9):
                n += x != sets[j]
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return [(r[0], best.get(find(i))) for i, r in enumerate(rows)], n


def near_copies(seed, n=60):
    """Texts of 60 to 150 words, each with copies of one to six changed words, and chains of copies of copies."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(500)]
    out = []
    for _ in range(n):
        t = rng.choices(words, k=rng.randint(60, 150))
        for _ in range(rng.randint(0, 5)):
            copy = list(rng.choice([t, out[-1].split() if out else t]))
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("room", [16 << 20, 2000])
def test_against_brute_force(spark, room):
    rows = corpus(n=40, seed=3) + [(5000 + i, t, None, None, None) for i, t in enumerate(near_copies(1))]
    rows += [(None, rows[3][1], None, None, None), (rows[5][0], rows[9][1], None, None, None), (None, "alone with a null id here", None, None, None)]
    random.Random(2).shuffle(rows)
    want, n = brute(rows)
    assert n > 50
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs, room=room).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stage_of_the_pipeline_against_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(near_copies(5))]
    want, _ = brute(rows)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert got == {i for i, c in want if i == c}


def test_joined_and_bands():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(150)]
    root = list(range(len(sets)))
    for i, j in jaccard.joined(sets, 0.8):
        assert len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
        a, b = root[i], root[j]
        root = [b if x == a else x for x in root]
    for i, x in enumerate(sets):
        for j in range(i):
            if len(np.intersect1d(x, sets[j])) >= 0.8 * len(np.union1d(x, sets[j])):
                assert root[i] == root[j]
    missed = 0
    for _ in range(2000):  # 160 of 200 shared: a similarity of 0.8
        x = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        missed += not (jaccard.bands(x[:180]) == jaccard.bands(x[20:])).any()
    assert missed <= 2



def test_candidates_come_from_the_index_of_fingerprints(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(400)]
    text = rng.choices(words, k=120)
    near = [*text[:-1], "other"]
    rows = [(0, " ".join(text)), (1, " ".join(near)), (2, " ".join(text[1:])), (3, " ".join(rng.choices(words, k=120)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [jaccard.shingles(t.encode(), 5) for _, t in rows]
    keys = [jaccard.set_key(s) for s in sets]
    base = 0x0123456789ABCDEF
    # 0 and 1: alike, two bits apart; 2: alike, but three bits from either; 3: not alike, with an equal fingerprint
    prints = [[base, 11 << 40], [base ^ 1 << 3 ^ 1 << 60, 23 << 20], [base ^ 7 << 30, 57 << 10], [base, 99]]
    nodes = spark.createDataFrame([(k, i, len(s), p) for i, (k, s, p) in enumerate(zip(keys, sets, prints))], "key long, least long, size long, prints array<long>")
    got = {frozenset((r.a, r.b)) for r in jaccard.links(docs, nodes, 5, 0.8, 4 << 20).collect()}
    assert got == {frozenset(keys[:2])}


def test_fingerprints_are_the_bits_of_most_shingles():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 100, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(3))
        want = [2 * sum(int(g) >> b & 1 for g in x) > len(x) for b in range(64)]
        got = np.frombuffer(int(jaccard.fingerprint(x)).to_bytes(8, "little", signed=True), np.uint8)
        x = np.frombuffer(x.tobytes(), np.uint8).reshape(-1, 8)
        assert np.unpackbits(got).tolist() == (2 * np.unpackbits(x, axis=1).sum(0, dtype=int) > len(x)).astype(int).tolist()
        assert sum(want) == np.unpackbits(got).sum()
