import random

import pytest
import xxhash

from velar.llm import graph, simhash
from .data import DOCS, corpus


def brute(texts, ngram=3, distance=2):
    prints = {}
    for i, t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
        s = [" ".join(w[k : k + ngram]) for k in range(max(1, len(w) - ngram + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (p, find(i)) for i, p in prints.items()}


@pytest.mark.parametrize("dense", [64, 1])
def test_against_brute_force(spark, dense):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, dense=dense).collect()}
    assert got == brute([r[:2] for r in rows])


@pytest.mark.parametrize("distance,dense", [(2, 64), (2, 2), (1, 64), (1, 2), (0, 64)])
def test_links_of_close_fingerprints(spark, distance, dense):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(6)}
    for p in list(prints):
        for _ in range(40):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.component for r in graph.components(simhash.links(df, distance, dense)).collect()}
    root = {p: p for p in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and ((i ^ j) & ((1 << 64) - 1)).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {p: find(p) for p in prints}
    assert {p: got.get(p, p) for p in prints} == want


def test_components_of_chains_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 199: 199, 200: 199}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(3, "a b c d", 1, "x"), (3, "a b c d", 2, "y"), (None, "a b c d", 1, "x"), (5, None, None, None), (9, "", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 5), (9, 5)]
    assert sorted(r.doc_id or -1 for r in simhash.kept(docs).collect()) == [-1, 3, 3, 5]
    assert simhash.kept(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
