import hashlib
import math
import random

import numpy as np

from velar.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, `a.b` string, cluster int"


def brute(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(middle)), key=lambda c: (far(v, middle[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for c in range(len(middle)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                middle[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, nearest(v), far(v, middle[nearest(v)])) for i, v in kept), key=str), middle


def vectors(n, dim, seed, spread=0.2):
    rng = random.Random(seed)
    tops = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(tops)]) for i in range(n)]
    rows += [(5000 + i, rows[0][1]) for i in range(n // 3)]  # a third are copies
    rows += [(None, rows[1][1]), (None, rows[2][1]), (3, rows[4][1]), (900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [None] + [1.0] * (dim - 1))]
    return rows + [(904, [float("nan")] * dim), (905, [float("inf")] + [0.0] * (dim - 1)), (906, [0.0] * dim), (907, [-0.0001] * dim)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    found, ends = centroids.clustered(df, **options)
    assert found.dtypes == [("id", "bigint"), ("cluster", "int"), ("distance", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=str), ends


def test_against_brute_force(spark):
    rows = vectors(300, 8, 1)
    got, ends = run(spark, rows, clusters=6, rounds=5, dim=8, scale=1024)
    assert (got, ends) == brute(rows, 6, 5, 8, 1024)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("velar_")]


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-3, 4) for y in range(-3, 4))] * 2
    assert run(spark, rows, clusters=4, rounds=4, dim=2, scale=1) == brute(rows, 4, 4, 2, 1)


def test_fewer_vectors_than_clusters_huge_components_and_empty(spark):
    rows = [(1, [1e30, -1e30]), (2, [0.5, 0.25]), (3, [-7.0, 1e7])]
    assert run(spark, rows, clusters=8, rounds=3, dim=2, scale=1024) == brute(rows, 8, 3, 2, 1024)
    assert run(spark, [], clusters=8, rounds=3, dim=2) == ([], [])
    assert run(spark, rows[:1], clusters=8, rounds=2, dim=2, scale=1)[0] == [(1, 0, 0)]


def test_only_expired_vectors_are_compared_and_none_is_missed():
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(6, 64))[rng.integers(0, 6, 1000)] * 800 + rng.normal(size=(1000, 64)) * 200).astype(np.int32)
    middle, drift = data[:6].astype(np.int64), np.zeros(6)
    block, looked = centroids.Block(data, 6), []
    for _ in range(10):
        items, _ = block.settle(middle, drift)
        looked.append(len(items))
        block = centroids.Block(data, 6, block.cluster, block.keys)  # what a round writes is all that the next needs
        assert np.array_equal(block.cluster, centroids.distances(data, middle).argmin(1))
        new = np.array([data[block.cluster == c].astype(np.int64).sum(0) // max(1, (block.cluster == c).sum()) if (block.cluster == c).any() else middle[c] for c in range(6)])
        drift, middle = drift + centroids._closing(middle, new), new
    assert looked[0] == 1000 and sum(looked[1:]) < 3000


def test_distances_are_exact_for_large_components():
    big = np.array([[centroids.LIMIT] * 64, [-centroids.LIMIT] * 64, [12345678] * 64], np.int64)
    got = centroids.distances(big, big)
    assert got.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in big] for x in big]
