import base64
import random
from collections import Counter, defaultdict
from itertools import combinations

import tiktoken

from velar.llm import packing
from .data import DOCS, corpus


def padding(histogram, uppers):
    return sum(n * (min(u for u in uppers if u >= x) - x) for x, n in histogram.items())


def test_bounds_are_optimal():
    rng = random.Random(0)
    for _ in range(60):
        histogram = {x: rng.randint(1, 9) for x in rng.sample(range(1, 40), rng.randint(1, 9))}
        for k in (1, 2, 3, 12):
            got = packing.bounds(histogram, k)
            every = [c for n in range(1, k + 1) for c in combinations(sorted(histogram), n) if c[-1] == max(histogram)]
            assert len(got) <= k and got[-1] == max(histogram)
            assert padding(histogram, got) == min(padding(histogram, c) for c in every)
    assert packing.bounds({}, 4) == [] and packing.bounds({0: 9}, 4) == []


def test_pieces_and_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 40)
    rows = corpus(n=80, seed=9) + [(3, "again a", None, None, None), (None, "no id", None, None, None), (7000, "a" * 3000, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.packed(docs, context=64, buckets=4, token_budget=200).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.TOKENIZER, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for i, t, *_ in rows:
        n = len(encode(t or ""))
        for k in range(max(1, -(-n // 64))):
            want[(i, k, 64 * k, min(64, n - 64 * k))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == want
    histogram = Counter(r.n_tokens for r in got if r.n_tokens)
    uppers = packing.bounds(histogram, 4)
    batches = defaultdict(list)
    for r in got:
        if r.n_tokens == 0:
            assert (r.bucket, r.batch, r.slot) == (None, None, None)
            continue
        assert r.bucket == min(u for u in uppers if u >= r.n_tokens)
        batches[r.bucket, r.batch].append(r.slot)
    for (bucket, batch), slots in batches.items():
        room = 200 // bucket
        last = batch == max(b for u, b in batches if u == bucket)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == room or last and len(slots) <= room)
        assert batch == 0 or (bucket, batch - 1) in batches


def test_long_text_is_cut_where_the_pattern_cuts():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.TOKENIZER, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choices(["a", "bé", " ", "  ", "\n", "7", "'s", "!", " \t"], k=300))
        assert packing._count(encode, text, 10) == len(encode(text))


def test_nothing_to_pack(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    assert packing.packed(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None, 5), (2, "", 6)], "doc_id long, text string, bucket long")
    assert sorted((r.doc_id, r.n_tokens, r.bucket) for r in packing.packed(only).collect()) == [(1, 0, None), (2, 0, None)]
