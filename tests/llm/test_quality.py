import random
import re
from collections import Counter

import numpy as np

from velar.llm import quality
from .data import DOCS, corpus


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_measures_against_brute_force(spark):
    rows = corpus(vocabulary=12) + [(900, "a b c a b c\na b\n\na b\n é|é é", None, None, None), (None, "# a\n# a", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_words", "'x' as vote_length")
    found, model = quality.judged(docs)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found.collect())
    assert got == Counter((r[0], *brute(r[1])) for r in rows)
    assert found.where("quality is null or quality not between 0 and 1").count() == 0
    assert len(model.good) == len(model.bad) == len(quality.RULES) and list(quality.rules()) == quality.RULES
    empty, start = quality.judged(docs.limit(0))
    assert empty.count() == 0 and start.prior == quality.SHARE


def test_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(40000) < 0.85
    good = np.array([[0.02, 0.18, 0.8], [0.05, 0.05, 0.9], [0.01, 0.39, 0.6], [0.1, 0.2, 0.7], [0.03, 0.67, 0.3]])
    bad = np.array([[0.6, 0.3, 0.1], [0.5, 0.2, 0.3], [0.7, 0.2, 0.1], [0.4, 0.4, 0.2], [0.8, 0.15, 0.05]])
    chance = np.where(truth[:, None, None], good, bad).cumsum(2)
    votes = (rng.random((40000, 5, 1)) > chance).sum(2) - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float), rounds=400)
    assert np.abs(np.array(model.good) - good).max() < 0.03 and np.abs(np.array(model.bad) - bad).max() < 0.05
    assert abs(model.prior - 0.85) < 0.02


def test_good_prose_is_kept_and_junk_is_not(spark):
    rng = random.Random(3)
    letters = ["".join(rng.choices("abdeilmnorstu", k=rng.randint(3, 8))) for _ in range(300)]
    prose = lambda: " ".join(f"{' '.join(rng.choices(letters + ['the', 'of', 'and'] * 30, k=12)).capitalize()}." for _ in range(12))
    junk = lambda: " ".join("".join(rng.choices("#$%&*|<>XQ19", k=rng.randint(1, 9))) for _ in range(90))
    rows = [(i, junk() if i % 10 == 0 else prose(), "en", "s", None) for i in range(200)]
    found, _ = quality.judged(spark.createDataFrame(rows, DOCS))
    assert all((r.quality >= 0.5) == (r.doc_id % 10 != 0) for r in found.collect())
