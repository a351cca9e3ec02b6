"""Every registered query of the subpackage as it is registered, on a small folder of tables, against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from velar.llm import language, licenses, packing, queries, token_counts, toxicity
from . import test_centroids, test_decontaminate, test_divergence, test_licenses, test_lines, test_lm, test_quality, test_simhash, test_spans
from .data import DOCS, corpus

TYPES = {
    "op1_lines": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op2_spans": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, quality double",
    "op6_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_lm_score": "doc_id bigint, n_tokens bigint, ce_target double, ce_background double, score double",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op11_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op12_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op13_centroids": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op10_packing": "doc_id bigint, piece bigint, start bigint, n_tokens bigint, bucket bigint, batch bigint, slot bigint",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with copies, near copies, empty and null texts, and a text of over a megabyte."""
    rng = random.Random(12)
    top = str(tmp_path_factory.mktemp("tables"))
    rows = [(r[0], r[1], rng.choice(["en", "fr", None]), "s", r[4]) for r in corpus(n=30, seed=11, vocabulary=30)]
    big = "\n".join(" ".join(rng.choices([f"big{i}é" for i in range(50)], k=5000)) for _ in range(36))
    assert len(big.encode()) > 1 << 20
    rows += [(5000, big, "en", "s", len(big)), (5001, "MIT License and cc by\n# CC-BY x", "fr", "s", 9), (5002, "Wé1 w2 w3 apache license", None, "s", 9)]
    bench = [(k, " ".join(rng.choice(rows[:30])[1].split()[2:14])) for k in range(5)] + [(9, " ".join(big.split()[70000:70012])), (10, None), (11, "")]
    labels = [(r[0], rng.randint(0, 1), int(r[0] % 7 == 0)) for r in rows if r[0] % 2] + [(None, 1, 1), (99999, 1, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    vectors = test_centroids.vectors(60, 64, 13)
    spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return top, rows, bench, labels


def run(spark, folder, name):
    df = queries.QUERIES[name](spark, folder[0])
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == TYPES[name]
    return sorted((tuple(r) for r in df.collect()), key=str)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_lines_query(spark, folder):
    rows = [r[:2] for r in folder[1]]
    kept = test_lines.brute(rows, 2, 16)
    n = lambda t: sum(bool(x.strip()) for x in (t or "").split("\n"))
    assert run(spark, folder, "op1_lines") == sorted(((i, n(t), n(t) - n(kept[i]), sha(kept[i])) for i, t in rows), key=str)


def test_spans_query(spark, folder):
    want = test_spans.brute([r[:2] for r in folder[1]], 13)
    texts = {r[0]: r[1] for r in folder[1]}
    # the contract's kept words are joined by one space; a text that loses none is its words as well
    assert run(spark, folder, "op2_spans") == sorted(((i, n, gone, sha(kept) if texts[i] else sha("")) for i, n, gone, kept in want), key=str)


def test_simhash_query(spark, folder):
    want = test_simhash.brute([r[:2] for r in folder[1]])
    assert run(spark, folder, "op3_simhash") == sorted(((i, f"{p:016x}", c) for i, (p, c) in want.items()), key=str)


def test_decontaminate_query(spark, folder):
    want = test_decontaminate.brute([r[:2] for r in folder[1]], [(str(k), t) for k, t in folder[2]], 10)
    rows = [(i, n, hit, len(x.split(",")) if x else 0, sha(x), hit > 0) for i, n, hit, x in want]
    assert run(spark, folder, "op4_decontaminate") == sorted(rows, key=str) and sum(r[2] for r in rows) > 40


def test_quality_query(spark, folder):
    got = run(spark, folder, "op5_quality")
    base = {r[0]: test_quality.brute(r[1]) for r in folder[1]}
    for i, *measures, failed, kept, quality in got:
        assert tuple(measures) == base[i]
        assert failed == (base[i][0] < 50 or 100 * base[i][4] > 50 * base[i][0]) and kept == (not failed and quality >= 0.5)
    assert len(got) == len(base)


def grams(text):
    """Letters with word borders in runs of one to three, by plain steps."""
    out = Counter()
    flat = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in flat:
        flat = flat.replace("  ", " ")
    for k in range(len(flat)):
        for n in (1, 2, 3):
            if k + n <= len(flat) and not (n == 1 and flat[k] == " "):
                out[flat[k : k + n]] += 1
    return out


def bucket(gram):
    code = 0
    for c in gram:
        code = code * 1000003 + ord(c)
    code += {1: 1 << 40, 2: 1 << 41, 3: 0}[len(gram)]
    return (code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 50


def test_language_query(spark, folder):
    counts, docs = {}, Counter()
    sums = lambda t: Counter({b: sum(n for g, n in grams(t).items() if bucket(g) == b) for b in {bucket(g) for g in grams(t)}})
    for i, t, lang, *_ in folder[1]:
        if fold(i, 3) != 1 and lang and any(c.isalpha() for c in t or ""):
            counts.setdefault(lang, Counter()).update(sums(t))
            docs[lang] += 1
    got = {r[0]: r[1:] for r in run(spark, folder, "op6_language")}
    assert len(got) == len(folder[1])
    for i, t, *_ in folder[1]:
        held, lang, score = got[i]
        assert held == (fold(i, 3) == 1)
        if not any(c.isalpha() for c in t or ""):
            assert (lang, score) == ("und", 0.0)
            continue
        z = {}
        for k, c in counts.items():
            total = c.total() + 0.5 * language.DIM
            z[k] = np.log(docs[k] / docs.total()) + sum(n * np.log((c[b] + 0.5) / total) for b, n in sums(t).items())
        best = max(sorted(z), key=z.get)
        assert lang == best or abs(z[best] - z[lang]) < 1e-2
        assert score == pytest.approx(1 / sum(np.exp(v - z[lang]) for v in z.values()), abs=2e-3)


def test_lm_query(spark, folder):
    good = {i for i, q, _ in folder[3] if q == 1 and i is not None}
    want = test_lm.brute([r[:2] for r in folder[1]], good, 4.0)
    got = run(spark, folder, "op7_lm_score")
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        if w[2] is None:
            assert g[2:] == (None, None, None)
        else:
            assert g[2:] == pytest.approx((w[2], w[3], w[3] - w[2]), rel=1e-8, abs=1e-8)


def test_toxicity_query(spark, folder):
    read = lambda name: spark.read.parquet(f"{folder[0]}/{name}.parquet")
    keep = lambda df: df.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
    model, features = toxicity.train(keep(read("documents")), keep(read("labels"))), toxicity.Features()
    want = []
    for i, t, *_ in folder[1]:
        z = sum(float(model.weights[b]) for b in features((t or "").encode())) + model.bias
        want.append((i, fold(i, 5) == 0, 1 / (1 + np.exp(-z))))
    for g, w in zip(run(spark, folder, "op8_toxicity"), sorted(want, key=str)):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-5) and g[3] == int(g[2] >= 0.5)


def test_licenses_query(spark, folder):
    want = {}
    for i, t, *_ in folder[1]:
        n, places = test_licenses.places(t)
        first, last = (places[0][0], max(p for p, _ in places)) if places else (None, None)
        want[i] = (n, len(places), first, last, ",".join(sorted({x for _, x in places})))
    ordered = licenses.rules()
    texts = {r[0]: r[1] for r in folder[1]}
    for i, *base, labels, score in run(spark, folder, "op9_licenses"):
        assert tuple(base) == want[i] and 0 <= score <= 1
        found = {x[2] for x in licenses.detections((texts[i] or "").encode().translate(licenses.LOWER), ordered)}
        assert labels == ",".join(sorted({*want[i][4].split(","), *found} - {""}))
    assert sum(w[1] for w in want.values()) == 4  # MIT License, cc by, CC-BY, apache license


def test_packing_query(spark, folder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.TOKENIZER, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for i, t, *_ in folder[1]:
        n = len(encode(t or ""))
        want.update((i, k, 2048 * k, min(2048, n - 2048 * k)) for k in range(max(1, -(-n // 2048))))
    got = run(spark, folder, "op10_packing")
    assert Counter(r[:4] for r in got) == want
    uppers = packing.bounds(Counter(r[3] for r in got), 8)
    assert all(r[4] == (min(u for u in uppers if u >= r[3]) if r[3] else None) for r in got)
    places = Counter((r[4], r[5], r[6]) for r in got if r[3])
    assert max(places.values()) == 1 and all(slot < 65536 // bucket for bucket, _, slot in places)


def test_token_counts_query(spark, folder):
    library = Tokenizer.from_file(token_counts.default_tokenizer())
    n = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in folder[1]}
    want = [(r[0], len((r[1] or "").encode()), n[r[0]], n[r[0]] > 2048) for r in folder[1]]
    assert run(spark, folder, "op11_token_counts") == sorted(want, key=str)


def test_divergence_query(spark, folder):
    want = test_divergence.brute([(r[2], r[1], None, r[3], None) for r in folder[1]], 30, 50)
    assert run(spark, folder, "op12_divergence") == sorted(want, key=str)


def test_centroids_query(spark, folder):
    rows, ends = test_centroids.brute(test_centroids.vectors(60, 64, 13), 8, 10, 64, 1024)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in ends]
    inertia = Counter()
    for _, c, d in rows:
        inertia[c] += d
    want = [(i, c, d, inertia[c], inertia.total(), marks[c]) for i, c, d in rows]
    assert run(spark, folder, "op13_centroids") == sorted(want, key=str)


def test_null_and_repeated_ids_spread_over_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 50)
    rows = [(None, f"only words {k}") for k in range(400)] + [(7, "the same row")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cut = packing.pieces(docs, 64).selectExpr("pmod(at, 16) as slice").groupBy("slice").count().collect()
    assert len(cut) == 16 and max(r["count"] for r in cut) < 110
    got = packing.packed(docs, context=64, buckets=2, token_budget=64).collect()
    assert len(got) == 800 and max(Counter((r.bucket, r.batch, r.slot) for r in got).values()) == 1


def test_risk_and_gradient_by_hand():
    """One step of training follows the class-prior-corrected risk: finite differences of it give the same direction."""
    rng = np.random.default_rng(1)
    pos = [np.unique(rng.integers(1, 30, 6)).astype(np.int32) for _ in range(20)]
    unl = [np.unique(rng.integers(1, 60, 6)).astype(np.int32) for _ in range(50)]
    soft = lambda z: np.logaddexp(0, z)

    def risk(w, b, prior):
        zp, zu = (np.array([w[x].sum() + b for x in side]) for side in (pos, unl))
        negative = soft(zu).mean() - prior * soft(zp).mean()
        return (prior * soft(-zp).mean() + negative, negative)

    prior, w, b = 0.2, np.zeros(toxicity.DIM), -1.0
    assert risk(w, b, prior)[1] >= 0
    model = toxicity.fit(pos, unl, prior, epochs=1, rate=0.02, decay=0.0, significance=-1e9, batch=1000)
    step = model.weights.astype(float)
    for k in range(1, 60):
        e = np.zeros(toxicity.DIM)
        e[k] = 1e-5
        slope = (risk(w + e, b, prior)[0] - risk(w - e, b, prior)[0]) / 2e-5
        if abs(slope) > 1e-6:  # the first step of Adam is as long as the rate, against the slope
            assert step[k] == pytest.approx(-0.02 * np.sign(slope), rel=1e-3), k
