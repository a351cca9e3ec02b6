import base64
import random
from collections import Counter

import tiktoken

import corpus_pipeline
from velar.llm import packing, spans, toxicity
from velar.llm.common import written
from .data import DOCS, corpus
from .test_decontaminate import words
from .test_jaccard import brute as groups
from .test_lines import brute as without_lines
from .test_toxicity import planted


def tables(spark, top):
    rows, labels = planted(n=240, size=12)
    rows += [(1000 + r[0], *r[1:]) for r in corpus(n=30, seed=8)]
    rng = random.Random(0)
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 14]
    bench = [(i, " ".join(rng.choice(texts).split()[2:14])) for i in range(6)] + [(7, None), (8, "")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return rows, bench


def decontaminated(text, bench):
    if text is None:
        return None
    found, low = words(text), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    windows = {tuple(w[i : i + 10]) for _, t in bench for w in [words(t)] for i in range(max(1, len(w) - 9) if w else 0)}
    hit = {k + j for k in range(len(found)) for n in range(1, 11) if tuple(found[k : k + n]) in windows for j in range(n)}
    keep, at, out = 0, 0, ""
    for k, w in enumerate(found):
        start = low.index(w, at)
        at = start + len(w)
        if k in hit:
            if k - 1 not in hit:
                out += text[keep:start]
            keep = at
    return out + text[keep:]


def test_run_against_brute_force(spark, tmp_path):
    top = str(tmp_path)
    rows, bench = tables(spark, top)
    got = corpus_pipeline.run(spark, top).collect()
    read = lambda name: spark.read.parquet(f"{top}/{name}.parquet")
    model, features = toxicity.train(read("documents"), read("labels")), toxicity.Features()
    docs = [(r[0], r[1]) for r in rows if r[1] is None or model.score(features(r[1].encode())) < 0.5]
    assert 15 < len(rows) - len(docs) < 60
    docs = list(without_lines(docs, 2, 16).items())
    docs = [(i, t) for (i, t), (_, c) in zip(docs, groups(docs, 0.8)[0]) if i == c]
    docs = [(i, decontaminated(t, bench)) for i, t in docs]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.TOKENIZER, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for i, t in docs:
        n = len(encode(t or ""))
        for k in range(max(1, -(-n // 2048))):
            want[i, k, min(2048, n - 2048 * k)] += 1
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == want
    uppers = packing.bounds(Counter(r.n_tokens for r in got), 8)
    assert all(r.bucket == (min(u for u in uppers if u >= r.n_tokens) if r.n_tokens else None) for r in got)


def test_stages_bear_empty_tables_and_more_columns(spark, tmp_path):
    top = str(tmp_path)
    tables(spark, top)
    docs = spark.read.parquet(f"{top}/documents.parquet")
    names = ["id", "h", "fp", "_toxic", "_gone", "_lines", "_removed", "row", "c0", "a.b", "back`quote", "spans", "key", "part one"]
    odd = docs.selectExpr("*", *(f"doc_id as `{c.replace('`', '``')}`" for c in names), "named_struct('in.ner', doc_id) as nested")
    for part in (odd.limit(0), odd.where("doc_id < 40 or doc_id > 1050")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            new = stage(spark, part, top)
            if k == 4:
                new.count()
                break
            assert new.columns == part.columns
            part = written(new)
            for r in part.collect():
                assert all(r[c] == r["doc_id"] for c in names) and r["nested"][0] == r["doc_id"]


def test_spans_and_lines_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", 5, 6), (2, "x a b c d e f g h i j k l m n", 7, 8)], "doc_id long, text string, _words long, `a.b` long")
    assert sorted(tuple(r) for r in spans.deduplicated(docs, counts=False).collect()) == [(1, "a b c d e f g h i j k l m n", 5, 6), (2, "x", 7, 8)]
    assert sorted(tuple(r) for r in spans.deduplicated(docs).collect()) == [(1, "a b c d e f g h i j k l m n", 6, 14, 0), (2, "x", 8, 15, 14)]
