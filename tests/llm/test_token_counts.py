import random
import unicodedata

import numpy as np
import pytest

from velar.llm import token_counts
from velar.llm.common import written
from velar.llm.token_counts import Counter, default_tokenizer, spec_of

PARTS = [*"abcaeinorst  \n\t'’0129_-!?<|>ß", "'re", "'ve ", "they'll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "İ", "Σ", "ΑΣ", "²", "漢", "😀"]
PARTS += ["가", "ﬁ", "ก็", " ", " ", "​", "́", "Å", "x́", "\x00", "\x1c", "\x85", "'l", "Wonderful", "internationalisation"]


@pytest.fixture(scope="module")
def counter():
    return Counter(spec_of(default_tokenizer()))


def library(counter, text):
    return len(counter.library.encode(text, add_special_tokens=False).ids)


def random_texts(n, seed, length=12):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, length))) for _ in range(n)]


def test_totals_are_the_librarys(counter):
    texts = random_texts(1500, 1, 30)
    assert counter.of(texts) == [library(counter, t) for t in texts]


def test_every_prefix_is_the_librarys_count_of_it(counter):
    for text in random_texts(250, 2):
        form = unicodedata.normalize("NFC", text)
        got = [int(n) for run in counter.at_prefixes(text) for n in run]
        assert got == [library(counter, form[:k]) for k in range(1, len(form) + 1)], text


def test_long_words_and_single_tokens(counter):
    rng = random.Random(3)
    words = ["".join(rng.choices("aeinrstlohdcu", k=k)) for k in (63, 64, 65, 200, 3000)] + ["a" * 500, "ha" * 90, "é" * 70]
    words += [bytes(t).decode() for t in (b"the", b"a", b"s")]
    assert counter.bpe.totals([w.encode() for w in words]) == [library(counter, w) for w in words]
    pre = counter.bpe.at_prefixes([w.encode() for w in words[:4]])
    assert [p.tolist() for p in pre] == [[library(counter, w[:k]) for k in range(1, len(w) + 1)] for w in words[:4]]


def test_what_is_remembered_does_not_change_counts(monkeypatch, counter):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 5)
    monkeypatch.setattr(token_counts, "STRETCH", 7)
    fresh = Counter(spec_of(default_tokenizer()))
    for text in random_texts(60, 4, 40):
        assert fresh.total(text) == library(counter, text)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        spec_of(public_tokenizers.path("byte_bpe_50k.json"))


def test_table_of_prefixes_answers_budgets(spark, counter):
    big = " ".join(random.Random(5).choices(["one", "twofold", "threescore", "x"], k=30000))
    assert len(big) > 2 * token_counts.PART
    texts = ["", None, "Hello there, they're here", "hello", "hello", big] + random_texts(20, 6, 30)
    rows = [(None if k % 5 == 0 else 7, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, row int").repartition(3)
    table = written(token_counts.prefixes(docs)).persist()
    assert table.select("row").distinct().count() == len(rows) == table.where("last").count()
    wanted = {i: sorted(library(counter, t or "") for k, t in enumerate(texts) if rows[k][0] == i) for i in (None, 7)}
    for i, tokens in wanted.items():
        assert sorted(r.n_tokens for r in token_counts.fits(table, 5).collect() if r.id == i) == tokens
    assert all(r.fits == (r.n_tokens <= 5) for r in token_counts.fits(table, 5).collect())
    for budget in (0, 3, 20000):
        want = []
        for i, t, *_ in rows:
            form = unicodedata.normalize("NFC", t or "")
            every = [int(n) for run in counter.at_prefixes(t or "") for n in run]
            n = max((k + 1 for k, c in enumerate(every) if c <= budget), default=0)
            want.append((i, n, library(counter, form[:n])))
        got = [(r.id, r.n_chars, r.n_tokens) for r in token_counts.truncated(table, budget).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_counted_table(spark, counter):
    texts = random_texts(40, 7, 30) + ["", None, "same", "same"]
    rows = [(k // 2 if k % 3 else None, t, "n") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "`my.id` long, text string, n_tokens string")
    got = sorted((tuple(r) for r in token_counts.counted(docs, id_col="my.id").collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), library(counter, t or "")) for i, t, _ in rows), key=str)
    assert token_counts.counted(docs.limit(0), id_col="my.id").count() == 0
    assert token_counts.truncated(token_counts.prefixes(docs.limit(0), id_col="my.id"), 3).count() == 0
    assert np.array_equal(np.concatenate([*counter.at_prefixes(""), np.empty(0)]), [])
