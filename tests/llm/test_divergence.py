import random
import re
from collections import Counter, defaultdict

from velar.llm import divergence

WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, text string, `a.b` string, source string, share int"


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, text, _, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: of(counts[lang, s]) for s in sources}
        q = of(sum((counts[lang, s] for s in sources), Counter()))
        for a in sources:
            pairs = [(-sum(abs(p[a][t] - p[b][t]) for t in kept), b.encode(), b) for b in sources if b != a]
            terms = [(q[t] - p[a][t], t, t.decode()) for t in kept if counts[lang, a][t] and p[a][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = enumerate(sorted(found)[: top if part == "term" else None], 1)
                out += [(lang, a, part, item, -value, k) for k, (value, _, item) in ranked]
    return sorted(out)


def corpus(n, seed, sources):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Rot", "é", "blau", "日本", "x", "Ä") for b in ("", "a", "bb", "ß")]
    own = {s: rng.sample(words, 9) for s in sources}
    rows = []
    for _ in range(n):
        source = sources[0] if rng.random() < 0.4 else rng.choice(sources)
        text = " 1,".join(rng.choices(own[source], k=rng.randint(0, 30)))
        rows.append((rng.choice(["en", "fr", None, "xx"]) if rng.random() < 0.9 else "rare", text, "x", source, 3))
    return rows + rows[:5] + [("en", None, None, None, None), ("lonely", "word", None, "s", None), (None, None, None, "s2", None), (None, "", None, None, None)]


def run(spark, rows, **options):
    got = divergence.audited(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == "lang string, source string, part string, item string, value bigint, rank int"
    return sorted(tuple(r) for r in got.collect())


def test_against_brute_force(spark):
    rows = corpus(300, 1, ["a", "b", "Ω", "z2", None, ""])
    want = brute(rows, 6, 4)
    assert run(spark, rows, least=6, top=4) == want and {w[2] for w in want} == {"pair", "term"}


def test_spills_and_shares_do_not_change_results(spark):
    rows = corpus(200, 2, ["a", "b", "c"])
    want = brute(rows, 3, 50)
    assert run(spark, rows, least=3, most=7, shares=2) == want == run(spark, rows, least=3, shares=1)


def test_very_long_text_and_many_sources(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices(["alpha", "Beta", "gamma9delta"], k=250_000))
    assert len(long) > 1 << 20
    rows = [("en", long, None, "big", 0)] + [("en", "alpha beta " * (k % 4), None, f"s{k:03}", 0) for k in range(60)]
    assert run(spark, rows, least=2) == brute(rows, 2, 50)


def test_empty_table_and_nothing_kept(spark):
    assert run(spark, []) == []
    rows = [("en", "a b", None, s, 1) for s in "xyz"]
    assert run(spark, rows, least=30) == brute(rows, 30, 50) and len(brute(rows, 30, 50)) == 6


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(4)
    rows = [(n := rng.randint(1, 9 * 10**15), rng.randint(0, n)) for _ in range(200)] + [(1, 1), (9 * 10**15, 9 * 10**15)]
    got = spark.createDataFrame(rows, "size long, count long").select("size", "count", divergence.share(divergence.F.col("count"), divergence.F.col("size")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * r["count"] // r["size"] for r in got)
