"""Document quality by weak supervision.

Rules look at simple measures of a text and vote good, bad, or abstain. Which votes fall together is counted over all
documents: at most 3 ** len(RULES) patterns, whatever the corpus. Expectation-maximisation over those counts estimates
each rule's accuracy (how often its vote is right where it votes) and the share of good documents, with no labels.
The posterior probability of good, given a document's votes, replaces an all-must-pass filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, texts, word_pieces, written

SYMBOLS = b"#*$%&|<>"
UNCOUNTED = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])  # white space, and what continues a code point
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in "the of and to in a is that for it was on with as are le la les de des du et un une est que qui dans pour der die das und ist ein eine nicht mit zu von den el los las y en por con una del se no".split()
)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_function", "n_alpha", "n_upper", "n_distinct"]


def measures(text: bytes) -> list[int]:
    """MEASURES of one text; all are zero for an empty one."""
    ids: dict[bytes, int] = {}
    parts = []
    n_function = n_alpha = n_upper = 0
    for words in word_pieces(text, None):
        part = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        parts.append(part)
    seq = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    counts = np.bincount(seq, minlength=len(ids)).tolist()
    for w, n in zip(ids, counts):
        bare = w.strip(b".,;:!?\"'()")
        n_function += n * (bare.lower() in FUNCTION_WORDS)
        n_alpha += n * (bare.isalpha() or bool(bare) and bare[0] >= 128 and not bare.isdigit())
        n_upper += n * (len(bare) > 1 and bare.isupper())
    seen: set[bytes] = set()
    n_lines = n_dup = n_stops = 0
    for line in text.split(b"\n"):
        bare = line.strip()
        if bare:
            n_lines += 1
            n_stops += bare[-1:] in (b".", b"!", b"?", b'"', b":")
            n_dup += line in seen
            seen.add(line)
    repeat = 0
    if len(seq) >= 4:
        size = len(ids)
        pair = seq[:-1] * size + seq[1:]
        if size >= 1 << 20:  # the product of three would not fit
            _, pair = np.unique(pair, return_inverse=True)
        key = pair[:-1] * size + seq[2:]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        cover = np.zeros(len(seq), bool)
        for k in range(3):
            cover[k : len(seq) - 2 + k] |= twice
        repeat = int(cover.sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return [len(seq), len(text.translate(None, UNCOUNTED)), symbols, n_dup, repeat, n_lines, n_stops, n_function, n_alpha, n_upper, len(ids)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, MEASURES): one row per row of docs; null text counts as empty. Other columns are not read."""
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def run(batches):
        for batch in batches:
            rows = np.array([measures(t) for t in binaries(batch.column(1))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in rows.T]], names=["id", *MEASURES])

    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("id", id_col)


def _rule(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name and vote (1 good, -1 bad, 0 abstains) of each rule, from MEASURES. A null condition abstains."""
    words, lines_ = F.col("n_words"), F.col("n_lines")
    some = words > 0
    mean = F.try_divide("word_chars", "n_words")
    return {
        "length": _rule(words >= 80, words < 50),
        "word_length": _rule(mean.between(3.5, 9), ~mean.between(2.5, 12)),
        "symbols": _rule(some & (F.col("n_symbols") * 50 <= words), F.col("n_symbols") * 10 > words),
        "repeated_lines": _rule((lines_ > 1) & (F.col("n_dup_lines") * 20 <= lines_), F.col("n_dup_lines") * 10 > lines_ * 3),
        "repeated_words": _rule(some & (F.col("n_repeat_words") * 20 <= words), F.col("n_repeat_words") * 10 > words * 3),
        "line_ends": _rule((lines_ > 0) & (F.col("n_stops") * 10 >= lines_ * 7), F.col("n_stops") * 5 < lines_),
        "function_words": _rule(F.col("n_function") * 10 >= words, F.col("n_function") * 50 < words) * some.cast("int"),
        "letters": _rule(some & (F.col("n_alpha") * 10 >= words * 9), F.col("n_alpha") * 10 < words * 6),
        "capitals": _rule(F.lit(False), F.col("n_upper") * 5 > words),
        "variety": _rule((words >= 50) & (F.col("n_distinct") * 10 >= words * 3), (words >= 50) & (F.col("n_distinct") * 10 < words)),
    }


RULES = list("length word_length symbols repeated_lines repeated_words line_ends function_words letters capitals variety".split())


#: Where estimation starts, and what it is drawn to: chances of a bad vote, no vote and a good vote.
START = {"good": (0.03, 0.22, 0.75), "bad": (0.35, 0.35, 0.30)}
SHARE, PSEUDO = 0.85, 20.0


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; good, bad: for each of RULES the chances of its votes -1, 0, 1 in that class.

    A rule's accuracy on good documents is the chance of 1 there, on bad ones that of -1.
    """

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def posterior(self) -> Column:
        """Probability of good from the columns vote_<rule>."""
        logit = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for name, g, b in zip(RULES, self.good, self.bad):
            minus, none, plus = (float(np.log(x / y)) for x, y in zip(g, b))
            logit = logit + F.when(F.col(f"vote_{name}") == -1, minus).when(F.col(f"vote_{name}") == 1, plus).otherwise(none)
        return 1 / (1 + F.exp(-logit))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Fit to vote patterns (rows of -1, 0, 1) and how many documents have each.

    Each estimate is drawn towards START and SHARE by PSEUDO votes. A bad vote never speaks for good, nor a good vote
    for bad: where an estimate says so, both classes take their common chance. Without documents the start stands.
    """
    n = patterns.shape[1]
    start = {c: np.tile(np.array(START[c]), (n, 1)) for c in START}
    chance, p = dict(start), SHARE
    cast = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # pattern x rule x vote
    for _ in range(rounds if len(patterns) else 0):
        ratio = np.log(chance["good"]) - np.log(chance["bad"])
        z = np.log(p / (1 - p)) + np.einsum("prv,rv->p", cast, ratio)
        good = counts / (1 + np.exp(-np.clip(z, -500, 500)))
        for name, weight in (("good", good), ("bad", counts - good)):
            sums = np.einsum("p,prv->rv", weight, cast) + PSEUDO * start[name]
            chance[name] = sums / sums.sum(1, keepdims=True)
        for v, sign in ((0, 1), (2, -1)):
            wrong = sign * (chance["good"][:, v] - chance["bad"][:, v]) > 0
            both = (chance["good"][wrong, v] + chance["bad"][wrong, v]) / 2
            for name in chance:
                chance[name] = chance[name].copy()
                chance[name][wrong, v] = both
                chance[name] /= chance[name].sum(1, keepdims=True)
        p = float(np.clip((good.sum() + PSEUDO * SHARE) / (counts.sum() + PSEUDO), 0.05, 0.99))
    rows = {c: tuple(tuple(float(x) for x in r) for r in chance[c]) for c in chance}
    return LabelModel(p, rows["good"], rows["bad"])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, LabelModel]:
    """(id_col, MEASURES, vote_<rule>..., quality): the posterior of each row of docs; and the model behind it.

    Repeated rows each get a row and count each. Posteriors are equal for equal votes, so ties need no rule. Very long
    texts are read whole. An empty table gives an empty result and the model's start.
    """
    found = measured(docs, id_col, text_col)
    voted = written(found.withColumns({f"vote_{k}": F.coalesce(v, F.lit(0)).cast("int") for k, v in rules().items()}))
    votes = [f"vote_{k}" for k in RULES]
    rows = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(RULES)
    rows.sort(key=lambda r: tuple(r))
    patterns = np.array([[r[v] for v in votes] for r in rows], np.float64).reshape(-1, len(votes))
    model = expectation_maximisation(patterns, np.array([r["n"] for r in rows], np.float64))
    return voted.withColumn("quality", model.posterior()), model


