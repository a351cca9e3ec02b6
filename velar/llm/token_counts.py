"""Exact token counts of texts and of all their prefixes, for tokenizers that merge byte pairs within words.

The text is cut into words as the tokenizer cuts it; PrefixBpe says how many tokens each prefix of a word has, and a
running sum over the words before it makes that the count of the text's prefix. Words are worked out once for each
task's share of texts, all new ones of a piece of text together. `prefixes` stores the count at every code point;
`truncated` and `fits` answer from that table what a budget of tokens holds, and encode nothing.

How characters are folded and told apart is asked of the tokenizer's own library, once for each character. Texts with
a character that our pattern sees in another way, or that aren't in normal form C, go through the library's normalizer
and pre-tokenizer instead.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, texts
from .prefix_bpe import PrefixBpe

VOCABULARY = "word_bpe_49k.json"
#: The steps of the tokenizer files that are read here.
NORMAL_STEPS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same words by Python's classes, for texts of which all characters are known to be the same in both.
WORDS_HERE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space here, but not there
LARGEST_VOCABULARY = 64 << 20  # bytes of a tokenizer file, which goes to all tasks
KEPT_WORDS = 800_000  # words whose counts a worker remembers; more start anew
STRETCH = 1 << 20  # characters of a text that are cut into words at a time
PART = 1 << 16  # counts in a row of the table of prefixes


def default_tokenizer() -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def spec_of(path: str) -> str:
    """The text of a tokenizer file, if it is one that can be counted here."""
    data = Path(path).read_bytes()
    if len(data) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} is larger than {LARGEST_VOCABULARY} bytes")
    spec = json.loads(data)
    model, steps = spec["model"], [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cutters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    plain = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["dropout"] or model["ignore_merges"] or steps != NORMAL_STEPS or cutters[0].get("pattern") != {"Regex": WORDS} or not plain:
        raise ValueError(f"{path}: not a tokenizer of this kind")
    return data.decode()


class Counter:
    """Token counts by one tokenizer file; what it remembers is bounded and doesn't change results."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        read = json.loads(spec)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in read["model"]["merges"]]
        self.bpe = PrefixBpe(pairs, read["model"]["end_of_word_suffix"])
        self.library = Tokenizer.from_str(spec)
        self.special = sorted((t["content"] for t in read["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.same: set[str] = set()
        self.other: set[str] = set()
        self.totals: dict[str, int] = {}
        self.inner: dict[str, np.ndarray] = {}
        self.letters_held = 0

    def _library_words(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        normal = self.library.normalizer.normalize_str(text)
        return normal, [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _known(self, text: str) -> bool:
        """Whether the text's words can be found by Python's own lower() and classes."""
        if text.isascii() and not SEPARATORS.search(text):
            return True
        if not unicodedata.is_normalized("NFC", text):
            return False
        for c in set(text) - self.same - self.other:
            probe = f"a{c}a !{c}! {c}{c} '{c}"
            normal, at = self._library_words(probe)
            here = probe.lower()
            alike = normal == re.sub(r"\s+", " ", here) and len(here) == len(probe) and [normal[a:b] for a, b in at] == WORDS_HERE.findall(here)
            # a capital sigma is folded by its place in the word here, and by itself there
            (self.same if alike and c != "Σ" else self.other).add(c)
        return self.other.isdisjoint(text)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, folded."""
        if self._known(text):
            return WORDS_HERE.findall(text.lower())
        normal, at = self._library_words(text)
        return [normal[a:b] for a, b in at]

    def stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in order, in runs of about STRETCH characters that end before a blank or a line's end, and special tokens."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield part, True
                continue
            at = 0
            while at < len(part):
                end = at + STRETCH
                while end < len(part) and part[end] not in " \n":
                    end += 1
                yield part[at:end], False
                at = end

    def _learn(self, words: set[str]) -> None:
        """Makes sure that the counts of these words are known, all new ones worked out together."""
        new = words - self.totals.keys()
        if new:
            if len(self.totals) + len(new) > KEPT_WORDS:
                self.totals, new = {}, words
            new = list(new)
            self.totals.update(zip(new, self.bpe.totals([w.encode() for w in new])))

    def _total(self, words: list[str]) -> int:
        self._learn(set(words))
        return sum(map(self.totals.__getitem__, words))

    def total(self, text: str) -> int:
        """How many tokens the text has."""
        return self.of([text])[0]

    def of(self, many: list[str]) -> list[int]:
        """How many tokens each text has. About STRETCH characters of words are held at a time."""
        out, held, size = [0] * len(many), [], 0
        for k, text in enumerate(many):
            for part, special in self.stretches(text):
                if special:
                    out[k] += 1
                    continue
                held.append((k, self.words(part)))
                size += len(part)
                if size >= STRETCH:
                    self._settle(out, held)
                    held, size = [], 0
        self._settle(out, held)
        return out

    def _settle(self, out: list[int], held: list[tuple[int, list[str]]]) -> None:
        self._learn(set().union(*(words for _, words in held)))
        for k, words in held:
            out[k] += sum(map(self.totals.__getitem__, words))

    def learn(self, many: list[str]) -> None:
        """Works out the words of several short texts together, ahead of at_prefixes."""
        self._inner(set().union(*(self.words(part) for text in many for part, special in self.stretches(text) if not special)))

    def _inner(self, words: set[str]) -> None:
        """Learns the counts at the prefixes of these words."""
        new = words - self.inner.keys()
        if not new:
            return
        if self.letters_held + sum(map(len, new)) > KEPT_WORDS * 8:
            self.inner, self.letters_held, new = {}, 0, words
        self.letters_held += sum(map(len, new))
        new = list(new)
        self.inner.update(zip(new, self.bpe.at_prefixes([w.encode() for w in new])))
        for w in new:
            if w in ("'re", "'ve", "'ll"):  # one word, of which the first two characters are two
                self.inner[w] = np.array([self._total(WORDS_HERE.findall(w[:k])) for k in range(1, len(w) + 1)])

    def normal(self, text: str) -> tuple[str, str, np.ndarray | None]:
        """The text in normal form C, the same folded, and where each character's fold ends if folds differ in length."""
        if self._known(text):
            return text, text.lower(), None
        form = unicodedata.normalize("NFC", text)
        fold = self.library.normalizer.normalizers[2] if hasattr(self.library.normalizer, "normalizers") else self.library.normalizer[2]
        each = [fold.normalize_str(c) for c in form]
        return form, "".join(each), np.cumsum([len(x) for x in each])

    def at_prefixes(self, text: str) -> Iterator[np.ndarray]:
        """Counts at all prefixes of the text in normal form C, the empty one left out, in runs."""
        before, tail = 0, ""  # tokens so far, and the last word if nothing stands between it and what follows
        for part, special in self.stretches(text):
            if special:
                less = before - (self._total([tail]) if tail else 0)
                yield np.array([less + self._total(self.words(tail + part[:k])) for k in range(1, len(part))] + [before + 1], np.int32)
                before, tail = before + 1, ""
                continue
            form, folded, ends = self.normal(part)
            if ends is None:
                at = [m.span() for m in WORDS_HERE.finditer(folded)]
            else:
                at = [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(folded)]
            words = [folded[a:b] for a, b in at]
            self._inner(set(words))
            inner = [self.inner[w] for w in words]
            counts = np.zeros(len(folded), np.int64)
            if words:
                sizes = np.array([b - a for a, b in at])
                starts = np.array([a for a, _ in at])
                whole = np.array([c[-1] for c in inner])
                sums = np.cumsum(whole)
                inside = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                step = np.zeros(len(folded) + 1, np.int64)
                np.add.at(step, starts + sizes, whole)
                counts = np.cumsum(step)[1 : len(folded) + 1]  # after the last whole word that ended by then
                counts[inside] = np.concatenate(inner) + np.repeat(sums - whole, sizes)
            total = int(counts[-1])
            yield (counts if ends is None else counts[ends - 1]).astype(np.int32) + before
            tail = words[-1] if words and at[-1][1] == len(folded) else ""
            before += total


@lru_cache(maxsize=2)
def _counter(spec: str) -> Counter:
    return Counter(spec)


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    kind = dict(docs.select(F.col(f"`{id_col}`").alias("id")).dtypes)["id"]
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return texts(named, "id"), kind


def counted(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens): one row for each row of docs, its text's bytes in UTF-8 and its tokens.

    Strings of special tokens inside a text count as those tokens, as they do by default in the tokenizer's library.
    Null and empty texts have none. Rows that repeat and null ids count each. Very long texts are counted whole, a
    stretch at a time. An empty table gives an empty result; other columns, whatever their names, aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec_of(tokenizer or default_tokenizer()))
    source, kind = _source(docs, id_col, text_col)

    def run(batches):
        count = _counter(held.value)
        for batch in batches:
            data = binaries(batch.column(1))
            sizes = pa.array([len(t) for t in data], pa.int64())
            tokens = pa.array(count.of([t.decode(errors="replace") for t in data]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens], names=["id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")


def prefixes(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, part, start, counts, last): counts[i] is the number of tokens of the text's first start + i + 1 characters.

    Characters are code points of the text in normal form C, in which the tokenizer reads it. A text takes as many
    parts of 65,536 counts as it needs, the last one marked; null and empty texts have one empty part. row tells rows of
    docs apart where ids are null or repeat; write the table before you use it twice. Very long texts are held by parts.
    An empty table gives an empty result; other columns, whatever their names, aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec_of(tokenizer or default_tokenizer()))
    source, kind = _source(docs, id_col, text_col)

    def run(batches):
        count, row = _counter(held.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            every = [t.decode(errors="replace") for t in binaries(batch.column(1))]
            size = 0
            for k, text in enumerate(every):
                if size <= 0:
                    ahead = []
                    while k + len(ahead) < len(every) and (size := size + len(every[k + len(ahead)])) < STRETCH:
                        ahead.append(every[k + len(ahead)])
                    count.learn(ahead)
                size -= len(text)
                row += 1
                waiting, start, part = np.empty(0, np.int32), 0, 0
                for run_ in chain(count.at_prefixes(text), [None]):
                    waiting = waiting if run_ is None else np.concatenate((waiting, run_))
                    while len(waiting) > PART or run_ is None:
                        here, waiting = waiting[:PART], waiting[PART:]
                        over = run_ is None and not len(waiting)
                        columns = [batch.column(0).slice(k, 1), pa.array([row]), pa.array([part]), pa.array([start], pa.int64())]
                        counts = pa.ListArray.from_arrays(pa.array([0, len(here)], pa.int32()), pa.array(here))
                        yield pa.RecordBatch.from_arrays([*columns, counts, pa.array([over])], names=["id", "row", "part", "start", "counts", "last"])
                        start, part = start + len(here), part + 1
                        if over:
                            break

    return source.mapInArrow(run, f"id {kind}, row long, part long, start long, counts array<int>, last boolean")


def truncated(table: DataFrame, budget: int) -> DataFrame:
    """(id, row, n_chars, n_tokens): the longest prefix of each text that has at most budget tokens.

    table comes from `prefixes`. A longer prefix can have fewer tokens than a shorter one, inside a word; the longest
    one that fits counts. Null and empty texts, and a budget that nothing fits, give 0 and 0. Parts are looked at where
    they lie, and a row for each is joined by its maximum.
    """
    size = F.size("counts")
    fitting = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda best, i: F.when(F.element_at("counts", i) <= budget, i).otherwise(best))
    best = F.when(size > 0, fitting).otherwise(0)
    found = table.select("id", "row", "start", "counts", best.alias("best"))
    at = F.when(F.col("best") > 0, F.struct((F.col("start") + F.col("best")).alias("n"), F.element_at("counts", F.greatest("best", F.lit(1))).alias("tokens")))
    most = found.select("id", "row", at.alias("at")).groupBy("row").agg(F.first("id").alias("id"), F.max("at").alias("at"))
    return most.select("id", "row", F.coalesce("at.n", F.lit(0)).cast("long").alias("n_chars"), F.coalesce("at.tokens", F.lit(0)).cast("long").alias("n_tokens"))


def fits(table: DataFrame, budget: int) -> DataFrame:
    """(id, row, n_tokens, fits): the tokens of each whole text, and whether they are within the budget.

    table comes from `prefixes`; only the last part of each text is read.
    """
    tokens = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")
    return table.where("last").select("id", "row", tokens.alias("n_tokens"), (tokens <= budget).alias("fits"))
