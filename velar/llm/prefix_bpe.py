"""Byte pair encoding as a dynamic program over prefixes: how many tokens every prefix of a word has.

A word is a run of byte symbols; its last byte is a symbol of its own where the vocabulary marks word ends. Encoding
never looks back across a place where two tokens meet for good, so the encoding of a prefix is the encoding of a
shorter prefix and one more token. Exactly one token that ends the prefix can follow the shorter prefix's last token:
the one that no earlier merge would have crossed into. So last[i], the last plain token of the first i bytes, and
count[i] follow from what stands before, and a prefix taken as a text of its own only differs in its marked last byte.
"""

from __future__ import annotations

import numpy as np

LONGEST = (8, 16, 32, 64)  # bytes of the words that are worked out together; longer ones one by one
MEMO = 1 << 20
SEEN = 1 << 20  # places for pairs of tokens that were looked at; a newer pair takes an older one's place
NONE, START = -1, -2


def byte_letters() -> dict[str, int]:
    """Which byte a letter of the vocabulary file stands for: printable bytes themselves, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Lookup:
    """Small integers by integer keys, for whole arrays: an open table of which an eighth at most is used."""

    def __init__(self, entries: dict[int, int]):
        self.bits = max(8, (8 * len(entries)).bit_length())
        keys, values = np.array(list(entries), np.int64), np.array(list(entries.values()), np.int32)
        self.keys, self.values = np.full(1 << self.bits, NONE, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == NONE)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, at = keys[rest], values[rest], at[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        here = self.keys[at]
        out = np.where(here == keys, self.values[at], np.int32(NONE))
        todo = np.flatnonzero((here != keys) & (here != NONE))
        at = at[todo]
        while len(todo):
            at = at + 1 & (1 << self.bits) - 1
            here = self.keys[at]
            hit = here == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (here != NONE)
            todo, at = todo[more], at[more]
        return out


class PrefixBpe:
    """Counts of one vocabulary: merges by rank, and the mark of a word's last symbol.

    Tokens are numbered in the order in which they come about: 0-255 bytes, 256-511 marked bytes, then the merges.
    """

    def __init__(self, merges: list[tuple[str, str]], mark: str):
        if not mark:
            raise ValueError("only vocabularies that mark the ends of words are read")
        letters = byte_letters()
        number = {c: b for c, b in letters.items()} | {c + mark: 256 + b for c, b in letters.items()}
        spelled = {k: (bytes([k & 255]), k > 255) for k in range(512)}
        self.left, self.right, pairs = list(range(512)), list(range(512)), {}
        for a, b in merges:
            new = len(self.left)
            if a + b in number or a not in number or b not in number:
                raise ValueError(f"{a} {b}: each token must come from one merge of earlier ones")
            x, y = number[a], number[b]
            number[a + b], pairs[x, y] = new, new
            spelled[new] = (spelled[x][0] + spelled[y][0], spelled[y][1])
            self.left.append(x)
            self.right.append(y)
        self.size, self.pairs, self.memo = len(self.left), pairs, {}
        self.seen, self.seen_apart = np.full(SEEN, NONE, np.int64), np.zeros(SEEN, bool)
        self._left, self._right = np.array(self.left), np.array(self.right)
        self._pairs = Lookup({x * self.size + y: v for (x, y), v in pairs.items()})
        self._index(spelled)

    def _index(self, spelled: dict[int, tuple[bytes, bool]]) -> None:
        """A tree of bytes over all tokens that encode as themselves."""
        merged = np.arange(512, self.size)
        whole = self._apart(self._left[merged], self._right[merged], inner=True)
        reached = {*range(512), *merged[whole].tolist()}
        self.child: dict[tuple[int, int], int] = {}
        plain, marked = [NONE], [NONE]
        for token, (text, end) in spelled.items():
            if token not in reached:
                continue
            node = 0
            for b in text:
                key = (node, b)
                if key not in self.child:
                    self.child[key] = len(plain)
                    plain.append(NONE)
                    marked.append(NONE)
                node = self.child[key]
            (marked if end else plain)[node] = token
        self.plain, self.marked = plain, marked
        self._plain, self._marked = np.array(plain), np.array(marked)
        self._child = Lookup({node << 8 | b: v for (node, b), v in self.child.items()})

    def _apart(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether tokens a and b stay apart when their bytes are encoded together; START before b always does.

        The symbols beside the border are undone from the last merge back. Where they could merge with each other
        before they go into their own tokens (of equal ranks the one further left comes first), the border goes.
        inner: whether nothing crosses before a and b themselves would merge.
        """
        out = np.ones(len(a), bool)
        todo = np.flatnonzero(a != START)
        x, y = a[todo], b[todo]
        far = np.full(len(todo), self.size)
        above_x, above_y = far, far.copy()
        first = inner
        while len(todo):
            if first:
                crossed, first = np.zeros(len(todo), bool), False
            else:
                new = self._pairs(x * self.size + y)
                crossed = (new >= 0) & (new < above_x) & (new <= above_y)
            out[todo[crossed]] = False
            go = ~crossed & ((x >= 512) | (y >= 512))
            todo, x, y, above_x, above_y = todo[go], x[go], y[go], above_x[go], above_y[go]
            undo_x = x > y
            above_x, above_y = np.where(undo_x, x, above_x), np.where(undo_x, above_y, y)
            x, y = np.where(undo_x, self._right[x], x), np.where(undo_x, y, self._left[y])
        return out

    def _known_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What _apart says; pairs that were seen lately aren't walked again."""
        keys = a * self.size + b
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)
        out = self.seen_apart[at]
        new = np.flatnonzero(self.seen[at] != keys)
        if len(new):
            out[new] = self._apart(a[new], b[new])
            self.seen[at[new]], self.seen_apart[at[new]] = keys[new], out[new]
        return out

    def _one_apart(self, a: int, b: int) -> bool:
        if a == START:
            return True
        key = a * self.size + b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self._apart_by_steps(a, b)
        return known

    def _apart_by_steps(self, x: int, y: int) -> bool:
        """What _apart says, for one pair."""
        above_x = above_y = self.size
        while True:
            new = self.pairs.get((x, y), self.size)
            if new < above_x and new <= above_y:
                return False
            if x < 512 and y < 512:
                return True
            if x > y:
                above_x, x = x, self.right[x]
            else:
                above_y, y = y, self.left[y]

    def _long(self, word: bytes) -> np.ndarray:
        """Tokens of each prefix of one word, as a text of its own."""
        n = len(word)
        last, count, ended = [START] + [NONE] * n, [0] * (n + 1), [0] * (n + 1)
        for j in range(n):
            node = 0
            for k in range(j, n):
                node = self.child.get((node, word[k]))
                if node is None:
                    break
                t = self.plain[node]
                if t >= 0 and last[k + 1] == NONE and self._one_apart(last[j], t):
                    last[k + 1], count[k + 1] = t, count[j] + 1
                t = self.marked[node]
                if t >= 0 and not ended[k + 1] and self._one_apart(last[j], t):
                    ended[k + 1] = count[j] + 1
        return np.array(ended[1:], np.int64)

    def _together(self, words: list[bytes], every: bool) -> np.ndarray:
        """Row i, column w: tokens of the first i + 1 bytes of the w-th word as a text; without every only of the whole."""
        sizes = np.array([len(w) for w in words])
        widest, n = int(sizes.max()), len(words)
        data = np.frombuffer(b"".join(w.ljust(widest, b"\0") for w in words), np.uint8).reshape(n, widest).T.astype(np.int64)
        last = np.full((widest + 1, n), NONE, np.int64)
        count, ended = np.zeros((widest + 1, n), np.int32), np.zeros((widest + 1, n), np.int32)
        last[0] = START
        for j in range(widest):
            rows, node = np.flatnonzero(sizes > j), None
            for k in range(j, widest):
                if k > j:
                    inside = sizes[rows] > k
                    rows, node = rows[inside], node[inside]
                node = self._child((node << 8 if node is not None else 0) | data[k, rows])
                live = node >= 0
                rows, node = rows[live], node[live]
                if not len(rows):
                    break
                for tokens, marked in ((self._plain[node], False), (self._marked[node], True)):
                    open_ = tokens >= 0
                    if marked:
                        open_ &= (ended[k + 1, rows] == 0) & (every | (sizes[rows] == k + 1))
                    else:
                        open_ &= (last[k + 1, rows] == NONE) & (sizes[rows] > k + 1)
                    at = np.flatnonzero(open_)
                    at = at[self._known_apart(last[j, rows[at]], tokens[at])]
                    if marked:
                        ended[k + 1, rows[at]] = count[j, rows[at]] + 1
                    else:
                        last[k + 1, rows[at]], count[k + 1, rows[at]] = tokens[at], count[j, rows[at]] + 1
        return ended[1:] if every else ended[sizes, np.arange(n)]

    def totals(self, words: list[bytes]) -> list[int]:
        """How many tokens each word has."""
        out = [0] * len(words)
        for long, at in self._by_length(words):
            if long:
                for i in at:
                    out[i] = int(self._long(words[i])[-1])
            else:
                for i, n in zip(at, self._together([words[i] for i in at], False).tolist()):
                    out[i] = n
        return out

    def at_prefixes(self, words: list[bytes]) -> list[np.ndarray]:
        """For each word, how many tokens each of its prefixes of whole code points has as a text of its own."""
        out: list = [None] * len(words)
        for long, at in self._by_length(words):
            each = [self._long(words[i]) for i in at] if long else list(self._together([words[i] for i in at], True).T)
            for i, counts in zip(at, each):
                data = np.frombuffer(words[i], np.uint8)
                ends = np.append((data[1:] & 0xC0) != 0x80, True)
                out[i] = counts[: len(data)][ends]
        return out

    @staticmethod
    def _by_length(words: list[bytes]):
        sizes = np.array([len(w) for w in words], np.int64)
        low = 0
        for high in (*LONGEST, None):
            at = np.flatnonzero((sizes > low) & (sizes <= high if high else True))
            if len(at):
                yield high is None, at.tolist()
            low = high
