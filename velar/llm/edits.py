"""Edit distance under a small threshold, and the segments and probes of a segment-partition join."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

WIDTH = 64
FULL, TOP = (1 << WIDTH) - 1, 1 << WIDTH - 1


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance (insert, delete, replace; code points) is at most `most`, below 32.

    After a common beginning and end, a band of 64 diagonals goes down the matrix, a column a step, as bits that say
    where values rise or fall (Myers 1999; the band along the diagonal after Hyyro 2003).
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    at, end = 0, min(len(a), len(b))
    while at < end and a[at] == b[at]:
        step = 1
        while at + step <= end and a[at : at + step] == b[at : at + step]:  # doubling, so that long runs cost little
            at, step = at + step, step * 2
    back = 0
    while back < end - at and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = a[at : len(a) - back], b[at : len(b) - back]
    if not b or len(a) <= 1:
        return len(a) <= most
    if not most:
        return a == b
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    rise, fall, distance, low = FULL << (WIDTH - most - 1) & FULL, 0, most, most + 1 - WIDTH
    top = 1 << (WIDTH - 1)
    for j, c in enumerate(b):
        match = where.get(c, 0)
        match = (match >> low if low > 0 else match << -low) & FULL
        same = ((((match & rise) + rise) ^ rise) | match | fall) & FULL
        right_up, right_down = fall | ~(same | rise) & FULL, same & rise
        if j < len(a) - most:
            distance += not same & top
        else:
            top >>= 1
            distance += bool(right_up & top) - bool(right_down & top)
        rise, fall = (right_down | ~((same >> 1) | right_up)) & FULL, (same >> 1) & right_up
        low += 1
    return distance <= most


def segments(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of most + 1 segments whose lengths differ by one at most."""
    short, longer = divmod(length, most + 1)
    out, at = [], 0
    for i in range(most + 1):
        n = short + (i >= most + 1 - longer)
        out.append((at, n))
        at += n
    return out


@lru_cache(1 << 14)
def layout(n: int, most: int, least: int) -> tuple[tuple[tuple[int, int, int], ...], tuple[tuple[int, int, int], ...]]:
    """(start, end, seed) of the substrings under which a line of n characters is indexed, and of those it looks for."""
    index, probes = [], []
    for shorter in range(0, most + 1):
        length = n - shorter
        if length < least:
            break
        for i, (start, size) in enumerate(segments(length, most)):
            seed = length * 64 + i
            lowest = max(0, start - i, start + shorter - (most - i))
            highest = min(n - size, start + i, start + shorter + (most - i))
            for at in range(lowest, highest + 1):
                (index if not shorter and at == start else probes).append((at, at + size, seed))
    return tuple(index), tuple(probes)


def signatures(line: str, most: int, least: int) -> tuple[list[int], list[int]]:
    """Hashes under which a line is indexed, and further ones under which it looks for lines as long or shorter.

    Two lines of at least `least` characters within `most` edits share a hash that at least one of them is indexed
    under. Of a segment's possible places only those are probed where the edits left and right of it can add up.
    """
    data, digest = line.encode(errors="replace"), xxhash.xxh64_intdigest
    index, probes = layout(len(line), most, least)
    if len(data) == len(line):  # a byte is a character
        return [digest(data[a:b], s) - TOP for a, b, s in index], [digest(data[a:b], s) - TOP for a, b, s in probes]
    part = lambda a, b: line[a:b].encode(errors="replace")
    return [digest(part(a, b), s) - TOP for a, b, s in index], [digest(part(a, b), s) - TOP for a, b, s in probes]


class _Bits(dict):
    """The class of each character, as one of 64 bits."""

    def __missing__(self, c: str) -> int:
        bit = 1 << (ord(c) * 0x9E3779B1 >> 7 & WIDTH - 1)
        if len(self) < 1 << 16:
            self[c] = bit
        return bit


_BITS = _Bits()


def character_classes(line: str) -> int:
    """64 bits: which classes of code points the line has. An edit changes two of them at most."""
    out = 0
    for c in set(line):
        out |= _BITS[c]
    return out


def _counts(lines: list[str]) -> np.ndarray:
    """How often each line has code points of each of 64 classes, at most 127."""
    out = np.zeros((len(lines), WIDTH), np.int16)
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out[i] = np.minimum(np.bincount(codes * 0x9E3779B1 >> 7 & WIDTH - 1, minlength=WIDTH), 127)
    return out


def alike(lines: list[str], most: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of places within `most` edits, enough of them to join all that such pairs join.

    Each line in turn meets those that nothing has joined yet, by counts of characters (an edit changes their sum of
    differences by two at most) and then by edit distance; those found are next in turn.
    """
    counts, left, queue, out = _counts(lines), np.arange(len(lines)), [], []
    while len(left) or queue:
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        if not len(left):
            continue
        near = np.flatnonzero(np.abs(counts[left] - counts[i]).sum(1) <= 2 * most)
        good = np.array([within(lines[i], lines[j], most) for j in left[near].tolist()], bool)
        found = left[near[good]] if len(near) else left[:0]
        out += [(i, j) for j in found.tolist()]
        queue += found.tolist()
        if len(found):
            left = np.delete(left, near[good])
    return out
