import random

from velar.llm.edits import alike, character_classes, segments, signatures, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n, letters="abcé"):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]])
    return s


def test_distance_and_shared_signatures():
    rng = random.Random(0)
    for _ in range(4000):
        a = "".join(rng.choices("abcé", k=rng.randint(0, 90 if rng.random() < 0.3 else 20)))
        b = edited(rng, a, rng.randint(0, 5))
        d = distance(a, b)
        for most in (0, 1, 2, 3, 6):
            assert within(a, b, most) == (d <= most), (a, b, most, d)
            if most < 4 and d <= most and min(len(a), len(b)) >= 5:
                (ai, ap), (bi, bp) = signatures(a, most, 5), signatures(b, most, 5)
                assert {*ai} & {*bi, *bp} or {*bi} & {*ap}, (a, b, most)


def test_segments_cover():
    for n in range(1, 50):
        for most in range(4):
            s = segments(n, most)
            assert s[0][0] == 0 and all(x + y == z for (x, y), (z, _) in zip(s, s[1:])) and sum(s[-1]) == n


def test_characters_bound_the_distance_and_alike_joins_all():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choices("abxyzé19", k=rng.randint(0, 30)))
        b = edited(rng, a, rng.randint(0, 3), "abxq7")
        assert (character_classes(a) ^ character_classes(b)).bit_count() <= 2 * distance(a, b)
    for most in (0, 1, 2, 3):
        lines = ["".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(70)] + [f"page {k}" for k in range(40)] + ["", ""]
        root = list(range(len(lines)))
        for i, j in alike(lines, most):
            assert distance(lines[i], lines[j]) <= most
            root = [root[j] if x == root[i] else x for x in root]
        for i, x in enumerate(lines):
            for j in range(i):
                assert root[i] == root[j] or distance(x, lines[j]) > most
