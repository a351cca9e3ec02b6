"""Small tables that hold what every operator must bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1, vocabulary=40):
    """Random texts with copies, near copies, shared passages, empty, null and very long ones."""
    rng = random.Random(seed)
    words = [f"w{i}" if i % 7 else f"Wé{i}" for i in range(vocabulary)]
    made = []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        made.append("\n".join(lines))
    made += rng.choices(made, k=n // 5)
    for t in rng.choices(made, k=n // 4):
        parts = t.split(" ")
        parts[rng.randrange(len(parts))] = rng.choice(words)
        made.append(" ".join(parts))
    passage = " ".join(rng.choices(words, k=40))
    made += [f"{t}\n{passage} {rng.choice(words)}" for t in rng.choices(made, k=n // 6)]
    made += ["", None, " \n\t", "one", "one two", " ".join(rng.choices(words, k=3000)), "", None]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(made)]
