"""Small tables with the awkward cases: nulls, empty and long texts, copies, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, label int, _id string, _kept int, fp string, root int"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" + rng.choice(["", ",", "é"]) for _ in range(n)]


def documents(seed=1, n=60):
    """(doc_id, text) rows: every awkward case at least once."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    near = words(rng, 300)
    rows = []
    for i in range(n):
        w = words(rng, rng.choice([5, 40, 120, 300]))
        if i % 5 == 1:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        if i % 7 == 2:
            w = list(near)
            w[rng.randrange(300)] = "changed"
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n\x0b"), (n + 3, "one two"), (n + 4, "ONE Two"), (n + 5, " ".join(words(rng, 12000)))]
    rows += [(n + 6, " ".join(["of"] * 200)), (n + 7, rows[0][1]), (n + 8, " ".join(["of"] * 130)), (None, rows[3][1]), (5, rows[5][1]), (6, "another text of six")]
    return rows


def frame(spark, rows):
    full = [(d, t, "en", "src", len(t or ""), 7.0, "own", 1, "mine", 2, "f", 3) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
