"""Spelling variants against a plain version: all pairs of words by edit distance, forms followed one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyform.llm import queries, spelling
from tests.llm.fixture import empty, frame


def one_apart(a, b):
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def count_words(rows, modulus=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            crc = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = crc % len(run)
            n[run if crc % modulus else run[:at] + run[at + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain(rows, modulus=97):
    n = count_words(rows, modulus)
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def rows_of(seed=2, docs=150):
    """Few letters, so that words have many near ones, some accented, some with the signs between the accented letters."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀé×ÿ") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 300, "x" * 299]
    out = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(60)):
            w = base[min(int(rng.expovariate(0.07)), len(base) - 1)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "Z" + w[k + 1 :], w.upper(), w.capitalize()])
            words.append(w)
        out.append((i, rng.choice([" ", ", ", "1", "ı", "\n"]).join(words)))
    return out + [(None, out[0][1]), (3, out[3][1]), (5, None), (5, ""), (7, "x" * 400_000 + " short"), (8, "ſtrange Āstrange"), (9, "abcde " * 2000), (20, "klmno " * 3 + "klmnx " * 7 + "klmyx " * 15)]


def test_against_all_pairs(spark):
    rows = rows_of()
    want = plain(rows)
    assert any(r[5] for r in want) and any(r[1] != r[2] for r in want if r[1]) and any(r[4] == 0 for r in want)
    assert result(spelling.group_variants(frame(spark, rows))) == want


def test_many_deletions(spark):
    rows = rows_of(7)
    assert result(spelling.group_variants(frame(spark, rows), modulus=3)) == plain(rows, 3)


def test_shards_passes_and_blocks_change_nothing(spark, monkeypatch):
    rows = rows_of(4, 60)
    for name, value in [("SHARD_WORDS", 7), ("SHARD_BYTES", 40), ("BROADCAST_BYTES", 5000), ("BLOCK", 5), ("TASK_WORDS", 16)]:
        monkeypatch.setattr(spelling, name, value)
    assert result(spelling.group_variants(frame(spark, rows))) == plain(rows)


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = result(queries.op12_spelling_variants(spark, sf))
    assert got == by_deletions(rows) and len(got) > 1000


def by_deletions(rows):
    """plain() by way of words that share a text with one place left out, for vocabularies too large for all pairs."""
    n = count_words(rows)
    holes = {}
    for w in n:
        for key in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}:
            holes.setdefault(key, []).append(w)
    near = {w: {x for key in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w} for x in holes[key] if one_apart(w, x)} for w in n}
    form = {w: (lambda top: top if top and n[top] >= 2 * n[w] else None)(min(near[w], key=lambda x: (-n[x], x), default=None)) for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_long_chains_of_forms(spark):
    chain = [("w%02d" % i, "w%02d" % (i + 1)) for i in range(37)] + [("v", "w05")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in chain}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "a b c")]])
def test_no_words(spark, rows):
    df = frame(spark, rows) if rows else empty(spark)
    assert result(spelling.group_variants(df)) == set()
