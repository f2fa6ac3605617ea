import random

from tallyform.llm import licenses
from tests.llm import fixture


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def worn(rng, words, added, dropped):
    """words with some dropped and some of the notice's own words put in."""
    out = []
    for w in words:
        if rng.random() < added:
            out.append(rng.choice(words))
        if rng.random() >= dropped:
            out.append(w)
    return out


def test_common_length_against_the_full_table():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 20))] for _ in range(2))
        bits = {}
        for i, w in enumerate(a):
            bits[w] = bits.get(w, 0) | 1 << i
        assert licenses.common_length(bits, len(a), b) == slow_common(a, b)


def test_coverage_against_a_full_alignment():
    """Every worn notice whose full alignment covers SHARE is reported, under its name or by an overlapping notice."""
    rng, s = random.Random(12), licenses.Scanner(licenses.TEMPLATES)
    filler = fixture.words(rng, 60)
    due = other = 0
    for name, text in licenses.TEMPLATES.items():
        words = licenses.words_of(text)
        for _ in range(12):
            inside = worn(rng, words, 0.06, 0.1)
            length = slow_common(words, inside)
            got = s.scan(" ".join(filler + inside + filler))
            if length >= licenses.SHARE * len(words):
                due += 1
                named = [g for g in got if g[0] == name]
                other += not named
                assert got, name
            for g in got:
                want = licenses.words_of(licenses.TEMPLATES[g[0]])
                place = licenses.words_of(" ".join(filler + inside + filler))[g[2] : g[2] + g[3]]
                assert round(slow_common(want, place) / len(want), 4) >= g[1] >= licenses.SHARE
    assert due > 100 and other < due / 4, (due, other)


def test_long_and_odd_texts(spark):
    mit = licenses.TEMPLATES["MIT-full"]
    rows = [(1, "word " * 1_000_000 + mit + " word" * 1_000_000), (2, "software " * 100_000), (3, None), (4, "")]
    got = {r.doc_id: (r.license, r.n_spans) for r in licenses.scan_licenses(fixture.frame(spark, rows)).collect()}
    assert got == {1: ("MIT-full", 1), 2: (None, 0), 3: (None, 0), 4: (None, 0)}


def test_dense_texts_take_little_time():
    import random
    import time

    scanner = licenses.Scanner(licenses.TEMPLATES)
    name, long = max(licenses.TEMPLATES.items(), key=lambda t: len(t[1]))
    began = time.process_time()
    spans = scanner.scan("\n".join([long] * 320))
    assert [s[0] for s in spans] == [name] * 320 and all(s[1] == 1.0 for s in spans)
    rng = random.Random(1)
    pool = [w for t in licenses.TEMPLATES.values() for w in licenses.words_of(t)]
    scanner.scan(" ".join(rng.choice(pool) for _ in range(20_000)))
    assert time.process_time() - began < 20
