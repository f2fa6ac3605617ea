import random

import numpy as np
import pyarrow as pa
import pytest

from tallyform.llm import common, decontam, langid, packing, quality, simhash
from tests.llm import fixture
from tests.llm.test_dedup import slow_fingerprint
from tests.llm.test_text import model


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_hashes_do_not_depend_on_what_is_hashed_at_once(monkeypatch, most):
    texts = [t for _, t in fixture.documents(3)] + ["x" * 5000 + " " + "y" * 90]
    raw, off = common.utf8_view(pa.array(texts))
    start, end, _ = common.word_spans(raw, off)
    words, windows = common.word_hashes(raw, start, end), [common.window_hashes(np.arange(n, dtype=np.uint64), 5) for n in (0, 4, 5, 6, 200)]
    monkeypatch.setattr(common, "HASHED", most)
    assert np.array_equal(common.word_hashes(raw, start, end), words)
    assert all(np.array_equal(common.window_hashes(np.arange(n, dtype=np.uint64), 5), w) for n, w in zip((0, 4, 5, 6, 200), windows))


def test_parts_of_a_text_are_labelled_like_the_whole(spark, monkeypatch):
    _, m = model(spark)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["kora mel", "drif gwost", "дом река", "ΣΑΣ.", "12"]) for _ in range(rng.choice([0, 1, 30, 400]))) for _ in range(30)] + ["", "korameltibu" * 50]
    whole = langid.label_texts(m, texts, spans=True)
    for most in (1, 10, 97):
        monkeypatch.setattr(langid.parted, "__defaults__", (most,))
        monkeypatch.setattr(langid, "PART_CHARS", most)
        parts, counts = langid.parted(texts)
        assert len(parts) == sum(counts) > len(texts) and "".join(parts) == "".join(texts)
        assert langid.label_texts(m, texts, spans=True) == whole


@pytest.mark.parametrize("block", [3, 1 << 15])
def test_rows_followed_one_by_one_get_the_same_labels(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(7)
    for _ in range(40):
        sizes = rng.choice([0, 1, 2, 5, 40, 200], rng.integers(1, 14))
        of = np.concatenate([[0], np.cumsum(sizes)])
        score = np.round(rng.normal(0, 3, (of[-1], 3))).astype(np.float32)  # whole numbers, so that there are ties
        want = langid.viterbi(score, of, 4.0, few=0)
        assert all(np.array_equal(langid.viterbi(score, of, 4.0, few=f), want) for f in (1, 3, 50))


@pytest.fixture(scope="module")
def long():
    rng = random.Random(9)
    return " ".join(fixture.words(rng, 1_700_000, 50_000))


def test_operators_take_ten_megabytes_in_one_row(spark, long):
    assert len(long) > 10_000_000
    rows = [(1, long), (2, "short text of a few words"), (3, None)]
    docs = fixture.frame(spark, rows)
    words = long.split()
    item = " ".join(words[1_000_000:1_000_020])
    bench = spark.createDataFrame([(1, item), (2, "not in any of these")], "item_id long, text string")
    hits = decontam.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.errors) for r in hits} == {(1, 1, 0)}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in quality.classify(docs, labels).collect()) == [1, 2, 3]
    _, m = model(spark)
    got = {r.doc_id: r for r in langid.identify(docs, m).collect()}
    assert got[3].lang_pred == "und" and got[1].lang_pred in m.langs and got[1].score > 0
    fps = {r.doc_id: r.fp % 2**64 for r in simhash.near_duplicates(docs).collect()}
    assert fps == {d: slow_fingerprint(t) for d, t in rows}
    pieces = packing.pack(docs.where("doc_id = 1"))
    assert pieces.selectExpr("sum(length) as n").first().n == len(packing.encoder(None)(long)) + 1
