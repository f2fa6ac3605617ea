import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyform.llm import substring
from tests.llm import fixture
from tests.llm.test_dedup import slow_removal


def phrase_rows(n=150):
    """Documents that differ but for one run of eight words in each of them, with some repeated passages among them."""
    rng = random.Random(5)
    phrase, passage = "all of these words stand in every document".split(), fixture.words(rng, 60)
    rows = []
    for i in range(n):
        w = fixture.words(rng, rng.randint(60, 120), 5000)
        at = rng.randint(0, len(w))
        w[at:at] = phrase + (passage if i % 6 == 0 else [])
        rows.append((i, " ".join(w)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n, rows[3][1]), (n + 2, " ".join(["of"] * 40_000)), (n + 3, " ".join(["of"] * 70)), (None, rows[4][1])]


@pytest.mark.parametrize("sample,part", [(1, 0.02), (1, 0.0), (2, 0.1), (64, 0.25)])
def test_dealt_windows_give_the_same(spark, monkeypatch, sample, part):
    monkeypatch.setattr(substring, "SAMPLE", sample)
    monkeypatch.setattr(substring, "PART", part)
    monkeypatch.setattr(substring, "LOCAL_BYTES", 3000)
    rows = phrase_rows()
    got = substring.dedup_substrings(fixture.frame(spark, rows))
    assert sorted(((r.doc_id, r._n_words, r._n_removed, r._sha) for r in got.collect()), key=repr) == slow_removal(rows, 50)


def test_no_task_gathers_the_windows_around_a_phrase(spark, monkeypatch):
    monkeypatch.setattr(substring, "SAMPLE", 1)
    monkeypatch.setattr(substring, "PART", 0.02)
    frame = fixture.frame(spark, [r for r in phrase_rows(600) if r[0] is not None and r[0] < 600])
    rows = frame.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    hot, bits = substring.common_minimisers(rows, 50, 8)
    assert len(hot) and (np.diff(hot) > 0).all()

    class Common:
        value = hot, bits

    def largest(common):
        at, total = Counter(), 0
        for b in substring._sender(50, 8, common)(iter(rows.toArrow().to_batches())):
            for m, n, packed in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                if packed is not None:
                    at[m] += n
                    total += n
                    assert len(packed) == 6 * n
        return max(at.values()), total

    (before, all_), (after, same) = largest(None), largest(Common)
    assert same == all_ and before > 0.04 * all_ and after < before / 4


def test_a_document_of_ten_megabytes(spark):
    w = [f"w{i * 7919 % 1_000_003}" for i in range(1_300_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[500_000:500_060] + ["end"]))]
    assert len(rows[0][1]) > 10_000_000
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]._n_words, got[1]._n_removed) == (1_300_000, 0) and got[1]._sha == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert (got[2]._n_words, got[2]._n_removed, got[2]._kept) == (61, 60, "end")


def test_ranges_are_joined_without_a_hash_table_where_they_are_many(spark, monkeypatch):
    rows = fixture.documents(2)
    one = sorted((repr(r.doc_id), r._sha) for r in substring.dedup_substrings(fixture.frame(spark, rows)).collect())
    monkeypatch.setattr(substring, "HASH_BYTES", 0)
    out = substring.dedup_substrings(fixture.frame(spark, rows))
    assert "ShuffledHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((repr(r.doc_id), r._sha) for r in out.collect()) == one


def test_steps_of_empty_batches():
    empty = pa.RecordBatch.from_pylist([], schema=substring._SENT)
    assert all(b.num_rows == 0 for b in substring._settle(iter([empty, empty])))
