import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyform.llm import graph, queries, simhash, substring
from tests.llm import fixture


# ---------------------------------------------------------------- SimHash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def slow_components(fps, d):
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_against_all_pairs(spark):
    rows = fixture.documents()
    got = simhash.near_duplicates(fixture.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) for _, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64) for r in got) == sorted((d is None, d or 0, f) for (d, _), f in zip(rows, fps))
    comp = slow_components(fps, 4)
    low = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            low[c] = min(low.get(c, d), d)
    want = {f: low.get(c) for f, c in zip(fps, comp)}
    assert all(r.component_id == want[r.fp % 2**64] for r in got)


@pytest.mark.parametrize("chunk", [8, 2048])
def test_links_connect_exactly_what_is_near(spark, chunk):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(150)} | {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(120)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in graph.connected_components(simhash.fingerprint_links(df, chunk=chunk)).collect()}
    comp = slow_components(fps, 4)
    groups = {}
    for f, c in zip(fps, comp):
        groups.setdefault(c, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_masks_leave_one_choice_untouched():
    masks = simhash.block_masks()
    rng = random.Random(1)
    for _ in range(300):
        flipped = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flipped & m for m in masks)
    with pytest.raises(ValueError):
        simhash.block_masks(4, 4)


def test_pivots_never_discard_a_near_pair():
    rng = np.random.default_rng(0)
    piv = simhash.pivots()
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    assert (np.abs(simhash._coordinates(a, piv) - simhash._coordinates(b, piv)).max(axis=1) <= 4).all()


def test_one_document_of_each_group_stays(spark):
    rows = fixture.documents()
    docs = fixture.frame(spark, rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    roots = {r.root: r.component_id for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(roots.values()) and ids.count(None) == 1
    assert ids.count(6) == 2  # two different texts share this id, each with a group of its own


def plans_of(spark, make):
    """Plans of all that Spark runs while make(spark) does."""
    runs = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    last = runs().last().executionId() if runs().nonEmpty() else -1
    assert make(spark).collect()
    return [r.physicalPlanDescription() for r in (runs().apply(i) for i in range(runs().size())) if r.executionId() > last]


def test_no_join_of_the_stage_broadcasts(spark):
    """Exploded keys are 35 times what Spark takes them for; as a broadcast they ended the driver over 0.5 GB."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plans = plans_of(spark, lambda s: simhash.drop_near_duplicates(fixture.frame(s, fixture.documents())))
    assert sum("SortMergeJoin" in p for p in plans) >= 5
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_no_join_of_op7_broadcasts(spark, sf):
    plans = plans_of(spark, lambda s: queries.queries()["op7_simhash"](s, sf))
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_empty_table(spark):
    assert simhash.near_duplicates(fixture.empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(fixture.empty(spark)).count() == 0
    assert substring.dedup_substrings(fixture.empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.sql("select 1000L, 1001L union all select null, 3L union all select 7L, 7L"))
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(401)}, 1000: 1000, 1001: 1000}


# ---------------------------------------------------------------- substrings


def slow_removal(rows, width):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, float("inf")), key(d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width,core,local", [(50, 8, 1 << 22), (50, 8, 2000), (7, 3, 1 << 22), (7, 7, 500), (1, 1, 1 << 22)])
def test_removal_against_all_windows(spark, monkeypatch, width, core, local):
    monkeypatch.setattr(substring, "LOCAL_BYTES", local)
    rows = fixture.documents(2)
    got = substring.dedup_substrings(fixture.frame(spark, rows), width=width, core=core)
    assert sorted(((r.doc_id, r._n_words, r._n_removed, r._sha) for r in got.collect()), key=repr) == slow_removal(rows, width)


def test_local_slices_do_not_change_the_result():
    import pyarrow as pa

    rows = [(d, t) for d, t in fixture.documents(4) if d is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array(range(len(rows)), pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "row_key", "text"])

    def settled(most):
        old, substring.LOCAL_BYTES = substring.LOCAL_BYTES, most
        try:
            sent = pa.Table.from_batches(substring._sender(50, 8)([batch]), schema=substring._SENT).sort_by("minimiser")
        finally:
            substring.LOCAL_BYTES = old
        cover = {}
        for part in (1, 10, 10**6):
            got = {}
            for b in substring._settle(iter(sent.to_batches(max_chunksize=part))):
                for d, _, at, n in zip(*b.to_pydict().values()):
                    got.setdefault(d, set()).update(range(at, at + n))
            cover[part] = got
        assert cover[1] == cover[10] == cover[10**6]
        return cover[1]

    assert settled(1 << 22) == settled(3000) == settled(1)


def test_kept_text_and_columns(spark):
    rows = fixture.documents(2)
    docs = fixture.frame(spark, rows)
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by = {r.doc_id: r for r in out.collect()}
    assert by[60].text is None and by[61].text == "" and by[3].text == rows[3][1]
    assert by[67].text.split() == ([] if len(rows[0][1].split()) >= 50 else rows[0][1].split())  # a copy of document 0
    assert by[1].score == 7.0
