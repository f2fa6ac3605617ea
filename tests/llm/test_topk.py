import math
from fractions import Fraction

import numpy as np
import pytest

from tallyform.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def exact(rows, k=10, every=100):
    """All scores in Python's integers, sorted."""
    ok = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def found(df, **more):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, **more).collect())


def test_large_components_beside_small_ones(spark):
    assert found(spark.createDataFrame([(0, [1.0, 1.0]), (1, [3e6, 0.0]), (2, [2.0, 2.0])], SCHEMA)) == [(0, 1, 1, 1024 * 1024 * 3_000_000), (0, 2, 2, 4 * 1024 * 1024)]
    rng = np.random.default_rng(11)
    rows = [(int(i), (rng.normal(0, 1, 6) * 10.0 ** rng.choice([0, 0, 0, 3, 4, 5])).tolist()) for i in range(400)]
    rows += [(500, [1e6, -1e6, 1e-3, 0.0, 0.0, 1.0]), (501, [1e4, -1e4, 5.0, 0.1, 0.0, 0.0]), (600, [0.0] * 6), (601, [0.0, 0.0, 0.0, 0.0, 0.0, 1e6]), (700, [1e-9] * 6)]
    want = exact(rows)
    assert max(abs(w[3]) for w in want) > 2**53
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for block in (4, 8192):
        assert found(df, query_block=block) == want


def test_scores_beyond_a_long_only_matter_where_they_are_chosen(spark):
    huge = (1, [-1e200, 0.0])
    rows = [(0, [1.0, 0.0]), huge, *[(i, [float(i), 1.0]) for i in range(2, 20)]]
    assert found(spark.createDataFrame(rows, SCHEMA)) == exact(rows)
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame([*rows, (30, [1e200, 0.0])], SCHEMA)).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame([(0, [1.0, 0.0]), huge], SCHEMA)).collect()
    far = [(0, [1e308, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1e308]), (100, [2**52 + 0.0, 0.0]), (101, [1.0, 1.0])]
    want = [w for w in exact(far) if w[0] == 100]
    assert [w for w in want if abs(w[3]) < 2**63]
    a, b = (np.array([far[i][1]]) for i in (0, 1))
    assert topk.products(a, np.array([np.inf]), b, 1024).tolist() == [[0]] and topk.products(a, np.array([np.inf]), a, 1024).tolist() == [[topk.OVER]]


def test_products_of_all_sizes():
    rng = np.random.default_rng(2)
    for power in (1, 1e3, 1e6, 1e9, 1e15):
        q, x = (rng.normal(0, s, (4, 5)) for s in (1.0, power))
        want = [[min(max(sum(math.floor(a * 1024) * math.floor(b * 1024) for a, b in zip(r, c)), topk.UNDER), topk.OVER) for c in x.tolist()] for r in q.tolist()]
        got = topk.products(q, topk.norms(np.floor(q * 1024)), x, 1024)
        assert got.tolist() == want


def test_many_queries_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(3000)]
    want = exact(rows, k=3, every=2)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), k=3, every=2, query_block=400) == want
