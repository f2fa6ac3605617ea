"""Edges and the lossy block transform against plain versions, pixel by pixel."""

import math
import random

import numpy as np
import pytest

from tallyform.operators import codec, edges, image


def plain_edges(g):
    h, w = len(g), len(g[0])
    px = lambda y, x: int(g[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)])
    grad = {}
    for y in range(h):
        for x in range(w):
            dx = sum(k * (px(y + j, x + 1) - px(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (px(y + 1, x + j) - px(y - 1, x + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            grad[y, x] = dx, dy
    size = {k: abs(a) + abs(b) for k, (a, b) in grad.items()}
    peaks = set()
    for (y, x), (dx, dy) in grad.items():
        m = lambda j, i: size.get((y + j, x + i), 0)  # noqa: B023, E731
        t = abs(dx) * 13573
        if abs(dy) * 2**15 < t:
            top = size[y, x] > m(0, -1) and size[y, x] >= m(0, 1)
        elif abs(dy) * 2**15 > t + abs(dx) * 2**16:
            top = size[y, x] > m(-1, 0) and size[y, x] >= m(1, 0)
        else:
            s = -1 if (dx < 0) != (dy < 0) else 1
            top = size[y, x] > m(-1, -s) and size[y, x] > m(1, s)
        if top and size[y, x] > 50:
            peaks.add((y, x))
    found, todo = set(), [p for p in peaks if size[p] > 150]
    while todo:
        p = todo.pop()
        if p in peaks and p not in found:
            found.add(p)
            todo += [(p[0] + j, p[1] + i) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    return np.array([[(y, x) in found for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("seed", range(12))
def test_edges(seed):
    rng = np.random.default_rng(seed)
    shape = [(1, 1), (1, 9), (9, 1), (2, 2), (30, 41), (17, 64)][seed % 6]
    g = rng.integers(0, [256, 60, 30][seed % 3], shape)
    if seed > 5:
        g = np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 5) % 256 + rng.integers(0, 9, shape)
    assert np.array_equal(edges.canny(g), plain_edges(g.tolist()))


def test_a_long_weak_chain_is_kept_by_one_strong_pixel():
    g = np.zeros((40, 400), int)
    g[20:] = 25  # a faint step of size 100 along the whole width
    assert not edges.canny(g).any()
    g[20:, 0:3] = 60
    assert edges.canny(g)[:, 50:390].any(axis=0).all()
    assert edges.crowded_border(np.ones((4, 4), bool)) and not edges.crowded_border(np.zeros((0, 0), bool))


def test_edges_of_rows(spark):
    rng = random.Random(1)
    rows = [(i, [[rng.randrange(200) for _ in range(9)] for _ in range(7)]) for i in range(20)] + [(20, []), (21, None)]
    out = {r.k: r for r in image.edge_tiles(spark.createDataFrame(rows, "k int, px array<array<int>>")).collect()}
    for k, px in rows:
        want = plain_edges(px) if px else np.zeros((0, 0), bool)
        assert (out[k].n_edges, out[k].cropped) == (int(want.sum()), edges.crowded_border(want))


def test_block_transform():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (13, 21))
    got = codec.quantised(g, 28)
    p = np.pad(g, ((0, 3), (0, 3)), mode="edge") - 128.0
    steps = codec.table(28)
    c = [math.sqrt(1 / 8)] + [0.5] * 7
    for by in range(0, 16, 8):
        for bx in range(0, 24, 8):
            coef = np.array([[c[u] * c[v] * sum(p[by + y, bx + x] * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for y in range(8) for x in range(8)) for v in range(8)] for u in range(8)])
            coef = np.floor(coef / steps + 0.5 + 1e-9) * steps
            for y in range(8):
                for x in range(8):
                    v = sum(c[u] * c[w] * coef[u, w] * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * w * math.pi / 16) for u in range(8) for w in range(8))
                    if by + y < 13 and bx + x < 21:
                        assert got[by + y, bx + x] == min(max(math.floor(v + 128.5 + 1e-9), 0), 255)
    assert np.array_equal(codec.quantised(np.full((8, 8), 128)), np.full((8, 8), 128.0)) and codec.table(100).max() == 1 and codec.table(50)[0, 0] == 16


def test_resampling():
    g = np.random.default_rng(3).integers(0, 256, (90, 180))
    small = codec.resized(g, 60)
    assert small.shape == (30, 60) and np.array_equal(codec.resized(g, 180), g)
    y, x = 11, 22
    centre = [(y + 0.5) * 3, (x + 0.5) * 3]
    cubic = lambda t: 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0
    wy, wx = ([cubic(abs(i + 0.5 - m) / 3) for i in range(n)] for m, n in zip(centre, g.shape))
    want = sum(a * b * g[i, j] for i, a in enumerate(wy) if a for j, b in enumerate(wx) if b) / sum(wy) / sum(wx)
    assert small[y, x] == min(max(math.floor(want + 0.5), 0), 255)
    assert np.array_equal(codec.resized(np.full((1, 2000), 7)), np.full((1, 900), 7.0)) and image.degrade(g, "whatsapp").shape == g.shape
