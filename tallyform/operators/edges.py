"""Edges of gray images: Sobel gradients, thinning along their direction, and two thresholds joined by hysteresis.

Integer arithmetic throughout, so results are exact: a gradient's size is |dx| + |dy|, its direction one of four, told by
tan 22.5 degrees in 15 bits. Weak edge pixels count where they are connected to a strong one, by union-find over the grid.
"""

from __future__ import annotations

import numpy as np

#: Thresholds of the quality check, and tan(22.5 degrees) * 2^15 (fixed values).
LOW, HIGH, TAN_22 = 50, 150, 13573


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients along x and y of whole-numbered pixels, the border repeated."""
    p = np.pad(gray.astype(np.int64), 1, mode="edge")
    up, mid, down = p[:-2], p[1:-1], p[2:]
    dx = up[:, 2:] - up[:, :-2] + 2 * (mid[:, 2:] - mid[:, :-2]) + down[:, 2:] - down[:, :-2]
    low = down - up
    return dx, low[:, :-2] + 2 * low[:, 1:-1] + low[:, 2:]


def thin(dx: np.ndarray, dy: np.ndarray, low: int = LOW) -> np.ndarray:
    """Sizes of the gradients that are largest across their edge and over low; 0 elsewhere. Outside of the image all sizes are 0."""
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    at = {(y, x): m[1 + y : 1 + y + size.shape[0], 1 + x : 1 + x + size.shape[1]] for y in (-1, 0, 1) for x in (-1, 0, 1)}
    x22 = np.abs(dx) * TAN_22
    y = np.abs(dy) << 15
    flat, steep = y < x22, y > x22 + (np.abs(dx) << 16)
    falls = (dx ^ dy) < 0
    before = np.where(flat, at[0, -1], np.where(steep, at[-1, 0], np.where(falls, at[-1, 1], at[-1, -1])))
    after = np.where(flat, at[0, 1], np.where(steep, at[1, 0], np.where(falls, at[1, -1], at[1, 1])))
    peak = (size > before) & np.where(flat | steep, size >= after, size > after)
    return np.where(peak & (size > low), size, 0)


def connected(mask: np.ndarray) -> np.ndarray:
    """Label of each pixel of mask (-1 elsewhere): the smallest number of its component over the eight neighbours."""
    h, w = mask.shape
    label = np.full(mask.size, -1)
    own = np.flatnonzero(mask)
    label[own] = own
    grid = np.arange(mask.size).reshape(h, w)
    pairs = []
    for a, b in ((grid[:, :-1], grid[:, 1:]), (grid[:-1], grid[1:]), (grid[:-1, :-1], grid[1:, 1:]), (grid[:-1, 1:], grid[1:, :-1])):
        both = mask.ravel()[a.ravel()] & mask.ravel()[b.ravel()]
        pairs.append(np.stack([a.ravel()[both], b.ravel()[both]]))
    a, b = np.concatenate(pairs, axis=1)
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # hang the larger root under the smaller
        while True:
            up = label[label[own]]
            if np.array_equal(up, label[own]):
                break
            label[own] = up
    return label.reshape(h, w)


def canny(gray: np.ndarray, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Whether each pixel is on an edge."""
    if not gray.size:
        return np.zeros(gray.shape, bool)
    size = thin(*sobel(gray), low)
    label = connected(size > 0)
    strong = np.unique(label[size > high])
    return (size > 0) & np.isin(label, strong)


def crowded_border(edges: np.ndarray, share: float = 0.25) -> bool:
    """Whether more than a share of the border pixels, corners twice, are on edges: the document seems cut off."""
    if not edges.size:
        return False
    return bool(np.concatenate([edges[0], edges[-1], edges[:, 0], edges[:, -1]]).mean() > share)
