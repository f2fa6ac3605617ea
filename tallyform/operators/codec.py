"""What sending a gray image through a chat does to it: resampling to a longest side, then a lossy block transform."""

from __future__ import annotations

import numpy as np

#: Luminance table of baseline JPEG, in rows (fixed values).
LUMINANCE = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61],
        [12, 12, 14, 19, 26, 58, 60, 55],
        [14, 13, 16, 24, 40, 57, 69, 56],
        [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77],
        [24, 35, 55, 64, 81, 104, 113, 92],
        [49, 64, 78, 87, 103, 121, 120, 101],
        [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)
#: Longest side and quality of a sent image (fixed values).
MAX_SIDE, QUALITY = 900, 28

#: Basis of the 8-point cosine transform: row u, place x.
BASIS = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def table(quality: int) -> np.ndarray:
    """Quantisation steps of a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((LUMINANCE * scale + 50) // 100, 1, 255)


def near(a: np.ndarray) -> np.ndarray:
    """Nearest whole numbers, halves up, also where a half is missed by the noise of the arithmetic."""
    return np.floor(a + 0.5 + 1e-9)


def quantised(gray: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    """Pixels after the transform of each 8 x 8 block was cut to multiples of its steps; edges are repeated up to whole blocks."""
    h, w = gray.shape
    p = np.pad(gray.astype(np.float64), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2)
    steps = table(quality)
    kept = near(BASIS @ blocks @ BASIS.T / steps) * steps
    back = (BASIS.T @ kept @ BASIS).swapaxes(1, 2).reshape(p.shape)[:h, :w]
    return np.clip(near(back + 128), 0, 255)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def weights(size: int, out: int) -> np.ndarray:
    """out x size matrix of a cubic filter as wide as the reduction asks for; each row sums to one."""
    scale = size / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    w = _cubic((np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide)
    return w / w.sum(axis=1, keepdims=True)


def resized(gray: np.ndarray, max_side: int = MAX_SIDE) -> np.ndarray:
    """gray reduced to a longest side of max_side; smaller images stay as they are."""
    h, w = gray.shape
    scale = min(1.0, max_side / max(h, w))
    if scale == 1.0:
        return gray.astype(np.float64)
    nh, nw = max(1, int(h * scale)), max(1, int(w * scale))
    return np.clip(near(weights(h, nh) @ gray.astype(np.float64) @ weights(w, nw).T), 0, 255)


def sent(gray: np.ndarray, max_side: int = MAX_SIDE, quality: int = QUALITY) -> np.ndarray:
    return quantised(resized(gray, max_side), quality)
