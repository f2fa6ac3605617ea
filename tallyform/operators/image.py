"""Image quality on pixel arrays, portrait choice, and capture degradations.

Quality is an expression over gray pixels (array of rows) for small tiles, so it stays in the JVM;
larger images and degradations run over Arrow batches with numpy. No image codec is assumed:
decoding is a callable that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyform.functions.numbers import rounded
from tallyform.operators import codec, edges


def _at(px: Column, y: Column, x: Column) -> Column:
    return F.element_at(F.element_at(px, y.cast("int")), x.cast("int")).cast("double")


def _mirror(i: Column, n: Column) -> Column:
    """Neighbour index with the border reflected: 0 becomes 2, n + 1 becomes n - 1 (one pixel: itself)."""
    return F.greatest(F.lit(1), F.least(n, F.when(i < 1, 2).when(i > n, n - 1).otherwise(i)))


def laplacian_variance(px: Column | str) -> Column:
    """Variance of the four-neighbour Laplacian of an array of rows."""
    p = F.col(px) if isinstance(px, str) else px
    h, w = F.size(p), F.size(F.element_at(p, 1))
    cells = F.flatten(F.transform(F.sequence(F.lit(1), h), lambda y: F.transform(F.sequence(F.lit(1), w), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    lap = F.transform(
        cells,
        lambda c: _at(p, _mirror(c["y"] - 1, h), c["x"]) + _at(p, _mirror(c["y"] + 1, h), c["x"]) + _at(p, c["y"], _mirror(c["x"] - 1, w)) + _at(p, c["y"], _mirror(c["x"] + 1, w)) - 4 * _at(p, c["y"], c["x"]),
    )
    sums = F.aggregate(lap, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    n = F.size(lap).cast("double")
    return sums["q"] / n - (sums["s"] / n) * (sums["s"] / n)


def level(value: Column, high: float, medium: float, falling: bool) -> Column:
    """high, medium or low; falling: small values are high."""
    if falling:
        return F.when(value < high, "high").when(value < medium, "medium").otherwise("low")
    return F.when(value > high, "high").when(value > medium, "medium").otherwise("low")


def quality_of(lap: Column, bright: Column, lum: Column, cropped: Column, height: Column, width: Column) -> Column:
    """struct(readable, blur, glare, cropped, orientation, quality_score) from the four measurements."""
    blur, glare, dark = level(lap, 60, 200, True), level(bright, 0.12, 0.04, False), lum < 70
    score = rounded(
        0.4 * F.least(lap / 300.0, F.lit(1.0)) + 0.25 * F.greatest(F.lit(0.0), 1.0 - bright / 0.15) + 0.2 * F.least(lum / 130.0, F.lit(1.0)) + 0.15 * F.when(cropped, 0.6).otherwise(1.0), 3
    )
    return F.struct(
        ((blur != "high") & ~dark & (score > 0.45)).alias("readable"), blur.alias("blur"), glare.alias("glare"), cropped.alias("cropped"),
        F.when(height >= width * 0.5, "upright").otherwise("rotated").alias("orientation"), score.alias("quality_score"),
    )


def tile_quality(px: Column | str, cropped: Column | None = None) -> Column:
    """Quality of a small gray tile, in built-in functions only; `cropped` comes from an edge detector if there is one."""
    p = F.col(px) if isinstance(px, str) else px
    flat = F.flatten(p)
    n = F.size(flat).cast("double")
    bright = F.size(F.filter(flat, lambda v: v > 245)) / n
    lum = F.aggregate(flat, F.lit(0.0), lambda a, v: a + v.cast("double")) / n
    return quality_of(laplacian_variance(p), bright, lum, F.lit(False) if cropped is None else cropped, F.size(p), F.size(F.element_at(p, 1)))


def pick_portrait(boxes: Column | str) -> Column:
    """Largest of the boxes struct(x, y, w, h) by area, as [x, y, x + w, y + h]; the first of equal ones; null if none."""
    b = F.col(boxes) if isinstance(boxes, str) else boxes
    best = F.aggregate(b, F.try_element_at(b, F.lit(1)), lambda a, x: F.when(x["w"] * x["h"] > a["w"] * a["h"], x).otherwise(a))
    return F.when(F.size(b) > 0, F.array(best["x"], best["y"], best["x"] + best["w"], best["y"] + best["h"]))


def portrait_quality(sharpness: Column, area_ratio: Column) -> Column:
    """struct(quality_score, confidence) from sharpness and the face's share of the image."""
    q = rounded(0.6 * F.least(sharpness / 250.0, F.lit(1.0)) + 0.4 * F.least(area_ratio / 0.10, F.lit(1.0)), 3)
    return F.struct(q.alias("quality_score"), rounded(0.5 + 0.5 * q, 3).alias("confidence"))


# ---------------------------------------------------------------- whole images over Arrow batches


def gray_measures(gray: np.ndarray) -> tuple[float, float, float, bool]:
    """Laplacian variance, share of pixels over 245, mean, and whether edges crowd the border."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return float(lap.var()), float((g > 245).mean()), float(g.mean()), edges.crowded_border(edges.canny(gray))


def edge_tiles(tiles: DataFrame, px: str = "px") -> DataFrame:
    """tiles with n_edges and cropped: pixels on edges, and whether these crowd the border. px is an array of rows; a null or empty one has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [edges.canny(np.array(p if p and p[0] else np.zeros((0, 0)), np.int64)) for p in batch.column(px).to_pylist()]
            more = [pa.array([int(e.sum()) for e in found], pa.int64()), pa.array([edges.crowded_border(e) for e in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "n_edges", "cropped"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema)
    return tiles.mapInArrow(run, fields + ", n_edges long, cropped boolean")


def assess_images(images: DataFrame, decode: Callable[[bytes], np.ndarray], content: str = "content") -> DataFrame:
    """images with `quality`; decode gives gray pixels. Undecodable content gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf[content]:
                try:
                    gray = decode(bytes(raw))
                    rows.append((*gray_measures(gray), *gray.shape[:2]))
                except Exception:  # noqa: BLE001  any codec error means that the image cannot be read
                    rows.append((None,) * 6)
            yield pdf.assign(**dict(zip(("_lap", "_bright", "_lum", "_cut", "_h", "_w"), zip(*rows)))) if rows else pdf.assign(_lap=[], _bright=[], _lum=[], _cut=[], _h=[], _w=[])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    out = images.mapInPandas(run, fields + ", _lap double, _bright double, _lum double, _cut boolean, _h int, _w int")
    quality = F.when(F.col("_lap").isNotNull(), quality_of(F.col("_lap"), F.col("_bright"), F.col("_lum"), F.col("_cut"), F.col("_h"), F.col("_w")))
    return out.withColumn("quality", quality).drop("_lap", "_bright", "_lum", "_cut", "_h", "_w")


def with_image_error(images: DataFrame, decode: Callable[[bytes], np.ndarray], content: str = "content") -> DataFrame:
    """images with image_error: the name of the error that decode raises for an image's content, else null. A null content is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults: list[str | None] = []
            for raw in batch.column(content):
                try:
                    decode(raw.as_py() or b"")
                    faults.append(None)
                except Exception as e:  # noqa: BLE001  any codec error means that the image cannot be read
                    faults.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(faults, pa.string())], [*batch.schema.names, "image_error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    return images.mapInArrow(run, fields + ", image_error string")


def _box_blur(a: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur by a separable kernel."""
    r = max(1, int(round(3 * radius)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / radius) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if i == axis else (0, 0) for i in range(a.ndim)]
        a = np.apply_along_axis(lambda v: np.convolve(v, k, mode="valid"), axis, np.pad(a, pad, mode="edge"))
    return a


def degrade(px: np.ndarray, condition: str, seed: int = 7) -> np.ndarray:
    """Pixels (0..255, gray) under a capture condition; unknown conditions change nothing. The numbers are fixed values."""
    a = px.astype(np.float64)
    h, w = a.shape[:2]
    if condition == "mobile":
        a = _box_blur(a, 1.1) * 0.9
    elif condition == "blurred":
        a = _box_blur(a, 2.4)
    elif condition == "low_light":
        a = a * 0.35
    elif condition == "glare":
        y, x = np.mgrid[0:h, 0:w]
        far = np.hypot(x - w * 0.62, y - h * 0.4) / (0.45 * max(h, w))
        a = a + np.clip(1 - far, 0, 1) ** 2 * 200.0
    elif condition == "rotated":
        t = np.deg2rad(9.0)
        oh, ow = int(np.ceil(h * np.cos(t) + w * np.sin(t))), int(np.ceil(w * np.cos(t) + h * np.sin(t)))
        y, x = np.mgrid[0:oh, 0:ow]
        y, x = y - (oh - 1) / 2, x - (ow - 1) / 2
        sx, sy = np.rint(x * np.cos(t) - y * np.sin(t) + (w - 1) / 2).astype(int), np.rint(x * np.sin(t) + y * np.cos(t) + (h - 1) / 2).astype(int)
        inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
        a = np.where(inside, a[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 190.0)
    elif condition == "cropped":
        dx, dy = int(w * 0.12), int(h * 0.12)
        a = a[dy:, dx : w - dx // 2]
    elif condition == "photocopy":
        a = np.clip((a - 110) * 1.8 + 128, 0, 255) + np.random.default_rng(seed).normal(0, 12, a.shape)
    elif condition == "whatsapp":
        a = codec.sent(a)
    return np.clip(a, 0, 255).astype(np.uint8)


def degrade_tiles(tiles: DataFrame, px: str = "px", condition: str = "capture_condition") -> DataFrame:
    """tiles with their pixel arrays (array of rows of int) under each row's condition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [degrade(np.array([list(r) for r in p]), c).astype(int).tolist() for p, c in zip(pdf[px], pdf[condition])]
            yield pdf.assign(**{px: out})

    return tiles.mapInPandas(run, tiles.schema)


def low_light(px: Column | str, factor: float = 0.35) -> Column:
    """The one degradation that is a plain expression: every pixel times a factor."""
    p = F.col(px) if isinstance(px, str) else px
    return F.transform(p, lambda row: F.transform(row, lambda v: F.floor(v * F.lit(factor)).cast("int")))
