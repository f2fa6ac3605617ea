"""Quality scores by a regularised quadratic discriminant over document statistics.

Each document becomes a short vector of transformed statistics (lengths, case, symbols, repetition,
lines). Class means and covariances come from sums that Spark adds up over all labelled documents;
each covariance is shrunk towards its diagonal, and its Cholesky factor is kept, so a score is the
difference of two Mahalanobis log densities by one triangular product each.

Texts are read once: the vectors are written to the shared scratch folder, and fitting and scoring
read those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, held_out, materialize, slices, sort_groups, utf8_view, word_hashes, word_spans

SHRINK, SOFT, CUT = 0.1, 10.0, 0.3
NAMES = (
    "words", "word_length", "word_spread", "upper", "initials", "symbols", "exclamations", "bars", "digits", "stops", "unlike_last", "repeated", "distinct_pairs", "short_words", "line_words", "wide_bytes",
)
DIM = len(NAMES)


def _class_of(*chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[[ord(c) for c in "".join(chars)]] = 1
    return t


_UPPER, _LOWER = _class_of(*map(chr, range(65, 91))), _class_of(*map(chr, range(97, 123)))
_DIGIT, _STOP, _CRY, _BAR = _class_of("0123456789"), _class_of(".,;:?"), _class_of("!"), _class_of("|")
_SYMBOL, _LINE = _class_of("#$%&*@^~=+<>\\{}[]_"), _class_of("\n")
_WIDE = np.array([0] * 128 + [1] * 128)


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of DIM statistics for each text of a slice; raw starts at off[0] == 0."""
    rows = len(off) - 1
    start, end, first = word_spans(raw, off)
    n = np.diff(first)
    size, most = np.diff(off), np.maximum(n, 1)

    def by_row(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
        return c[at[1:]] - c[at[:-1]]

    def count(t: np.ndarray) -> np.ndarray:
        return by_row(t[raw], off)

    length = (end - start).astype(np.float64)
    mean = by_row(length, first) / most
    spread = np.sqrt(np.maximum(by_row(length**2, first) / most - mean**2, 0))
    h = word_hashes(raw, start, end)
    row = np.repeat(np.arange(rows), n)

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        k = keys ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        s = k[sort_groups(k)] if len(k) else k
        lead = sort_groups(k)[np.append(True, s[1:] != s[:-1])] if len(k) else np.empty(0, np.int64)
        return np.bincount(of[lead], minlength=rows).astype(np.float64)

    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    joint = np.flatnonzero(row[1:] == row[:-1]) if len(h) > 1 else np.empty(0, np.int64)
    pairs = h[joint] * np.uint64(31) + h[joint + 1] if len(joint) else np.empty(0, np.uint64)
    upper, lower = count(_UPPER), count(_LOWER)
    initial = by_row(_UPPER[raw[start]], first) if len(start) else np.zeros(rows)
    lines = count(_LINE) + 1

    def ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.log((x + 0.5) / (y + 1.0))

    out = np.stack(
        [
            np.log1p(n), np.log1p(mean), np.log1p(spread), ratio(upper, upper + lower), ratio(initial, n), ratio(count(_SYMBOL), n), ratio(count(_CRY), n), ratio(count(_BAR), n),
            ratio(count(_DIGIT), size), ratio(count(_STOP), n), ratio(n - by_row(same, first), n), ratio(by_row(same, first), n), ratio(distinct(pairs, row[joint]), n),
            ratio(by_row(length <= 3, first), n), np.log1p(n / lines), ratio(count(_WIDE), size),
        ],
        axis=1,
    )
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8_view(batch.column("__tf_text"))
        keep = [i for i, n in enumerate(batch.schema.names) if n != "__tf_text"]
        for a, b in slices(off, SLICE_BYTES * 2):
            x = features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM, np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in keep), flat], [*(batch.schema.names[i] for i in keep), "__tf_x"])


def vectors(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (all but the text if none are given) and _x, the statistics of the whole text; null counts as empty."""
    own = [c for c in docs.columns if c not in (text, "__tf_x")] if columns is None else columns
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(text).cast("string").alias("__tf_text"))
    return rows.mapInArrow(_vectors, "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own) + "__tf_x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 + DIM + DIM * DIM))
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
        for c in (0, 1):
            z = x[y == c]
            total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["y", "s"])


class Discriminant:
    """Two Gaussians with shrunk covariances, kept as means and inverted Cholesky factors.

    A class without rows takes the other's moments; without any row all scores are equal.
    """

    def __init__(self, sums: np.ndarray, shrink: float = SHRINK) -> None:
        n = sums[:, 0]
        self.prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        self.mean, self.inverse, self.offset = [], [], []
        for c in (0, 1):
            m, mean, cross = sums[c, 0], sums[c, 1 : DIM + 1], sums[c, DIM + 1 :].reshape(DIM, DIM)
            if not m:
                m, mean, cross = (x + 0.0 for x in (sums[1 - c, 0], sums[1 - c, 1 : DIM + 1], sums[1 - c, DIM + 1 :].reshape(DIM, DIM)))
            mean = mean / max(m, 1)
            cov = cross / max(m, 1) - np.outer(mean, mean)
            diag = np.diag(np.maximum(np.diag(cov), 1e-4) + 1e-3)
            factor = np.linalg.cholesky((1 - shrink) * (cov + cov.T) / 2 + shrink * diag + 1e-6 * np.eye(DIM))
            self.mean.append(mean)
            self.inverse.append(np.linalg.inv(factor))
            self.offset.append(-float(np.log(np.diag(factor)).sum()))

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the prior."""
        d = [self.offset[c] - 0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return d[1] - d[0] + self.prior

    def score(self, x: np.ndarray, soft: float = SOFT) -> np.ndarray:
        """The log ratio squeezed into 0..1 without saturating, so that far values still differ."""
        z = self.log_ratio(x) / soft
        return 0.5 + 0.5 * z / (1 + np.abs(z))


def _scorer(shared, soft: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = batch.column("__tf_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__tf_x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(model.score(x, soft))], [*(batch.schema.names[i] for i in keep), "score"])

    return run


def fit(labelled: DataFrame, label: str, shrink: float = SHRINK) -> Discriminant:
    """Discriminant from all rows of (label, _x) whose label is 0 or 1; only sums reach the driver, 273 numbers a class."""
    sums = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), "__tf_x").mapInArrow(_sums, "y int, s array<double>")
    got = sums.select("y", F.posexplode("s").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + DIM + DIM * DIM))
    for r in got:
        total[r.y, r.i] = r.v
    return Discriminant(total, shrink)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", shrink: float = SHRINK, soft: float = SOFT, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels are learned only from rows that are not held out (crc32 of doc_id as text, modulo 5, is
    not 0) and whose label is 0 or 1; of rows that repeat an id in labels each counts. Inputs are
    statistics of the text alone. Null and empty texts get the score of a text without words. A null
    doc_id is held out. Without labels all scores are equal.
    """
    rows = materialize(vectors(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), "_t", ["doc_id"]), "statistics")
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("_y"))
    model = fit(rows.where(~held_out()).join(known, "doc_id"), "_y", shrink)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_scorer(shared, soft), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
