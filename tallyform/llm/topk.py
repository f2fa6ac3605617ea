"""Exact top-k by inner product of integer vectors, by distributed histogram selection.

Rows are checked and written once. All of them are scored against one block of queries at a time (a
stated query set, in blocks of bounded size). Each round every worker counts its scores in equal bins
of the interval that still holds a query's kth value; the counts are summed in Spark, the bin with
the kth value is found, and the interval shrinks to it, until a bin is one score wide. One more pass
keeps the scores above the kth value and, among those equal to it, the smallest ids. A worker sends
only its k highest occupied places per query, since the kth value overall is never below a worker's own.

Scores are exact for vectors of any size: a pair's norms bound every partial sum of its products, so
pairs under 2^52 are multiplied as doubles, pairs under 2^62 as 64-bit integers, and the few beyond
as Python's integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_folder, scratch_root

K, SCALE, EVERY = 10, 1024, 100
#: Queries of one job, queries and rows that are multiplied at once, bins of a round.
QUERY_BLOCK, QUERIES, ROWS, BINS = 8192, 1024, 2048, 1024
#: A query's own row, and scores beyond a long in either direction.
OWN, UNDER, OVER = -(1 << 63), -(1 << 63) + 1, (1 << 63) - 1


def finite(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<double>): rows whose id and vector are set and not empty and whose components are all finite numbers."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    d = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    return d.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))


def norms(m: np.ndarray) -> np.ndarray:
    """Euclidean norm of each row, never too small."""
    big = np.abs(m).max(axis=1, initial=0)
    by = np.maximum(big, 1)[:, None]
    return np.sqrt(((m / by) ** 2).sum(axis=1)) * by[:, 0] * (1 + 1e-9)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers; a double is a whole number from 2^53 on."""
    return np.array([[int(np.floor(c * scale)) if abs(c) < 2.0**900 else int(c) * scale for c in row] for row in x.tolist()], object).reshape(x.shape)


def products(q: np.ndarray, q_norm: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Scores of queries by rows as 64-bit integers; OVER and UNDER stand for what a long can't hold.

    q and x are unscaled; rows are split by how large their sums with these queries may get.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.floor(q * scale), np.floor(x * scale)
        reach = np.nan_to_num(norms(b) * float(q_norm.max(initial=0)), nan=np.inf, posinf=np.inf)
    small, wide = reach < 2.0**52, reach >= 2.0**62
    if small.all():
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(q), len(x)), np.int64)
    out[:, small] = (a @ b[small].T).astype(np.int64)
    mid = ~small & ~wide
    if mid.any():
        out[:, mid] = a.astype(np.int64) @ b[mid].T.astype(np.int64)
    if wide.any():
        exact = integers(q, scale) @ integers(x[wide], scale).T
        out[:, wide] = np.array([[min(max(s, UNDER), OVER) for s in row] for row in exact.tolist()], np.int64).reshape(exact.shape)
    return out


class _Block:
    """Queries of one dimension: ids, a matrix, and per query the interval low..last to look into."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, norm: float, k: int, scale: int) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.nan_to_num(norms(np.floor(matrix * scale)), nan=np.inf, posinf=np.inf)
        order = np.argsort(size, kind="stable")
        self.ids, self.matrix, self.norm, self.scale = ids[order], matrix[order], size[order], scale
        reach = [min(int(min(n * norm * (1 + 1e-9), 2.0**63)) + 2, OVER) if n else 2 for n in self.norm.tolist()]
        self.last = np.array(reach, np.int64)
        self.low = -self.last
        self.need = np.full(len(ids), k)  # places left for scores inside the interval
        self.open = np.ones(len(ids), bool)
        # Queries that are multiplied at once: their norms differ by 2^10 at most, so a large one slows no others.
        self.parts, a = [], 0
        while a < len(ids):
            b = min(a + QUERIES, int(np.searchsorted(self.norm, max(self.norm[a], 1.0) * 1024, "right")))
            self.parts.append((a, b))
            a = b

    @property
    def step(self) -> np.ndarray:
        """Scores in one bin."""
        return (self.last.view(np.uint64) - self.low.view(np.uint64)) // np.uint64(BINS) + np.uint64(1)

    def narrow(self, found: dict[int, tuple[int, int]]) -> None:
        """found: per query the bin with the kth value and the scores in the bins over it.

        A query without one has fewer than k candidates; its interval stays and all are kept.
        """
        step = self.step
        for q in np.flatnonzero(self.open).tolist():
            if q in found:
                at, over = found[q]
                self.need[q] -= over
                low = int(self.low[q]) + at * int(step[q])
                self.low[q], self.last[q] = low, min(int(self.last[q]), low + int(step[q]) - 1)
            else:
                self.low[q] = UNDER
            self.open[q] = q in found and self.low[q] < self.last[q]


def _chunks(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vec_ids, vectors) of up to ROWS rows of one dimension."""
    for batch in batches:
        v = batch.column(1)
        size = np.asarray(v.value_lengths())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        rows = np.flatnonzero(size == dim)
        for a in range(0, len(rows), ROWS):
            r = rows[a : a + ROWS]
            yield ids[r], flat[first[r][:, None] + np.arange(dim)]


def _scores(block: _Block, batches: Iterator[pa.RecordBatch], only: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first query, end, vec_ids, scores by query) for every part of the queries that has one of `only`."""
    for ids, x in _chunks(block.matrix.shape[1], batches):
        for a, b in block.parts:
            if only is None or only[a:b].any():
                s = products(block.matrix[a:b], block.norm[a:b], x, block.scale)
                yield a, b, ids, np.where(ids[None, :] == block.ids[a:b, None], OWN, s)


def _histogram(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = shared.value
        n, step = len(block.ids), block.step
        counts = np.zeros((n, BINS), np.int32)
        least = block.low.copy()  # scores under the bin with the worker's own kth value are of no use
        last = np.where(block.open, block.last, OWN)
        for a, b, _, s in _scores(block, batches, block.open):
            i, j = np.nonzero((s >= least[a:b, None]) & (s <= last[a:b, None]) & (s > OWN))
            if not len(i):
                continue
            at = ((s[i, j].view(np.uint64) - block.low.view(np.uint64)[a + i]) // step[a + i]).astype(np.int64)
            counts[a:b] += np.bincount(i * BINS + at, minlength=(b - a) * BINS).reshape(b - a, BINS).astype(np.int32)
            enough = np.cumsum(counts[a:b, ::-1], axis=1) >= block.need[a:b, None]
            floor = np.where(enough[:, -1], BINS - 1 - np.argmax(enough, axis=1), 0)
            least[a:b] = (block.low[a:b].view(np.uint64) + floor.astype(np.uint64) * step[a:b]).view(np.int64)
            counts[a:b][np.arange(BINS)[None, :] < floor[:, None]] = 0
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j].astype(np.int64))], ["q", "bin", "n"])

    return run


def _select(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = shared.value
        n = len(block.ids)
        held: list[list[np.ndarray]] = [[np.empty(0, np.int64), np.empty(0, np.int64)] for _ in range(n)]
        for a, b, ids, s in _scores(block, batches):
            i, j = np.nonzero((s >= block.low[a:b, None]) & (s > OWN))
            cut = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.empty(0, np.int64)
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(i)).tolist()):
                q, got = a + int(i[x]), j[x:y]
                score, vec = np.concatenate([held[q][0], s[i[x], got]]), np.concatenate([held[q][1], ids[got]])
                best = np.lexsort((vec, ~score))[:k]  # ~ turns the order around and fits the least score too
                held[q] = [score[best], vec[best]]
        size = [len(h[0]) for h in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(block.ids, size)), pa.array(np.concatenate([h[1] for h in held])), pa.array(np.concatenate([h[0] for h in held]))], ["query_id", "vec_id", "score"]
        )

    return run


def _block_top(rows: DataFrame, block: _Block, k: int) -> DataFrame:
    spark = rows.sparkSession
    over = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))).alias("reached")
    while block.open.any():
        shared = spark.sparkContext.broadcast(block)
        need = F.broadcast(spark.createDataFrame(list(enumerate(block.need.tolist())), "q int, need long"))
        hist = rows.mapInArrow(_histogram(shared), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        kth = hist.select("q", "bin", "n", over).join(need, "q").where("reached >= need and reached - n < need")
        found = {r.q: (r.bin, r.reached - r.n) for r in kth.collect()}
        shared.unpersist()
        block.narrow(found)
    return rows.mapInArrow(_select(spark.sparkContext.broadcast(block), k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to smaller ids.

    A component counts as floor(scale * x), x as double. Queries are the rows whose id is divisible by
    `every`; candidates are all rows but those with the query's own id. Rows whose id or vector is null
    or empty, or that hold a null or non-finite component, take no part. Fewer candidates than k: all
    of them. Only rows of the query's dimension are candidates. If several rows have a query's id, the
    least vector is the query; rows that repeat another id are candidates each. An empty table, or one
    without queries, gives no rows. Scores among a query's k highest that do not fit a long are an error.
    """
    spark = vectors.sparkSession
    rows = materialize(finite(vectors, vec_id, embedding), "vectors")
    bound = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + (F.abs(e) * scale + 1) * (F.abs(e) * scale + 1)))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.max(bound).alias("norm"), F.count_if(F.col("vec_id") % every == 0).alias("n")).where("n > 0").collect()
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    # Queries lie in one folder a block, so a block's turn reads its own rows only.
    blocks = {r.d: -(-r.n // query_block) for r in sizes}
    of = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]) if blocks else None
    hits, schema = own_folder(spark, f"{scratch_root(spark)}/tallyform/top-{uuid.uuid4().hex}"), "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(hits)
    if blocks:
        number = F.pmod(F.xxhash64("vec_id"), F.element_at(of, F.size("x"))).cast("int")
        queries = materialize(asked.select("vec_id", "x", F.size("x").alias("d"), number.alias("block")), "queries", "d", "block")
    for r in sorted(sizes, key=lambda r: r.d):
        for b in range(blocks[r.d]):
            got = queries.where((F.col("d") == r.d) & (F.col("block") == b)).select("vec_id", "x").toArrow()
            if got.num_rows:
                matrix = got.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, r.d)
                block = _Block(got.column(0).to_numpy(), matrix, float(r.norm), k, scale)
                _block_top(rows, block, k).write.mode("append").parquet(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = spark.read.schema(schema).parquet(hits).withColumn("rank", rank).where(F.col("rank") <= k)
    fits = F.when(F.col("score").isin(UNDER, OVER), F.raise_error(F.concat(F.lit("a score of query "), "query_id", F.lit(" does not fit a long"))).cast("long")).otherwise(F.col("score"))
    return top.select("query_id", "rank", "vec_id", fits.alias("score"))
