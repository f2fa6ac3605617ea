"""Near-duplicate groups by SimHash fingerprints, with pivot distance tables as the candidate filter.

A fingerprint's coordinates are its Hamming distances to a fixed set of reference fingerprints. By
the triangle inequality two fingerprints within distance d differ by at most d in every coordinate,
so a pair whose largest coordinate difference exceeds d is discarded unseen; survivors are verified
by exact distance.

Distances from random 64-bit fingerprints to any pivot concentrate around 32, so pivots alone leave
a constant share of all pairs. Pairs are therefore met inside blocks first: the 64 bits are cut into
`blocks` parts, and d differing bits leave at least blocks - d parts untouched, so fingerprints
within d agree on the bits of at least one choice of blocks - d parts. Each choice gives one key.
Blocks are lossless for every setting; the setting only moves work.

Only distinct fingerprints take part; rows follow by an equi-join. A block with more members than
`chunk` is cut into chunks by hash, and each pair of chunks is one group, so no task ever holds more
than about two chunks of one block. Groups emit links to the smallest linked member, not pairs.

Joins are merge joins by hint: Spark takes exploded keys to be as large as the fingerprints that they
come from, and would send one side through the driver as a broadcast that grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean_batches, materialize, mix, row_bytes, slices, utf8_view
from .graph import connected_components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
BLOCKS, PIVOTS, CHUNK = 7, 32, 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lower-cased, words between spaces and 0x09-0x0D, XXH64 of shingles.

    Fewer words than a shingle: the whole sequence is the one shingle. No word: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ends) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 4096):
        part = h[a : a + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(2)
        _, off = utf8_view(text)
        for a, b in slices(off, 8 << 20):
            fp = np.fromiter(map(fingerprint, row_bytes(text.slice(a, b - a))), np.uint64, b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(fp.view(np.int64))], ["doc_id", "row_key", "fp"])
    give_back()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, row_key long, fp long) per row; null text counts as empty, row_key is a hash of the text."""
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, row_key long, fp long")


# ---------------------------------------------------------------- links between distinct fingerprints


def block_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of every choice of blocks - max_bits parts out of `blocks` parts of the 64 bits."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("blocks must exceed max_bits")
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [reduce(int.__or__, c) for c in combinations(parts, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> np.ndarray:
    """n reference fingerprints spread over the space by a mixing function."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _coordinates(fp: np.ndarray, piv: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ piv[None, :]).astype(np.int8)


def star_links(fp: np.ndarray, max_bits: int, piv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for every member of a linked set within one group.

    Breadth first: each fingerprint leaves the open set once found, so a dense group costs about one
    comparison a member. Open fingerprints are kept in order of their first coordinate, and only
    those within max_bits of the current one there are looked at.
    """
    fp = np.unique(fp)
    coord = _coordinates(fp, piv)
    order = np.argsort(coord[:, 0], kind="stable")
    fp, coord = fp[order], coord[order]
    was, to = [], []
    while len(fp):
        members, queue = [fp[:1]], [(fp[0], coord[0])]
        fp, coord = fp[1:], coord[1:]
        while queue and len(fp):
            x, c = queue.pop()
            first = coord[:, 0]
            a, b = np.searchsorted(first, c[0] - max_bits, "left"), np.searchsorted(first, c[0] + max_bits, "right")
            near = np.flatnonzero((np.abs(coord[a:b] - c) <= max_bits).all(axis=1)) + a
            near = near[np.bitwise_count(fp[near] ^ x) <= max_bits]
            if len(near):
                members.append(fp[near])
                queue += list(zip(fp[near], coord[near]))
                left = np.ones(len(fp), bool)
                left[near] = False
                fp, coord = fp[left], coord[left]
        got = np.concatenate(members)
        if len(got) > 1:
            low = got.min()
            was.append(got[got != low])
            to.append(np.full(len(got) - 1, low))
    none = np.empty(0, np.uint64)
    return (np.concatenate(was), np.concatenate(to)) if was else (none, none)


def _linker(max_bits: int, n_pivots: int):
    small = 6  # groups up to this size are compared at once, by offset

    def links(fp: np.ndarray, run: np.ndarray, piv: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(run)) + 1
        at, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
        size = end - at
        was, to = [], []
        few = np.repeat(size <= small, size)
        f, r = fp[few], run[few]
        coord = _coordinates(f, piv)
        for d in range(1, small):
            i = np.flatnonzero(r[d:] == r[:-d]) if len(r) > d else np.empty(0, np.int64)
            i = i[(np.abs(coord[i] - coord[i + d]) <= max_bits).all(axis=1)]
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= max_bits]
            was.append(f[i])
            to.append(f[i + d])
        for a, b in zip(at[size > small].tolist(), end[size > small].tolist()):
            x, y = star_links(fp[a:b], max_bits, piv)
            was.append(x)
            to.append(y)
        x, y = np.concatenate(was).view(np.int64), np.concatenate(to).view(np.int64)
        a, b = np.maximum(x, y), np.minimum(x, y)
        keep = a != b
        pair = np.unique(np.stack([a[keep], b[keep]], 1), axis=0) if keep.any() else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv = pivots(n_pivots)
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            if cut:
                yield links(fp[:cut], key[:cut], piv)
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield links(fp, key, piv)

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, n_pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(a, b) fingerprint links that connect every pair of distinct fingerprints within max_bits."""
    masks = block_masks(max_bits, blocks)
    keys = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    met = keys.hint("merge").join(shared.hint("merge"), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int").alias("own")
    met = met.select("key", "fp", own, F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group")
    met = met.select(group, "fp").repartition("group").sortWithinPartitions("group")
    return met.mapInArrow(_linker(max_bits, n_pivots), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id: long) per row of docs.

    row_key is a hash of the whole text, root the smallest fingerprint of the component.

    component_id is the smallest doc_id reachable over links of at most max_bits differing bits, the
    row's own included. Null or empty texts have fingerprint zero and are linked like any other;
    rows with a null doc_id keep their row and take the component's smallest non-null id (null if it
    has none). Repeated rows stay. Other columns of docs are not read.
    """
    rows = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = fingerprint_links(distinct.select("fp"), max_bits)
    roots = materialize(connected_components(links), "roots")
    low = distinct.hint("merge").join(roots.hint("merge"), distinct.fp == roots.node).groupBy("root").agg(F.min("least").alias("component_id"))
    low = materialize(low, "components")  # as below, for a component of very many fingerprints
    linked = roots.hint("merge").join(low.hint("merge"), "root").select(F.col("node").alias("fp"), "root", "component_id")
    # Written out, so that the last join has nothing but two exchanges under it and a fingerprint that
    # very many rows share can be split.
    label = distinct.hint("merge").join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.hint("merge").join(materialize(label, "labels").hint("merge"), "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row for each near-duplicate group: the one with the group's smallest doc_id.

    Of repeated rows with that doc_id a single one stays. Rows with a null doc_id can't be named as
    members; they take no part and all stay. Columns are kept as they are.
    """
    named = docs.where(F.col(doc_id).isNotNull()).withColumns({"__tf_id": F.col(doc_id).cast("long"), "__tf_key": F.xxhash64(text)})
    marked = near_duplicates(named, doc_id, text, max_bits).where("doc_id = component_id")
    first = marked.groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("k")).select(F.col("k.doc_id").alias("__tf_id"), F.col("k.row_key").alias("__tf_key"))
    kept = named.hint("merge").join(first.hint("merge"), ["__tf_id", "__tf_key"], "left_semi").dropDuplicates(["__tf_id", "__tf_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))
