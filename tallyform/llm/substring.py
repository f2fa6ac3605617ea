"""Removal of word passages that an earlier document already holds.

Every window of `width` consecutive words gets a Rabin-Karp hash. Windows meet in Spark by their
minimiser, the least hash of the short word runs inside the window: it depends on the window's words
alone, and neighbouring windows mostly share it, so a run of windows travels as one row of packed
hashes instead of one row each. Within a minimiser, the least doc_id of each hash is found and the
windows of larger doc_ids are removed; removed windows merge into maximal intervals per document.

Before the shuffle each worker compares the windows it has read: one whose words start in a smaller
doc_id of the same slice is settled there and is not sent. A passage that a third of all documents
share thus sends one row a slice, and no key gathers its occurrences.

Windows that differ may share a minimiser too, such as those around a short phrase that very many
documents hold. Minimisers that would take a good part of a task are found in a sample of the rows
beforehand, and their windows are dealt by some bits of their own hashes as well; equal windows share
those bits, so the sample decides where windows meet and never whether they do.

Two windows count as equal when their 64-bit minimiser and 48 further hash bits agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, give_back, lean_batches, materialize, mix, row_bytes, slices, sort_groups, utf8_view, window_hashes, word_hashes, word_spans

WIDTH, CORE = 50, 8
#: Bytes of text in one slice of local comparison; its windows are sorted in memory.
LOCAL_BYTES = 4 << 20
#: A null doc_id is later than any other.
LAST = (1 << 63) - 1

#: One row in so many is looked at for common minimisers; one is common if its share of the windows exceeds a quarter of a task's.
SAMPLE, PART = 64, 0.25
#: Bytes of ranges in one task up to which they are joined by a hash table.
HASH_BYTES = 64 << 20

_SENT = pa.schema([("minimiser", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("packed", pa.binary()), ("steps", pa.binary())])
_SENT_DDL = "minimiser long, doc_id long, row_key long, at int, n int, packed binary, steps binary"
_RANGE = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])


def _least_of(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values, by doubling."""
    span, m = 1, h
    while span * 2 <= k:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (k - span)], m[k - span :]) if k > span else m


def _runs(*keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the maximal runs of equal keys at consecutive positions."""
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = at[1:] != at[:-1] + 1
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _windows(data: np.ndarray, off: np.ndarray, width: int, core: int) -> tuple[np.ndarray, ...]:
    """Row, position, minimiser and hash of every window of the rows of one slice.

    Bytes are hashed a small sub-slice at a time, as those arrays are much larger than the windows'.
    """
    parts = []
    for a, b in slices(off, SLICE_BYTES):
        start, end, first = word_spans(data[off[a] : off[b]], off[a : b + 1] - off[a])
        h = word_hashes(data[off[a] : off[b]], start, end)
        if len(h) < width:
            continue
        win, least = window_hashes(h, width), _least_of(window_hashes(h, core), width - core + 1)
        row = np.repeat(np.arange(b - a), np.diff(first))[: len(win)]
        pos = np.arange(len(win)) - first[row]
        inside = np.arange(len(win)) + width <= first[row + 1]
        parts.append(((row[inside] + a), pos[inside].astype(np.int32), least[inside], win[inside]))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _binary(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw).view(np.uint8))])


def _packed(h: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Six bytes of each hash, joined for each run that starts at `cut`."""
    return _binary(h.view(np.uint8).reshape(-1, 8)[:, :6].copy(), np.append(cut, len(h)) * 6)


def _slices(batch: pa.RecordBatch, width: int, core: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, position, minimiser, hash, doc_id, row_key of every window of a slice, and whether it is settled there."""
    ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
    keys = batch.column(1).to_numpy(zero_copy_only=False)
    raw, off = utf8_view(batch.column(2))
    for a, b in slices(off, LOCAL_BYTES):
        row, pos, least, win = _windows(raw[off[a] : off[b]], off[a : b + 1] - off[a], width, core)
        if not len(row):
            continue
        doc, key = ids[a:b][row], keys[a:b][row]
        # A window is settled here if a smaller doc_id of this slice starts with the same words.
        order = sort_groups(win)
        w = win[order]
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        size = np.diff(np.append(head, len(w)))
        low = np.empty(len(w), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(doc[order], head), size)
        yield row, pos, least, win, doc, key, doc > low


def _counter(width: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, least, _, _, _, settled in _slices(batch, width, core):
                m = np.sort(least[~settled].view(np.int64))
                head = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(m[head]), pa.array(np.diff(np.append(head, len(m))))], ["minimiser", "n"])
        give_back()

    return run


def common_minimisers(rows: DataFrame, width: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers that hold more than PART of a task's windows, in order, and the bits by which to deal the windows of each.

    At most 1 / PART minimisers a shuffle partition can be that common, so the driver holds no more.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where(F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(SAMPLE)) == 0)
    counts = materialize(some.mapInArrow(_counter(width, core), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")), "minimisers")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(total * PART / tasks, 4 * width)
    got = sorted((r.minimiser, r.n) for r in counts.where(F.col("n") > most).collect())
    return np.array([m for m, _ in got], np.int64), np.array([min(int(n / most).bit_length(), 16) for _, n in got], np.int64)


def _sender(width: int, core: int, common=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, bits = common.value if common else (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            for row, pos, least, win, doc, key, settled in _slices(batch, width, core):

                def sent(i: np.ndarray, to: np.ndarray, n: np.ndarray, packed: pa.Array, steps: pa.Array | None = None) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(to), pa.array(doc[i]), pa.array(key[i]), pa.array(pos[i].astype(np.int32)), pa.array(n.astype(np.int32)), packed, pa.nulls(len(i), pa.binary()) if steps is None else steps], schema=_SENT)

                i = np.flatnonzero(settled)
                if len(i):
                    r = _runs(row[i], at=pos[i])
                    n = np.diff(np.append(r, len(i)))
                    i = i[r]
                    yield sent(i, mix(key[i].view(np.uint64) + doc[i].view(np.uint64)).view(np.int64), n, pa.nulls(len(i), pa.binary()))
                place = np.searchsorted(hot, least.view(np.int64)) if len(hot) else None
                dealt = hot[np.minimum(place, len(hot) - 1)] == least.view(np.int64) if len(hot) else np.zeros(len(row), bool)
                i = np.flatnonzero(~settled & ~dealt)
                if len(i):
                    r = _runs(row[i], least[i], at=pos[i])
                    blob = _packed(win[i], r)
                    yield sent(i[r], least[i[r]].view(np.int64), np.diff(np.append(r, len(i))), blob)
                i = np.flatnonzero(~settled & dealt)
                if len(i):
                    # Windows of one run that go to the same place travel in one row, with their steps from its first.
                    run_of = np.zeros(len(i), np.int64)
                    run_of[_runs(row[i], least[i], at=pos[i])] = 1
                    salt = (win[i] >> (np.uint64(64) - bits[place[i]].astype(np.uint64))).astype(np.int64)
                    order = np.lexsort((pos[i], pos[i] >> 15, salt, np.cumsum(run_of)))
                    i, salt, part = i[order], salt[order], (np.cumsum(run_of)[order], pos[i][order] >> 15)
                    r = np.flatnonzero(np.append(True, (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]) | (salt[1:] != salt[:-1])))
                    n = np.diff(np.append(r, len(i)))
                    steps = _binary((pos[i] - np.repeat(pos[i[r]], n)).astype(np.uint16), np.append(r, len(i)) * 2)
                    yield sent(i[r], mix(least[i[r]] ^ mix(salt[r].view(np.uint64) + np.uint64(1))).view(np.int64), n, _packed(win[i], r), steps)
        give_back()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser to removed ranges. Only what a minimiser still needs is carried on."""
    keep: list[np.ndarray] = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]

    def ranges(doc, key, at, n=None) -> pa.RecordBatch:
        if n is None:
            order = np.lexsort((at, key, doc))
            doc, key, at = doc[order], key[order], at[order]
            r = _runs(doc, key, at=at)
            n = np.diff(np.append(r, len(at)))
            doc, key, at = doc[r], key[r], at[r]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], schema=_RANGE)

    for batch in batches:
        blob = batch.column(5)
        done = np.asarray(blob.is_null())
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if done.any():
            yield ranges(*[c[done].astype(np.int64) for c in cols[1:5]])
        least, doc, key, at, n = [c[~done] for c in cols]
        raw, off = utf8_view(blob)
        six = raw[off[0] : off[-1]].reshape(-1, 6) if len(raw) else np.empty((0, 6), np.uint8)
        h = np.zeros((len(six), 8), np.uint8)
        h[:, :6] = six
        n = n.astype(np.int64)
        step = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        jumps = batch.column(6)
        if jumps.null_count < len(jumps):
            far, cut = utf8_view(jumps)
            step[np.repeat(np.asarray(jumps.is_valid())[~done], n)] = far[cut[0] : cut[-1]].view(np.uint16)
        new = [np.repeat(least.view(np.uint64), n), h.reshape(-1).view(np.uint64), np.repeat(doc, n), np.repeat(key, n), np.repeat(at.astype(np.int64), n) + step]
        m, h, doc, key, at = [np.concatenate([x, y]) for x, y in zip(keep, new)]
        if not len(m):
            continue
        both = mix(m) ^ h * np.uint64(0x9E3779B97F4A7C15)
        order = sort_groups(both)
        ms, hs = m[order], h[order]
        b = both[order]
        if np.any((b[1:] == b[:-1]) & ((ms[1:] != ms[:-1]) | (hs[1:] != hs[:-1]))):
            order = np.lexsort((h, m))
            ms, hs = m[order], h[order]
        head = np.flatnonzero(np.append(True, (ms[1:] != ms[:-1]) | (hs[1:] != hs[:-1])))
        low = np.empty(len(m), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(doc[order], head), np.diff(np.append(head, len(m))))
        gone = doc > low
        if gone.any():
            yield ranges(doc[gone], key[gone], at[gone])
        last = m[-1] if not len(new[0]) else new[0][-1]
        open_ = ~gone & (m == last)  # the last minimiser may go on in the next batch
        keep = [x[open_] for x in (m, h, doc, key, at)]
    give_back()


def removed_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, core: int = CORE) -> DataFrame:
    """(doc_id, row_key, at, n): runs of n windows from word `at` on that a smaller doc_id also starts."""
    if not 0 < core <= width:
        raise ValueError("core must be in 1..width")
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), F.col(text).cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_minimisers(rows, width, core))
    sent = rows.mapInArrow(_sender(width, core, common), _SENT_DDL)
    return sent.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_settle, "doc_id long, row_key long, at int, n int")


def _keep_mask(n_words: int, ranges: list[dict] | None, width: int) -> np.ndarray:
    change = np.zeros(n_words + 1, np.int64)
    for r in ranges or ():
        change[r["at"]] += 1
        change[r["at"] + r["n"] - 1 + width] -= 1
    return np.cumsum(change[:-1]) == 0


def _apply(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, is_null, ranges in zip(row_bytes(batch.column("__tf_text")), np.asarray(batch.column("__tf_text").is_null()).tolist(), batch.column("__tf_ranges").to_pylist()):
                words = text.split()
                kept = words
                if ranges:
                    mask = _keep_mask(len(words), ranges, width)
                    kept = [w for w, k in zip(words, mask.tolist()) if k]
                joined = b" ".join(kept)
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(None if is_null else joined if ranges else text)
                out[3].append(hashlib.sha256(joined).hexdigest())
            cols = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in ("__tf_text", "__tf_ranges")]
            names = [x for x in batch.schema.names if x not in ("__tf_text", "__tf_ranges")]
            new = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + new, names + ["_n_words", "_n_removed", "_kept", "_sha"])
        give_back()

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, core: int = CORE) -> DataFrame:
    """All rows and columns of docs but the text, with _n_words, _n_removed, _kept (what is left of the text) and _sha.

    A word goes if a window of `width` words that covers it also starts in a row with a smaller
    doc_id. Rows are judged on the input, not on what is left, so order does not matter. Null texts
    have no words and stay null; texts without a removal keep their spacing in _kept, others are
    joined by single spaces. A null doc_id counts as the largest. Rows that repeat a doc_id do not
    remove each other's words. _sha is the SHA-256 of the kept words joined by single spaces.
    """
    ranges = materialize(removed_ranges(docs, doc_id, text, width, core), "ranges")
    # Rows that repeat a document send the same ranges; by their starts first, a list is never longer than the document.
    gone = ranges.groupBy("doc_id", "row_key", "at").agg(F.max("n").alias("n")).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("at", "n")).alias("__tf_ranges"))
    few = ranges.count() * 64 <= HASH_BYTES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = gone.select(F.col("doc_id").alias("__tf_id"), F.col("row_key").alias("__tf_key"), "__tf_ranges")
    names = [c for c in docs.columns if c not in (text, "_n_words", "_n_removed", "_kept", "_sha")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias("__tf_text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("__tf_id"), F.xxhash64(text).alias("__tf_key"))
    joined = rows.join(gone.hint("shuffle_hash") if few else gone, ["__tf_id", "__tf_key"], "left").drop("__tf_id", "__tf_key")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(_apply(width), (fields + ", " if fields else "") + "_n_words long, _n_removed long, _kept string, _sha string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, core: int = CORE) -> DataFrame:
    """docs with repeated passages removed from their text; columns and rows are kept.

    Repeated rows stay, each with the same words left: they do not remove each other's. Null texts stay null.
    """
    new = ("_n_words", "_n_removed", "_kept", "_sha")
    own = [c for c in docs.columns if c in new]
    out = dedup_substrings(docs.withColumnsRenamed({c: f"__tf_own{c}" for c in own}), doc_id, text, width, core)
    out = out.drop(*[c for c in new if c != "_kept"]).withColumnRenamed("_kept", "__tf_kept").withColumnsRenamed({f"__tf_own{c}": c for c in own})
    return out.select(*[F.col("__tf_kept").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
