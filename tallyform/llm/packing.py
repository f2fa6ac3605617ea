"""Harmonic packing of tokenised documents into fixed-length sequences.

A length in (C/(k+1), C/k] belongs to class k, and a sequence of class k is closed once it holds k
pieces, so a worker fills sequences on its own, whatever the others do. Documents are cut so that
almost every piece has a length of exactly floor(C/k): whole sequences first (class 1), then the
largest floor(C/k) that fits the rest, and so on down to TAIL tokens; sequences of class k then miss
at most k - 1 of C tokens. Pieces of a worker's unfinished sequences are joined and cut at C, and the
last of those at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_view

CAPACITY, END_ID, TAIL = 1024, 0, 32
TOKENIZER = "byte_bpe_50k.json"
#: The split pattern that a ByteLevel pre-tokenizer stands for (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of a text as `tokenizers` gives them without special tokens being added.

    Byte-level BPE files whose ids follow the merge order are run by tiktoken, which gives the same
    ids several times as fast; texts that name an added token, and all other files, go to tokenizers.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.named = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not spec.get("normalizer"):
            chars = _byte_chars()
            ranks = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
            merged = [a + b if isinstance(m, list) else m.replace(" ", "") for m in model["merges"] for a, b in [m if isinstance(m, list) else ("", "")]]
            ids = [model["vocab"][t] for t in merged]
            if ids == sorted(ids) and len(ranks) == 256 + len(merged):
                import tiktoken

                self.fast = tiktoken.Encoding("from-file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not (self.named and self.named.search(text)):
            return np.asarray(self.fast.encode_ordinary(text), "<u4")
        return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(2)
def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Encoder(path)


def cuts(length: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Piece lengths of a document: whole sequences, then the largest reciprocal shares of one."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest >= max(tail, 1):
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out + [rest] * (rest > 0)


def powers(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Open sequences of one worker. Pieces are (row, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.tobytes(), total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray, tail: int) -> Iterator[tuple]:
        start = 0
        for n in cuts(len(ids), self.capacity, tail):
            k = self.capacity // n
            group = self.open.setdefault(k, [])
            group.append((doc, start, ids[start : start + n], len(ids)))
            start += n
            if len(group) == k:
                yield from self.close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """Join what is left and cut it at the capacity, then at powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in rest)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        i = 0
        for size in sizes:
            pieces, need = [], size
            while need:
                doc, start, ids, n = rest[i]
                if len(ids) <= need:
                    pieces.append(rest[i])
                    need -= len(ids)
                    i += 1
                else:
                    pieces.append((doc, start, ids[:need], n))
                    rest[i] = (doc, start + need, ids[need:], n)
                    need = 0
            yield from self.close(pieces)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(path: str | None, capacity: int, end_id: int | None, tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(path), Packer(capacity, TaskContext.get().partitionId() << 33)
        end = np.array([] if end_id is None else [end_id], "<u4")

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        rows: list[tuple] = []
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            _, off = utf8_view(text)
            for a, b in slices(off):
                for doc, t in zip(ids.slice(a, b - a).to_pylist(), text.slice(a, b - a).to_pylist()):
                    rows += packer.add(doc, np.concatenate([encode(t or ""), end]), tail)
                if rows:
                    yield table(rows)
                    rows = []
        rows = list(packer.finish())
        if rows:
            yield table(rows)

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID, tail: int = TAIL) -> DataFrame:
    """Pieces of all documents, each in its place: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Every id of every row lies in exactly one piece. Null texts count as empty: a row then has the
    closing id alone (no piece if end_id is None). Rows that repeat a doc_id, or have none, are packed
    one by one. Nothing is shuffled; sequence ids start at the partition number times 2^33. Without a
    path, the file is looked up where the worker runs.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_pack(tokenizer_path, capacity, end_id, tail), PIECES)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens and padded places of a packing (none where a length is a power of two)."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    two = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return per.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(two, 0).otherwise(capacity - F.col("n"))), F.lit(0)).alias("padded"))
