"""Benchmark leaks in documents, by pigeonhole pieces and Myers' bit-parallel edit distance over words.

A test item of m words may be met with up to floor(rate * m) wrong, missing or extra words. Cut into
one piece more than that, at least one piece must occur unchanged, so every true match has an exact
piece hit. Hits are looked up by the hash of the piece's words; around each, the item is verified
with the bit-parallel distance (one bit a word of the item), and the best place is reported.

Items are indexed in blocks of bounded size, each broadcast to one pass over the documents. No
document is ever shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, utf8_view, window_hashes, word_hashes, word_spans

RATE, MIN_WORDS, BLOCK_BYTES = 0.2, 5, 8 << 20
_NOT_WORD = re.compile(r"\W+")
#: Characters of scripts that set no spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, bopomofo and han.
_UNSPACED = re.compile("([\u0e00-\u109f\u1780-\u17ff\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U000323af])")


def spaced(text: str) -> str:
    """text in lower case with a space for all that is no word, and around every character of an unspaced script."""
    text = text.lower()
    return _NOT_WORD.sub(" ", text if text.isascii() else _UNSPACED.sub(r" \1 ", text))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the first word's number of each text.

    Words are runs of letters, digits and _, lower case; each character of an unspaced script is one.
    """
    rows = [spaced(t).encode("utf-8", "surrogatepass") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    raw = np.frombuffer(b"".join(rows), np.uint8)
    start, end, first = word_spans(raw, off)
    return word_hashes(raw, start, end), first


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 pieces of m words whose lengths differ by one at most."""
    cut = [i * m // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def myers(masks: dict[int, int], m: int, text: list[int], anchored: bool) -> list[int]:
    """Distance of the pattern to the best substring that ends at each word of text (anchored: to the whole prefix).

    masks has the pattern's places of each word, one bit a place.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full | anchored
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        out.append(score)
    return out


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, w in enumerate(words):
        out[w] |= 1 << i
    return dict(out)


def best_match(item: list[int], text: list[int], k: int) -> tuple[int, int, int] | None:
    """(errors, start, end) of the first best place of item in text within k errors, else None."""
    m = len(item)
    dist = myers(_masks(item), m, text, False)
    least = min(dist, default=k + 1)
    if least > k:
        return None
    end = dist.index(least) + 1
    back = myers(_masks(item[::-1]), m, text[max(0, end - m - k) : end][::-1], True)
    size = min((n for n, d in enumerate(back, 1) if d == least), key=lambda n: abs(n - m), default=0)
    return least, end - size, end


class Index:
    """Pieces of a block of items by length and hash."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = RATE, min_words: int = MIN_WORDS) -> None:
        h, first = hashed_words(texts)
        self.items: list[tuple[int, list[int], int]] = []
        #: Words of the items that are too short to be looked for inside a text.
        self.lines = {tuple(w) for w in (spaced(t).split() for t in texts) if 0 < len(w) < min_words}
        by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()):
            m = b - a
            if m < max(min_words, 1):
                continue
            k = int(rate * m + 1e-9)
            for at, n in pieces(m, k):
                by_length[n].append((int(window_hashes(h[a + at : a + at + n], n)[0]), len(self.items), at))
            self.items.append((i, h[a:b].tolist(), k))
        self.pieces = {}
        for n, got in by_length.items():
            got.sort()
            keys = np.array([g[0] for g in got], np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[keys >> np.uint64(48)] = True
            self.pieces[n] = keys, np.array([g[1:] for g in got], np.int64), seen

    def has_line(self, text: str) -> bool:
        """Whether a whole line of text is one of the short items."""
        return bool(self.lines) and any(tuple(spaced(x).split()) in self.lines for x in text.splitlines())

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Per text (item id, errors, first word, end word) of every item that it holds, by item id."""
        h, first = hashed_words(texts)
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for n, (keys, refs, seen) in self.pieces.items():
            win = window_hashes(h, n)
            at = np.flatnonzero(seen[win >> np.uint64(48)])
            left = np.searchsorted(keys, win[at], "left")
            count = np.searchsorted(keys, win[at], "right") - left
            at, left, count = at[count > 0], left[count > 0], count[count > 0]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + n <= first[row + 1]
            for p, r, a, c in zip(at[inside].tolist(), row[inside].tolist(), left[inside].tolist(), count[inside].tolist()):
                for item, offset in refs[a : a + c].tolist():
                    places[r, item].add(p - offset)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for (r, item), starts in places.items():
            ident, words, k = self.items[item]
            a, b = int(first[r]), int(first[r + 1])
            best, spans = None, []
            for s in sorted(starts):
                x, y = max(a, s - k), min(b, s + len(words) + k)
                if spans and x <= spans[-1][1]:
                    spans[-1][1] = max(y, spans[-1][1])
                else:
                    spans.append([x, y])
            for x, y in spans:
                got = best_match(words, h[x:y].tolist(), k)
                if got and (best is None or got[0] < best[0]):
                    best = got[0], got[1] + x - a, got[2] + x - a
            if best:
                out[r].append((ident, *best))
        return [sorted(o) for o in out]


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, *, nameless: bool = False) -> Iterator[Index]:
    """One index for each block of about block_bytes of item text; a block is all that the driver holds.

    nameless takes items without an id too; all ids are 0 then.
    """
    ident = F.col(item_id).cast("long") if not nameless else F.lit(0).cast("long")
    items = benchmark.select(ident.alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        got = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        if got:
            yield Index([r.i for r in got], [r.t for r in got], rate, min_words)


_HIT = "doc_id long, item_id long, errors int, first_word int, end_word int"


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            _, off = utf8_view(text)
            for a, b in slices(off, SLICE_BYTES * 2):
                found = index.leaks([t or "" for t in text.slice(a, b - a).to_pylist()])
                rows = [(d, *hit) for d, hits in zip(ids.slice(a, b - a).to_pylist(), found) for hit in hits]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(cols)], ["doc_id", "item_id", "errors", "first_word", "end_word"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, errors, first_word, end_word): the best place of each item in each row that holds it.

    Items with fewer than min_words words are common phrases and take no part (min_words=1 looks for
    them too, unchanged); neither do items whose id or text is null or texts that have no words. Of equally good places the first is given. Rows of docs
    that repeat are judged one by one; of items with one id but several texts each is.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    parts = [rows.mapInArrow(_finder(spark.sparkContext.broadcast(x)), _HIT) for x in indexes(benchmark, item_id, item_text, rate, min_words)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _HIT)


def _cleaner(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            text = batch.column(at)
            _, off = utf8_view(text)
            for a, b in slices(off, SLICE_BYTES * 2):
                own = [t or "" for t in text.slice(a, b - a).to_pylist()]
                yield batch.slice(a, b - a).filter(pa.array([not f and not index.has_line(t) for f, t in zip(index.leaks(own), own)], pa.bool_()))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the rows that hold an item (see find_leaks), with an id or not; all columns are kept as they are.

    An item of fewer than min_words words is a phrase that clean texts hold too: a row goes if a whole line of it has the
    item's words and no others.
    """
    out = docs
    for x in indexes(benchmark, item_id, item_text, rate, min_words, nameless=True):
        out = out.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(x), docs.columns.index(text)), docs.schema)
    return out
