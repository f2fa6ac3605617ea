"""Spelling variants: words at distance one, found by walking compact tries with each word's automaton.

Words are counted in Spark. The sorted vocabulary is cut into shards of bounded size, each of which a
worker builds into a path-compressed trie. Tries are broadcast a bounded number of bytes at a time,
and every word's automaton of Levenshtein distance one is intersected with each of them depth-first:
along the path of the word itself every edit opens branches, which are followed to their end before
the path goes on. Words are taken in blocks, so that one step moves the states of a whole block.
What the shards accept is summed up per word in Spark, and forms are followed to their roots by
doubling the links.

Letters are those of Latin-1, so a word is one byte a code point and bytes sort like code points.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize

#: Words and bytes of one trie; a longer word is a trie of its own.
SHARD_WORDS, SHARD_BYTES = 1 << 16, 1 << 20
#: Bytes of tries that are broadcast at once. More tries take more passes over the words, not more memory.
BROADCAST_BYTES = 48 << 20
#: Words whose automata walk together, and words of one task.
BLOCK, TASK_WORDS = 1 << 12, 1 << 14

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 97, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words of at least least_length code points that occur at least least_n times.

    A run whose crc32 of `<doc_id>:<run>` the modulus divides loses its code point number crc32 % length. Runs shorter
    than least_length can only get shorter, so they are not looked at. A null text has no runs, a null doc_id is empty in the key.
    """
    low = F.translate(F.col(f"`{text}`").cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    keyed = runs.withColumn("crc", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = (F.col("crc") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = keyed.select(F.when(F.col("crc") % modulus == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


# ---------------------------------------------------------------- tries


def build_trie(words: list[bytes], counts: list[int]) -> dict[str, np.ndarray]:
    """A path-compressed trie of sorted distinct words.

    Node v ends at depth[v], at word term[v] if that is not -1, and its label is the end of the path that word rep[v]
    spells from its parent's depth. Children lie by (parent, first byte) in keys and kids, those of v from first[v] on.
    """
    parent, depth, term, rep, stack, last = [0], [0], [-1], [0], [0], b""
    for i, word in enumerate(words):
        common = 0
        for a, b in zip(last, word):
            if a != b:
                break
            common += 1
        below = -1
        while depth[stack[-1]] > common:
            below = stack.pop()
        if depth[stack[-1]] < common:
            parent[below] = len(parent)
            parent.append(stack[-1])
            depth.append(common)
            term.append(-1)
            rep.append(i)
            stack.append(len(parent) - 1)
        parent.append(stack[-1])
        depth.append(len(word))
        term.append(i)
        rep.append(i)
        stack.append(len(parent) - 1)
        last = word
    up, down = np.array(parent, np.int64), np.array(depth, np.int64)
    pool = np.frombuffer(b"".join(words), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    path = start[np.array(rep, np.int64)]
    kids = np.arange(1, len(up))
    keys = up[1:] * 256 + pool[path[1:] + down[up[1:]]]
    order = np.argsort(keys)
    keys = np.append(keys[order], np.iinfo(np.int64).max)
    return {
        "pool": pool, "start": start, "path": path, "depth": down, "term": np.array(term, np.int64), "keys": keys, "kids": np.append(kids[order], 0),
        "first": np.searchsorted(keys, np.arange(len(up) + 1) * 256), "n": np.array(counts, np.int64),
    }


def _bytes(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done() -> pa.RecordBatch:
        trie = pickle.dumps(build_trie(words, counts), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([trie], pa.binary()), pa.array([len(trie)], pa.int64())], ["trie", "size"])

    words, counts, size = [], [], 0
    for batch in batches:
        for word, n in zip(_bytes(batch.column("word")), batch.column("n").to_pylist()):
            if words and (len(words) == SHARD_WORDS or size + len(word) > SHARD_BYTES):
                yield done()
                words, counts, size = [], [], 0
            words.append(word)
            counts.append(n)
            size += len(word)
    if words:
        yield done()


class _Walk:
    """The automata of a block of words on one trie."""

    def __init__(self, trie: dict[str, np.ndarray], words: list[bytes]) -> None:
        self.__dict__.update(trie)
        self.chars = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self.size = np.diff(self.at)
        self.found: list[np.ndarray] = []

    def step(self, node: np.ndarray, deep: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where char leads from depth `deep` on the way to node, and whether it leads anywhere."""
        inside = deep < self.depth[node]
        to, ok = node.copy(), np.zeros(len(node), bool)
        i = np.flatnonzero(inside)
        ok[i] = self.pool[self.path[node[i]] + deep[i]] == char[i]
        i = np.flatnonzero(~inside)
        key = node[i] * 256 + char[i]
        k = np.searchsorted(self.keys, key)
        ok[i] = self.keys[k] == key
        to[i] = self.kids[k]
        return to, ok

    def follow(self, word: np.ndarray, node: np.ndarray, deep: np.ndarray, pos: np.ndarray) -> None:
        """Branches after their edit: the rest of the word has to be spelled exactly, and a word has to end there."""
        while len(word):
            end = pos == self.size[word]
            i = np.flatnonzero(end)
            hit = (deep[i] == self.depth[node[i]]) & (self.term[node[i]] >= 0)
            i = i[hit]
            self.found.append(word[i] * len(self.n) + self.term[node[i]])
            word, node, deep, pos = (x[~end] for x in (word, node, deep, pos))
            node, ok = self.step(node, deep, self.chars[self.at[word] + pos])
            word, node, deep, pos = word[ok], node[ok], deep[ok] + 1, pos[ok] + 1

    def near(self) -> np.ndarray:
        """Sorted distinct word * shard size + term of all pairs at distance one."""
        word = np.arange(len(self.size))
        node = deep = np.zeros(len(word), np.int64)
        pos = 0
        while len(word):
            left = pos < self.size[word]
            self.follow(word[left], node[left], deep[left], np.full(left.sum(), pos + 1))  # the word's own letter is left out
            inside = deep < self.depth[node]
            i, j = np.flatnonzero(inside), np.flatnonzero(~inside)
            low, many = self.first[node[j]], self.first[node[j] + 1] - self.first[node[j]]
            slot = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(j) else low, many) + np.arange(many.sum())
            kid = self.kids[slot]
            w = np.concatenate([word[i], np.repeat(word[j], many)])
            to = np.concatenate([node[i], kid])
            d = np.concatenate([deep[i], np.repeat(deep[j], many)])
            char = self.pool[self.path[to] + d]
            self.follow(w, to, d + 1, np.full(len(w), pos))  # the trie has a letter more
            other = (pos < self.size[w]) & (char != self.chars[np.minimum(self.at[w] + pos, len(self.chars) - 1)])
            self.follow(w[other], to[other], d[other] + 1, np.full(other.sum(), pos + 1))  # another letter
            word, node, deep = word[left], node[left], deep[left]
            node, ok = self.step(node, deep, self.chars[self.at[word] + pos])
            word, node, deep, pos = word[ok], node[ok], deep[ok] + 1, pos + 1
        return np.unique(np.concatenate(self.found)) if self.found else np.empty(0, np.int64)


def near_words(trie: dict[str, np.ndarray], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of words with near ones in the trie, the number of these, and of these the one of largest n (ties: the first)."""
    pairs = _Walk(trie, words).near()
    word, term = pairs // len(trie["n"]), pairs % len(trie["n"])
    who, many = np.unique(word, return_counts=True)
    order = np.lexsort((term, -trie["n"][term], word))
    return who, many, term[order][np.searchsorted(word, who)]


def _walk(tries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            for a in range(0, len(column), BLOCK):
                words = _bytes(column.slice(a, BLOCK))
                for data in tries.value:
                    trie = pickle.loads(data)
                    who, many, best = near_words(trie, words)
                    if len(who):
                        text = [bytes(trie["pool"][trie["start"][t] : trie["start"][t + 1]]).decode("latin-1") for t in best]
                        arrays = [pa.array([words[i].decode("latin-1") for i in who], pa.string()), pa.array(many, pa.int64()), pa.array(-trie["n"][best], pa.int64()), pa.array(text, pa.string())]
                        yield pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "minus_n", "best"])

    return run


def _passes(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Shards of at most BROADCAST_BYTES together, or one larger."""
    part: list[int] = []
    held = 0
    for shard, size in sizes:
        if part and held + size > BROADCAST_BYTES:
            yield part
            part, held = [], 0
        part.append(shard)
        held += size
    if part:
        yield part


def neighbours(vocabulary: DataFrame) -> list[DataFrame]:
    """(word, n_near, minus_n, best) for each word and shard that holds words near it, in written tables; vocabulary is a written table.

    The driver reads the sizes of the tries, and of the tries themselves one pass at a time.
    """
    spark: SparkSession = vocabulary.sparkSession
    size = vocabulary.count()
    built = vocabulary.repartitionByRange(max(1, -(-size // SHARD_WORDS)), "word").sortWithinPartitions("word").mapInArrow(_shards, "trie binary, size long")
    shards = materialize(built.withColumn("shard", F.monotonically_increasing_id()), "trie-shards")
    out = []
    for part in _passes(sorted((r.shard, r.size) for r in shards.select("shard", "size").collect())):
        tries = spark.sparkContext.broadcast([bytes(r.trie) for r in shards.where(F.col("shard").isin(part)).select("trie").collect()])
        try:
            found = vocabulary.select("word").repartition(max(1, -(-size // TASK_WORDS)), "word").mapInArrow(_walk(tries), "word string, n_near long, minus_n long, best string")
            out.append(materialize(found, "near-words"))
        finally:
            tries.destroy()
    discard(vocabulary, [shards])
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links without a cycle: each round doubles the steps, so a chain of k takes log2 k rounds."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        links = materialize(links, "form-links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        if longer.where("moved").isEmpty():
            return links
        links = longer.drop("moved")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 97, least_length: int = 5, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs; see word_counts for the words.

    n_near is the number of words at Levenshtein distance one over code points; form is the near word of largest n, of equal
    ones the smallest, if that n is at least ratio times the word's; root follows forms to the last. Words without a form
    have null form and form_n and are their own root. Repeated rows count again; other columns play no part; no words, no rows.
    n grows by the ratio (at least 2) with each form, so forms make no cycle.
    """
    vocabulary = materialize(word_counts(docs, doc_id, text, modulus, least_length, least_n), "vocabulary")
    found = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("minus_n"), F.lit(None).cast("string").alias("best"))
    for part in neighbours(vocabulary):
        found = found.unionByName(part.withColumn("n", F.lit(None).cast("long")))
    summed = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), F.struct("minus_n", "best"))).alias("top"))
    enough = -F.col("top.minus_n") >= ratio * F.col("n")
    words = materialize(summed.select("word", F.when(enough, F.col("top.best")).alias("form"), "n", "n_near", F.when(enough, -F.col("top.minus_n")).alias("form_n")), "variants")
    ends = roots(words.where("form IS NOT NULL"))
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
