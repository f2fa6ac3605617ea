"""Language of documents by spans: script ranges narrow the candidates, Viterbi labels the words.

Words are runs of letters and marks. Each word scores every language by smoothed log frequencies of
its character pairs and triples (word edges included) and of the whole word, all hashed. A word's
script leaves only the languages that were seen in that script. Viterbi over a document's words with
a penalty for each switch gives the spans; the document takes the language with most letters.

The model is counted in Spark from about `per_lang` documents of each language, those whose hash of
doc_id lies in the lowest share that this makes of the language; the bound does not grow with the
table. Scoring reads all whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, give_back, held_out, lean_batches, mix, slices, utf8_view, word_hashes

PER_LANG, BUCKET_BITS, SWITCH, SMOOTH, SCRIPT_SHARE = 3000, 15, 8.0, 0.5, 0.01
#: Weights of the pair, triple and whole-word terms; pairs and triples overlap, so they count less than one each.
WEIGHTS = (0.2, 0.4, 0.5)
UND = "und"
#: Characters of a text whose words are scored at once; the parts of a longer one are joined before Viterbi.
PART_CHARS = 1 << 19
#: Rows that Viterbi follows one by one, and words of one that it turns into plain numbers at once.
FEW, BLOCK = 8, 1 << 15
_BLANK = re.compile(r"\s")

#: First and last code point of the main ranges of each script (fixed values of the Unicode standard).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))
_TOP = 0x323B0


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """2 for letters and 1 for marks, and the number of the script; the last entry stands for all higher code points."""
    letter = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(_TOP)] + [0], np.uint8)
    script = np.zeros(_TOP + 1, np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return letter, script


class Words:
    """Words of some texts as arrays: row, first letter's script, letters, and hashed features."""

    def __init__(self, texts: list[str]) -> None:
        letter, script = _tables()
        lowered = [t.lower() for t in texts]
        code = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = letter[np.minimum(code, _TOP)] if len(code) else np.empty(0, np.uint8)
        self.at = np.flatnonzero(kind)
        run = np.flatnonzero(np.append(True, np.diff(self.at) > 1)) if len(self.at) else np.empty(0, np.int64)
        bare = np.maximum.reduceat(kind[self.at], run) < 2 if len(run) else np.empty(0, bool)
        if bare.any():  # marks without a letter are no word
            kind = kind.copy()
            kind[self.at[np.repeat(bare, np.diff(np.append(run, len(self.at))))]] = 0
            self.at = np.flatnonzero(kind)
        is_letter = kind > 0
        edge = np.append(True, np.diff(self.at) > 1) if len(self.at) else np.empty(0, bool)
        self.first = np.flatnonzero(edge)  # among letters
        start = self.at[self.first]
        self.letters = np.diff(np.append(self.first, len(self.at)))
        ends = np.cumsum([len(t) + 1 for t in lowered]) if lowered else np.empty(0, np.int64)
        self.row = np.searchsorted(ends, start, "right")
        self.of_row = np.searchsorted(start, np.concatenate([[0], ends])) if len(ends) else np.zeros(1, np.int64)
        self.script = script[np.minimum(code[start], _TOP)] if len(start) else np.empty(0, np.uint8)
        padded = np.zeros(len(code) + 2, np.uint64)
        padded[1:-1] = np.where(is_letter, code, 0)
        b, a, c = padded[self.at + 1], padded[self.at], padded[self.at + 2]
        shift = np.uint64(64 - BUCKET_BITS)
        odd = np.uint64(0x9E3779B97F4A7C15)
        pair = (b << np.uint64(21)) | c
        self.pair = ((pair * odd) >> shift).astype(np.int32)
        self.triple = (mix((a << np.uint64(42)) ^ pair) >> shift).astype(np.int32)
        self.word = (word_hashes(code, start, start + self.letters) >> shift).astype(np.int32)


#: Kinds of counts in the model's table.
PAIR, TRIPLE, WORD, SCRIPT = 0, 1, 2, 3


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        langs, text = batch.column(0).to_pylist(), batch.column(1)
        _, off = utf8_view(text)
        for a, b in slices(off):
            rows, names = text.slice(a, b - a).to_pylist(), np.array(langs[a:b], object)
            for lang in sorted(set(langs[a:b])):
                w = Words([t for t, n in zip(rows, names) if n == lang])
                for kind, ids, size in ((PAIR, w.pair, 1 << BUCKET_BITS), (TRIPLE, w.triple, 1 << BUCKET_BITS), (WORD, w.word, 1 << BUCKET_BITS), (SCRIPT, w.script, len(SCRIPT_NAMES))):
                    got = np.bincount(ids, minlength=size)
                    total[lang, kind] = got + total.get((lang, kind), 0)
    for (lang, kind), n in total.items():
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(n[i].astype(np.int64))], ["lang", "kind", "id", "n"])


class Model:
    """Log frequencies by hashed feature and language, and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        rate = counts + SMOOTH
        self.tables = [(np.log(rate[k] / rate[k].sum(axis=0)) * w).astype(np.float32) for k, w in enumerate(WEIGHTS)]
        self.allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)

    def scores(self, w: Words) -> np.ndarray:
        """One row a word: a score for each language, far below all others where the script rules it out."""
        out = np.add.reduceat(self.tables[PAIR][w.pair] + self.tables[TRIPLE][w.triple], w.first, axis=0) if len(w.first) else np.empty((0, len(self.langs)), np.float32)
        out += self.tables[WORD][w.word]
        out -= out.max(axis=1, keepdims=True)
        may = self.allowed[w.script]
        out[~may] = -1e6
        out[~may.any(axis=1)] = 0
        return out


def viterbi(score: np.ndarray, of_row: np.ndarray, penalty: float, few: int = FEW) -> np.ndarray:
    """Best label of every word: the sum of scores less the penalty for each switch inside a row.

    All rows advance together, one word a step, longest rows first, so each step is a few array
    operations; once no more than `few` rows are left, each goes on by itself over plain numbers. Ties
    keep the current label, then take the smaller one.
    """
    size = np.diff(of_row)
    order = np.argsort(-size, kind="stable")
    start, size = of_row[:-1][order], size[order]
    label = np.zeros(len(score), np.int16)
    if not len(score):
        return label
    steps = int(size[0])
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # rows with more than t words
    until = max(int(np.searchsorted(-alive, -few, "left")), 1)  # from here on rows are followed one by one
    stay, best = np.ones(score.shape, bool), np.zeros(len(score), np.int16)
    value = score[start[: alive[0]]].astype(np.float64)
    for t in range(1, min(steps, until)):
        n = alive[t]
        v, at = value[:n], start[:n] + t
        top = v.argmax(axis=1)
        moved = (v[np.arange(n), top] - penalty)[:, None]
        keep = v >= moved
        stay[at], best[at] = keep, top
        value[:n] = np.where(keep, v, moved) + score[at]
    late = int(alive[until]) if until < steps else 0
    for r in range(late):
        v = value[r].tolist()
        for a in range(start[r] + until, start[r] + size[r], BLOCK):
            b = min(a + BLOCK, start[r] + size[r])
            before = []
            for s in score[a:b].tolist():
                before.append(v)
                moved = max(v) - penalty
                v = [(x if x >= moved else moved) + y for x, y in zip(v, s)]
            was = np.array(before)
            stay[a:b], best[a:b] = was >= was.max(axis=1, keepdims=True) - penalty, was.argmax(axis=1)
        value[r] = v
    now = np.zeros(len(size), np.int16)
    now[: alive[0]] = value.argmax(axis=1)
    for r in range(late):
        # Back from switch to switch: a label reaches back to the last word at which it was not kept.
        first, end, k = start[r] + until, start[r] + size[r], now[r]
        while end > first:
            cut = _last_false(stay, first, end, k)
            if cut < first:
                label[first:end] = k
                break
            label[cut:end] = k
            k, end = best[cut], cut
        now[r] = k
    for t in range(min(steps, until) - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        label[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], best[at])
    return label


def _last_false(stay: np.ndarray, first: int, end: int, k: int) -> int:
    """Last place in first..end at which label k was not kept; first - 1 if there is none. Looks back in growing steps."""
    step = 64
    while end > first:
        a = max(first, end - step)
        gone = np.flatnonzero(~stay[a:end, k])
        if len(gone):
            return a + int(gone[-1])
        end, step = a, step * 2
    return first - 1


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """(lang, text) of rows with a language that are not held out: about per_lang of each language, all of smaller ones.

    Hashes are spread evenly, so a language of n rows keeps those under per_lang / n of their range;
    only the counts are gathered, one row a language.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).cast("string").alias("text"), held_out(doc_id).alias("out"))
    rows = rows.where("lang is not null and not out")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.select("lang", "text").limit(0)
    last = {k: (1 << 63) - 1 if n <= per_lang else (per_lang << 64) // n - (1 << 63) for k, n in sizes.items()}
    bound = F.create_map(*[F.lit(x) for kv in sorted(last.items()) for x in kv])
    return rows.where(F.col("h") <= F.element_at(bound, F.col("lang"))).select("lang", "text")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Model from training_rows. A language all of whose texts are null or have no letter is not learned."""
    lean_batches(docs.sparkSession)
    chosen = training_rows(docs, doc_id, text, lang, per_lang).where("text is not null")
    got = chosen.mapInArrow(_counter, "lang string, kind int, id int, n long").groupBy("lang", "kind", "id").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts, scripts = np.zeros((3, 1 << BUCKET_BITS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    number = np.array([langs.index(x) for x in got.column("lang").to_pylist()], np.int64)
    kind, i, n = (got.column(c).to_numpy() for c in ("kind", "id", "n"))
    f = kind != SCRIPT
    counts[kind[f], i[f], number[f]] = n[f]
    scripts[i[~f], number[~f]] = n[~f]
    return Model(langs, counts, scripts)


def parted(texts: list[str], most: int = PART_CHARS) -> tuple[list[str], list[int]]:
    """Texts cut at white space into parts of about `most` characters, so that a long one needs no more memory at once, and the parts of each."""
    parts, counts = [], []
    for t in texts:
        before, a = len(parts), 0
        while len(t) - a > most:
            m = _BLANK.search(t, a + most)
            if m is None:
                break
            parts.append(t[a : m.start()])
            a = m.start()
        parts.append(t[a:])
        counts.append(len(parts) - before)
    return parts, counts


class Scored:
    """Scores, letters and rows of all words of some texts, worked out part by part."""

    def __init__(self, model: Model, texts: list[str]) -> None:
        parts, counts = parted(texts)
        score, letters, size, a = [], [], [], 0
        while a < len(parts):
            b, n = a + 1, len(parts[a])
            while b < len(parts) and n + len(parts[b]) <= 2 * PART_CHARS:
                n += len(parts[b])
                b += 1
            w = Words(parts[a:b])
            score.append(model.scores(w) if model.langs else np.empty((len(w.first), 0), np.float32))
            letters.append(w.letters)
            size.append(np.diff(w.of_row))
            a = b
        none = np.empty(0, np.int64)
        self.score = np.concatenate(score) if score else np.empty((0, len(model.langs)), np.float32)
        self.letters = np.concatenate([none, *letters])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([none, *size]))]).astype(np.int64)
        self.of_row = upto[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.of_row))


def label_texts(model: Model, texts: list[str], penalty: float = SWITCH, spans: bool = False) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, share of letters in it, and spans (lang, first word, words) of each text."""
    w = Scored(model, texts)
    k = len(model.langs)
    label = viterbi(w.score, w.of_row, penalty) if k else np.zeros(len(w.score), np.int16)
    weight = np.zeros((len(texts), max(k, 1)))
    np.add.at(weight, (w.row, label), w.letters)
    total, top = weight.sum(axis=1), weight.argmax(axis=1)
    pred = [model.langs[t] if k and s else UND for t, s in zip(top.tolist(), total.tolist())]
    share = np.where(total > 0, weight[np.arange(len(texts)), top] / np.maximum(total, 1), 0.0) * (k > 0)
    out: list[list[dict]] = []
    if spans:
        for a, b in zip(w.of_row[:-1].tolist(), w.of_row[1:].tolist()):
            cut = np.flatnonzero(np.diff(label[a:b])) + 1
            edge = [0, *cut.tolist(), b - a] if b > a and k else []
            out.append([{"lang": model.langs[label[a + x]], "first": x, "words": y - x} for x, y in zip(edge, edge[1:])])
    return pred, share.tolist(), out


def _labeller(shared, penalty: float, spans: bool):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column("__tf_text")
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__tf_text"]
            _, off = utf8_view(text)
            for a, b in slices(off, SLICE_BYTES * 2):
                pred, share, found = label_texts(model, [t or "" for t in text.slice(a, b - a).to_pylist()], penalty, spans)
                cols = [batch.column(i).slice(a, b - a) for i in keep] + [pa.array(pred, pa.string()), pa.array(share, pa.float64())]
                names = [batch.schema.names[i] for i in keep] + ["lang_pred", "score"]
                if spans:
                    cols, names = [*cols, pa.array(found, kind)], [*names, "spans"]
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH, spans: bool = False) -> DataFrame:
    """docs with lang_pred, score and, if asked for, spans appended (earlier columns of these names are replaced).

    score is the share of a text's letters inside spans of lang_pred. Null texts, texts without a
    letter, and all texts if nothing was learned are `und` with score 0. Words in a script that no
    learned language uses favour none. Rows repeat and stay.
    """
    lean_batches(docs.sparkSession)
    new = {"lang_pred", "score"} | ({"spans"} if spans else set())
    own = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(text).cast("string").alias("__tf_text"))
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own) + "lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_labeller(shared, penalty, spans), fields + (", spans array<struct<lang:string,first:int,words:int>>" if spans else ""))


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those whose language can't be told (und); columns are kept as they are."""
    named = docs.withColumnsRenamed({c: f"_own_{c}" for c in ("lang_pred", "score", "spans") if c in docs.columns})
    out = identify(named, train(docs, doc_id, text, lang), text).where(F.col("lang_pred") != UND)
    return out.select(*[F.col(f"`_own_{c}`").alias(c) if c in ("lang_pred", "score", "spans") else F.col(f"`{c}`") for c in docs.columns])
