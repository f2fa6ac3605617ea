import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyform.llm import common, decontam, langid, licenses, quality
from tests.llm import fixture


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["a b  ab", None, "", "ba\tab\x0b a", "é e\u0301", "x" * 5000 + " " + "x" * 4999]
    raw, off = common.utf8_view(pa.array(texts))
    start, end, first = common.word_spans(raw, off)
    h = common.word_hashes(raw, start, end)
    got = [w for t in texts for w in (t or "").encode().split()]
    assert len(got) == len(h) and len(set(got)) == len(set(h.tolist()))
    assert all((a == b) == (x == y) for a, x in zip(got, h) for b, y in zip(got, h))
    assert np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts]


def test_sliced_arrays_are_read_from_their_offset():
    import pyarrow as pa

    a = pa.array(["aa", None, "b", "cc"]).slice(1, 3)
    assert common.row_bytes(a) == [b"", b"b", b"cc"]


def test_sort_groups_falls_back_on_shared_bits():
    key = np.array([5, 4, 5, 4, 7], np.uint64)  # all differ in the low bits only
    assert key[common.sort_groups(key)].tolist() == [4, 4, 5, 5, 7]


# ---------------------------------------------------------------- decontamination


def slow_distance(item, text):
    """Least edit distance of item to any substring of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_against_the_full_table():
    rng = random.Random(2)
    for _ in range(400):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(lo, 70))] for lo in (1, 0))
        if not item:
            continue
        got = decontam.best_match(item, text, len(item))
        assert (got[0] if got else len(item)) == slow_distance(item, text)
        if got:
            assert slow_distance(item, text[got[1] : got[2]]) == got[0]


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        at = rng.randrange(len(w))
        rng.choice([lambda: w.insert(at, "new"), lambda: w.pop(at), lambda: w.__setitem__(at, "other")])()
    return w


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(fixture.words(rng, rng.randint(6, 40)))) for i in range(12)] + [(12, "two words"), (13, None), (14, ""), (3, "a second text under id three that counts")]
    docs = []
    for d in range(50):
        w = fixture.words(rng, rng.randint(0, 200))
        if d % 2:
            item = items[d % 12][1].split()
            at = rng.randint(0, len(w))
            w[at:at] = edited(rng, item, rng.randint(0, len(item) // 3))
        docs.append((d, " ".join(w).upper()))
    docs += [(50, None), (51, ""), (52, items[1][1]), (52, items[2][1]), (None, items[4][1]), (53, " ".join(fixture.words(rng, 9000)) + " " + items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((repr(r.doc_id), r.item_id, r.errors) for r in decontam.find_leaks(fixture.frame(spark, docs), bench).collect())
    norm = lambda t: decontam._NOT_WORD.sub(" ", (t or "").lower()).split()
    want = []
    for d, t in docs:
        for i, x in items:
            item = norm(x)
            if len(item) >= decontam.MIN_WORDS and (e := slow_distance(item, norm(t))) <= int(0.2 * len(item) + 1e-9):
                want.append((repr(d), i, e))
    assert got == sorted(want) and len({w[2] for w in want}) > 2
    kept = decontam.without_leaks(fixture.frame(spark, docs), bench)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(d) for d, t in docs if not any(w[0] == repr(d) for w in want))
    assert kept.columns == fixture.empty(spark).columns


def test_items_of_unspaced_scripts_are_found(spark):
    items = [(1, "下列哪一项是正确的答案呢"), (2, "次のうち正しいものはどれですか"), (3, "ข้อใดต่อไปนี้เป็นคำตอบที่ถูกต้อง"), (4, "你好吗")]
    docs = [(1, "前文很长很长，下列哪一项是正确的答案呢？后文"), (2, "文章。次のうち正しいものはどれですか。"), (3, "บทความ" + items[2][1] + "จบ"), (4, "他说你好吗然后走了"), (5, "下列哪一项是不正确的答案呢"), (6, "没有关系的另一段文字在这里")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = fixture.frame(spark, docs)
    assert sorted((r.doc_id, r.item_id, r.errors) for r in decontam.find_leaks(frame, bench).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 1, 1)]
    assert sorted(r.doc_id for r in decontam.without_leaks(frame, bench).collect()) == [4, 6]
    assert (4, 4) in {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, bench, min_words=1).collect()}
    assert decontam.spaced("Ab, 한국어 é_1") == "ab 한국어 é_1"


def test_items_without_an_id_are_leaks_too(spark):
    text = "what is the answer to this question"
    bench = spark.createDataFrame([(None, text), (1, "another item of at least five words"), (None, None)], "item_id long, text string")
    frame = fixture.frame(spark, [(1, f"so {text} then"), (2, "nothing of that kind is in here"), (3, "another item of at least five words")])
    assert [r.doc_id for r in decontam.without_leaks(frame, bench).collect()] == [2]
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, bench).collect()] == [(3, 1)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    items = spark.createDataFrame([(i, " ".join(fixture.words(rng, 20))) for i in range(30)], "item_id long, text string")
    docs = fixture.frame(spark, [(i, r.text) for i, r in enumerate(items.collect())])
    one = decontam.find_leaks(docs, items).count()
    assert sum(1 for _ in decontam.indexes(items, block_bytes=300)) > 3
    monkeypatch.setattr(decontam.indexes, "__defaults__", ("item_id", "text", decontam.RATE, decontam.MIN_WORDS, 300))
    assert decontam.find_leaks(docs, items).count() == one == 30


def test_no_items_no_leaks(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = fixture.frame(spark, fixture.documents())
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.without_leaks(docs, none).count() == docs.count()
    assert decontam.find_leaks(fixture.empty(spark), none).count() == 0


def test_pieces_cover_the_item():
    for m in range(1, 60):
        for k in range(m):
            p = decontam.pieces(m, k)
            assert len(p) == k + 1 and [x for a, n in p for x in range(a, a + n)] == list(range(m)) and all(n for _, n in p)


# ---------------------------------------------------------------- quality


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = [t or "" for _, t in fixture.documents(3)]
    raw, off = common.utf8_view(pa.array(texts))
    both = quality.features(raw, off)
    for i, t in enumerate(texts):
        r, o = common.utf8_view(pa.array([t]))
        assert np.allclose(quality.features(r, o)[0], both[i])
    assert np.isfinite(both).all()


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(c, 1 + c, (300, quality.DIM)) @ rng.normal(size=(quality.DIM, quality.DIM)) for c in (0, 1)]
    sums = np.stack([np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()]) for z in x])
    got = quality.Discriminant(sums, 0.2).log_ratio(x[0][:5])
    dens = []
    for z in x:
        cov = np.cov(z.T, bias=True)
        cov = 0.8 * cov + 0.2 * np.diag(np.maximum(np.diag(cov), 1e-4) + 1e-3) + 1e-6 * np.eye(quality.DIM)
        d = x[0][:5] - z.mean(0)
        dens.append(-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(got, dens[1] - dens[0])


def test_quality_learns_and_keeps_held_out_labels_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels)
    rows = out.join(labels, "doc_id").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.9
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (out, quality.classify(docs, flipped)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert {r.doc_id for r in out.where("held_out").collect()} == {d for d in a if __import__("zlib").crc32(str(d).encode()) % 5 == 0}


def test_quality_of_awkward_rows(spark):
    rows = fixture.documents()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, None, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(fixture.frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in quality.classify(fixture.frame(spark, rows), labels.limit(0)).collect()}) == 1
    assert quality.classify(fixture.empty(spark), labels).count() == 0


# ---------------------------------------------------------------- language


def slow_viterbi(score, penalty):
    n, k = score.shape
    best = [[score[0, j], [j]] for j in range(k)]
    for t in range(1, n):
        best = [max(([best[i][0] - (penalty if i != j else 0) + score[t, j], best[i][1] + [j]] for i in range(k)), key=lambda x: x[0]) for j in range(k)]
    return max(best, key=lambda x: x[0])[0]


def test_viterbi_reaches_the_best_value():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 7, 0, 30, 7, 2, 0]
    of = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.normal(0, 3, (of[-1], 3)).astype(np.float32)
    label = langid.viterbi(score, of, 2.5)
    for a, b in zip(of[:-1], of[1:]):
        if b > a:
            s, lab = score[a:b].astype(float), label[a:b]
            assert s[np.arange(b - a), lab].sum() - 2.5 * (np.diff(lab) != 0).sum() == pytest.approx(slow_viterbi(s, 2.5))


def test_words_split_at_anything_but_letters():
    w = langid.Words(["Ça va, l'été?", "", "1 2 3", "日本 ab", "e\u0301t", "\u0301 1\u0302"])
    assert np.diff(w.of_row).tolist() == [4, 0, 0, 2, 1, 0]
    assert [langid.SCRIPT_NAMES[s] for s in w.script] == ["latin"] * 4 + ["han", "latin", "latin"]
    letter, _ = langid._tables()
    assert all((letter[c] > 0) == (unicodedata.category(chr(c))[0] in "LM") for c in range(0, 0x3000, 7))


def model(spark):
    rng = random.Random(1)
    own = {"xx": "kora mel tibu sanna", "yy": "drif gwost plench urk", "ru": "слово дом река"}
    rows = [(i, " ".join(rng.choice(own[k].split()) for _ in range(60)), k) for i, k in enumerate(list(own) * 40)] + [(500, None, "xx"), (501, "drif", None), (502, "", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, langid.train(docs)


def test_letters_of_all_planes_are_words(spark):
    assert [langid.SCRIPT_NAMES[s] for s in langid.Words(["\U00030000\U0003134a", "\U00031350", "\U000323af"]).script] == ["han"] * 3
    letter, _ = langid._tables()
    assert all((letter[min(c, langid._TOP)] == 2) == (unicodedata.category(chr(c))[0] == "L") for c in range(0x2F000, 0x110000))
    docs = fixture.frame(spark, [(1, "\U00030000\U00030001"), (2, "12")])
    assert [r.doc_id for r in langid.keep_known(docs).collect()] == [1]


def test_spans_of_mixed_text(spark):
    docs, m = model(spark)
    assert m.langs == ["ru", "xx", "yy"]
    text = " ".join(["kora mel tibu"] * 9 + ["drif gwost urk"] * 5 + ["дом река"] * 2)
    pred, share, spans = langid.label_texts(m, [text, "", "12 34", "слово"], spans=True)
    assert pred == ["xx", "und", "und", "ru"] and 0.5 < share[0] < 0.7
    assert [(s["lang"], s["first"], s["words"]) for s in spans[0]] == [("xx", 0, 27), ("yy", 27, 15), ("ru", 42, 4)] and spans[1] == []


def test_identify_awkward_rows(spark):
    _, m = model(spark)
    rows = fixture.documents()
    got = langid.identify(fixture.frame(spark, rows), m, spans=True)
    assert got.count() == len(rows) and got.columns.count("score") == 1
    by = {r.doc_id: r for r in got.collect()}
    assert by[60].lang_pred == by[61].lang_pred == by[62].lang_pred == "und" and by[60].score == 0
    assert langid.identify(fixture.empty(spark), m).count() == 0
    kept = langid.keep_known(fixture.frame(spark, rows))
    assert kept.columns == fixture.empty(spark).columns and kept.count() == len(rows) - 3
    assert {r.score for r in kept.collect()} == {7.0}
    nothing = langid.train(fixture.empty(spark))
    assert {r.lang_pred for r in langid.identify(fixture.frame(spark, rows), nothing).collect()} == {"und"}


def test_held_out_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify(docs, langid.train(docs)).where(langid.held_out())
    assert out.where("lang = lang_pred").count() / out.count() > 0.95


def test_training_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a bc").alias("text"), F.lit("xx").alias("lang"))
    n = langid.train(docs, per_lang=500).tables[langid.WORD]
    assert np.isfinite(n).all()
    assert 350 < langid.training_rows(docs, per_lang=500).count() < 650
    assert langid.training_rows(docs.limit(100), per_lang=500).count() == docs.limit(100).where(~langid.held_out()).count()


# ---------------------------------------------------------------- licenses


def test_alignment_rises_and_matches():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert licenses.align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]
    assert len(licenses.longest_rise([3, 1, 2, 5, 4])) == 3 and licenses.longest_rise([]) == []


def test_notices_are_found_where_they_stand():
    s = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["MIT"]
    filler = " ".join(fixture.words(random.Random(1), 300))
    assert s.scan(filler) == [] and s.scan("") == [] and s.scan("the license") == []
    got = s.scan(f"{filler} {mit.upper()} {filler} Released under the MIT License.")
    assert [(g[0], g[1]) for g in got] == [("MIT", 1.0), ("MIT-line", 1.0)] and got[0][2] == len(licenses.words_of(filler))
    words = mit.split()
    worn = " ".join(w for i, w in enumerate(words) if i % 8)
    assert [g[0] for g in s.scan(worn)] == ["MIT"] and 0.8 <= s.scan(worn)[0][1] < 1
    assert s.scan(" ".join(words[: len(words) // 2])) == []
    assert len(s.scan("Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.")) == 2
    assert [g[0] for g in s.scan(licenses.TEMPLATES["Apache-2.0"])] == ["Apache-2.0"]


def test_every_copy_of_a_repeated_notice_is_found():
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        m = len(licenses.words_of(text))
        for n in (2, 3, 7):
            got = s.scan("x y " + " ".join([text] * n) + " z")
            assert [g for g in got if g[0] == name] == got == [(name, 1.0, 2 + i * m, m) for i in range(n)]
    worn = "Released under MIT License. Released under the fine MIT License. " * 3
    assert [(g[1], g[3]) for g in s.scan(worn)] == [(0.8, 4), (1.0, 6)] * 3
    assert [g[0] for g in s.scan("Released under the MIT License. Licensed under CC BY-NC 4.0. " * 3)] == ["MIT-line", "CC-BY-NC-4.0-line"] * 3


def test_gaps_without_anchors_are_aligned_whole():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = licenses.common([(w, i) for i, w in enumerate(a)], [(w, j) for j, w in enumerate(b)])
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        best = max(n for n in range(10) for c in itertools.combinations(a, n) if all(w in it for it in [iter(b)] for w in c))
        assert len(got) == best


def test_every_template_is_found_alone():
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert (name, 1.0) in [(g[0], g[1]) for g in s.scan("x y z " + text + " z y x")]


def test_scan_rows(spark):
    rows = fixture.documents() + [(900, "see: Released under the MIT License. bye"), (900, "see: Released under the MIT License. bye")]
    out = licenses.scan_licenses(fixture.frame(spark, rows))
    assert out.count() == len(rows) and out.columns.count("spans") == 1 and "text" not in out.columns
    got = out.where("license is not null").collect()
    assert [(r.doc_id, r.license, r.coverage, r.n_spans) for r in got] == [(900, "MIT-line", 1.0, 1)] * 2
    assert licenses.scan_licenses(fixture.empty(spark)).count() == 0
    assert licenses.scan_licenses(fixture.frame(spark, rows), templates={}).where("n_spans > 0").count() == 0
