import pytest

import __spark_entry__
import corpus_pipeline
from tallyform.llm import decontam, langid, packing, queries, simhash, substring
from tests.llm import fixture
from tests.llm.test_dedup import slow_components, slow_fingerprint


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(names) <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "pack"]


@pytest.fixture
def folder(spark, tmp_path):
    rows = fixture.documents() + [(800, "so " * 20 + "what is the answer to the question that was asked here")]
    docs = fixture.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "What is the answer to the question that was asked HERE?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_pipeline_against_its_stages_by_hand(spark, folder):
    path, rows = folder
    named = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    ids = [(d, t) for d, t in named if d is not None]
    fps = [slow_fingerprint(t) for _, t in ids]
    low = {}
    for (d, _), c in zip(ids, slow_components(fps, 4)):
        low[c] = min(low.get(c, d), d)
    stay = set(low.values())
    got = corpus_pipeline.run(spark, path).collect()
    kept = {r.doc_id for r in got}
    assert 800 not in kept and kept - {None} == stay - {800}
    # token counts follow from the text that is left after the repeated passages went
    groups = {}
    for (d, t), c in zip(ids, slow_components(fps, 4)):
        if d == low[c]:
            groups.setdefault((c, d), set()).add(t)
    assert len(groups) == len(low)
    docs = [(d, min(own)) for (_, d), own in groups.items() if len(own) == 1]
    assert len(docs) == len(groups)  # no group offers a choice here
    texts = spark.createDataFrame([*docs, *[(d, t) for d, t in named if d is None]], "doc_id long, text string")
    left = sorted((repr(r.doc_id), len(packing.encoder(None)(r._kept or "")) + 1) for r in substring.dedup_substrings(texts).collect() if r.doc_id != 800)
    assert sorted({(repr(r.doc_id), r.doc_tokens) for r in got}) == sorted(set(left))
    assert sum(r.length for r in got) == sum(n for _, n in left)


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, path)
        assert out.dtypes == docs.dtypes, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_stages_call_the_operators():
    for f, module in zip((f for _, f in corpus_pipeline.STAGES), (langid, simhash, substring, decontam, packing)):
        assert module.__name__.rsplit(".", 1)[1] in f.__code__.co_names


def test_short_benchmark_items(spark, folder):
    path, _ = folder
    bench = spark.createDataFrame([(1, "What is two?"), (2, "Paris"), (None, "東京"), (3, "..."), (4, None)], "item_id long, text string")
    rows = [(1, "Words.\n what is TWO \nmore"), (2, "what is two more"), (3, "paris"), (4, "In Paris it rains."), (5, "一\n東京。\n"), (6, "東京都"), (7, None), (8, ""), (9, "...\n")]
    kept = decontam.without_leaks(fixture.frame(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 7, 8, 9]
    assert decontam.find_leaks(fixture.frame(spark, rows), bench, min_words=1).count() == 4


def test_clashing_columns_and_long_texts(spark, tmp_path):
    rows = fixture.documents() + [(801, "long words of one text " * 450_000), (802, None), (803, "")]
    fixture.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "What is the answer to the question that was asked HERE?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    tokens = {r.doc_id: r.doc_tokens for r in got.collect()}
    assert 801 in tokens and not {802, 803} & set(tokens)
