import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyform.llm import html_extract, packing, queries, topk, url_filter
from tests.llm import fixture
from tests.oracle import same


def check_packing(rows, pieces, encode, capacity):
    """Every id once, gapless sequences, crcs, and little padding."""
    from collections import defaultdict

    whole = sorted(np.append(encode(t or ""), np.uint32(0)).astype("<u4").tobytes() for _, t in rows)
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.length * 4 == len(p.ids)
        seqs[p.sequence_id].append(p)
        docs[p.doc_id, p.doc_tokens].append(p)
    for s in seqs.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0] + [p.length for p in s])[:-1].tolist() and sum(p.length for p in s) <= capacity
    got = []
    for (_, total), own in docs.items():
        # rows that repeat a doc_id and length are told apart by taking pieces start by start
        by_start = defaultdict(list)
        for p in own:
            by_start[p.start].append(p)
        while by_start[0]:
            at, raw = 0, b""
            while at < total:
                p = by_start[at].pop()
                raw += p.ids
                at += p.length
            got.append(raw)
        assert not any(by_start.values())
    assert sorted(got) == whole
    sizes = [sum(p.length for p in s) for s in seqs.values()]
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes), sum(sizes)


@pytest.mark.parametrize("capacity", [1024, 37, 1])
def test_packing_round_trip(spark, capacity):
    rows = [(d, t) for d, t in fixture.documents() if d != 5]
    pieces = packing.pack(fixture.frame(spark, rows), capacity=capacity).collect()
    padded, total = check_packing(rows, pieces, packing.encoder(None), capacity)
    assert padded <= 0.05 * total
    r = packing.padding(packing.pack(fixture.frame(spark, rows), capacity=capacity), capacity).first()
    assert (r.tokens, r.padded) == (total, padded)
    assert packing.pack(fixture.empty(spark), capacity=capacity).count() == 0


def test_ids_are_those_of_the_tokenizer():
    enc = packing.encoder(None)
    assert enc.fast is not None
    rng = random.Random(8)
    pool = "abcXYZ 019,.;'\n\t\r\x0b\x1c\x85\xa0\u2028\u3000éßñ漢字かなабв\u0301\u200d😀٣½Ⅷ'sthe" + "".join(map(chr, range(0x180E, 0x1810)))
    texts = ["", " ", "a<|endoftext|>b", "don't we'll", "  x  y ", "\n\n a"] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(1500)]
    for t in texts:
        assert enc(t).tolist() == enc.plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_cuts_are_reciprocal_shares():
    for n in range(1, 3000):
        c = packing.cuts(n)
        assert sum(c) == n and all(x == 1024 // (1024 // x) for x in c if x >= packing.TAIL)
    assert packing.powers(1023) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1] and packing.powers(0) == []


# ---------------------------------------------------------------- top-k


def test_topk_equals_sql(spark, sf):
    assert same(spark, sf, queries.op4_exact_topk, queries.ORACLES["op4_exact_topk"]) > 0


@pytest.mark.parametrize("kind", ["ties", "wide", "huge"])
def test_topk_against_sorting(spark, kind):
    rng = np.random.default_rng(3)
    scale = {"ties": 0.002, "wide": 1.0, "huge": 60000.0}[kind]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, scale, (330, 5)))]
    rows += [(330, None), (331, [1.0, None, 0.0, 0.0, 0.0]), (332, [float("nan")] * 5), (333, [float("inf")] * 5), (None, [1.0] * 5), (400, [0.1, 0.2]), (7, [0.5] * 5), (334, []), (500, [0.1, 0.3])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), k=10, query_block=2).collect()
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in ok:
        if q % 100 == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a)))[:10]
            want += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---------------------------------------------------------------- urls


RULES_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, rh, rp) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
m AS (SELECT h.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS i FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, verdict FROM m WHERE i = 1"""


def test_rules_equal_sql(spark, sf):
    def rules_only(s, d):
        out = queries.op10_url_filter(s, d)
        return out.withColumn("verdict", F.when(F.col("rule").isNotNull(), F.col("verdict"))).drop("score")

    assert same(spark, sf, rules_only, RULES_SQL) > 0


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM", "x://a.com/en/7?x#y", "x://example.com/en/71", "x://notexample.com/en/7", "x://b.example.net#/de/8", "x://b.example.net/de/8", "x://É.org/es/ Q?", "a://b://c/d\nq?e", "x://com/en/", "x://telecom/en/"]
    df = spark.createDataFrame([(i, u, "own", "own", 1) for i, u in enumerate(urls)], "page_id int, url string, host string, verdict string, score int")
    out = url_filter.judge(df)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    got = {r.page_id: (r.host, r.path, r.rule) for r in out.collect()}
    want = [("", "", None)] * 4 + [
        ("www.example.com", "", None), ("a.com", "/en/7", "com/en/"), ("example.com", "/en/71", "example.com/en/7"), ("notexample.com", "/en/7", "com/en/"), ("b.example.net", "", None),
        ("b.example.net", "/de/8", "example.net/de/8"), ("É.org", "/es/ Q", "org/es/"), ("b:", "//c/d\nq", None), ("com", "/en/", "com/en/"), ("telecom", "/en/", None),
    ]
    assert [got[i] for i in range(len(urls))] == want
    v = {r.page_id: r.verdict for r in out.collect()}
    assert (v[0], v[5], v[6], v[9]) == ("allow", "block", "allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(df, rules=[("deny", "a/")])


def test_model_tells_unwanted_urls():
    w = url_filter.default_model()
    assert np.array_equal(w, url_filter.fit(url_filter.labelled_urls()))
    bad = ["free-poker.example.org", "www.cheap-viagra.net", "blog.online-casino.example.com", "xxx-cams.org"]
    good = ["en.wikipedia.org", "thornel.example.net", "www.city-library.example.org", "m.tionsh.example.com", ""]
    assert all(url_filter.score(w, h, "/fr/22") > 0.5 for h in bad) and all(url_filter.score(w, h, "/fr/22") < 0.5 for h in good)
    rows = url_filter.labelled_urls()
    assert np.mean([(url_filter.score(w, h, p) >= 0.5) == bool(y) for h, p, y in rows]) > 0.97
    assert not url_filter.fit([]).any()


# ---------------------------------------------------------------- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu one</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="layout-3"><div class="post body-17"><h1>Title &amp; more</h1><p>First <b>bold<br>line</b>\n  two.</p><div class=ad>Buy</div><p>Second &eacute; para&nbsp;here &lt;b&gt;<ul><li>item<li>next</ul><form><p>Sign</p></form><script>var a="</div><p>no</p>"</script></div>
<aside>Side</aside><section id="comments"><p>A reader's long comment that goes on and on and on and on, longer than all the rest of this page together, surely.</p></section></div><footer>&copy; F</footer></body></html>"""
TEXT = ["Title & more", "First bold line two.", "Second é para here <b>", "item", "next"]


def test_main_text():
    assert html_extract.main_text(PAGE, None).split("\n\n") == TEXT
    assert html_extract.main_text("", None) == "" and html_extract.main_text("<p>", None) == ""
    assert html_extract.main_text("plain &amp text", None) == "plain & text"
    assert html_extract.main_text("<p>a<p>b</div></p>c", None) == "a\n\nb\n\nc"
    assert html_extract.main_text("<article><p>a</p><script>x", None) == "a"
    assert html_extract.main_text("<p title='a>b'>x</p><p title=\"unclosed>y</p>", None).startswith("x")
    assert html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"
    assert html_extract.main_text("1 < 2 and <3", None) == "1 < 2 and <3"


def test_host_consensus_moves_a_page(spark):
    usual = "<html><body><div class='story'><p>" + "Words of the story go here. " * 5 + "</p></div><div class='list'><p>small</p></div></body></html>"
    odd = "<html><body><div class='story'><p>Short.</p></div><div class='list'><p>" + "A long list of other things. " * 20 + "</p></div></body></html>"
    rows = [(i, "http://h.example/a", usual) for i in range(5)] + [(9, "http://h.example/b", odd), (10, "http://other.example/", odd), (11, None, None), (12, "nohost", ""), (9, "http://h.example/b", odd)]
    df = spark.createDataFrame([(*r, "own", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows) and got[9] == "Short." and got[10].startswith("A long list") and got[11] == "" and got[12] == ""
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_raw_elements_end_where_they_end():
    for n in (1, 3, 9, 40):
        assert html_extract.main_text(f"<article><p>{'İ' * n}</p><script>'{'İ' * n}'</ScRipt ><p>kept words</p><style>p{{}}</style><p>too</p></article>", None) == f"{'İ' * n}\n\nkept words\n\ntoo"
    assert html_extract.main_text("<article><p>a</p><script>'</ſcript>'</script><p>b</p></article>", None) == "a\n\nb"


def test_parts_beside_the_longest_container_stay(spark):
    body = "<div class=body>" + "<p>Body text of the story goes on.</p>" * 9 + "</div>"
    long = ["Body text of the story goes on."] * 9
    layouts = {
        "<body><article><h1>T</h1><p>lead</p>%s</article><div class=list><p>other</p></div></body>" % body: ["T", "lead", *long],
        "<body><main><h1>T</h1><article><section class=intro><p>lead</p></section><section class=rest>%s</section></article></main><p>other</p></body>" % body: ["T", "lead", *long],
        "<body><div class=post><h1>T</h1><div class=wrap><p>lead</p>%s</div></div><div class=list><p>other</p></div></body>" % body: ["T", "lead", *long],
        "<body><div class=post><section class=intro><p>lead</p></section><section class=rest>%s</section></div><div class=list><p>other</p></div></body>" % body: ["lead", *long],
        "<body><h1>T</h1><p>lead</p>%s<footer>other</footer></body>" % body: ["T", "lead", *long],
        "<body><article><h1>T</h1><nav>menu</nav><p>lead</p>%s<div class=comments><p>other</p></div></article></body>" % body: ["T", "lead", *long],
        "<body><p>other</p><div class=list><p>other</p></div>%s</body>" % body: long,
    }
    for page, want in layouts.items():
        assert html_extract.main_text(page, None).split("\n\n") == want
    rows = [(i, f"http://h{i // 2}.example/{i % 2}", page) for i, page in enumerate(p for p in layouts for _ in range(2))]
    got = {r.page_id: r.text.split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: layouts[page] for i, _, page in rows}


def test_many_hosts_are_joined_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i}.example/", PAGE) for i in range(6)], "page_id long, url string, html string")
    one = sorted(r.text for r in html_extract.extract(df).collect())
    monkeypatch.setattr(html_extract, "FEW_HOSTS", 2)
    assert sorted(r.text for r in html_extract.extract(df).collect()) == one == ["\n\n".join(TEXT)] * 6


def test_pages_of_the_tables(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op9_html_consensus(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_crc_is_unsigned(spark):
    assert spark.sql("select crc32(cast('abc' as binary)) c").first().c == zlib.crc32(b"abc")
