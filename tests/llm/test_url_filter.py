import zlib

import numpy as np
import pytest

from tallyform.llm import url_filter


@pytest.mark.parametrize(
    "url,rule,verdict",
    [
        ("http://a.com/en/1", "com/en/", "block"),
        ("http://shop.example.com/en/71", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "com/en/", "block"),
        ("http://a.net/de/1", "net/de/", "allow"),
        ("http://free-casino-bets.net/de/1", "net/de/", "allow"),
        ("http://www.example.net/de/8", "example.net/de/8", "block"),
        ("http://www.example.net/de/9", "net/de/", "allow"),
        ("http://a.b.org/es/", "org/es/", "block"),
        ("http://a.org/es", None, "allow"),
        ("http://free-casino-bets.org/en/1", None, "block"),
    ],
)
def test_each_rule_by_hand(spark, url, rule, verdict):
    r = url_filter.judge(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.rule, r.verdict) == (rule, verdict)


def test_held_out_urls():
    """Five folds by the host's crc32; figures are in the README."""
    rows = url_filter.labelled_urls()
    got, want = [], []
    for fold in range(5):
        out = [r for r in rows if zlib.crc32(r[0].encode()) % 5 == fold]
        w = url_filter.fit([r for r in rows if zlib.crc32(r[0].encode()) % 5 != fold])
        got += (url_filter.scores(w, [h for h, _, _ in out], [p for _, p, _ in out]) >= url_filter.CUT).tolist()
        want += [bool(y) for *_, y in out]
    got, want = np.array(got), np.array(want)
    assert len(want) == len(rows)
    assert (got & want).sum() / got.sum() > 0.9 and (got & want).sum() / want.sum() > 0.9


def slow_grams(host, path, buckets):
    """Distinct n-grams, one at a time, by a hash written out for plain integers."""
    out = set()
    for mark, part in enumerate((host, path.lower())):
        raw = url_filter._NUMBER.sub("0", f"^{part}$").encode("utf-8", "surrogatepass")
        for n in url_filter.GRAMS:
            for i in range(len(raw) - n + 1):
                h = mark + 2 * n
                for b in raw[i : i + n]:
                    h = (h * 0x100000001B3 + b) % 2**64
                for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ h >> shift) * odd % 2**64
                out.add((h ^ h >> 31) % buckets)
    return sorted(out)


def test_grams_and_scores_against_a_plain_version():
    rows = [("", ""), ("a", "/"), ("www.É1.com", "/x/123/Y"), ("long" * 50, "/p" * 3000), ("", "/a?"), ("\x00", "\n")]
    w = np.random.default_rng(5).normal(size=(1 << 10) + 1)
    row, col = url_filter.grams([h for h, _ in rows], [p for _, p in rows], 1 << 10)
    score = url_filter.scores(w, [h for h, _ in rows], [p for _, p in rows])
    for i, (h, p) in enumerate(rows):
        want = slow_grams(h, p, 1 << 10)
        assert col[row == i].tolist() == want
        assert score[i] == pytest.approx(1 / (1 + np.exp(-(w[want].sum() / np.sqrt(max(len(want), 1)) + w[-1]))))
        assert url_filter.score(w, h, p) == pytest.approx(score[i])
    assert len(url_filter.grams([], [])[0]) == 0


def test_split_equals_the_columns(spark):
    urls = [None, "", "no", "http://", "HTTP://A.É.Com?x/y", "a://b#c://d/e", "x://h/p/q?r#s", "x://" + "a" * 70000 + "/" + "b/" * 2_500_000]
    out = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")).collect()
    assert {r.page_id: (r.host, r.path) for r in out} == {i: url_filter.split_url(u) for i, u in enumerate(urls)}
    assert all(0 <= r.score <= 1 for r in out)


def test_labelled_table_is_read_whole():
    rows = url_filter.labelled_urls()
    assert len(rows) > 400 and {y for *_, y in rows} == {0, 1} and ("viagra.shop", "/", 1) in rows and ("", "", 0) in rows


def test_fit_against_a_plain_version():
    """Full gradient steps, scaled by the gradients so far, one weight at a time."""
    rows = [("casino.example", "/play", 1), ("museum.example", "/maps/12", 0), ("", "", 0), ("casino-bets.example", "/", 1), ("maps.example", "/play", 0)]
    buckets, rounds, rate, decay = 32, 7, 0.5, 1e-2
    own = [slow_grams(h, p, buckets) for h, p, _ in rows]
    w, seen = [0.0] * (buckets + 1), [1e-12] * (buckets + 1)
    for _ in range(rounds):
        grad = [decay * x for x in w[:-1]] + [0.0]
        for g, (_, _, y) in zip(own, rows):
            unit = max(len(g), 1) ** -0.5
            off = (1 / (1 + np.exp(-(sum(w[b] * unit for b in g) + w[-1]))) - y) / len(rows)
            for b in g:
                grad[b] += off * unit
            grad[-1] += off
        for i, g in enumerate(grad):
            seen[i] += g * g
            w[i] -= rate * g / seen[i] ** 0.5
    assert url_filter.fit(rows, buckets, rounds, rate, decay) == pytest.approx(w)
