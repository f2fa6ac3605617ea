import random
import re
import time
import xml.etree.ElementTree as ET
from collections import Counter

import pytest

from tallyform.llm import html_extract

RUNNING = "Running text of the story here. " * 3
P, R = f"<p>{RUNNING}</p>", RUNNING.strip()
REMARKS = "<p>A reader's long remark that goes on and on, longer than all the rest of this page together, surely.</p>" * 9


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>A.</p><svg/><p>B.</p></article>", ["A.", "B."]),
        ("<article><p>A.</p><svg viewBox='0 0 1 1' /><p>B.</p></article>", ["A.", "B."]),
        ("<article><p>A.</p><div class='ad'/><p>B.</p><nav/><p>C.</p></article>", ["A.", "B.", "C."]),
        (f"<body><div class='content no-sidebar'><h1>T</h1>{P}</div></body>", ["T", R]),
        (f"<body class='has-sidebar social'><div class='with-comments'>{P}</div></body>", [R]),
        (f"<article class='post share-enabled'>{P}</article>", [R]),
        (f"<main class='sidebar'>{P}</main>", [R]),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x=1</annotation></math> hold.</p></article>", ["Let x=1 hold."]),
        ("<article><p>See <button>press</button>this <svg><text>no</text></svg>line, <label>too</label>.</p><p>un<button>closed</p></article>", ["See this line, too.", "unclosed"]),
        (f"<article><p>intro</p><div class=body>{P}</div></article>", ["intro", R]),
        (f"<body><form id=aspnetForm><div class=social><h1>T</h1>{P}<div class=ad>Buy</div></div></form></body>", ["T", R]),
        (f"<body><div><h1>T</h1>{P}<form><p>Sign up</p></form></div><div class='site-footer'>f</div><div id=mainNav>menu</div></body>", ["T", R]),
        (f"<body><article>{P}</article><div id=comments><ol class=comment-list><li class=comment><article class='comment-body'>{REMARKS}</article></li></ol></div></body>", [R]),
        (f"<article>{P}<section><article class=comment>{REMARKS}</article></section></article>", [R]),
        (f"<body><div class='comments'><article>{P}</article></div></body>", [R]),
        ("<article><p>x &am<b>p; y&nbsp;</b>&#233;</p></article>", ["x &amp; y é"]),
        ("<article><header><h1>T</h1><p>By me</p></header><p>A.</p></article>", ["T", "A."]),
    ],
)
def test_whole_articles(page, want):
    assert html_extract.main_text(page, None).split("\n\n") == want


def test_names_count_whole():
    assert html_extract.marks_of("ad-slot-3 cookieNotice post_comments") == {"ad", "cookie", "notice", "comments"}
    assert html_extract.marks_of("no-sidebar shareable loading adsorption menu-item-has-children") == set()


def layout(rng, kind, size):
    story, other = (f"<div class='{c}'><p>{'Some words in a row. ' * n}</p></div>" for c, n in ((f"story s{rng.randrange(9)}", size), ("extra", 20 - size)))
    return f"<html><body><div class=top{kind}>{story}{other}</div></body></html>"


def test_hosts_without_article_agree_on_a_path(spark):
    """No page has article or main: the votes alone decide, and pages with little story text follow their host."""
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 3}.example/{i}", layout(rng, i % 3, rng.choice([18, 17, 16, 3]))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    votes: Counter = Counter()
    for _, url, page in rows:
        best = html_extract.scored(html_extract.blocks(page))
        for path, s in best.items():
            votes[url.split("/")[2], path] += s * 1000 // max(best.values())
    want = {h: max((v, p) for (x, p), v in votes.items() if x == h)[1] for h in {"h0.example", "h1.example", "h2.example"}}
    assert {r.host: r.path for r in html_extract.host_paths(df).collect()} == want
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for i, _, page in rows:
        n = page.split("class='story")[1].split("extra")[0].count("Some words")
        assert got[i] == " ".join(["Some words in a row."] * n), i


def test_a_page_of_many_megabytes(spark):
    page = "<article>" + "<p>Many words of one long page.</p>" * 300_000 + "<svg/>" * 1000 + "<p>" + "x" * 2_000_000 + "</p></article>"
    r = html_extract.extract(spark.createDataFrame([(1, "http://a.example/", page), (2, "http://a.example/", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0].n_chars == len("Many words of one long page.\n\n") * 300_000 + 2_000_000 and r[1].text == ""


def test_many_unclosed_elements_take_linear_time():
    assert html_extract.main_text("<article>" + "<button><svg>" * 50_000 + "<p>end</p>", None) == "end"


NAMES = "widget alert notice promo cookies banner menu main-menu login signup popup overlay section-widget share-content subscribe-page".split()


def test_names_never_hide_the_body(spark):
    body = "Prose of the article goes on. " * 10
    rows = []
    for name in NAMES:
        rows += [
            f"<article><h1>T</h1><div class='{name}'><p>{body}</p></div></article>",
            f"<div id=page><h1>T</h1><div class='{name}'><p>{body}</p></div></div>",
            f"<body><div id=page><h1>T</h1><div class='{name}'><p>{body}</p></div></div><div class=footer>Imprint and so on</div></body>",
        ]
    want = f"T\n\n{body.strip()}"
    assert [html_extract.main_text(page, None) for page in rows] == [want] * len(rows)
    df = spark.createDataFrame([(i, f"http://h{i}.example/{k}", page) for k in range(3) for i, page in enumerate(rows)], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(df).collect()] == [want] * 3 * len(rows)


@pytest.mark.parametrize("name", NAMES)
def test_a_longer_box_beside_the_article_stays_out(name):
    page = f"<body><article><h1>T</h1>{P}</article><div class='{name}'><p>{'Other words of a box. ' * 30}</p></div></body>"
    assert html_extract.main_text(page, None).split("\n\n") == ["T", R]


@pytest.mark.parametrize("head", ["<h1>T</h1>", "<div><h1>T</h1></div>", "<hgroup><h1>T</h1><p>sub</p></hgroup>", "<div><div><h1><span>T</span></h1><p>By me</p></div></div><nav><a href=x>x</a></nav>", "words <div>more <h1>T</h1> words</div>"])
def test_titles_in_headers(head):
    assert html_extract.main_text(f"<body><header><h1>Site</h1></header><article><header>{head}</header>{P}</article></body>", None).split("\n\n") == ["T", R]


def test_discussions_of_readers():
    talk = f"<div class=discussion>{REMARKS}</div>"
    assert html_extract.main_text(f"<body><article>{P}</article>{talk}</body>", None) == R
    assert html_extract.main_text(f"<body><div id=page><h1>T</h1>{P}{talk}</div></body>", None).split("\n\n") == ["T", R]
    assert html_extract.main_text(f"<article>{P}<section class=discussion>{P}</section></article>", None).split("\n\n") == [R, R]


@pytest.mark.parametrize("part", ["<div>word text here", "<div class=widget><h1>word", "<ul><li>word text here", "<blockquote class=comment>word text", "<div>word</p></i></section>", "<article class=promo><h1>word"])
def test_deep_nesting_takes_linear_time(part):
    def seconds(n):
        began = time.process_time()
        html_extract.blocks(part * n)
        html_extract.main_text(part * n, None)
        return time.process_time() - began

    seconds(1000)
    assert seconds(80_000) < 3 * 8 * seconds(10_000)  # by the square it would be 64 times


class Tree:
    """Plain recursion over XML trees: containers, votes, winner, and the ancestors around it."""

    def __init__(self, pages):
        self.pages = [ET.fromstring(p) for p in pages]
        votes = Counter()
        for page in self.pages:
            score = Counter()
            for way in self.ways(page):
                for i, box in enumerate(range(len(way) - 1, max(0, len(way) - 4), -1)):
                    score[way[:box]] += 4 * len(way[-1].text) >> i
            best = Counter()
            for way, s in score.items():
                best[self.path(way)] = max(best[self.path(way)], s)
            votes.update({p: s * 1000 // max(best.values()) for p, s in best.items()})
        self.winners = [p for p in votes if votes[p] == max(votes.values())]

    def ways(self, e, way=()):
        way = (*way, e)
        if e.tag in ("p", "h2"):
            yield way
        for child in e:
            yield from self.ways(child, way)

    @staticmethod
    def path(way):
        return tuple((e.tag, re.sub("[0-9]", "", e.get("class", ""))) for e in way)

    def text(self, page):
        chosen = set()
        for way in self.ways(page):
            for i in range(1, len(way)):
                if self.path(way[:i]) == self.winners[0]:
                    node = way[i - 1]
                    for j in range(i - 1, 0, -1):
                        kinds = {c.tag for c in way[j - 1]} & {"p", "h2"}
                        if len(kinds) == 2 if way[j - 1].tag in ("html", "body") else kinds or way[j].tag == "section":
                            node = way[j - 1]
                    chosen.add(node)
        return [way[-1].text for way in self.ways(page) if any(e in chosen for e in way)]


def test_votes_and_choice_by_plain_trees(spark):
    rng = random.Random(11)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<{(tag := rng.choice(['p', 'p', 'h2']))}>{' '.join(['word'] * rng.randrange(1, 30))}</{tag}>"
        inner = "".join(part(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f"<{(tag := rng.choice(['div', 'div', 'section']))} class='{rng.choice('xyz')}{rng.randrange(10)}'>{inner}</{tag}>"

    checked = 0
    for host in range(25):
        pages = [f"<html><body>{part(4)}{part(3)}</body></html>" for _ in range(4)]
        tree = Tree(pages)
        if len(tree.winners) > 1:
            continue
        checked += 1
        df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(2)
        got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
        for i, page in enumerate(tree.pages):
            want = tree.text(page)
            if want:
                assert got[i] == "\n\n".join(want), (host, i, pages[i])
    assert checked > 15
