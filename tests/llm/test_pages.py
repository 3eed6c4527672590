"""The given pages against their articles as cut out by hand, also with the marks of the article taken away."""

import re
from collections import Counter
from html import unescape

import pytest

from pricegate.llm import html

NAMED = re.compile(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
SECTIONS = re.compile(r"<(/?)(article|main|nav|aside|footer|header|section|form|menu|dialog)\b")


def by_hand(page):
    """Text of the marked article: tags and scripts cut out, block tags as spaces."""
    inner = "".join(re.findall(r"<article\b[^>]*>(.*?)</article>", page or "", re.S))
    inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner, flags=re.S)
    inner = re.sub(r"</?(?:b|i|em|strong|a|span|u|small|code|sub|sup)\b[^>]*>", "", inner)
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())


@pytest.fixture(scope="module")
def pages(spark):
    found = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    counts = sum((html.count_names(html.parse(p)) for p in found), start=Counter())
    return found, html.weigh(counts), [by_hand(p) for p in found]


def f1(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_articles(pages):
    found, weights, want = pages
    assert [html.main_text(p, weights) for p in found] == want


def test_weights_are_learnt(pages, monkeypatch):
    """Without labelled pages hardly any text is right; without what the lists lend, all are."""
    found, _, want = pages
    assert sum(html.main_text(p, html.weigh(Counter())) == w for p, w in zip(found, want, strict=True)) < 0.1 * len(found)
    monkeypatch.setattr(html, "LEAN", 1)
    weights = html.weigh(sum((html.count_names(html.parse(p)) for p in found), start=Counter()))
    assert [html.main_text(p, weights) for p in found] == want


def test_without_marks_and_names(pages, monkeypatch):
    """No article, landmark, class, id or role is left: blocks and the region decide."""
    found, weights, want = pages
    bare = [SECTIONS.sub(r"<\1div", NAMED.sub("", p or "")) for p in found]
    got = [html.main_text(p, weights) for p in bare]
    assert sum(map(f1, got, want)) / len(want) > 0.99 and sum(a == b for a, b in zip(got, want, strict=True)) > 0.95 * len(want)
    monkeypatch.setattr(html, "best_region", lambda scores: (0, len(scores)))
    assert sum(html.main_text(p, weights) == w for p, w in zip(bare, want, strict=True)) < 0.1 * len(want)


def test_more_labelled_pages_than_the_bound(spark):
    """Weights come from the bound's pages only, the same in every run."""
    page = lambda k: f"<nav><li>m</li></nav><div class=n{k}>x y</div><article><p>" + "word " * 30 + "</p></article>"
    df = spark.createDataFrame([(k, page(k)) for k in range(40)], "page_id long, html string")
    one, two = html.learn(df, most=10), html.learn(df.repartition(5), most=10)
    assert one == two and one.blocks["p"] > 1 > -1 > one.blocks["li"]
    assert html.learn(df, most=40).blocks["p"] > one.blocks["p"] - 0.5
