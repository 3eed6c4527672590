"""Main text of web pages: the contiguous region with the greatest sum of word and tag scores."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled pages that the weights are learnt from (those with the least hash of page_id).
FIT_PAGES = 20_000
#: Words that every name's counts start with, LEAN times as many on the side where the lists below put it. A name with
#: fewer words than that in all labelled pages, and in no list, decides nothing.
PRIOR, LEAN = 20, 8
#: Names that mark an article, names that an article hardly has, and of these the ones of readers' comments.
CONTENT = set("article main story post entry articlebody maincontent".split())
BOILERPLATE = set(
    "nav navigation navbar menu breadcrumb breadcrumbs toolbar pagination pager footer copyright aside sidebar rail widget related recommended trending "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola notice cookie cookies consent gdpr alert disclaimer "
    "popup modal overlay dialog newsletter subscribe signup login search share sharing social form comment comments commentlist disqus reply replies respond "
    "contentinfo complementary header masthead skip paywall".split()
)
COMMENTS = set("comment comments commentlist disqus reply replies respond".split())
#: Elements whose own name counts; those whose text is never shown as running text, those whose
#: content is no markup, those without content, and those that do not end a block.
LANDMARKS = set("nav menu aside footer header form dialog".split())
DROPPED = set("head title script style noscript template svg math iframe object embed canvas audio video map select option button textarea input label datalist".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that end an open one of the same name.
ALONE = set("p li tr td th dt dd option".split())
#: Pseudo-names of text within and outside of what a page marks as its article.
MARKED, UNMARKED = "(marked)", "(unmarked)"
#: A name decides from this weight on, up or down; the most that a word scores, what it scores if nothing speaks for it, and the least unless a name speaks against it; the
#: bounds of what a tag takes away, and the most that an element whose names speak against it takes in all.
DECISIVE, BEST, PLAIN, FAINT, TAG_LEAST, TAG_MOST, ISLAND = 1.0, 3.0, 0.5, 0.01, 0.05, 1.0, 20.0
#: An element with this share of the page's words says nothing against them by its names, where no article is marked.
WRAPPER = 0.9

_OPEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|\Z)|aria-hidden\s*+=\s*+["']?true|display\s*+:\s*+none|visibility\s*+:\s*+hidden""", re.I)
_PART = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}


@dataclass
class Element:
    """An element, and what is known of it and of what it holds."""

    up: int
    tag: str
    own: frozenset = frozenset()
    unseen: bool = False
    words: int = 0
    articles: int = 0
    mains: int = 0
    marks: int = 0
    wrapper: bool = False
    marked: bool = False
    names: frozenset = frozenset()
    last: int = 0
    island: int = 0
    block: str = ""  # the tag of the nearest element that is not inline, itself or around it


@dataclass
class Item:
    """A tag (text None) or a text, in an element, by its number."""

    tag: str
    text: str | None
    at: int


@dataclass
class Page:
    """Tags and texts in page order, and the elements; 0 is the page itself."""

    items: list[Item] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element(0, "")])


def own_names(tag: str, attributes: str) -> frozenset:
    """A landmark's name, and the words of class, id and role."""
    found = {tag} if tag in LANDMARKS or tag in ("article", "main") else set()
    for m in _NAMES.finditer(attributes) if "=" in attributes else ():
        value = m[2] or m[3] or m[4] or ""
        found.update(w for w in _PART.findall(_SPLIT.sub(" ", value).lower()) if len(w) > 1)
    return frozenset(found)


def parse(html: str | None) -> Page:
    """The page's tags and texts; an end tag closes the nearest open element of its name. One pass, in linear time.

    An unfinished tag at the end is left out; a "<" that begins no tag is text.
    """
    html, out = html or "", Page()
    items, elements, stack, open_at, last = out.items, out.elements, [0], defaultdict(list), html.rfind(">")
    at = begun = 0

    def text(upto: int) -> None:
        if upto > begun:
            items.append(Item("", html[begun:upto], stack[-1]))

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_at[elements[stack.pop()].tag].pop()

    while (at := html.find("<", at)) >= 0:
        following = html[at + 1 : at + 2]
        if following in ("!", "?") or (following == "/" and not html[at + 2 : at + 3].isalpha()):
            text(at)
            end = html.find("-->", at + 4) + 3 if html.startswith("<!--", at) else html.find(">", at) + 1
            at = begun = end if end > 2 or (end > 0 and not html.startswith("<!--", at)) else len(html)
            continue
        if not (following.isascii() and following.isalpha()) and following != "/":
            at += 1
            continue
        # quotes may hold ">" but end before the next "<"; else the tag ends at the first ">"
        nearest = html.find("<", at + 1)
        m = _OPEN.match(html, at, nearest if nearest >= 0 else len(html)) or (_LOOSE.match(html, at) if at < last else None)
        text(at)
        if not m:
            at = begun = nearest if nearest >= 0 else len(html)
            continue
        at = begun = m.end()
        tag = m[2].lower()
        if m[1]:
            if open_at[tag]:
                close(open_at[tag][-1])
            elif tag in INLINE:  # closes nothing, parts nothing
                continue
            items.append(Item(tag, None, stack[-1]))
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = begun = end.end() if end else len(html)
            continue
        if tag in ALONE and elements[stack[-1]].tag == tag:
            close(len(stack) - 1)
        items.append(Item(tag, None, stack[-1]))
        if tag not in VOID:
            elements.append(Element(stack[-1], tag, own_names(tag, m[3]) if tag not in ("html", "body") else frozenset(), tag in DROPPED or bool(_HIDDEN.search(m[3]))))
            open_at[tag].append(len(stack))
            stack.append(len(elements) - 1)
    at = len(html)
    text(at)
    return _described(out)


def _described(page: Page) -> Page:
    """What each element holds, which ones mark the article, and the names that speak for or against each one's text.

    An article marks itself, unless it stands in another one or among comments, or, where
    others don't, in what the lists call boilerplate; so does a main element without an
    article in it, and else the outermost element named like one. An element that holds
    every mark, or without marks WRAPPER of all words, wraps the page: names of the lists say
    nothing against it, nor is it hidden.
    """
    elements = page.elements
    for i in page.items:
        if i.text is not None and not i.text.isspace():
            elements[i.at].words += len(i.text.split())
    under = [frozenset()] * len(elements)  # names of the lists at or above
    inside = [False] * len(elements)
    good, all_ = [], []
    for k, e in enumerate(elements[1:], 1):
        e.block = elements[e.up].block if e.tag in INLINE else e.tag
        if e.tag == "article":
            if inside[e.up]:
                e.own |= {"comment"}  # an article in an article is a reader's comment
            elif not under[e.up] & COMMENTS:
                all_.append(k)
                if not under[e.up] & BOILERPLATE:
                    good.append(k)
        inside[k] = inside[e.up] or e.tag == "article"
        under[k] = under[e.up] | (e.own & BOILERPLATE)
    articles = set(good or all_)
    for k in range(len(elements) - 1, 0, -1):
        e, up = elements[k], elements[elements[k].up]
        e.articles += k in articles
        e.mains += e.tag == "main" or "main" in e.own
        up.words, up.articles, up.mains = up.words + e.words, up.articles + e.articles, up.mains + e.mains
    if articles:
        marks = articles
    elif elements[0].mains:
        marks = {k for k, e in enumerate(elements) if e.mains and (e.tag == "main" or "main" in e.own) and not under[k] & COMMENTS}
    else:
        marks = {k for k, e in enumerate(elements) if e.own & CONTENT and not under[k] & COMMENTS}
    for k, e in enumerate(elements):
        e.marked = k in marks or (k > 0 and elements[e.up].marked)
    for k in range(len(elements) - 1, 0, -1):
        e, up = elements[k], elements[elements[k].up]
        e.marks += k in marks and not up.marked
        e.last = max(e.last, k)
        up.marks, up.last = up.marks + e.marks, max(up.last, e.last)
    every, words = elements[0].marks, elements[0].words
    for e in elements[1:]:
        up = elements[e.up]
        e.wrapper = e.marks == every if every else e.words >= WRAPPER * words
        e.names = e.own - CONTENT - (BOILERPLATE if e.wrapper else set())
        if e.tag == "header":  # an article's own header belongs to it
            e.names = e.names - {"header"} | ({"masthead"} if not up.marked and not e.wrapper else set())
        e.unseen = up.unseen or (e.unseen and not (e.wrapper and e.tag not in DROPPED))
    return page


@dataclass
class Weights:
    """Of names, logarithms of how much likelier they stand over words of articles than over others; of tags, what each takes away."""

    names: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    blocks: dict[str, float] = field(default_factory=dict)  # the same of words by the block element that they stand in

    def word(self, low: float, high: float, block: float = 0.0) -> float:
        """What a word scores by the least and the greatest weight of the names around it, as they were learnt, within BEST:
        negative if one speaks against it, however many speak for it. Where names say nothing, its block does: at the least
        FAINT, so that its tags outweigh it, but what the region holds of it stays."""
        if low <= -DECISIVE:
            return max(low, -BEST)
        return min(max(high, PLAIN), BEST) if high >= DECISIVE else min(max(PLAIN + block, FAINT), BEST)

    def tag(self, t: str) -> float:
        return -self.tags.get(t, TAG_MOST / 2)


def count_names(page: Page) -> Counter:
    """Words (and tags) within and outside of the marked article, by name (and tag); nothing for pages that mark none.

    Within means in the article and under none of the lists' names of boilerplate.
    """
    found: Counter = Counter()
    elements = page.elements
    if not elements[0].marks:
        return found
    bad = [False] * len(elements)
    for k, e in enumerate(elements):
        bad[k] = e.unseen or bool(e.names & BOILERPLATE) or (k > 0 and bad[e.up])
    words = [[0, 0] for _ in elements]  # without and within, of each element and then of all it holds
    for i in page.items:
        within = elements[i.at].marked and not bad[i.at]
        if i.text is None:
            found["tag", i.tag, within] += 1
        elif not i.text.isspace():
            n = len(i.text.split())
            words[i.at][within] += n
            found["word", "", within] += n
            found["name", MARKED if elements[i.at].marked else UNMARKED, within] += n
            found["block", elements[i.at].block, within] += n
    for k in range(len(elements) - 1, 0, -1):
        for side in (0, 1):
            words[elements[k].up][side] += words[k][side]
    covered: dict[str, int] = {}  # the last element within the last one of a name, which has counted its words
    for k, e in enumerate(elements):
        for name in e.names:
            if covered.get(name, -1) < k:
                covered[name] = e.last
                for side in (0, 1):
                    found["name", name, bool(side)] += words[k][side]
    return found


def weigh(counts: Counter) -> Weights:
    """Log ratios of the rates within and outside of articles. The lists only lend a name its first words; counts outweigh them.
    Without labelled pages nothing is lent either: all weights are neutral."""
    if not counts:
        return Weights()
    total = {k: counts["word", "", k] + 1 for k in (True, False)}
    tags = {k: sum(n for (kind, _, inside), n in counts.items() if kind == "tag" and inside is k) + 1 for k in (True, False)}
    few = PRIOR / (total[True] + total[False])
    out = Weights()
    for name in {n for kind, n, _ in counts if kind == "name"} | BOILERPLATE | {MARKED, UNMARKED}:
        up, down = (LEAN, 1) if name == MARKED else (1, LEAN) if name in BOILERPLATE or name == UNMARKED else (1, 1)
        out.names[name] = log((counts["name", name, True] / total[True] + few * up) / (counts["name", name, False] / total[False] + few * down))
    for block in {n for kind, n, _ in counts if kind == "block"}:
        out.blocks[block] = log((counts["block", block, True] / total[True] + few) / (counts["block", block, False] / total[False] + few))
    for tag in {n for kind, n, _ in counts if kind == "tag"}:
        ratio = log((counts["tag", tag, False] + 1) / tags[False] / ((counts["tag", tag, True] + 1) / tags[True]))
        out.tags[tag] = min(max(TAG_MOST / 2 + ratio / 8, TAG_LEAST), TAG_MOST)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open range of the contiguous run with the greatest sum (the first of equals); empty if none is positive."""
    best, range_, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, range_ = total, (start, k + 1)
    return range_


def scores_of(page: Page, weights: Weights) -> list[float]:
    """A score for each tag and text: words count for the text, and tags against it (the least within a marked article).
    What names speak against counts little, however long it is, as an article may go on after it."""
    elements = page.elements
    said = {m: weights.names.get(MARKED if m else UNMARKED, 0.0) if elements[0].marks else 0.0 for m in (True, False)}
    low, high, word = [0.0] * len(elements), [0.0] * len(elements), [0.0] * len(elements)
    against = [False] * len(elements)
    left: dict[int, float] = {}  # of each outermost element that names speak against, what it may still take away
    for k, e in enumerate(elements):
        own = [weights.names.get(n, 0.0) for n in e.names]
        low[k], high[k] = min(own, default=0.0), max(own, default=0.0)
        if k:
            low[k], high[k] = min(low[k], low[e.up]), max(high[k], high[e.up])
        block = 0.0 if elements[0].marks else weights.blocks.get(e.block, 0.0)
        word[k] = weights.word(min(low[k], said[e.marked]), max(high[k], said[e.marked]), block)
        against[k] = e.unseen or word[k] < 0
        e.island = elements[e.up].island if k and against[e.up] else k
    out = []
    for i in page.items:
        e = elements[i.at]
        if not against[i.at]:
            out.append((-TAG_LEAST if e.marked else weights.tag(i.tag)) if i.text is None else len(i.text.split()) * word[i.at])
            continue
        takes = -weights.tag(i.tag) if i.text is None else 0.0 if i.text.isspace() else 1.0
        takes = min(takes, left.get(e.island, ISLAND))
        left[e.island] = left.get(e.island, ISLAND) - takes
        out.append(-takes)
    return out


def main_text(html: str | None, weights: Weights) -> str:
    """Blocks of the best region joined by a space; texts that names speak against are left out."""
    page = parse(html)
    scores = scores_of(page, weights)
    a, b = best_region(scores)
    blocks: list[str] = []
    block: list[str] = []
    for i, s in zip(page.items[a:b], scores[a:b], strict=True):
        if i.text is None:
            if i.tag not in INLINE:
                blocks.append("".join(block))
                block = []
        elif s > 0 or i.text.isspace():
            block.append(unescape(i.text))
    blocks.append("".join(block))
    return " ".join(t for x in blocks if (t := " ".join(x.split())))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: Counter = Counter()
    for b in batches:
        for html in b["html"]:
            found.update(count_names(parse(html)))
    if found:
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "name", "inside", "n"])


def learn(pages: DataFrame, most: int = FIT_PAGES) -> Weights:
    """Weights from at most ``most`` pages, of which those that mark an article are the labelled ones.

    Every count of these pages is used but those of names that can decide nothing, so a
    bounded sample's counts reach the driver. Of pages that repeat a page_id, each row counts.
    """
    sample = pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    counts = pages.join(F.broadcast(sample), "page_id").select("html").mapInPandas(_count, "kind string, name string, inside boolean, n long")
    sums = counts.groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside"))
    rows = sums.filter((F.col("kind") != "name") | (F.col("inside") + F.col("outside") >= PRIOR) | F.col("name").isin(*BOILERPLATE, MARKED, UNMARKED)).collect()
    return weigh(Counter({(r["kind"], r["name"], k): n for r in rows for k, n in ((True, r["inside"]), (False, r["outside"]))}))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; null html gives an empty text.

    The weights are learnt from the table's own pages that mark an article. Repeated rows give
    repeated results, an empty table none; ties between regions go to the first; a page
    without positive words has an empty text. Time is linear in a page's length.
    """
    weights = learn(pages)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(lambda page: main_text(page, weights))

    return pages.select("page_id", "url", text(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
