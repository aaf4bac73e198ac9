"""Operator 5: main text of web pages by text-to-tag ratios.

Events of the standard library's streaming parser are cut into lines at block elements. Each line has its text length
over the number of its tags; the ratios are smoothed with a Gaussian and lines over a threshold (their mean less part
of their deviation) are the content cluster. The region that holds it gives the text: the article or main elements, or
else the lowest container that holds ``HELD`` of the cluster. All its lines count, short ones too, but for those inside
elements that are no content by their name, class, id or role (menus, headers, footers, sidebars, notices, adverts,
forms, comments) and, without article or main, for containers of links only.

Classes and ids that also name layouts ("layout sidebar-right") mark an element as furniture only if it does not hold
most of the page's text; negated forms ("no-sidebar") mark nothing, and "header" only what is outside an article and no
part of one ("entry-header"). Adverts, notices, comments and the like are left out whatever they hold.

Defined results: a null page is an empty page; a page without text, or with furniture only, gives an empty text; ties
between regions go to the earlier one; repeated rows give repeated results; an empty table gives an empty table; other
columns are ignored. The parser takes malformed markup as it comes; elements left open end with their parent. The time
is linear in the page's length, whatever the depth.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

SIGMA, CUT, HELD = 1.0, 0.5, 0.8
#: Elements by kind, and words in class, id and role that mark furniture.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title svg math iframe object canvas audio video select option textarea button".split())
FURNITURE = set("nav header footer aside form menu dialog".split())
CLOSES_P = BLOCKS - {"html", "body"}
MARKS = set("nav navbar navigation menu header footer sidebar side aside widget form search toolbar banner complementary".split())
NEVER = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs masthead related recommended cookie cookies consent notice notices popup modal newsletter subscribe signup login share sharing social pagination pager contentinfo alert comment comments disqus reply replies respond".split())
NEGATIONS = set("no not has have with without hide hidden show".split())
PARTS = set("entry article post story page content title section".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())


def marked(value: str, inside: bool) -> int:
    """Of a class or id: 2 for furniture, 1 for what also names layouts, 0 for neither. ``inside``: inside an article or main."""
    found = 0
    for name in value.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        for i, w in enumerate(words):
            if i and words[i - 1] in NEGATIONS:
                continue
            if w in NEVER:
                return 2
            if w in MARKS and not (w == "header" and (inside or not PARTS.isdisjoint(words[:i]))):
                found = 1
    return found


class Lines(HTMLParser):
    """lines: [text parts, tags, region, furniture, soft, characters in links].

    A region is a number for the nearest article, main or container; ``soft`` the nearest element that its class or id
    marks as furniture (0: none), which holds only if it does not have most of the text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, int, int, int]] = []  # tag, and bad, hidden, region, soft, articles before it
        self.count: Counter[str] = Counter()  # open elements by tag
        self.lines: list[list] = []
        self.regions: list[tuple[int, bool]] = [(-1, False)]  # parent, article or main
        self.softs: list[int] = [-1]  # parent
        self.bad = self.hidden = self.region = self.soft = self.articles = 0
        self.row = [[], 0, 0, 0, 0, 0]

    def line(self) -> None:
        if self.row[0]:
            self.lines.append(self.row)
        self.row = [[], 0, self.region, self.bad, self.soft, 0]

    def push(self, tag) -> None:
        self.open.append((tag, self.bad, self.hidden, self.region, self.soft, self.articles))
        self.count[tag] += 1

    def pop_to(self, i: int) -> None:
        if i < len(self.open):
            _, self.bad, self.hidden, self.region, self.soft, self.articles = self.open[i]
            for name, *_ in self.open[i:]:
                self.count[name] -= 1
            del self.open[i:]

    def handle_starttag(self, tag, attrs):
        if self.hidden and tag not in ("body", "article", "main"):
            if tag not in VOID:
                self.push(tag)
            return
        if tag in CLOSES_P and (self.count["p"] or tag == "li" and self.count["li"]):
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name == "p" or tag == "li" and name == "li":
                    self.line()
                    self.pop_to(i)
                    break
                if name in BLOCKS:
                    break
        block = tag in BLOCKS
        if block:
            self.line()
        self.row[1] += 1
        if tag in VOID:
            if tag == "br":
                self.row[0].append(" ")
            return
        article, inside = tag in ("article", "main"), self.articles > 0
        self.push(tag)
        if article and self.count[tag] == 1 or tag == "body":
            self.bad = self.hidden = self.soft = 0  # something before it was left open
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in FURNITURE and not (tag == "header" and inside):
            self.bad += 1
        elif tag not in ("html", "body"):
            kind = 0
            for name, value in attrs:
                if value and name in ("class", "id") and not (tag == "main" or article and not inside):
                    kind = max(kind, marked(value, inside))
                elif value and name == "role" and value.strip().lower() in ROLES:
                    kind = 2
            if kind == 2:
                self.bad += 1
            elif kind:
                self.softs.append(self.soft)
                self.soft = len(self.softs) - 1
        if article:
            self.articles += 1
        if article or block and tag in ("div", "section", "td", "body"):
            self.regions.append((self.region, article and not inside))
            self.region = len(self.regions) - 1
        if block:
            self.row[2:5] = [self.region, self.bad, self.soft]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag):
        if tag == "br":
            self.row[0].append(" ")
        if not self.count[tag]:
            return
        i = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)
        block = any(o[0] in BLOCKS for o in self.open[i:])
        if block and not self.hidden:
            self.line()
        self.pop_to(i)
        if block:
            self.row[2:5] = [self.region, self.bad, self.soft]
        else:
            self.row[1] += 1

    def handle_data(self, data):
        if not self.hidden:
            self.row[0].append(data)
            if self.count["a"]:
                self.row[5] += len(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, kernel, "full")[reach : reach + len(x)] / np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]


def main_text(html: str | None) -> str:
    p, html = Lines(), html or ""
    if (at := html.rfind("<")) > html.rfind(">") and html[at + 1 : at + 2].isalpha():
        html = html[:at]  # a tag that never ends is no text
    p.feed(html)
    p.close()
    p.line()
    lines = [(" ".join("".join(parts).split()), tags, region, soft, links) for parts, tags, region, bad, soft, links in p.lines if not bad]
    lines = [x for x in lines if x[0]]
    # What each softly marked element holds, with the elements inside it; children have greater numbers.
    held = [0] * len(p.softs)
    for text, _, _, soft, _ in lines:
        held[soft] += len(text)
    whole = sum(held)
    for i in range(len(held) - 1, 0, -1):
        held[p.softs[i]] += held[i]
    out = [False] * len(held)
    for i in range(1, len(held)):
        out[i] = out[p.softs[i]] or 2 * held[i] <= whole
    lines = [x for x in lines if not out[x[3]]]
    if not lines:
        return ""
    ratio = smooth(np.array([len(t) / max(1, tags) for t, tags, *_ in lines]))
    content = ratio >= ratio.mean() - CUT * ratio.std()
    # The cluster's weight by region; an article or main element above a line stands for all its parts.
    parent = [x[0] for x in p.regions]
    home = list(range(len(parent)))  # the article or main that a region is in, or itself
    for i in range(1, len(home)):
        if not p.regions[i][1] and p.regions[home[parent[i]]][1]:
            home[i] = home[parent[i]]
    weight, cluster, total, linked = ([0] * len(parent) for _ in range(4))
    for (text, _, region, _, links), inside in zip(lines, content, strict=True):
        total[region] += len(text)
        linked[region] += links
        if inside:
            weight[home[region]] += len(text)
            cluster[region] += len(text)
    articles = {i for i, x in enumerate(p.regions) if x[1] and weight[i]}
    if articles and sum(weight[i] for i in articles) >= 0.2 * max(weight):
        return "\n".join(x[0] for x in lines if home[x[2]] in articles)
    below = cluster.copy()
    for i in range(len(parent) - 1, 0, -1):
        below[parent[i]] += below[i]
    most = below[0]
    # Of the containers that hold enough the lowest: those that hold enough are one chain, deeper ones have greater numbers.
    chosen = max((i for i in range(len(parent)) if below[i] >= HELD * most), default=0)
    under = [False] * len(parent)
    for i in range(len(parent)):
        under[i] = i == chosen or i > 0 and under[parent[i]]
    return "\n".join(x[0] for x in lines if under[x[2]] and (cluster[x[2]] or 2 * linked[x[2]] <= total[x[2]]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. One row per row of ``pages``."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.iloc[i : i + 500]
                text = [main_text(h if isinstance(h, str) else None) for h in some["html"]]
                yield pd.DataFrame({"page_id": some["page_id"], "url": some["url"], "text": text, "n_chars": list(map(len, text))})

    bounded_batches(pages.sparkSession)
    # Ids pass pandas as strings: a null would make numbers of them that lose digits.
    rows = pages.select(F.col(id_col).cast("long").cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(tidy(run), "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
