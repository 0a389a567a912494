"""Main text of web pages: a tree-structured graphical model over the DOM.

Method. Every element and every block of text is a node: content, not content, or (elements) a frame that holds either. A node's potential comes from its tag,
the words of its class, id and role, and features of its text; an edge's potential says how a child follows its parent.
Sum-product messages are passed upward and then downward, which gives each block its marginal. All potentials are counted
on labelled pages.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end, elements whose text is never shown or typed, and elements inside a line
#: (formulas, drawings and players among them: their text and fallback text is read).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template annotation annotation-xml desc metadata iframe canvas select option textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var math mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics svg tspan object audio video".split())
#: Fixed values of HTML: which open elements a start tag ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An end or an implied end doesn't reach beyond these.
FENCES = frozenset("html body table ul ol dl article section nav aside main div header footer form td th blockquote".split())
NAME = re.compile(r"[a-z]+|\d+")
#: Attribute of labelled pages: 1 for content, 0 for the rest; it holds for an element and what it contains.
LABEL = "data-content"


class Dom(HTMLParser):
    """Nodes of a page: parents, features, texts (None for elements), labels and link shares."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.text, self.label = [-1], ["#page"], [()], [None], [None]
        self.linked = [0]
        self.open: list[tuple[str, int]] = [("#page", 0)]
        self.block: list[str] = []
        self.block_at, self.block_linked, self.silent, self.links = 0, 0, 0, 0

    def add(self, parent: int, tag: str, names: tuple, text: str | None, label: int | None, linked: int = 0) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.text, text), (self.label, label), (self.linked, linked)):
            column.append(value)
        return len(self.parent) - 1

    def flush(self) -> None:
        text = " ".join("".join(self.block).split())
        if text:
            self.add(self.block_at, "#text", (), text, self.label[self.block_at], self.block_linked)
        self.block, self.block_linked = [], 0

    def home(self) -> int:
        return next(at for tag, at in reversed(self.open) if at >= 0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.handle_data(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag not in SILENT:
                self.imply("p")
            for other in CLOSES.get(tag, ()):
                self.imply(other)
        if tag in INLINE:
            self.open.append((tag, -1))
            self.links += tag == "a"
            return
        found = dict(attrs)
        names = tuple(dict.fromkeys(w for k in ("class", "id", "role") for w in NAME.findall((found.get(k) or "").lower())))
        label = int(found[LABEL]) if found.get(LABEL) in ("0", "1") else self.label[self.home()]
        self.open.append((tag, self.add(self.home(), tag, names, None, label)))
        self.silent += tag in SILENT

    def imply(self, tag: str) -> None:
        """End an open element that can't contain what follows."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.close_to(i)
                return
            if self.open[i][0] in FENCES:
                return

    def close_to(self, i: int) -> None:
        self.flush()
        for tag, _ in self.open[i:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if tag in INLINE:
                    self.links -= tag == "a"
                    del self.open[i]
                else:
                    self.close_to(i)
                return
            if tag in INLINE and self.open[i][1] >= 0:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """<![...> other than CDATA is a comment up to the next >, as browsers read it; -1 where that is missing."""
        if self.rawdata.startswith("<![CDATA[", i):
            return super().parse_marked_section(i, report)
        return self.rawdata.find(">", i + 3) + 1 or -1

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        home = self.home()
        if home != self.block_at:
            self.flush()
            self.block_at = home
        self.block.append(data)
        if self.links:
            self.block_linked += len(data.strip())


def parse(html: str | None) -> Dom:
    dom = Dom()
    dom.feed(html or "")
    dom.close()
    dom.flush()
    return dom


def evidence(dom: Dom, i: int) -> list[str]:
    """Features of a node, as names of the model's potentials."""
    if dom.text[i] is None:
        return ["tag " + dom.tag[i], *["name " + w for w in dom.names[i]]]
    share = dom.linked[i] / max(1, len(dom.text[i]))
    return [f"links {0 if share < 0.2 else 1 if share < 0.7 else 2}"]


def node_labels(dom: Dom) -> list[int]:
    """States of all nodes as marked: 0 for the rest, 1 for content; elements without a mark are 2 (they hold either)."""
    return [(0 if dom.text[i] is not None else 2) if x is None else x for i, x in enumerate(dom.label)]


class ContentModel:
    """Log potentials of features and of parent-child pairs for the three states, from counts of labelled pages."""

    def __init__(self, counts: dict[str, tuple[float, ...]]) -> None:
        kinds = ("tag", "name", "links")
        totals = {kind: np.array([sum(v[y] for k, v in counts.items() if k.split(" ")[0] == kind) for y in range(3)], float) for kind in kinds}
        self.feature = {k: np.log((np.array(v, float) + 0.5) / (totals[k.split(" ")[0]] + 1)) for k, v in counts.items() if k.split(" ")[0] in kinds}
        edge = np.array([[counts.get(f"edge {p} {kind}", (0, 0, 0)) for p in range(3)] for kind in ("element", "text")], float) + 0.5
        self.edge = np.log(edge / edge.sum(2, keepdims=True))
        self.nothing = np.zeros(3)

    def marginals(self, dom: Dom) -> np.ndarray:
        """P(content) of each node by messages up the tree and down again."""
        n = len(dom.parent)
        own = np.zeros((n, 3))
        for i in range(1, n):
            for key in evidence(dom, i):
                own[i] += self.feature.get(key, self.nothing)
        below, up = own.copy(), np.zeros((n, 3))
        below[0] = (-50.0, -50.0, 0.0)  # the page itself holds either
        for i in range(n - 1, 0, -1):  # children come after their parents
            up[i] = np.logaddexp.reduce(self.edge[int(dom.text[i] is not None)] + below[i], 1)
            below[dom.parent[i]] += up[i]
        down = np.zeros((n, 3))
        for i in range(1, n):
            p = dom.parent[i]
            rest = down[p] + below[p] - up[i]
            down[i] = np.logaddexp.reduce(self.edge[int(dom.text[i] is not None)] + rest[:, None], 0)
            down[i] -= down[i].max()
        belief = below + down
        belief -= belief.max(1, keepdims=True)
        chance = np.exp(belief)
        return chance[:, 1] / chance.sum(1)

    def extract(self, html: str | None) -> str:
        dom = parse(html)
        chance = self.marginals(dom)
        return " ".join(t for i, t in enumerate(dom.text) if t is not None and chance[i] >= 0.5)


def labelled_pages(spark: SparkSession, pages: int = 600, seed: int = 3) -> DataFrame:
    """Labelled pages (html) made by rule: articles among menus, headers, sidebars, notices, adverts, forms, comments and footers."""
    rows = spark.range(0, pages, 1, 4)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"html": [example_page(random.Random(seed * 1_000_003 + int(i))) for i in frame["id"]]})

    return rows.mapInPandas(make, "html string")


#: Words of class names and ids by which pages name their parts; the first of each is the part itself.
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links toc pagination pager tabs",
    "header": "header masthead top branding logo sitehead banner hero topbar",
    "footer": "footer bottom copyright colophon legal sitefoot foot credits",
    "aside": "sidebar aside side related widget rail complementary recommended trending popular tags",
    "notice": "notice cookie consent alert gdpr message banner popup modal overlay warning disclaimer",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner",
    "form": "form newsletter subscribe signup search login contact poll",
    "comments": "comments comment replies reply discussion respond disqus thread reader",
    "share": "share social sharing follow buttons toolbar",
}
CONTENT_NAMES = "content article post entry main body text story page primary single hentry articlebody prose".split()


def example_page(r: random.Random) -> str:
    word = lambda: "".join(r.choice(("ta", "re", "in", "on", "mi", "el", "ou", "st", "er", "an")) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def named(names: list[str]) -> str:
        own = r.choice(names)
        return r.choice((f' class="{own}"', f' id="{own}"', f' class="{own} {word()}"', f' class="{word()}-{own}"', f' class="{own}-{r.choice(names)}"'))

    def boiler(kind: str) -> str:
        names = PARTS[kind].split()
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.7 else r.choice(("div", "div", "section"))
        name = "" if tag == kind and r.random() < 0.6 else named(names)
        plain = lambda: r.choice((f"<p>{words(2, 40)}</p>", words(2, 25), f"<div>{words(2, 20)}</div>"))
        if kind == "nav" or kind in ("aside", "share") and r.random() < 0.6:
            inside = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
        elif kind == "form":
            inside = f"{plain()}<label>{words(1, 3)}</label><input type=text><button>{word()}</button>"
        elif kind == "comments":
            inside = f"<h3>{words(1, 3)}</h3>" + "".join(f"<div{named(names)}><p>{words(3, 50)}</p></div>" for _ in range(r.randint(1, 5)))
        else:
            inside = "".join(plain() for _ in range(r.randint(1, 3))) + (link() if r.random() < 0.4 else "")
        return f'<{tag}{name} {LABEL}="0">{r.choice(("", f"<h2>{words(1, 3)}</h2>")) if kind == "aside" else ""}{inside}</{tag}>'

    def paragraph() -> str:
        text = words(1, r.choice((3, 20, 120)))
        if r.random() < 0.25:
            text += f" <b>{words(1, 3)}</b> {link()} {words(1, 9)}"
        return r.choice((f"<p>{text}</p>",) * 6 + (f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<h2>{words(1, 6)}</h2>", f"<h3>{words(1, 6)}</h3>", *("<ul>" + "".join(f"<li>{r.choice((words(1, 12), link(), words(1, 9) + ' ' + link()))}</li>" for _ in range(r.randint(1, 6))) + "</ul>" for _ in range(5)), f"<ol><li>{words(1, 12)}</li></ol>", f"<dl><dt>{word()}</dt><dd>{words(1, 9)}</dd></dl>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<figure><figcaption>{words(2, 9)}</figcaption></figure>", f"<section><h2>{words(1, 4)}</h2><p>{text}</p></section>"))

    title = f"<h1>{words(2, 10)}</h1>"
    title = f"<header>{title}</header>" if r.random() < 0.15 else title
    pieces = [paragraph() for _ in range(r.randint(0, 12))]
    for kind in ("share", "ad", "aside", "notice", "form", "comments"):
        if r.random() < 0.3:
            pieces.insert(r.randint(0, len(pieces)) if kind != "comments" else len(pieces), boiler(kind))
    inside = title + "".join(pieces)
    tag = r.choice(("article", "article", "main", "div", "div", "section"))
    name = named(CONTENT_NAMES) if tag in ("div", "section") or r.random() < 0.3 else ""
    body = f'<{tag}{name} {LABEL}="1">{inside}</{tag}>'
    if r.random() < 0.3:
        body = f"<{r.choice(('main', 'div'))}{named(CONTENT_NAMES + ['wrapper', 'container', 'row', 'layout'])}>{body}</div>"
    if r.random() < 0.15:  # a page without a frame for its content
        body = "".join(f'<div {LABEL}="1">{x}</div>' if not x.startswith("<p>") else x.replace("<p>", f'<p {LABEL}="1">', 1) for x in pieces if LABEL not in x)
    kinds = list(PARTS)
    before = [boiler(k) for k in kinds if r.random() < (0.7 if k in ("nav", "header") else 0.25)]
    after = [boiler(k) for k in kinds if r.random() < (0.8 if k == "footer" else 0.25)]
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def fit_content(labelled: DataFrame, html: str = "html", most_features: int = 20_000) -> ContentModel:
    """The model of labelled pages, whose elements carry data-content 1 or 0 for themselves and what they contain.

    Spark counts features and parent-child pairs of all pages; the most_features commonest come to the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in batches:
            for page in frame["html"]:
                dom = parse(page)
                labels = node_labels(dom)
                for i in range(1, len(labels)):
                    held[f"edge {labels[dom.parent[i]]} {'text' if dom.text[i] is not None else 'element'}", labels[i]] += 1
                    for key in evidence(dom, i):
                        held[key, labels[i]] += 1
        yield pd.DataFrame([(k, y, c) for (k, y), c in held.items()], columns=["feature", "label", "c"])

    counted = labelled.select(F.col(html).cast("string").alias("html")).mapInPandas(count, "feature string, label int, c long")
    top = counted.groupBy("feature").agg(F.sum(F.when(F.col("label") == 0, F.col("c")).otherwise(0)).alias("c0"), F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("label") == 2, F.col("c")).otherwise(0)).alias("c2")).orderBy(F.desc(F.col("c0") + F.col("c1") + F.col("c2")), "feature").limit(most_features).collect()
    return ContentModel({x["feature"]: (x["c0"], x["c1"], x["c2"]) for x in top})


def extract_content(pages: DataFrame, model: ContentModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of each page: (page_id, url, text, n_chars).

    The project has no records of web pages, so this is general. The whole html is read (null: empty). Character
    references are decoded; white space inside a block becomes one space, blocks are trimmed and joined in page order by
    one space. Scripts, styles, controls and markup are never text. n_chars counts code points. Pages without content
    have an empty text; every row is returned, repeated ones and null ids too; further columns are ignored.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = [model.extract(x) for x in frame["html"]]
            yield pd.DataFrame({"id": frame["id"].tolist(), "url": frame["url"].tolist(), "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInPandas(extract, "id string, url string, text string, n_chars long").select(F.col("id").cast(kind).alias(page_id), F.col("url").alias(url), "text", "n_chars")
