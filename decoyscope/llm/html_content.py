"""Main text of web pages from a tree-structured graphical model of the DOM.

Every block element and every run of text between block boundaries is a variable: inside the main content or not.
A tree of them has an emission per node (tag, class and id words; for text its length, link share, ending and block tag)
and a potential per parent-child edge. Messages go up from the leaves and down from the root, level by level
for a whole batch of pages at once, and give every text run its exact marginal; runs with at least one half are the
main text, in page order. All weights are smoothed counts from labelled pages: pages built here from lists of
usual block kinds, and about `MAX_PAGES` pages of the corpus (by a hash of page_id, at most `MAX_BYTES` each) whose
own markup names one article.

Character references are decoded; white space in a block becomes one space; blocks are joined by two line feeds.
Edge cases: null or empty html gives an empty text; unclosed elements, stray end tags, a cut-off last tag and raw text
without an end are read as browsers do, roughly; a page without any content run gives an empty text; repeated
pages each get a row; an empty table gives an empty result. Columns `text` and `marginals` are replaced if the pages have
them, other columns stay.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import about

MAX_PAGES = 100
MAX_BYTES = 65_536
BUILT_PAGES = 600
SMOOTH = 0.5

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACES = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math object select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub "
    "sup time tt u var wbr input br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre search section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article aside section div td th table ul ol dl main nav header footer form blockquote figure fieldset".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table thead tbody tfoot tr th details summary address".split())
"""Fixed values: HTML's element kinds."""

CONTENT_NAMES = (
    "article content main post entry story body text page blog news prose markdown document detail single paragraph copy lead essay chapter"
).split()
NOISE_NAMES = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs toc pagination pager tabs links".split(),
    "header": "header masthead topbar banner logo brand site head hero".split(),
    "footer": "footer foot bottom copyright legal colophon".split(),
    "aside": "sidebar aside widget related recommended trending popular recent tags archive more rail secondary".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted outbrain taboola dfp".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message disclaimer paywall banner".split(),
    "form": "form search login signin signup subscribe subscription newsletter contact field input".split(),
    "comments": "comment comments discussion replies reply respond disqus feedback reviews".split(),
    "share": "share sharing social follow tools actions buttons byline meta author rating".split(),
}
"""Fixed values: usual names of page parts, for the built pages."""


@dataclass
class Page:
    """Nodes in page order; node 0 is the root. Text runs have texts, elements have None."""

    parent: list[int] = field(default_factory=lambda: [-1])
    level: list[int] = field(default_factory=lambda: [0])
    features: list[tuple[str, ...]] = field(default_factory=lambda: [("tag:#root",)])
    texts: list[str | None] = field(default_factory=lambda: [None])
    kinds: list[int] = field(default_factory=lambda: [0])
    """0: parts of pages, 1: text runs, 2: blocks of running text; each has its own parent-child potential."""


def _names(attributes: str) -> tuple[list[str], bool]:
    words, hidden = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            words += [word.lower() for word in _NAME_WORD.findall(value)]
    return words, hidden


_NOISE_WORDS = frozenset(word for words in NOISE_NAMES.values() for word in words)


def parse(html: str) -> Page:
    """The page's tree of block elements and text runs."""
    page = Page()
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # tag, its nearest node, is a node itself
    pieces: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACES.sub(" ", "".join(pieces)).strip()
            pieces.clear()
            if text:
                node = stack[-1][1]
                words = text.count(" ") + 1
                page.parent.append(node)
                page.level.append(page.level[node] + 1)
                share = min(linked / len(text), 1.0)
                page.features.append((
                    f"words:{min(words, 400).bit_length()}", f"linked:{int(share * 3.99)}", f"end:{_ending(text)}", f"in:{page.features[node][0]}",
                    f"commas:{min(text.count(','), 3)}", "sign:" + ("©" if "©" in text[:80] else "|" if "|" in text else "-"),
                ))
                page.texts.append(text)
                page.kinds.append(1)
        linked = 0

    def close(place: int) -> None:
        nonlocal links
        for tag, _, own in reversed(stack[place:]):
            if own:
                flush()
            if tag == "a":
                links -= 1
        del stack[place:]

    def add_text(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text)

    at, size = 0, len(html)
    while at < size:
        match = _TOKEN.search(html, at)
        if match is None:
            add_text(html[at:])
            break
        if match.start() > at:
            add_text(html[at : match.start()])
        at = match.end()
        tag = match[2] or match[5]
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), match[1] or match[4], match[3] or match[6] or ""
        if ending:
            if tag == "br":
                pieces.append(" ")
                continue
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if place:
                if any(stack[k][2] for k in range(place, len(stack))):
                    flush()
                close(place)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = size if end is None else (html.find(">", end.end()) + 1 or size)
            if tag not in INLINE:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr", "img", "input"):
                pieces.append(" " if tag != "wbr" else "")
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SIBLINGS[tag]:
                    close(k)
                    if tag != "tr" or stack[-1][0] not in SIBLINGS["tr"]:
                        break
                elif stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        words, hidden = _names(attributes) if attributes else ([], False)
        own = tag not in INLINE or hidden or any(word in _NOISE_WORDS for word in words)
        above = stack[-1][1]
        if own:
            flush()
            page.parent.append(above)
            page.level.append(page.level[above] + 1)
            page.features.append((f"tag:{tag}", *(f"name:{word}" for word in dict.fromkeys(words)), *(("hidden",) if hidden else ())))
            page.texts.append(None)
            page.kinds.append(2 if tag in FLOW else 0)
            above = len(page.parent) - 1
        if tag == "a":
            links += 1
        stack.append((tag, above, own))
    flush()
    return page


def _ending(text: str) -> str:
    last = text[-1]
    return "." if last in ".!?:;。！？”\"'»)" else "a" if last.isalnum() else "-"


@dataclass
class Model:
    """Log ratios of features (content over other) and log potentials [kind][parent label][child label]."""

    ratios: dict[str, float]
    edges: np.ndarray

    def emission(self, features: tuple[str, ...]) -> float:
        return sum(self.ratios.get(feature, 0.0) for feature in features)


def marginals(parent: np.ndarray, level: np.ndarray, kind: np.ndarray, emission: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Probability of content for every node of a forest (roots have parent -1), by sum-product up and down."""
    own = np.stack([np.zeros(len(emission)), np.clip(emission, -30, 30)], axis=1)
    own[parent < 0] = (0.0, -30.0)  # what lies above a page is not content
    up, sent = own.copy(), np.zeros((len(own), 2))
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(level.max() + 2)) if len(level) else np.array([0])
    for depth in range(len(cuts) - 2, 0, -1):
        nodes = order[cuts[depth] : cuts[depth + 1]]
        sent[nodes] = np.logaddexp.reduce(up[nodes][:, None, :] + edges[kind[nodes]], axis=2)  # over the child's label
        np.add.at(up, parent[nodes], sent[nodes])
    belief = up.copy()
    for depth in range(1, len(cuts) - 1):
        nodes = order[cuts[depth] : cuts[depth + 1]]
        above = belief[parent[nodes]] - sent[nodes]
        above -= above.max(axis=1, keepdims=True)
        belief[nodes] = up[nodes] + np.logaddexp.reduce(above[:, :, None] + edges[kind[nodes]], axis=1)  # over the parent's label
        belief[nodes] -= belief[nodes].max(axis=1, keepdims=True)
    return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))


def fitted(pages: list[tuple[Page, list[int]]]) -> Model:
    """Smoothed counts from pages with a label per node."""
    counts = (Counter(), Counter())
    edges = np.full((3, 2, 2), SMOOTH)
    for page, labels in pages:
        for k, label in enumerate(labels):
            counts[label].update(page.features[k])
            if k:
                edges[page.kinds[k], labels[page.parent[k]], label] += 1
    totals = defaultdict(lambda: [0.0, 0.0, set()])
    for label in (0, 1):
        for feature, number in counts[label].items():
            totals[feature.split(":")[0]][label] += number
            totals[feature.split(":")[0]][2].add(feature)
    ratios = {}
    for zero, one, features in totals.values():
        for feature in features:
            high = (counts[1][feature] + SMOOTH) / (one + SMOOTH * len(features))
            low = (counts[0][feature] + SMOOTH) / (zero + SMOOTH * len(features))
            ratios[feature] = float(np.log(high / low))
    return Model(ratios, np.log(edges / edges.sum(axis=2, keepdims=True)))


def named_labels(page: Page) -> list[int] | None:
    """Labels of a page whose markup has exactly one article (or main): what is in it, save parts named otherwise."""
    marks = [[k for k, f in enumerate(page.features) if f[0] == f"tag:{tag}"] for tag in ("article", "main")]
    root = next((found[0] for found in marks if len(found) == 1), None)
    if root is None:
        return None
    noise = {f"tag:{tag}" for tag in ("nav", "aside", "footer", "form", "button", "header")} | {f"name:{word}" for word in _NOISE_WORDS}
    labels = [0] * len(page.parent)
    labels[root] = 1
    for k in range(root + 1, len(labels)):
        labels[k] = int(labels[page.parent[k]] == 1 and not noise.intersection(page.features[k]))
    return labels


def built_pages(number: int, seed: int = 7) -> Iterator[tuple[Page, list[int]]]:
    """Labelled pages put together from usual parts; element attribute `data-c` marks content while building."""
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice(("an", "el", "to", "ri", "us", "me", "ka")) for _ in range(chance.randint(1, 4)))
    line = lambda low, high: " ".join(word() for _ in range(chance.randint(low, high)))
    sentence = lambda: ", ".join(line(3, 9) for _ in range(chance.randint(1, 3))).capitalize() + "."
    prose = lambda: " ".join(sentence() for _ in range(chance.choice((1, 1, 2, 3, 5, 8))))

    def attributes(names: list[str]) -> str:
        if chance.random() < 0.15:
            return ""
        kind = chance.choice(("class", "class", "id"))
        return f' {kind}="{chance.choice(("", "", "site-", "page-", "x-"))}{chance.choice(names)}"'

    def content() -> str:
        parts = [f"<h{chance.choice('112')}>{line(3, 10)}</h1>"] if chance.random() < 0.8 else []
        for _ in range(chance.randint(1, 12)):
            parts.append(chance.choice((
                lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}", lambda: f"<p>{line(1, 4)}.</p>",
                lambda: f"<h2>{line(2, 7)}</h2>", lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: f"<div>{prose()}</div>",
                lambda: f"<p>{prose()} <a href=x>{line(1, 3)}</a> {prose()}</p>", lambda: f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(3))}</ul>",
                lambda: f"<p><b>{prose()}<br>", lambda: f"<pre><code>{line(4, 20)}</code></pre>",
                lambda: f"<table><tr><td>{line(1, 3)}</td><td>{line(1, 3)}</td></tr></table>", lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>",
            ))())
        for _ in range(chance.choice((0, 0, 1, 2))):
            parts.insert(chance.randint(0, len(parts)), noise(chance.choice(("ad", "share", "aside", "notice", "form"))))
        return "".join(parts)

    def noise(part: str) -> str:
        links = "".join(f"<li><a href=x>{line(1, 3)}</a></li>" for _ in range(chance.randint(2, 8)))
        tags, inner = {
            "nav": ("nav nav div ul", lambda: f"<ul>{links}</ul>"),
            "header": ("header header div", lambda: f"<a href=x>{line(1, 2)}</a><p>{line(2, 6)}</p>" if chance.random() < 0.5 else f"<h1>{line(1, 3)}</h1><ul>{links}</ul>"),
            "footer": ("footer footer div", lambda: chance.choice((f"&copy; {word()} &middot; {sentence()}", f"<p>{sentence()}</p><ul>{links}</ul>", f"<p>{prose()}</p>"))),
            "aside": ("aside aside div section", lambda: f"<h3>{line(1, 3)}</h3>" + (f"<ul>{links}</ul>" if chance.random() < 0.6 else f"<p>{prose()}</p>")),
            "ad": ("div div aside section p", lambda: chance.choice((prose(), f"<p>{prose()}</p>", f"<a href=x>{line(2, 8)}</a>"))),
            "notice": ("div div section p", lambda: chance.choice((prose(), f"<p>{prose()}</p><a href=x>{line(1, 2)}</a>"))),
            "form": ("form form div", lambda: f"<label>{line(1, 3)}</label><input><button>{word()}</button><p>{sentence()}</p>"),
            "comments": ("section div ol", lambda: "".join(f'<div class="{chance.choice(NOISE_NAMES["comments"])}"><p>{prose()}</p></div>' for _ in range(chance.randint(1, 5)))),
            "share": ("div div p ul", lambda: f"<a href=x>{word()}</a> <a href=x>{word()}</a> {line(1, 4)}"),
        }[part]
        tag, inner = chance.choice(tags.split()), inner()
        named = attributes(NOISE_NAMES[part])
        if tag in ("div", "section", "p", "ul", "ol") and not named:
            named = f' class="{chance.choice(NOISE_NAMES[part])}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    for _ in range(number):
        tag = chance.choice(("article", "article", "main", "div", "div", "div", "section", "td", ""))
        named = attributes(CONTENT_NAMES) if tag not in ("article", "main") or chance.random() < 0.4 else ""
        before = [noise(part) for part in ("header", "nav", "notice", "ad", "share") if chance.random() < 0.55]
        after = [noise(part) for part in ("aside", "comments", "form", "ad", "footer") if chance.random() < 0.55]
        chance.shuffle(before)
        inside = content()
        marked = f'<{tag}{named} role="zzcontent">{inside}</{tag}>' if tag else inside
        body = "".join(before) + marked + "".join(after)
        for _ in range(chance.choice((0, 0, 1, 2))):
            body = f"<div{attributes(['wrapper', 'container', 'page', 'layout', 'row', 'site', 'app', 'root'])}>{body}</div>"
        if not tag:
            body = f'<div role="zzcontent">{body}</div>' if chance.random() < 0.5 else body
        mark = "" if "zzcontent" in body else ' role="zzcontent"'
        page = parse(f"<html><head><title>{line(2, 5)}</title></head><body{mark}>{body}</body></html>")
        root = next(k for k, f in enumerate(page.features) if "name:zzcontent" in f)
        page.features[root] = tuple(f for f in page.features[root] if f != "name:zzcontent")
        labels = [0] * len(page.parent)
        labels[root] = 1
        noisy = {f"tag:{t}" for t in ("nav", "aside", "footer", "form", "header", "button")} | {f"name:{w}" for w in _NOISE_WORDS}
        for k in range(root + 1, len(labels)):
            labels[k] = int(labels[page.parent[k]] == 1 and not noisy.intersection(page.features[k]))
        yield page, labels


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html", limit: int = MAX_PAGES, max_bytes: int = MAX_BYTES) -> Model:
    """A model from the built pages and about `limit` pages of the corpus, of at most `max_bytes` each."""
    own = pages.select(F.col(page_id).alias("id"), F.col(html).alias("html")).where(F.octet_length("html") <= max_bytes)
    labelled = list(built_pages(BUILT_PAGES))
    for row in about(own, limit, F.col("id"), F.octet_length("html")).sort("id", "html").collect():
        page = parse(row["html"])
        labels = named_labels(page)
        if labels is not None:
            labelled.append((page, labels))
    return fitted(labelled)


def texts(htmls: list[str | None], model: Model) -> tuple[list[str], list[list[float]]]:
    """The main texts of some pages, and the marginals of each page's text runs."""
    pages = [parse(html or "") for html in htmls]
    sizes = np.array([len(page.parent) for page in pages])
    begin = np.cumsum(sizes) - sizes
    parent = np.concatenate([np.array(page.parent) + low for page, low in zip(pages, begin)])
    parent[begin] = -1
    level = np.concatenate([page.level for page in pages])
    kind = np.concatenate([page.kinds for page in pages])
    scores: dict[tuple[str, ...], float] = {}
    emission = []
    for page in pages:
        for features in page.features:
            if features not in scores:
                scores[features] = model.emission(features)
            emission.append(scores[features])
    found = marginals(parent, level, kind, np.array(emission), model.edges)
    out, chances = [], []
    for page, low in zip(pages, begin):
        runs = [(text, found[low + k]) for k, text in enumerate(page.texts) if text is not None]
        out.append("\n\n".join(text for text, chance in runs if chance >= 0.5))
        chances.append([float(chance) for _, chance in runs])
    return out, chances


def extract(pages: DataFrame, model: Model, html: str = "html", at_once: int = 256) -> DataFrame:
    """The pages with `text`, the main text, and `marginals`, the content probability of each text run in page order."""
    kept = pages.drop("text", "marginals")
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("marginals", T.ArrayType(T.DoubleType()))])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                part = batch.slice(low, at_once)
                main, chances = texts(part.column(html).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(main, pa.string()), pa.array(chances, pa.list_(pa.float64()))], names=[*part.schema.names, "text", "marginals"]
                )

    return kept.mapInArrow(run, schema)
