"""Main-text extraction from HTML: flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. Each block carries its word count and link density, those of the blocks before and
behind it, whether it is a heading, whether it lies inside or outside an ``article`` or ``main`` element (or the page has none), and whether
an enclosing element marks it as furniture by tag, role, class or id. A decision tree trained on the small labelled
table below decides which blocks are text; it becomes a Spark expression over the array of blocks. More than half of that table comes from pages without
any telling tag or name, where menus, teasers and link lists differ from text by their link densities and lengths alone.

Scripts, styles, comments and other unseen elements never make blocks. Character references are decoded, white space inside a block becomes one
space, and the chosen blocks are joined by a line feed in page order. Whole pages are read; nothing is capped.

Defined results: null or empty html gives an empty text. Unclosed and truncated markup is read as far as it goes. Equal rows give equal results, an empty table none. Extra columns pass through.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.text import free_name

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "heading", "place", "furniture")
BLOCK = "struct<text: string, words: double, links: double, prev_words: double, prev_links: double, next_words: double, next_links: double, heading: double, place: double, furniture: double>"
MAX_DEPTH = 8

# Element kinds of the HTML standard.
UNSEEN = "script style title noscript template textarea svg math iframe object canvas video audio select datalist"
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button option"
).split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form button menu dialog label fieldset legend option".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Name parts that sites give to furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs "
    "sidebar side rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social follow related recommended recommendations teaser teasers widget widgets pagination pager pages comment comments commentlist disqus reply replies respond "
    "search skip copyright legal disclaimer tags tagcloud outbrain taboola print hidden".split()
)
CONTENT_NAMES = frozenset("article post entry content main story body text".split())

_ATTRS = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<unseen>{UNSEEN.replace(' ', '|')})\b{_ATTRS}(?:/>|>.*?(?:</(?P=unseen)\s*>|\Z))"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>|<[/a-zA-Z][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BLOCK_SET = frozenset(BLOCKS)
SPACES = re.compile(r"\s+")


def is_furniture(tag: str, attrs: str, in_content: bool) -> bool:
    """Whether an element's tag or attributes mark its contents as furniture or hidden."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_content):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in NAME_PARTS.findall(one)}
                if parts & FURNITURE_NAMES and not (parts & CONTENT_NAMES and not parts & {"comment", "comments", "ad", "ads", "related", "share", "tags"}):
                    return True
    return False


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Open:
    """The open elements of a page, with running counts, so that no question and no end tag needs a look at all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # tag, furniture, content
        self.places: dict[str, list[int]] = {}  # of each tag, from the outermost
        self.blocks: list[int] = []  # places of block-level elements
        self.links = self.headings = self.furniture = self.content = 0

    def _count(self, tag: str, furniture: bool, content: bool, by: int) -> None:
        self.links += by * (tag == "a")
        self.headings += by * (tag in HEADINGS)
        self.furniture += by * furniture
        self.content += by * content

    def push(self, tag: str, furniture: bool, content: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_SET:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, furniture, content))
        self._count(tag, furniture, content, 1)

    def cut(self, place: int) -> None:
        """Closes everything from ``place`` on."""
        while len(self.stack) > place:
            one = self.stack.pop()
            self.places[one[0]].pop()
            if one[0] in BLOCK_SET:
                self.blocks.pop()
            self._count(*one, -1)

    def close(self, tag: str) -> None:
        """An end tag: closes the innermost such element; one that is not block-level does not reach out of its block."""
        at = self.places.get(tag)
        if at and (tag in BLOCK_SET or not self.blocks or at[-1] > self.blocks[-1]):
            self.cut(at[-1])

    def make_room(self, tag: str) -> None:
        """A block-level start tag ends what may not hold it."""
        shut = CLOSES.get(tag, {"p"})
        while self.blocks and self.stack[self.blocks[-1]][0] in shut:
            self.cut(self.blocks[-1])


def flat_blocks(html: str | None) -> list[dict]:
    """The blocks of one page with their features."""
    raw: list[list] = []  # text, link characters, heading, inside, furniture
    open_ = Open()
    parts: list[str] = []
    links = heading = 0
    seen_content = False

    def flush() -> None:
        nonlocal links, heading
        text = SPACES.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            raw.append([text, min(links, len(text)), heading, open_.content > 0, open_.furniture > 0])
        links = heading = 0

    def add(text: str) -> None:
        nonlocal links, heading
        if text:
            parts.append(text)
            if open_.links:
                links += len(text.strip())
            if open_.headings:
                heading = 1

    html, at = html or "", 0
    for m in TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["unseen"] or m[0].startswith("<!--"):
                parts.append("" if m[0].startswith("<!--") else " ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK_SET:
            flush()
        if m["end"]:
            open_.close(tag)
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag in BLOCK_SET:
            open_.make_room(tag)
        content = tag in ("article", "main")
        seen_content |= content
        open_.push(tag, is_furniture(tag, m["attrs"], content or open_.content > 0), content)
    add(html[at:])
    flush()
    out = []
    for text, linked, is_heading, inside, furniture in raw:
        place = 0.0 if not seen_content else 1.0 if inside else -1.0
        out.append({"text": text, "words": float(text.count(" ") + 1), "links": linked / len(text), "heading": float(is_heading), "place": place, "furniture": float(furniture)})
    edge = {"words": 0.0, "links": 0.0}
    for i, b in enumerate(out):
        before, behind = (out[i - 1] if i else edge), (out[i + 1] if i + 1 < len(out) else edge)
        b |= {"prev_words": before["words"], "prev_links": before["links"], "next_words": behind["words"], "next_links": behind["links"]}
    return out


def _filler(n: int, start: int = 0) -> str:
    base = "the river rose over night and people moved their boats to higher ground before the water reached them while others waited".split()
    return " ".join(base[(start + i) % len(base)] for i in range(n)) + "."


MARK = "\u2063"  # stands behind every block of the labelled pages that is text


def labelled_pages(seed: int = 7) -> list[str]:
    """Pages of common layouts and lengths whose text blocks end in MARK."""
    plain = lambda html: html.replace(MARK, "")
    menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World news", "Sport", "About us")) + "</ul>"
    foot = "<footer>&copy; 2020 Example Media. All rights reserved. <a href='/p'>Privacy</a></footer>"
    pages = []
    for k, sizes in enumerate(((60, 25, 1, 80), (8, 5, 3), (120, 2, 40, 15, 70), (30,), (1, 1, 12), (18, 22, 9))):
        ps = [_filler(n, 3 * i + k) + MARK for i, n in enumerate(sizes)]
        title = _filler(5, k)[:-1] + MARK
        body = "".join(f"<p>{p}</p>" for p in ps)
        linked = _filler(14, k)
        with_link = body + f"<p>{linked} <a href='/x'>More on this</a> {linked}{MARK}</p>"
        noise = f"<div><p>{_filler(9, k + 5)}</p></div>"
        semantic = f"<article><h1>{title}</h1>{with_link}</article>"
        # semantic elements; loose text outside the article is not part of it
        pages.append(f"<body><nav>{menu}</nav><div>{_filler(6 + 12 * k, 2)}</div>{semantic}{foot}</body>")
        pages.append(f"<body><header>{menu}</header>{noise}<main><h2>{title}</h2>{with_link}<div class='comments'><p>{_filler(20 + 9 * k)}</p></div></main><aside>{noise}{menu}</aside></body>")
        pages.append(f"<body>{semantic.replace('</article>', '')}<form><p>{_filler(4)}</p></form><ul class='share'><li><a href='/s'>Share</a></li></ul></article>{noise}</body>")
        loose = "".join(f"<div>{_filler(n, k)}</div>" for n in (14 + 5 * k, 40, 22))
        pages.append(f"<body>{loose}{semantic}{loose}</body>")
        pages.append(f"<body>{semantic}<section class='related'><h3>{plain(title)}</h3>{plain(body)}</section></body>")
        # class names only
        text = "".join(f"<p>{p}</p>" for p in ps if p.count(" ") >= 8)
        boxes = {name: f"<div class='{name}'><p>{_filler(n, k)}</p><p>{_filler(n + 7, k)}</p></div>" for name, n in (("promo-box", 12 + k), ("related-posts", 25), ("reader_comments", 33 + k), ("newsletterSignup", 9))}
        if text:
            pages.append(f"<body>{boxes['promo-box']}<div class='entry-content'><h2>{title}</h2>{text}</div>{boxes['related-posts']}{boxes['reader_comments']}{boxes['newsletterSignup']}</body>")
            pages.append(f"<body><div class='top-menu'>{menu}</div><div class='post-content'><h1>{title}</h1>{text}</div><div class='sidebar'><p>{_filler(30)}</p></div><div id='cookie-notice'>{_filler(15)}</div>{foot}</body>")
    rng = random.Random(seed)

    def some(low: int, high: int) -> str:
        return _filler(rng.randint(low, high), rng.randint(0, 9))

    def linked(text: str, share: float) -> str:
        """``text`` with its last part as a link."""
        words = text.split(" ")
        cut = len(words) - round(share * len(words))
        return " ".join(words[:cut]) + (" <a href='/l'>" + " ".join(words[cut:]) + "</a>" if cut < len(words) else "")

    div = lambda text: f"<div>{text}</div>"
    entry = lambda low, high: div(f"<a href='/m'>{some(low, high)[:-1]}</a>")
    short = lambda: div(some(1, 5))
    for _ in range(30):  # with an article, of every size; its texts may hold links
        title, ps = some(1, 9)[:-1] + MARK, [some(1, 70) + MARK for _ in range(rng.randint(2, 6))]
        body = "".join(div(linked(p, rng.choice((0, 0, 0.1, 0.3, 1)))) for p in ps)
        box = f"<div class='sidebar'>{short()}{''.join(div(plain(p)) for p in ps)}</div>" if rng.random() < 0.5 else ""
        menus = ["".join(entry(1, 3) for _ in range(rng.randint(2, 8))) for _ in range(3)]
        loose = div(some(9, 40))
        pages.append(f"<body>{menus[0]}{short()}{loose}<article><h1>{title}</h1>{body}</article>{loose}{menus[1]}{short()}{box}{menus[2]}</body>")
    for _ in range(120):  # nothing tells but lengths and links: menus of short links, teasers of long ones, bylines, the small print
        title, ps = some(2, 9)[:-1] + MARK, [some(9, 70) + MARK for _ in range(rng.randint(2, 7))]
        body = "".join(div(linked(p, rng.choice((0, 0, 0, 0.1, 0.3)))) for p in ps)
        menu, more = ("".join(entry(1, 3) for _ in range(rng.randint(2, 8))) for _ in range(2))
        teasers = ["".join(entry(4, 24) for _ in range(rng.randint(1, 6))) for _ in range(3)]
        half = ["".join(div(linked(some(6, 30), rng.choice((0.6, 0.8, 0.9)))) for _ in range(rng.randint(0, 3))) for _ in range(2)]
        head = rng.choice((f"<h1>{title}</h1>", ""))
        print_ = rng.choice(("", short(), div("&copy; 2020 Example Media")))
        order = [rng.choice((menu, "")), rng.choice((teasers[0], "")), half[0]]
        rng.shuffle(order)
        tail = [more, teasers[1], half[1], print_]
        rng.shuffle(tail)
        inner = body.replace("</div>", "</div>" + rng.choice(("", "", entry(4, 20))), 1)
        pages.append(f"<body>{''.join(order)}{head}{inner}{''.join(tail)}{teasers[2]}</body>")
    return pages


def labelled_blocks(pages: list[str] | None = None) -> list[tuple]:
    """The labelled table: FEATURES and ``label`` of every block of the labelled pages (some 4,000 rows). Labels come from MARK alone, features from
    the pages without it."""
    rows = []
    for page in labelled_pages() if pages is None else pages:
        marked, clean = flat_blocks(page), flat_blocks(page.replace(MARK, ""))
        rows += [(*(b[f] for f in FEATURES), float(MARK in m["text"])) for m, b in zip(marked, clean, strict=True)]
    return rows


def train(spark: SparkSession) -> DecisionTreeClassificationModel:
    table = spark.createDataFrame(labelled_blocks(), ", ".join(f"{f} double" for f in FEATURES) + ", label double").coalesce(1)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=MAX_DEPTH, minInstancesPerNode=2, seed=1).fit(data)


def tree_expression(model: DecisionTreeClassificationModel, block: Column) -> Column:
    """True for a block that the tree calls text."""

    def walk(node: object) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() > 0.5)
        split = node.split()
        left = block[FEATURES[split.featureIndex()]] <= split.threshold()
        return F.when(left, walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(model._java_obj.rootNode())


def blocks(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with their ``blocks``, or underscores in front if that name is taken."""
    kept, name = [c for c in pages.columns if c != "html"], free_name(pages, "blocks")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[kept].assign(**{name: [flat_blocks(h) for h in pdf["html"]]})

    kinds = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + [f"{name} array<{BLOCK}>"])
    return pages.mapInPandas(cut_up, kinds)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text`` and ``n_chars``; underscores in front of names that are taken."""
    model = train(pages.sparkSession)
    chosen = F.filter(free_name(pages, "blocks"), lambda b: tree_expression(model, b))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    kept, name = [F.col(f"`{c}`") for c in pages.columns if c != "html"], free_name(pages, "text")
    return blocks(pages).select(*kept, text.alias(name)).withColumn(free_name(pages, "n_chars"), F.length(name).cast("long"))


