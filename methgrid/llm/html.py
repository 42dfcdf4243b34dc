"""Main-text extraction from web pages by two passes of block rules.

Pass one cuts a page into blocks and decides each by its container, its link
density, its length and its share of stop words; headings, short blocks and,
inside an article, long blocks of few stop words stay undecided. Pass two lets
every undecided block take the label of the nearest decided block beside it,
the following one's for headings. Inside an article the neighbours are those
inside, outside those outside; with none decided there, an article's blocks
are main text and others are not.

Cases: null and empty pages, and pages with no main text, give an empty text;
unclosed and stray tags, unfinished comments and references are read as
browsers do; equal pages get equal texts; columns whose names clash with the
results are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A few very frequent words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in is it that for on with as are was be by this at from or an not have which a "
    "de la le les et des un une en que qui dans pour par sur au est pas plus ne se ce il elle du "
    "der die das und ist nicht ein eine zu den von mit auf für im dem sich auch als an es "
    "el los las una del y con su al lo más o pero".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*>", re.S)
UNFINISHED = re.compile(r"<[/!?a-zA-Z][^>]*\Z")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text, and those that don't outside an article.
ASIDE = frozenset("nav footer aside form menu dialog button head".split())
FRAME = frozenset(["header"])
#: Parts of class names, ids and roles that mark boilerplate.
ASIDE_NAME = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments share sharing social related newsletter subscribe popup modal pagination disqus masthead "
    "contentinfo complementary search alert".split()
)
LONG, LINKED, STOPPED = 70, 0.5, 0.1


def blocks(page: str) -> list[tuple[str, str, bool, bool, int]]:
    """The text blocks of a page in order: text, tag, in boilerplate, in an article, characters inside links."""
    out: list[tuple[str, str, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, boilerplate, article
    text: list[str] = []
    linked, in_link, tag_now, at = 0, 0, "", 0

    def end() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, aside, article = stack[-1] if stack else ("", False, False)
                out.append((joined, tag_now, aside, article, linked))
            text.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if in_link:
                linked += len(raw.strip())

    search = TAG.search
    while m := search(page, at):
        take(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCK:
                end()
                tag_now = ""
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if depth is not None:
                    del stack[depth:]
            elif name == "button" and stack and stack[-1][0] == name:
                end()
                stack.pop()
            continue
        if name in RAW:
            m = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = m.end() if m else len(page)
            continue
        if name == "a":
            in_link = 1  # links don't nest
        elif name == "br":
            text.append(" ")
        elif name in BLOCK or name == "button":
            end()
            in_link = 0
            tag_now = name
            if name in VOID:
                continue
            while stack and stack[-1][0] in ("p", *HEADING) and (name == "p" or name in HEADING or name in ("div", "ul", "ol", "section", "article", "footer", "nav", "aside", "header", "table", "form", "blockquote", "pre", "main")):
                stack.pop()  # a paragraph ends where another block begins
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            _, aside, article = stack[-1] if stack else ("", False, False)
            names = {x for a in ATTRIBUTE.finditer(m[3]) for x in re.split("[^a-z]+", (a[2] or a[3] or a[4] or "").lower())} if m[3] else ()
            article = article or name == "article" or name == "main"
            aside = aside or name in ASIDE or name in FRAME and not article or name not in ("body", "html", "main") and not ASIDE_NAME.isdisjoint(names)
            stack.append((name, aside, article))
    take(UNFINISHED.sub("", page[at:]))
    end()
    return out


def main_blocks(page: str) -> list[str]:
    """The blocks of a page's main text."""
    found = blocks(page)
    labels: list[bool | None] = []
    for text, tag, aside, article, linked in found:
        if aside or linked > LINKED * len(text):
            labels.append(False)
        elif tag in HEADING or len(text) < LONG:
            labels.append(None)
        else:
            words = [w.strip(".,;:!?*#$%&'\"()") for w in text.lower().split()]
            stopped = sum(w in STOP_WORDS for w in words) >= STOPPED * len(words) or len(words) > 40
            labels.append(True if stopped else None if article else False)
    # boilerplate containers say nothing about their neighbours, nor the inside of an article about the outside
    decided = {scope: [k for k, x in enumerate(labels) if x is not None and not found[k][2] and found[k][3] == scope] for scope in (True, False)}
    kept = []
    for k, (text, tag, _, article, _) in enumerate(found):
        label = labels[k]
        if label is None:
            place = bisect_left(decided[article], k)
            before = decided[article][place - 1] if place else None
            after = decided[article][place] if place < len(decided[article]) else None
            if before is None or after is None:
                near = after if before is None else before
            elif tag in HEADING:
                near = after
            else:
                near = before if k - before <= after - k else after
            label = article if near is None else labels[near]
        if label:
            kept.append(text)
    return kept


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, plus ``text``: the main text, its blocks joined by line feeds."""
    rest = [c for c in pages.columns if c not in (html, "text")]
    slim = pages.select(*[pages[c] for c in rest], pages[html].alias("__html"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                texts = ["\n".join(main_blocks(x.as_py() or "")) for x in part.column("__html")]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [pa.array(texts, pa.string())], [*rest, "text"])

    return slim.mapInArrow(run, schema)
