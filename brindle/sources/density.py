"""The article of a page by the density of its text.

Every block of text gets a weight by its words and short words, which running text is full of, less the share of its letters that are links. A
block passes its weight to its parent, and half of it to the parent above. The container of the most weight holds the article; its
neighbours join it if their own weight is a fair share of its, or if they are paragraphs of running text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.sources.feeds import by_page

#: Elements whose text can be a block of an article, those that never hold one, and those without an end.
BLOCKS = frozenset("p pre td blockquote li h2 h3 h4".split())
DROPPED = frozenset("script style noscript nav footer aside header form button select iframe svg template".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words of a block at least, the letters of a short word, the share of a neighbour's weight, and the words of a paragraph that joins by itself.
LEAST_WORDS, SHORT, SHARE, RUNNING = 5, 3, 0.2, 20
LEAST_CHARS = 50
#: Names under which pages tell their data, the first that is there counts.
TITLES, AUTHORS, SUMMARIES, TIMES = ("og:title", "twitter:title"), ("author", "article:author"), ("description", "og:description"), ("article:published_time", "date")


@dataclass
class Element:
    """An element of a page; text is what stands directly in it, with the places of its children as their numbers."""

    tag: str
    parent: int
    linked: bool
    parts: list[str | int] = field(default_factory=list)


class Page(HTMLParser):
    """The elements of a page in the order of their begin tags; open paragraphs end where another block begins."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.elements = [Element("", -1, False)]
        self.open, self.dropped = [0], 0
        self.data: dict[str, str] = {}
        self.title: list[str] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            a = dict(attrs)
            name = (a.get("property") or a.get("name") or "").lower()
            if name and a.get("content"):
                self.data.setdefault(name, a["content"].strip())
        if tag in EMPTY:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag in BLOCKS and self.elements[self.open[-1]].tag == "p":
            self.open.pop()
        above = self.open[-1]
        self.elements.append(Element(tag, above, tag == "a" or self.elements[above].linked))
        self.elements[above].parts.append(len(self.elements) - 1)
        self.open.append(len(self.elements) - 1)
        self.dropped += tag in DROPPED

    def handle_endtag(self, tag: str) -> None:
        if tag in EMPTY or tag not in (self.elements[i].tag for i in self.open):
            return
        while True:
            gone = self.elements[self.open.pop()].tag
            self.dropped -= gone in DROPPED
            if gone == tag:
                return

    def handle_data(self, data: str) -> None:
        here = self.elements[self.open[-1]]
        if here.tag == "title":
            self.title.append(data)
        elif not self.dropped:
            here.parts.append(data)

    def told(self, names: tuple[str, ...]) -> str | None:
        return next((self.data[n] for n in names if self.data.get(n)), None)


def _texts(page: Page) -> list[tuple[str, int, int]]:
    """(text, letters, linked letters) of each element with all within it but for blocks, whose texts are their own."""
    out: list[tuple[str, int, int]] = [("", 0, 0)] * len(page.elements)
    for i in range(len(page.elements) - 1, -1, -1):
        e, text, letters, linked = page.elements[i], [], 0, 0
        for p in e.parts:
            if isinstance(p, str):
                n = sum(map(len, p.split()))
                text.append(p)
                letters, linked = letters + n, linked + n * e.linked
            elif page.elements[p].tag not in BLOCKS:
                t, n, m = out[p]
                text.append(t)
                letters, linked = letters + n, linked + m
        out[i] = ("".join(text), letters, linked)
    return out


def block_weight(text: str, letters: int, linked: int) -> float:
    """Words and short words of a block, less its share of links; 0 for a few words, or where most is links."""
    words = text.split()
    if len(words) < LEAST_WORDS or 2 * linked > letters:
        return 0.0
    short = sum(len(w.strip(".,;:!?()\"'")) <= SHORT for w in words)
    return (len(words) / 10 + short) * (1 - linked / letters)


def extracted(html: str | None) -> dict | None:
    """title (500 characters at most), content, author, published, summary (1000) and word_count; None if less than LEAST_CHARS are found."""
    page = Page(html or "")
    texts = _texts(page)
    weight = [0.0] * len(texts)
    own = [block_weight(*texts[i]) if e.tag in BLOCKS else 0.0 for i, e in enumerate(page.elements)]
    for i, w in enumerate(own):
        above = page.elements[i].parent
        if w and above >= 0:
            weight[above] += w
            if page.elements[above].parent >= 0:
                weight[page.elements[above].parent] += w / 2
    best = max(range(len(weight)), key=lambda i: (weight[i], -i))
    if not weight[best]:
        return None
    chosen = {best}
    for p in page.elements[page.elements[best].parent].parts if best else ():
        if isinstance(p, int) and p != best:
            text, letters, linked = texts[p]
            running = page.elements[p].tag == "p" and len(text.split()) >= RUNNING and 4 * linked < letters
            if running or weight[p] >= SHARE * weight[best]:
                chosen.add(p)
    inside, lines = [False] * len(texts), []
    for i, e in enumerate(page.elements):  # parents come first
        inside[i] = i in chosen or (e.parent >= 0 and inside[e.parent])
        text, letters, linked = texts[i]
        if inside[i] and e.tag in BLOCKS and letters and 2 * linked <= letters:
            lines.append(" ".join(text.split()))
    content = "\n\n".join(lines)
    if len(content.strip()) < LEAST_CHARS:
        return None
    heading = next((" ".join(texts[i][0].split()) for i, e in enumerate(page.elements) if e.tag == "h1" and texts[i][1]), "")
    title = page.told(TITLES) or " ".join("".join(page.title).split()) or heading
    summary = page.told(SUMMARIES)
    return {"title": title[:500], "content": content, "author": page.told(AUTHORS), "published": page.told(TIMES), "summary": summary and summary[:1000], "word_count": len(content.split())}


def density_extract(pages: DataFrame) -> DataFrame:
    """(page_id, title, content, author, summary, word_count, published) of pages (page_id, html); a page without an article has nulls. published is as the page writes it."""
    return by_page(pages, extracted, {"title": pa.string(), "content": pa.string(), "author": pa.string(), "summary": pa.string(), "word_count": pa.int64(), "published": pa.string()})
