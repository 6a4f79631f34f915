"""Captured feeds, sitemaps and pages to entries and articles. Fetching itself is plugged in; nothing here opens a connection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from ipaddress import ip_address
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fetcher = Callable[[DataFrame], DataFrame]  # rows with url -> rows with url, body


def address_allowed(address: str) -> bool:
    ip = ip_address(address)
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)


def url_allowed(url: str, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """http(s), a host, no credentials; an address in it, and those that ``resolve`` gives, must be public."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or parts.username or parts.password or host == "localhost":
        return False
    try:
        return address_allowed(host)
    except ValueError:
        addresses = resolve(host) if resolve else []
        return all(map(address_allowed, addresses)) and (bool(addresses) or resolve is None)


class Refused(ValueError):
    """An address that must not be read, or an answer that is no page."""


#: (url, address) -> status, headers in lower case, the body in pieces; it must connect to that address and follow no redirect.
Get = Callable[[str, str], tuple[int, dict[str, str], Iterator[bytes]]]


def guarded_fetch(url: str, get: Get, resolve: Callable[[str], list[str]], most_redirects: int = 5, most_bytes: int = 5 << 20) -> tuple[int, dict[str, str], bytes]:
    """Reads a url through ``get``, which is told the address to connect to, so that a name can't change between check and use.

    Every redirect is checked like the first url. More redirects or bytes than allowed are refused.
    """
    for _ in range(most_redirects + 1):
        if not url_allowed(url, resolve):
            raise Refused(f"not allowed: {url}")
        host = urlsplit(url).hostname or ""
        try:
            address = str(ip_address(host))
        except ValueError:
            address = resolve(host)[0]
        if not address_allowed(address):
            raise Refused(f"not allowed: {address}")
        status, headers, pieces = get(url, address)
        if status in (301, 302, 303, 307, 308) and headers.get("location"):
            url = urljoin(url, headers["location"])
            continue
        body = b""
        for piece in pieces:
            body += piece
            if len(body) > most_bytes:
                raise Refused(f"more than {most_bytes} bytes: {url}")
        return status, headers, body
    raise Refused(f"more than {most_redirects} redirects: {url}")


def decoded_body(status: int, headers: dict[str, str], body: bytes) -> str | None:
    """The text of an answer by the charset that its header, then its first kilobyte names, else UTF-8; wrong bytes are replaced. None for a status of 400 or more."""
    if status >= 400:
        return None
    found = re.search(r"charset=[\"']?([\w-]+)", headers.get("content-type", ""), re.I) or re.search(r"(?:charset|encoding)=[\"']?([\w-]+)", body[:1024].decode("latin-1"), re.I)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def url_shape_allowed(url: Column) -> Column:
    """The part of the same check that needs no look-up, within the JVM."""
    host = F.try_parse_url(url, F.lit("HOST"))
    private = host.rlike(r"^(localhost$|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.|22[4-9]\.|23[0-9]\.|\[)")
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & ~private, F.lit(False))


def absolute(base: Column, link: Column) -> Column:
    """Links from the root are put behind the source's url as it stands, without its closing slashes."""
    return F.when(F.startswith(link, F.lit("/")), F.concat(F.regexp_replace(base, "/+$", ""), link)).otherwise(link)


#: Zones that feeds name by letters, in hours from UTC.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def feed_time(text: Column) -> Column:
    """The UTC time of a date as RSS (RFC 822) or Atom (RFC 3339) write it, as a timestamp without zone; null if it is none."""
    day = F.regexp_extract(text, r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4}|\d{2})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*([A-Z]{1,3}|[+-]\d{4})?", 0)
    part = lambda i: F.regexp_extract(text, r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4}|\d{2})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*([A-Z]{1,3}|[+-]\d{4})?", i)
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3) < "69", F.concat(F.lit("20"), part(3))).otherwise(F.concat(F.lit("19"), part(3)))
    clock = F.when(F.length(part(4)) > 5, part(4)).otherwise(F.concat(part(4), F.lit(":00")))
    local = F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), year, clock), F.lit("d MMM yyyy H:mm:ss")).cast("timestamp_ntz")
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    sign = F.when(F.startswith(part(5), F.lit("-")), -1).otherwise(1)
    ahead = F.when(part(5).rlike("^[+-]"), sign * (F.substring(part(5), 2, 2).cast("int") * 60 + F.substring(part(5), 4, 2).cast("int"))).otherwise(F.coalesce(named[part(5)], F.lit(0)) * 60)
    iso = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?", 0)), F.expr("current_timezone()")).cast("timestamp_ntz")
    return F.when(day != "", F.timestamp_add("MINUTE", -ahead, local)).otherwise(iso)


#: Entities that XML itself names, in the order in which they are undone.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """With the entities of XML, and numeric ones, written as their characters."""
    pieces = F.regexp_extract_all(text, F.lit(r"(&#x?[0-9A-Fa-f]{1,6};|[^&]+|&)"), F.lit(1))
    number = lambda p: F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(p, "^&#([0-9]+);", 1)).try_cast("int")
    spelt = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    plain = F.when(text.rlike("&#"), F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^&#[xX]?[0-9A-Fa-f]+;$") & number(p).between(1, 0x10FFFF), spelt(number(p))).otherwise(p)), "")).otherwise(text)
    for name, char in ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return plain


def rss_entries(feeds: DataFrame) -> DataFrame:
    """(source_id, url, title, published, author, summary) of RSS items and Atom entries in ``body``; ``source_url`` completes links.

    ``published`` is the time of publication, else of the last update, in UTC; a summary is cut to 1000 characters. Entries without a link are left out.
    """
    items = F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    rows = feeds.select("source_id", "source_url", F.explode(items).alias("x"))

    def tag(*names: str) -> Column:
        found = []
        for n in names:
            raw = F.regexp_extract("x", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1)
            inner = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
            found.append(F.nullif(F.trim(F.when(inner != "", inner).otherwise(unescaped(raw))), F.lit("")))
        return F.coalesce(*found)

    link = F.coalesce(tag("link"), F.nullif(unescaped(F.regexp_extract("x", r'<link\b[^>]*href="([^"]+)"', 1)), F.lit("")))
    author = F.coalesce(tag("dc:creator"), F.nullif(F.trim(unescaped(F.regexp_extract("x", r"(?s)<author\b[^>]*>\s*<name\b[^>]*>(.*?)</name>", 1))), F.lit("")), tag("author"))
    published = F.coalesce(feed_time(tag("pubDate", "published", "dc:date")), feed_time(tag("updated")))
    return rows.select(
        "source_id", absolute(F.col("source_url"), link).alias("url"), F.coalesce(tag("title"), F.lit("")).alias("title"), published.alias("published"), author.alias("author"),
        F.substring(tag("description", "summary"), 1, 1000).alias("summary"),
    ).where("url is not null")


def sitemap_urls(maps: DataFrame, most: int = 50) -> DataFrame:
    """(source_id, url): the first places of each sitemap that look like articles."""
    found = F.filter(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda u: u.rlike("/(article|news|story|post)"))
    return maps.select("source_id", F.explode(F.slice(found, 1, most)).alias("url"))


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((self.href, " ".join("".join(self.text).split())[:200]))
            self.href = None


UNWANTED = ("/tag/", "/author/", "/page/", ".jpg", ".png", "#")


def page_links(html: str, base: str, most: int | None = 30) -> list[tuple[str, str]]:
    """(url, title) of a page's links: each once in order, long enough paths, no tags, authors, pages or images."""
    parser = _Links()
    parser.feed(html or "")
    out: dict[str, str] = {}
    for href, title in parser.found:
        url = urljoin(base, href) if href and href.startswith("/") else href or ""
        if url.startswith("http") and len(urlsplit(url).path) >= 10 and not any(x in url for x in UNWANTED):
            out.setdefault(url, title)
    return list(out.items())[:most]


def homepage_links(pages: DataFrame, most: int | None = 30) -> DataFrame:
    """(page_id, url, title, place) for captured pages (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, u, t, i) for p, base, html in zip(pdf.page_id, pdf.url, pdf.html, strict=True) for i, (u, t) in enumerate(page_links(html, base or "", most))]
            yield pd.DataFrame(rows, columns=["page_id", "url", "title", "place"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, place long")


BLOCKS = ("p", "h2", "h3", "li")
SKIPPED = ("script", "style")


class _Article(HTMLParser):
    """Collects blocks of text by the containers they stand in."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[tuple[str, int]] = []
        self.serial = 0
        self.title, self.author, self.description = "", None, None
        self.blocks: list[tuple[str, str, set[str], int]] = []  # tag, text, containers, parent
        self.open: list[tuple[str, list[str], int]] = []
        self.in_title = False
        self.byline: list[str] | None = None
        self.byline_at = 0  # the element whose text is the byline, while it is open

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.byline is None and "author" in (a.get("class") or "").lower():
            self.byline, self.byline_at = [], self.serial + 1
        if tag == "meta":
            if (a.get("name") or "").lower() == "author":
                self.author = self.author or a.get("content")
            if (a.get("name") or "").lower() == "description":
                self.description = self.description or a.get("content")
            return
        if tag in ("br", "img", "link", "input", "hr", "source", "wbr"):
            return
        self.in_title = self.in_title or tag == "title"
        if tag in BLOCKS:
            self.open.append((tag, [], self.stack[-1][1] if self.stack else 0))
        self.serial += 1
        self.stack.append((tag, self.serial))

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            t, serial = self.stack.pop()
            if serial == self.byline_at:
                self.byline_at = 0
            if t in BLOCKS and self.open:
                name, text, parent = self.open.pop()
                self.blocks.append((name, " ".join("".join(text).split()), {x for x, _ in self.stack}, parent))
            if t == tag:
                break

    def handle_data(self, data):
        if self.byline_at:
            self.byline.append(data)
        if self.in_title:
            self.title += data
        elif self.open and not any(t in SKIPPED for t, _ in self.stack):
            self.open[-1][1].append(data)


def extracted(html: str | None) -> dict | None:
    """title (500 characters at most), content, author, summary, word_count; None if less than 50 characters are found.

    The author is that of the page's data, else the text of the first element with a class of authors.

    The content is the blocks of article, else of main, else those below the parent with
    the most paragraph text.
    """
    parser = _Article()
    parser.feed(html or "")
    parser.close()
    for container in ("article", "main"):
        chosen = [t for n, t, inside, _ in parser.blocks if container in inside and t]
        if chosen:
            break
    else:
        weight: dict[int, int] = {}
        for n, t, _, parent in parser.blocks:
            if n == "p":
                weight[parent] = weight.get(parent, 0) + len(t)
        best = max(weight, key=lambda k: (weight[k], -k), default=None)
        chosen = [t for _, t, _, parent in parser.blocks if parent == best and t]
    content = "\n\n".join(chosen)
    if len(content) < 50:
        return None
    byline = "".join(x.strip() for x in parser.byline or [])[:200]
    return {"title": " ".join(parser.title.split())[:500], "content": content, "author": parser.author or byline or None, "summary": parser.description and parser.description[:1000], "word_count": len(content.split())}


#: Pages whose elements and texts exist in Python at a time.
PAGES = 50


def by_page(pages: DataFrame, extract: Callable[[str | None], dict | None], kinds: dict[str, pa.DataType]) -> DataFrame:
    """(page_id, fields...) of what extract() tells of each page's html; nulls where it tells nothing.

    Arrow hands over batches by their bytes; PAGES of them are made Python objects at a time, so that memory doesn't grow with the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                some = batch.slice(start, PAGES)
                rows = [extract(h) or {} for h in some.column(1).to_pylist()]
                told = [pa.array([r.get(f) for r in rows], kind) for f, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), *told], ["page_id", *kinds])

    sql = {pa.string(): "string", pa.int64(): "long"}
    return pages.select("page_id", "html").mapInArrow(run, ", ".join(["page_id long", *(f"{f} {sql[kind]}" for f, kind in kinds.items())]))


def html_extract(pages: DataFrame) -> DataFrame:
    """(page_id, title, content, author, summary, word_count); a page without an article has nulls."""
    return by_page(pages, extracted, {"title": pa.string(), "content": pa.string(), "author": pa.string(), "summary": pa.string(), "word_count": pa.int64()})


def extraction_cascade(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary extraction where it has content, else the fallback, else an error text."""
    fields = ["title", "content", "author", "summary", "word_count"]
    p = primary.select("page_id", F.when(F.length("content") >= 50, F.struct(*fields)).alias("p"))
    f = fallback.select("page_id", F.when(F.col("content").isNotNull(), F.struct(*fields)).alias("f"))
    rows = p.join(f, "page_id", "full").withColumn("r", F.coalesce("p", "f"))
    return rows.select("page_id", "r.*", F.when(F.col("r").isNull(), "no content extracted").alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that tell where the file is from."""
    rows = spark.read.schema(schema + ", _provenance string").json(path)
    return rows.where("_provenance is null").drop("_provenance")


def write_jsonl(df: DataFrame, path: str, provenance: str) -> None:
    """JSON lines, each file beginning with a line that tells where it is from."""
    header = df.sparkSession.createDataFrame([(provenance,)], "_provenance string").select(F.to_json(F.struct("_provenance")).alias("value"))
    rows = df.select(F.to_json(F.struct("*")).alias("value"))
    head = F.concat_ws("\n", *[F.lit(r["value"]) for r in header.collect()])  # one line
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0
    rows.select(F.when(first, F.concat(head, F.lit("\n"), F.col("value"))).otherwise(F.col("value")).alias("value")).write.text(path)


def primary_extract(pages: DataFrame) -> DataFrame:
    """The first extractor of the cascade: (page_id, title, content, author, summary, word_count) of pages that tell their article as linked data.

    The first ``application/ld+json`` block with an articleBody counts; pages without one have nulls, and are the fallback's.
    """
    blocks = F.regexp_extract_all("html", F.lit(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    kind = "headline string, articleBody string, description string, author struct<name:string>"
    told = F.transform(blocks, lambda b: F.from_json(b, kind))
    rows = pages.select("page_id", F.try_element_at(F.filter(told, lambda d: F.length(d["articleBody"]) >= 50), F.lit(1)).alias("d"))
    words = F.size(F.filter(F.split(F.col("d.articleBody"), r"(?U)\s+"), lambda w: w != "")).cast("long")
    return rows.select("page_id", F.col("d.headline").alias("title"), F.col("d.articleBody").alias("content"), F.col("d.author.name").alias("author"), F.col("d.description").alias("summary"), F.when(F.col("d").isNotNull(), words).alias("word_count"))


def read_labelled_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, comment="#")
