"""Extraction by density against a plain scorer over invented pages."""

import random
from html.parser import HTMLParser

import pytest

from brindle.plans.registry import QUERIES
from brindle.sources import density

PAGE = """<html><head><title>Site - One</title><meta property="og:title" content="One"><meta name="author" content="Ana B"><meta name="description" content="Short."><meta property="article:published_time" content="2024-01-02T03:04:05Z"></head>
<body><nav><ul><li>Home of all the news in the city</li></ul></nav><div id=menu><ul><li><a href=/a>One of the many links in a long menu</a></li><li><a href=/b>And one more of the links in it</a></li></ul></div>
<div id=main><h1>One</h1><p>It was the end of the year and all of us were in the town.</p><p>We saw it <a href=/x>there</a> and it was as old as the sea is.<p>An open paragraph, which ends where the next block is.</p><h2>More of it to see</h2><p>So be it, and let us go on to the end of it all.</p></div>
<div id=foot><p>Rights of the owner are with the owner.</p></div><script>var p = "it is as it is and so it is";</script></body></html>"""


def test_article_of_a_page():
    x = density.extracted(PAGE)
    assert (x["title"], x["author"], x["summary"], x["published"]) == ("One", "Ana B", "Short.", "2024-01-02T03:04:05Z")
    assert x["content"].split("\n\n") == ["It was the end of the year and all of us were in the town.", "We saw it there and it was as old as the sea is.", "An open paragraph, which ends where the next block is.", "More of it to see", "So be it, and let us go on to the end of it all."]
    assert x["word_count"] == len(x["content"].split())


@pytest.mark.parametrize("html", [None, "", "<p>short</p>", "text alone, with no element at all around it, long as it may be", "<div><a href=/x>" + "all of it is a link " * 20 + "</a></div>", "<p", "</p></div>", "<script>" + "it is so " * 50])
def test_pages_without_an_article(html):
    assert density.extracted(html) is None


class Plain(HTMLParser):
    """The same rule by walking up from every piece of text: which container has the most weight."""

    def __init__(self):
        super().__init__()
        self.path, self.serial, self.blocks = [], 0, {}

    def handle_starttag(self, tag, attrs):
        self.serial += 1
        self.path.append((tag, self.serial))

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        block = next((k for k in range(len(self.path) - 1, -1, -1) if self.path[k][0] in density.BLOCKS), None)
        if block is not None and not any(t in density.DROPPED for t, _ in self.path):
            at = self.blocks.setdefault(self.path[block][1], [[], 0, 0, [s for _, s in self.path[:block]]])
            n = len("".join(data.split()))
            at[0].append(data)
            at[1] += n
            at[2] += n * any(t == "a" for t, _ in self.path)

    def best(self):
        weight = {}
        for text, letters, linked, above in self.blocks.values():
            words = "".join(text).split()
            if len(words) >= 5 and 2 * linked <= letters:
                w = (len(words) / 10 + sum(len(x.strip(".,;:!?()\"'")) <= 3 for x in words)) * (1 - linked / letters)
                for share, s in zip((1, 0.5), reversed([0, *above])):
                    weight[s] = weight.get(s, 0) + w * share
        return max(weight.items(), key=lambda x: (round(x[1], 9), -x[0]), default=(None, 0))


def invented(r, depth=0):
    if depth > 3 or r.random() < 0.3:
        words = " ".join(r.choices(["it", "of", "the", "a", "window", "winter", "sea,", "to", "stone."], k=r.randint(1, 25)))
        return f"<a>{words}</a>" if r.random() < 0.2 else words
    tag = r.choice(["div", "div", "p", "section", "nav", "b"]) if depth else "body"
    inner = "".join(invented(r, 9 if tag in ("p", "b") else depth + 1) for _ in range(r.randint(1, 4)))
    return f"<{tag}>{inner}</{tag}>"


def test_best_container_is_the_plain_one():
    met = 0
    for seed in range(200):
        html = invented(random.Random(seed))
        plain = Plain()
        plain.feed(html)
        best, weight = plain.best()
        x = density.extracted(html)
        if not weight:
            assert x is None
            continue
        inside = [" ".join("".join(t).split()) for t, letters, linked, above in plain.blocks.values() if best in [0, *above] and letters and 2 * linked <= letters]
        if len("\n\n".join(inside)) >= density.LEAST_CHARS:
            lines = x["content"].split("\n\n")
            assert [t for t in lines if t in inside] and all(t in lines for t in inside)
            met += 1
    assert met > 50


def test_cascade_takes_density_first(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", "<article><p>" + "linkword " * 20 + "</p></article>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in density.density_extract(pages).collect()}
    assert got[1].title == "One" and got[2].content is None and got[3].content == ("linkword " * 20).strip()
    rows = QUERIES["html_extraction_cascade"](spark, "/root/testdata/sf0.001").collect()
    assert rows and sum(r.content is not None for r in rows) > len(rows) / 2
