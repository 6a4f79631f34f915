"""A network for tests: captured feeds by url."""

import json

HOSTS = {"a.org": ["93.184.216.34"], "b.org": ["93.184.216.35"], "inside.org": ["10.0.0.1"]}


def resolve(host):
    return HOSTS.get(host, [])


def entry(n):
    return f"<item><title>T{n}</title><link>/news/{n}</link></item>"


def get(url, address):
    if url == "https://a.org/moved":
        return 302, {"location": "https://inside.org/secret"}, iter(())
    if url == "https://b.org/gone":
        return 404, {}, iter([b"none"])
    n = int(url.rpartition("/")[2]) if url.rpartition("/")[2].isdigit() else 1
    return 200, {"content-type": "text/xml; charset=utf-8"}, iter([f"<rss>{entry(n)}{entry(n - 1)}</rss>".encode()])


def latest(source):
    with open(source["counts"]) as f:
        return json.load(f)[str(source["id"])]
