"""The operators against brute force, round trips, held-out accuracy and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import mixing, pieces, pivots, pseudo_likelihood, quality_ranking, quality_rules, secrets, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, ties, repeated rows, and a very long text.
ODD = [
    (1, "a b c d", "en", "s", 7), (2, None, None, None, None), (None, "null id", "en", "s", 7), (3, "", "en", "s", 0), (4, " \n\t ", "en", None, 4),
    (1, "a b c d", "en", "s", 7), (5, "word " * 40000, "en", "s", 200000), (6, "x" * 30000, "en", "t", 30000), (7, "Ünï 中文 🙂 ▁ \x00 \r\n", "de", "t", 15), (8, None, "en", "s", None),
]
CLASHES = ["failed", "spans", "fp", "component_id", "replica", "rate", "score", "n_words", "key", "c", "raw", "a", "b", "row", "position"]


def odd(spark):
    df = spark.createDataFrame(ODD, DOC)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("own"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- rule ledger ----


def brute_repeats(words, width=3):
    grams = collections.Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return len({i + o for i in range(len(words) - width + 1) if grams[tuple(words[i : i + width])] > 1 for o in range(width)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeated_words(words):
    assert quality_rules.repeated_words(words) == brute_repeats(words)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab #$|!é中\n \t\x0b\x1c\x85A"), max_size=60))
def test_measured(text):
    m = quality_rules.measured(text.encode())
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert m[:6] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), brute_repeats(words))


def test_ledger_and_ablations(spark):
    book = quality_rules.ledger(odd(spark))
    assert book.count() == len(ODD) and quality_rules.ledger(empty(spark)).count() == 0
    rows = {(r.doc_id, r.n_words): r.failed for r in book.collect()}
    assert rows[(2, 0)] == 1 and rows[(5, 40000)] == 2
    found = {r.rule: r for r in quality_rules.ablations(book, [quality_rules.DEFAULT, quality_rules.BASE]).where("policy = 'web'").collect()}
    failed = [r.failed for r in book.collect()]
    for rule in quality_rules.RULES:
        bit = 1 << rule.bit
        r = found[rule.name]
        assert (r.failing, r.failing_alone, r.kept, r.kept_without) == (sum(f & bit > 0 for f in failed), sum(f == bit for f in failed), sum(f == 0 for f in failed), sum(f & ~bit == 0 for f in failed))


# ---- pseudo-likelihood ----


def test_scores_token_by_token():
    n = pseudo_likelihood.Network.fresh(vocabulary=11, window=2, embedded=3, hidden=4)
    docs = [np.array([1, 2, 3, 10]), np.array([], np.int64), np.array([5])]
    got = n.log_probabilities(docs)
    for d, p in zip(docs, got, strict=True):
        assert len(p) == len(d)
        for i in range(len(d)):
            x = np.concatenate([n.embedding[d[i + o] if 0 <= i + o < len(d) else 11] for o in (-2, -1, 1, 2)])
            z = np.tanh(x @ n.inner + n.inner_bias) @ n.outer + n.outer_bias
            assert p[i] == pytest.approx(z[d[i]] - np.log(np.exp(z).sum()), abs=1e-5)


def test_gradients():
    n = pseudo_likelihood.Network(*[w.astype(float) for w in pseudo_likelihood.Network.fresh(9, 1, 3, 4).weights])
    t, c = n.contexts([np.array([1, 2, 3, 4, 2, 1])])
    loss = lambda: -n.forward(c)[2][np.arange(len(t)), t].mean()
    rng = np.random.default_rng(0)
    for w, g in zip(n.weights, n.gradients(t, c), strict=True):
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in w.shape)
            w[i] += 1e-6
            up = loss()
            w[i] -= 2e-6
            assert (up - loss()) / 2e-6 == pytest.approx(g[i], abs=1e-6)
            w[i] += 1e-6


def test_training_learns_both_sides(spark):
    """The middle word follows from its neighbours; a trained network knows, an untrained one doesn't."""
    rng = random.Random(0)
    texts = [" ".join(f"l{k} m{k} r{k}" for k in rng.choices(range(8), k=30)) for _ in range(600)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    words = pseudo_likelihood.Words.of(docs)
    assert len(words.frequent) == 24
    mean = lambda n: pseudo_likelihood.score(docs, words, n).agg(F.sum("log_probability") / F.sum("n_tokens")).first()[0]
    fresh, trained = pseudo_likelihood.Network.fresh(), pseudo_likelihood.train(docs, words, rounds=6, masked=0.5)
    assert mean(fresh) < -5 and mean(trained) > mean(fresh) + 2
    rows = {r.doc_id: r for r in pseudo_likelihood.score(odd(spark), words, trained).where("doc_id is not null").collect()}
    assert rows[2].log_probability == 0 and rows[2].per_token is None and rows[5].n_tokens == 40000
    assert pseudo_likelihood.score(empty(spark), words, trained).count() == 0
    none = pseudo_likelihood.Words.of(empty(spark))
    assert none.frequent == () and np.array_equal(pseudo_likelihood.train(empty(spark), none).flat(), fresh.flat())


def test_counts_and_averages(spark):
    got = {bytes(r.word): r.n for r in pseudo_likelihood.word_counts(odd(spark)).collect()}
    assert got == collections.Counter(w for _, x, *_ in ODD for w in (x or "").encode().lower().split())
    rows = [(i, i + 1, np.full(5, i, np.float32).tobytes()) for i in range(70)]
    mean = pseudo_likelihood._averaged(spark.createDataFrame(rows, "part long, tokens long, weights binary").repartition(5)).collect()
    assert len(mean) == 1 and np.frombuffer(mean[0].weights, np.float32) == pytest.approx(np.full(5, np.average(range(70), weights=range(1, 71))), rel=1e-5)


# ---- mixing ----


def test_poisson(spark):
    for rate in (0.0, 0.3, 4.0, 900.0):
        sums = spark.range(1).select(mixing.cumulative(F.lit(rate))).first()[0]
        want = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else 1.0 for k in range(len(sums))]
        assert np.cumsum(want) == pytest.approx(sums, abs=1e-9) and sums[-1] == pytest.approx(1)


def test_mixing_meets_its_weights(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("source"))
    out = mixing.poisson_replicas(docs, {"hot": 1.0, "cold": 1.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["hot"] == pytest.approx(10000, rel=0.04) and n["cold"] == pytest.approx(10000, rel=0.04)
    again = mixing.shuffled(mixing.poisson_replicas(docs.repartition(7), {"hot": 1.0, "cold": 1.0}))
    assert sorted(map(tuple, out.select("doc_id", "replica").collect())) == sorted(map(tuple, again.select("doc_id", "replica").collect()))
    first = [r.doc_id for r in again.limit(2000).collect()]
    assert 7000 < np.mean(first) < 13000
    assert mixing.poisson_replicas(docs, {"nowhere": 1.0}).count() == 0


def test_mixing_odd(spark):
    out = mixing.poisson_replicas(odd(spark), total=20.0)
    assert {r.source for r in out.collect()} >= {None, "s", "t"} and mixing.poisson_replicas(empty(spark)).count() == 0
    per = out.where("doc_id = 1").groupBy("replica").count().collect()
    assert {r["count"] for r in per} == {2}  # repeated rows share their draw


# ---- quality ranking ----


def test_ranking_on_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ranking = quality_ranking.learn(docs, labels)
    rows = quality_ranking.score(docs, ranking).join(labels, "doc_id").where(quality_ranking.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95
    kept = quality_ranking.good_only(docs, ranking)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_ranking_odd(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (99, 1), (None, 1), (5, 1), (7, 0)], "doc_id long, quality int")
    ranking = quality_ranking.learn(odd(spark), labels)
    rows = quality_ranking.score(odd(spark), ranking).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality_ranking.good_only(odd(spark), ranking).columns == odd(spark).columns
    bare = quality_ranking.learn(empty(spark), labels.limit(0))
    assert {r.score for r in quality_ranking.score(odd(spark), bare).collect()} == {0.5}
    rows = np.array([[0.0, 1.0], [0.2, 0.5], [1.0, 0.0], [0.9, 0.1]])
    assert list(quality_ranking.fit(rows, np.array([True, True, False, False])).scores(rows) >= 0.5) == [True, True, False, False]


# ---- secrets ----


def brute_spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(secrets.FORMS):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    for k, (kind, chars, least) in enumerate(secrets.CLASSES, len(secrets.FORMS)):
        for m in re.finditer(f"{chars}+", text):
            s = m[0]
            windows = []
            for part in re.split(secrets.ALLOWED, s) if len(s) >= secrets.WINDOW else []:  # what the allow-list leaves
                if not re.search(secrets.NUMBER, part) and (re.search(secrets.DIGIT, part) or re.search(secrets.UNREADABLE, part)):
                    windows += [part[i : i + secrets.WINDOW] for i in range(len(part) - secrets.WINDOW + 1)]
            if max((-sum(n / len(w) * math.log2(n / len(w)) for n in collections.Counter(w).values()) for w in windows), default=0) >= least:
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_secrets_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["token: ", "API_KEY=", '"password" : "', "secret:", "AKIA", "abc123", "é", " ", "\n", "deadbeef" * 3, "0123456789abcdef" * 2, "Zm9vYmFyQmF6cXV4+/9x", "EXAMPLE", "q8Zr4Lx0Vn2Tb7Ky1Wd5", "_", "=", "\U0001f642", "AKIA" + "Q1" * 9, "token:token:abcdef", "f" * 30]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(300)]
    rows = secrets.scan(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        assert [(s.start, s.stop, s.kind) for s in r.spans] == brute_spans(r.text), r.text
    assert {k for x in texts for _, _, k in brute_spans(x)} == set(secrets.KINDS)


def test_redaction(spark):
    found = spark.createDataFrame([(1, "é password = hunter22! and token:abcdefg", 40), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in secrets.redact(found).collect()}
    assert rows[1].text == "é [SECRET]! and [SECRET]" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "clean" and rows[3].text is None
    assert secrets.redact(odd(spark)).columns == odd(spark).columns and secrets.redact(odd(spark)).exceptAll(odd(spark)).count() == 0
    assert secrets.redact(empty(spark)).count() == 0


# ---- sharding ----


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 99, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    if n > 90:
        assert got != sorted(got) and abs(np.corrcoef(got, range(n))[0, 1]) < 0.3


def test_shards(spark):
    docs = odd(spark).union(odd(spark).limit(5))
    rows = sharding.feistel_shards(docs, shards=4).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == len(ODD) + 5 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(r.row for r in rows) == list(range(len(rows)))
    want = sorted((i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x, *_ in ODD if i is not None)
    got = sorted({(r.doc_id, r["size"], r.text_crc32) for r in rows if r.doc_id is not None})
    assert got == sorted(set(want))
    key = lambda q: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in q.collect())
    assert key(sharding.feistel_shards(docs.repartition(5), 4)) == key(sharding.feistel_shards(docs, 4))
    assert sharding.feistel_shards(empty(spark)).count() == 0


# ---- pivots ----


def brute_links(rows, least=0.9):
    ok = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least] if i in ok else [] for i in range(len(rows))}
    return links


def test_pivots_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 40)  # so that the dense group is cut into blocks
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    near = base[0] + rng.normal(size=(110, 16)) * 0.1
    some = base[rng.integers(1, 120, 80)] + rng.normal(size=(80, 16)) * 0.15
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, near, some, np.repeat(base[5:6], 30, axis=0)])]
    vectors += [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], [1.0, 2.0]]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("c", F.lit("own")).repartition(3)
    got = {r.vec_id: r for r in pivots.linked(df).collect()}
    links = brute_links(rows)
    total, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert found <= total and found >= 0.97 * total
    assert all(got[i].n_links <= len(links[i]) for i in links)
    for i in range(len(rows) - 7, len(rows)):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert got[125].component_id == got[0].component_id == min(i for i in links if got[i].component_id == got[0].component_id)
    assert pivots.linked(df.limit(0)).count() == 0


# ---- sentencepiece ----


@pytest.fixture(scope="module")
def encoders():
    path = pieces.default_model()
    return pieces.Encoder(pieces.Vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\taeith▁-=.0é中🙂\x00\r"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_are_the_library_s(encoders, text):
    ours, theirs = encoders
    ids = theirs.encode(text)
    assert ours.encode([text]) == [ids] and ours.decode(ids) == theirs.decode(ids)


def test_long_words(encoders):
    ours, theirs = encoders
    for text in ("a" * 3000, " " * 3000 + "x", "ab" * 2000, "the" * 900 + " " * 40 + "q", "=" * 2000):
        assert ours.encode([text]) == [theirs.encode(text)]
        assert [x for w in ours.cut_up(text) for x in ours.merge([w])[0]] == theirs.encode(text)


def test_pieces_on_tables(spark, encoders):
    _, theirs = encoders
    docs = odd(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in pieces.digests(docs).collect():
        want = [(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest()) for ids in (theirs.encode(x) for x in texts[r.doc_id])]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want
    out = pieces.decode(pieces.encode(docs.where("doc_id = 7")))
    assert {r.text for r in out.collect()} <= {theirs.decode(theirs.encode(x)) for x in texts[7]}
    assert pieces.encode(empty(spark)).count() == 0


# ---- simhash ----


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abAÉé \n\t\x0b\x1c"), max_size=50))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_golay_code_is_perfect():
    g = simhash.golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    code = words ^ g.error[g.syndrome(words)]
    assert (g.syndrome(code) == 0).all() and np.bitwise_count(words ^ code).max() == 3
    assert len(set(g.error.tolist())) == 2048


def test_links_lose_none(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 4)}
    fps |= {0, 1, 7, 15, 2**64 - 1, 2**64 - 8}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long")).collect()}
    want = {tuple(sorted((signed[a], signed[b]))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert got == want


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd(spark).withColumn("doc_id", F.col("doc_id") + 100000), allowMissingColumns=True)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    fps = sorted({(r.doc_id if r.doc_id is not None else 10**9, r.fp & (2**64 - 1)) for r in rows})
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert all(r.component_id == find(r.doc_id) for r in rows if r.doc_id is not None)
    kept = simhash.one_of_each_group(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) == len({find(i) for i in root if i < 10**9})
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each_group(odd(spark)).columns == odd(spark).columns


# ---- warc ----


def test_archive(spark, tmp_path):
    long, other = "<p>" + "é" * 60, "x" * 200
    rows = [(5, "http://a/5", long), (3, "http://a/3\r\nEvil: 1", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (None, "u", other), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own")).withColumn("n", F.lit(1))
    warc.write_archive(pages, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len({h or "" for _, _, h in rows})
    records = warc.read_archive(spark, str(tmp_path / "w"))
    assert sorted((r.page_id or 0, bytes(r.payload).decode()) for r in records.collect()) == sorted((p or 0, h or "") for p, _, h in rows)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.parsed(records).collect())
    want = []
    for p, _, h in rows:
        same = [q for q, _, x in rows if (x or "") == (h or "") and q is not None]
        n = len((h or "").encode())
        response = n < 100 or p == min(same)
        want.append((p or 0, n, "response" if response else "revisit", None if response else min(same)))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    whole = {r.page_id: bytes(r.record) for r in warc.record_bytes(records).collect()}
    assert whole[3].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and whole[3].endswith(long.encode() + b"\r\n\r\n") and b"\r\nEvil" not in whole[3]
    warc.export_warc(records.where("page_id = 3"), str(tmp_path / "x"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "x").glob("part-*"))
    assert text == whole[3]
    damaged = records.withColumn("payload", F.lit("y").cast("binary"))
    with pytest.raises(Exception, match="doesn't match"):
        warc.parsed(damaged).collect()
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0
