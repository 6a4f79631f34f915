"""Search: shared filters, rank, pages, entities of a page, and vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import normalized, tokens
from brindle.functions.values import HIDDEN
from brindle.functions.vectors import cosine, hash_embedding

#: Rank constants of the usual cover-free text rank: weight of a position, and the sum of 1/j^2.
WEIGHT, ZETA2 = 0.1, 1.64493406685


def parse_list(text: str | None) -> list[str]:
    """Items between commas, trimmed, blanks dropped."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


@dataclass(frozen=True)
class SearchRequest:
    q: str | None = None
    languages: Sequence[str] = ()
    sentiments: Sequence[str] = ()
    source_id: int | None = None
    entity: str | None = None
    predicate: str | None = None
    date_from: date | None = None
    date_to: date | None = None
    include_hidden: bool = False
    sort: str = "auto"
    limit: int = 20
    offset: int = 0
    groups: tuple[tuple[str, ...], ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("limit must be 1 to 100 and offset not negative")


def query_groups(normalized_query: str) -> list[list[str]]:
    """Words that must all occur, as alternatives: the word or parts groups, all else is a conjunction."""
    groups: list[list[str]] = [[]]
    for word in normalized_query.split():
        if word == "or":
            groups.append([])
        elif word not in groups[-1]:
            groups[-1].append(word)
    return [g for g in groups if g]


def matches(words: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Whether an array of tokens has all words of one of the groups."""
    out = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for w in g:
            every = every & F.array_contains(words, w)
        out = out | every
    return out


def positions(words: Column, word: str) -> Column:
    return F.filter(F.transform(words, lambda t, i: F.when(t == word, i + 1)), lambda p: p.isNotNull())


def text_rank(words: Column, groups: Sequence[Sequence[str]]) -> Column:
    """The rank by the outermost operator of the query, as the database's ranking works: it looks at that operator only, and then at all different words.

    Alternatives, of words or of conjunctions, and single words: the mean over the words of 0.1 * sum 1/j^2 over their places, by ZETA2. A
    conjunction: places of different words combine by nearness."""
    terms = sorted({w for g in groups for w in g})
    if not terms:
        return F.lit(0.0)
    if len(groups) > 1 or len(terms) == 1:
        total = F.lit(0.0)
        for t in terms:
            n = F.size(positions(words, t))
            sums = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, j: a + WEIGHT / (j * j))
            total = total + F.when(n > 0, sums / ZETA2).otherwise(0.0)
        return total / len(terms)
    rest = F.lit(1.0)
    for i, a in enumerate(terms):
        for b in terms[i + 1 :]:
            rest = rest * _pair(positions(words, a), positions(words, b))
    return F.when(matches(words, groups), 1.0 - rest).otherwise(0.0)


def _pair(a: Column, b: Column) -> Column:
    def near(d: Column) -> Column:
        w = F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
        return 1.0 - WEIGHT * F.sqrt(w)

    return F.aggregate(a, F.lit(1.0), lambda s, x: s * F.aggregate(b, F.lit(1.0), lambda t, y: t * near(F.abs(x - y))))


def with_tokens(articles: DataFrame) -> DataFrame:
    """The ordered tokens of title and content."""
    return articles.withColumn("tokens", tokens(normalized(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))))


def apply_filters(articles: DataFrame, request: SearchRequest, mentions: DataFrame | None = None, triples: DataFrame | None = None, groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Articles (with tokens, if there are groups) that meet the request. An upper date excludes that day, as a comparison with its midnight does."""
    out = articles
    if groups:
        out = out.where(matches(F.col("tokens"), groups))
    if request.languages:
        out = out.where(F.col("language").isin(*request.languages))
    if request.sentiments:
        out = out.where(F.col("sentiment_label").isin(*request.sentiments))
    if request.source_id is not None:
        out = out.where(F.col("source_id") == request.source_id)
    if request.date_from:
        out = out.where(F.col("discovered_at") >= F.lit(str(request.date_from)).cast("timestamp_ntz"))
    if request.date_to:
        out = out.where(F.col("discovered_at") <= F.lit(str(request.date_to)).cast("timestamp_ntz"))
    if not request.include_hidden:
        out = out.where(~F.col("status").isin(*HIDDEN))
    if request.entity and mentions is not None:
        out = out.join(mentions.where(F.col("canonical") == request.entity).select(F.col("article_id").alias("id")), "id", "left_semi")
    if request.predicate and triples is not None:
        out = out.join(triples.where(F.col("predicate") == request.predicate).select(F.col("article_id").alias("id")), "id", "left_semi")
    return out


def normalized_query(q: str | None) -> str:
    """The same folding as for texts, on the driver for one short string."""
    import re
    import unicodedata

    from brindle.functions.text import fold_table

    source, target, several = fold_table()
    table = {**dict(zip(map(ord, source), target, strict=True)), **{ord(k): v for k, v in several.items()}}
    plain = unicodedata.normalize("NFKC", q or "").translate(table).lower()
    return " ".join(re.sub(r"[^a-z\s]", "", " ".join(plain.split())).split())


def scored(texts: DataFrame, request: SearchRequest) -> DataFrame:
    """Texts that have a request's words, with ``rank`` and without their contents; search() takes rows with a rank as found."""
    groups = query_groups(normalized_query(request.q))
    if not groups:
        return texts.withColumn("rank", F.lit(0.0)).drop("content")
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    # exploded out of an array of one, tokens are worked out once for filter and rank
    rows = texts.select("*", F.explode(F.array(tokens(normalized(body)))).alias("tokens")).where(matches(F.col("tokens"), groups))
    return rows.withColumn("rank", F.bround(text_rank(F.col("tokens"), groups), 4)).drop("tokens", "content")


def search(articles: DataFrame, request: SearchRequest, sources: DataFrame | None = None, mentions: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """All hits with their rank (0 without a query), not yet cut to a page. Articles that scored() has ranked aren't searched again."""
    ranked = "rank" in articles.columns
    groups = [] if ranked else query_groups(normalized_query(request.q))
    hits = apply_filters(with_tokens(articles) if groups else articles, request, mentions, triples, groups)
    if not ranked:
        hits = hits.withColumn("rank", F.bround(text_rank(F.col("tokens"), groups), 4) if groups else F.lit(0.0)).drop("tokens")
    if sources is not None:
        hits = hits.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")
    return hits


def page(hits: DataFrame, request: SearchRequest) -> DataFrame:
    """One page: by rank if there is a query (or sort says so), else the newest first; ties by id."""
    ranked = request.sort == "rank" or (request.sort == "auto" and bool(query_groups(normalized_query(request.q))))
    order = F.desc("rank") if ranked else F.desc_nulls_first("discovered_at")
    return hits.orderBy(order, "id").offset(request.offset).limit(request.limit)


def with_entities(page_: DataFrame, mentions: DataFrame, most: int = 5) -> DataFrame:
    """A page with the first few entities of each article, by place."""
    found = mentions.join(page_.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    per = found.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("start", "canonical"))).alias("e"))
    names = F.transform(F.slice("e", 1, most), lambda x: x["canonical"])
    return page_.join(per.select(F.col("article_id").alias("id"), names.alias("entities")), "id", "left")


def semantic_topk(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of greatest cosine with the query vector, those of 0 or less dropped."""
    scored = vectors.withColumn("similarity", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).where("similarity > 0")
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def total(articles: DataFrame, request: SearchRequest, mentions: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """One row: how many hits a request has on all of its pages."""
    return search(articles, request, None, mentions, triples).agg(F.count("*").alias("total"))


def semantic_search(articles: DataFrame, sources: DataFrame, text: str, k: int = 20, language: str | None = None) -> DataFrame:
    """The k analysed articles (with ``embedding``) nearest to a text of two characters or more, with source and score; those of 0 or less are left out."""
    asked = (text or "").strip()
    if len(asked) < 2:
        raise ValueError("the text is too short")
    query = articles.sparkSession.createDataFrame([(asked,)], "text string").select(hash_embedding("text")).first()[0]  # one vector
    rows = articles.where((F.col("status") == "analyzed") & F.col("embedding").isNotNull())
    rows = rows.where(F.col("language") == language) if language else rows
    top = semantic_topk(rows, query, k, "id", "embedding")
    named = top.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    return named.select("id", "title", "source_id", "source", "language", "sentiment_label", F.bround("similarity", 4).alias("score")).orderBy(F.desc("score"), "id")


def article(articles: DataFrame, mentions: DataFrame, sources: DataFrame, id_: int) -> DataFrame:
    """One article with its source and its entities by place; no row if there is none."""
    return with_entities(articles.where(F.col("id") == id_).join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left"), mentions, 1000)
