"""Exports: CSV, a JSON envelope, and the blocks of a printed page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import escaped
from brindle.operators.search import SearchRequest, apply_filters, normalized_query, query_groups, with_tokens

ARTICLE_COLUMNS = ("id", "title", "language", "status", "sentiment_label", "sentiment_score", "source_id", "discovered_at")


def csv_rows(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Strings in a fixed order, nulls as empty strings; columns that aren't there are empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_csv(df: DataFrame, columns: tuple[str, ...], path: str) -> None:
    csv_rows(df, columns).write.option("header", True).option("emptyValue", "").csv(path)


def json_envelope(df: DataFrame, name: str, most: int = 2000) -> DataFrame:
    """One row of {total, format, items}: the form of a response of at most ``most`` items."""
    items = df.limit(most).agg(F.count("*").alias("total"), F.lit(name).alias("format"), F.collect_list(F.struct(*df.columns)).alias("items"))
    return items.select(F.to_json(F.struct("total", "format", "items")).alias("json"))


def export_articles(articles: DataFrame, source_id: int | None = None, status: str | None = None, since: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    out = articles
    if source_id is not None:
        out = out.where(F.col("source_id") == source_id)
    if status:
        out = out.where(F.col("status") == status)
    if since:
        out = out.where(F.col("discovered_at") >= F.lit(since).cast("timestamp_ntz"))
    if limit is not None:
        out = out.orderBy(F.desc_nulls_first("discovered_at"), "id").offset(offset).limit(min(limit, 2000))
    return csv_rows(out, ARTICLE_COLUMNS)


def export_search(articles: DataFrame, request: SearchRequest, mentions: DataFrame | None = None, triples: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Hits, all or the newest so many (2000 at most); an export is by time and has no rank."""
    groups = query_groups(normalized_query(request.q))
    hits = apply_filters(with_tokens(articles) if groups else articles, request, mentions, triples, groups)
    if limit is not None:
        hits = hits.orderBy(F.desc_nulls_first("discovered_at"), "id").limit(min(limit, 2000))
    return csv_rows(hits, ARTICLE_COLUMNS)


def export_story(story_articles: DataFrame, articles: DataFrame, story_id: int) -> DataFrame:
    ids = story_articles.where(F.col("story_id") == story_id).select(F.col("article_id").alias("id"))
    return csv_rows(articles.join(ids, "id", "left_semi"), ARTICLE_COLUMNS)


def page_blocks(articles: DataFrame) -> DataFrame:
    """(id, seq, kind, text) of a printed article: title, facts, paragraphs."""
    paragraphs = F.transform(F.filter(F.split(F.coalesce("content", F.lit("")), "\n+"), lambda p: F.trim(p) != ""), lambda p: F.struct(F.lit("body").alias("kind"), escaped(p).alias("text")))
    facts = escaped(F.concat_ws(" | ", "language", "sentiment_label", "status"))
    head = F.array(F.struct(F.lit("title").alias("kind"), escaped(F.coalesce("title", F.lit(""))).alias("text")), F.struct(F.lit("meta").alias("kind"), facts.alias("text")))
    return articles.select("id", F.posexplode(F.concat(head, paragraphs)).alias("seq", "b")).select("id", "seq", "b.kind", "b.text")


def story_blocks(stories: DataFrame, summaries: DataFrame) -> DataFrame:
    """The same for a story, with the longest summary of its members."""
    rows = stories.join(summaries, "story_id", "left").select("story_id", F.posexplode(F.array(F.struct(F.lit("title").alias("kind"), F.col("story_id").cast("string").alias("text")), F.struct(F.lit("body").alias("kind"), escaped(F.coalesce("summary", F.lit(""))).alias("text")))).alias("seq", "b"))
    return rows.select("story_id", "seq", "b.kind", "b.text")
