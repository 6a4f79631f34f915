"""Stages of the article pipeline as plain transformations, and its state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as t
from brindle.functions.values import STATUSES
from brindle.functions.vectors import hash_embedding

STAGE_INPUT = {"extract": ("new", "fetched"), "analyze": ("extracted",), "ner": ("sentiment_done",)}
STAGE_OUTPUT = {"extract": "extracted", "analyze": "sentiment_done", "ner": "analyzed"}
MOST_RETRIES = 3


def valid_status(status: Column) -> Column:
    return status.isin(*STATUSES)


def claimable(articles: DataFrame, stage: str, as_of: str, batch: int, lease_minutes: int = 5) -> DataFrame:
    """The oldest articles that a stage may take: right state, lease over, retries left."""
    free = F.col("started_at").isNull() | (F.col("started_at") < F.expr(f"timestamp_ntz'{as_of}' - make_dt_interval(0, 0, {int(lease_minutes)})"))
    rows = articles.where(F.col("status").isin(*STAGE_INPUT[stage]) & free & (F.col("retry_count") < MOST_RETRIES))
    return rows.orderBy("discovered_at", "id").limit(batch)


def retry_transition(articles: DataFrame, failed: Column, stage: str, most: int = MOST_RETRIES) -> DataFrame:
    """After a try: success moves on and resets the counter, failure counts and at last fails."""
    again = F.col("retry_count") + 1
    back = F.lit(STAGE_INPUT[stage][0])
    return articles.withColumns({
        "status": F.when(~failed, STAGE_OUTPUT[stage]).when(again >= most, "failed").otherwise(back),
        "retry_count": F.when(failed, again).otherwise(0),
        "started_at": F.lit(None).cast("timestamp_ntz"),
    })


def dedup_url(entries: DataFrame, known: DataFrame, url: str = "url", first: str = "seen") -> DataFrame:
    """Entries whose url (without case and closing slashes) is new, the first of each."""
    hashed = entries.withColumn("url_hash", t.url_hash(F.col(url)))
    new = hashed.join(known.select("url_hash"), "url_hash", "left_anti")
    rows = new.groupBy("url_hash").agg(F.min_by(F.struct(*[F.col(c) for c in entries.columns]), F.struct(first, url)).alias("r"))
    return rows.select("url_hash", "r.*")


#: States whose articles a later copy counts as a copy of.
PROCESSED = ("extracted", "sentiment_done", "analyzed")


def dedup_content(articles: DataFrame, processed_only: bool = False) -> DataFrame:
    """(id, duplicate_of_id): copies of an earlier article with the same content, white space at the ends aside.

    With ``processed_only`` an article is a copy of the smallest other one that a stage has processed, earlier or not. Null contents are no copies.
    """
    columns = ["id", *["content_hash" if "content_hash" in articles.columns else t.content_hash(F.col("content")).alias("content_hash")], *["status"] * processed_only]
    hashed = articles.select(*columns).withColumnRenamed("content_hash", "h").where("h is not null")
    if not processed_only:
        first = hashed.groupBy("h").agg(F.min("id").alias("duplicate_of_id"))
        return hashed.join(first, "h").where("id > duplicate_of_id").select("id", "duplicate_of_id")
    done = hashed.where(F.col("status").isin(*PROCESSED)).groupBy("h").agg(F.min("id").alias("one"))
    rows = hashed.where(~F.col("status").isin(*PROCESSED)).join(done, "h")
    return rows.select("id", F.col("one").alias("duplicate_of_id"))


def reset(articles: DataFrame, ids: DataFrame, status: str = "sentiment_done") -> DataFrame:
    """The articles named in ``ids`` back in an earlier state: no lease, no retries, no error."""
    if status not in STATUSES:
        raise ValueError(f"no state {status}")
    rows = articles.join(ids.select("id", F.lit(True).alias("again")).distinct(), "id", "left")
    cleared = {"status": F.lit(status), "started_at": F.lit(None), "retry_count": F.lit(0), "error_message": F.lit(None), "analyzed_at": F.lit(None)}
    kinds = dict(articles.dtypes)
    return rows.withColumns({c: F.when(F.col("again"), v.cast(kinds[c])).otherwise(F.col(c)) for c, v in cleared.items() if c in kinds}).drop("again")


def extract_stage(articles: DataFrame) -> DataFrame:
    """Hash, summary, language and tokens of extracted contents."""
    norm = t.normalized(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    return articles.withColumns({
        "content_hash": t.content_hash(F.col("content")), "summary": t.summary(F.col("content")), "language": t.language_by_cues(F.col("content")),
        "word_count": t.word_count(F.col("content")), "tokens": t.tokens(norm), "status": F.lit("extracted"),
    })


def analyze_stage(articles: DataFrame, english=None, transformer=None) -> DataFrame:
    """Sentiment of content, summary or title, with the language found anew."""
    body = t.first_filled(F.col("content"), F.col("summary"), F.col("title"))
    language = t.language_by_cues(t.first_filled(F.col("title"), F.col("content")))
    said = t.sentiment(body, language, english, transformer)
    return articles.withColumn("language", language).withColumn("__s", said).withColumns({"sentiment_score": F.col("__s.score"), "sentiment_label": F.col("__s.label"), "status": F.lit("sentiment_done")}).drop("__s")


def embed_stage(articles: DataFrame, embedder=hash_embedding) -> DataFrame:
    """Vectors of analysed articles that have none; ``embedder`` is a column function."""
    body = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "summary", "content")])
    return articles.where("status = 'analyzed' and embedding is null").withColumn("embedding", embedder(F.when(body == "", F.col("url")).otherwise(body)))


def redetect_language(articles: DataFrame, strict_compat: bool = False) -> DataFrame:
    return articles.withColumn("language", t.language_by_cues(F.col("content"), strict_compat))


def fetch_bookkeeping(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Sources with the last scan, article counts and error counts of a run (fetched: source_id, at, articles, failed)."""
    per = fetched.groupBy(F.col("source_id").alias("id")).agg(F.max("at").alias("__at"), F.sum("articles").alias("__n"), F.count_if("failed").alias("__e"))
    rows = sources.join(per, "id", "left")
    return rows.withColumns({
        "last_scanned_at": F.coalesce("__at", "last_scanned_at"), "article_count": F.col("article_count") + F.coalesce("__n", F.lit(0)),
        "error_count": F.when(F.coalesce("__e", F.lit(0)) > 0, F.col("error_count") + F.col("__e")).when(F.col("__at").isNotNull(), 0).otherwise(F.col("error_count")),
    }).drop("__at", "__n", "__e")


def source_cascade(candidates: DataFrame, order: tuple[str, ...] = ("rss", "sitemap", "homepage")) -> DataFrame:
    """Entries of each source's first channel that has any."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("channel"))
    ranked = candidates.withColumn("__rank", rank).where("__rank > 0")
    best = ranked.groupBy("source_id").agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, ["source_id", "__rank"]).drop("__rank")


def seed_sources(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds whose url isn't there yet."""
    return seeds.dropDuplicates(["url"]).join(existing.select("url"), "url", "left_anti")
