"""Alert rules against articles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.patterns import Automaton

#: Rules that one row holds, and rules up to which they are sent to all tasks; more are joined by a shuffle.
RULES_A_ROW, MOST_SENT = 500, 10_000
#: Different words of rules that a pass over the texts looks for.
TERMS_A_PASS = 50_000
#: Words with these stand for patterns.
WILD = r"[%_\\\\]"
ANY = ""
RULES = "id long, name string, query string, languages array<string>, min_sentiment double, node string, match_in string, enabled boolean"


def terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"[,\s]+"), lambda t: t != "")


def reason() -> Column:
    """Why a rule matched: its set parts, joined by semicolons."""
    said = F.concat_ws(
        "; ",
        F.when(F.coalesce(F.col("query"), F.lit("")) != "", F.concat(F.lit("keyword: "), F.col("query"))),
        F.when(F.size(F.coalesce("languages", F.array().cast("array<string>"))) > 0, F.concat(F.lit("language: "), F.array_join("languages", ","))),
        F.when(F.col("min_sentiment").isNotNull(), F.concat(F.lit("sentiment <= "), F.col("min_sentiment").cast("string"))),
        F.when(F.col("node").isNotNull(), F.concat(F.lit("entity: "), F.col("node"))),
    )
    return F.when(said == "", "rule match").otherwise(said)


def _holds(r: Column) -> Column:
    """Whether a rule's words, languages and score hold for the article of the row; what a rule leaves out holds."""
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    # % and _ in a word stand for any letters and any letter, as in a LIKE pattern
    has = lambda text, t: F.when(t.rlike(WILD), F.call_function("like", text, F.concat(F.lit("%"), t, F.lit("%")))).otherwise(F.contains(text, t))
    said = lambda t: ((r["match_in"] != "content") & has(title, t)) | ((r["match_in"] != "title") & has(content, t))
    words = (F.size(r["terms"]) == 0) | F.exists(r["terms"], said)
    languages = (F.size(F.coalesce(r["languages"], F.array().cast("array<string>"))) == 0) | F.array_contains(r["languages"], F.col("language"))
    return F.coalesce(words & languages & (r["min_sentiment"].isNull() | (F.col("sentiment_score") <= r["min_sentiment"])), F.lit(False))


def _keyword_matches(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, article_id) of rules without an entity whose words are plain: one pass over the texts for every TERMS_A_PASS words.

    Tasks get an automaton of the words and, for each word, the rules that have it; a rule becomes a row only where it holds.
    """
    words = rules.select("id", F.explode("terms").alias("term"), "match_in", F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), "min_sentiment").where("match_in is not null")
    passes = -(-words.select("term").distinct().count() // TERMS_A_PASS)
    spark = articles.sparkSession
    found = spark.createDataFrame([], "rule_id long, article_id long")
    for i in range(passes):
        some = words.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).collect() if passes > 1 else words.collect()
        by_term: dict[bytes, list[tuple]] = {}
        for r in some:
            by_term.setdefault(r["term"].encode(), []).append((r["id"], r["match_in"], frozenset(r["languages"]), r["min_sentiment"]))
        sent = spark.sparkContext.broadcast(by_term)
        found = found.union(articles.select("article_id", "title", "content", "language", "sentiment_score").mapInArrow(partial(_keyword_rows, sent), "rule_id long, article_id long"))
    return found.distinct() if passes > 1 else found


def _keyword_rows(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_term = sent.value
    automaton = Automaton(list(by_term))
    rules = [by_term[t] for t in automaton.terms]
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            ids, titles, contents, languages, scores = (c.to_pylist() for c in batch.slice(start, 1000).columns)
            pairs = set()
            for texts, elsewhere in ((titles, "content"), (contents, "title")):
                text, _, _, term = automaton.find([(x or "").encode() for x in texts])
                for i, t in np.unique(np.stack([text, term], axis=1), axis=0).tolist():
                    for rule, place, wanted, most in rules[t]:
                        if place != elsewhere and (not wanted or languages[i] in wanted) and (most is None or scores[i] is not None and scores[i] <= most):
                            pairs.add((rule, i))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in pairs], pa.int64()), pa.array([ids[i] for _, i in pairs], pa.int64())], ["rule_id", "article_id"])


def match(articles: DataFrame, rules: DataFrame, mentions: DataFrame, already: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(rule_id, article_id, reason): every enabled rule with every article that meets all of its parts; pairs in ``already`` are left out.

    Rules with words find them through an automaton, in time that doesn't depend on the number of rules. Rules without words or entity meet articles, without their texts, by an equi-join on the language,
    rules without a language under a key that all articles have; words with wildcards take that way with texts. A row holds many rules, and a rule becomes a row only where it holds. Entity rules meet mentions by
    their node. Rules are sent to all tasks while they are counted to be few, and shuffled beyond that.
    With ``texts`` (id, title, content, language) words are looked for in those, so that articles that come out of a join bring their scores only.
    """
    live = rules.where("enabled").withColumn("terms", terms(F.col("query"))).withColumn("reason", reason())
    small = live.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = F.broadcast if small else (lambda df: df)
    a = articles.select(F.col("id").alias("article_id"), F.lower("title").alias("title"), F.lower("content").alias("content"), "language", "sentiment_score")
    slim = a.withColumns({"title": F.lit(""), "content": F.lit("")})
    worded, wild = F.size("terms") > 0, F.exists("terms", lambda t: t.rlike(WILD))
    free, entity = live.where("node is null"), live.where("node is not null")
    told = live.select(F.col("id").alias("rule_id"), "reason", "min_sentiment")
    if texts is None:
        plain = _keyword_matches(a, free.where(worded & ~wild)).join(sent(told), "rule_id")
    else:
        lowered = texts.select(F.col("id").alias("article_id"), F.lower("title").alias("title"), F.lower("content").alias("content"), "language", F.lit(float("-inf")).alias("sentiment_score"))
        plain = _keyword_matches(lowered, free.where(worded & ~wild)).join(sent(told), "rule_id").join(articles.select(F.col("id").alias("article_id"), "sentiment_score"), "article_id")
        plain = plain.where(F.col("min_sentiment").isNull() | (F.col("sentiment_score") <= F.col("min_sentiment")))
    found = plain.select("rule_id", "article_id", "reason").union(_joined(slim, free.where(~worded), sent))
    some = live.agg(F.count_if(wild & F.col("node").isNull()).alias("wild"), F.count_if(worded & F.col("node").isNotNull()).alias("entity")).first()
    if some["wild"]:
        found = found.union(_joined(a, free.where(wild), sent))
    parts = F.struct("id", "terms", "languages", "min_sentiment", "match_in", "reason").alias("r")
    named = mentions.select("node", "article_id").distinct().join(sent(entity.select("node", parts)), "node").join(a if some["entity"] else slim, "article_id")
    found = found.unionByName(named.where(_holds(F.col("r"))).select(F.col("r.id").alias("rule_id"), "article_id", "r.reason"))
    return found.join(already, ["rule_id", "article_id"], "left_anti") if already is not None else found


def _joined(a: DataFrame, rules: DataFrame, sent) -> DataFrame:
    """(rule_id, article_id, reason) by a join on the language."""
    parts = F.struct("id", "terms", "languages", "min_sentiment", "match_in", "reason").alias("r")
    none = F.array().cast("array<string>")
    wanted = F.when(F.size(F.coalesce("languages", none)) == 0, F.array(F.lit(ANY))).otherwise(F.array_distinct("languages"))
    keyed = rules.select(F.explode(wanted).alias("key"), parts, F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("h"))
    counts = keyed.groupBy("key").agg(F.ceil(F.count("*") / RULES_A_ROW).alias("rows"))
    packed = keyed.join(counts, "key").groupBy("key", F.pmod("h", "rows").alias("row")).agg(F.collect_list("r").alias("rules"))  # about RULES_A_ROW rules
    keys = F.array_distinct(F.array(F.lit(ANY), F.coalesce("language", F.lit(ANY))))
    met = a.withColumn("key", F.explode(keys)).join(sent(packed.select("key", "rules")), "key")
    return met.select("article_id", F.explode(F.filter("rules", _holds)).alias("r")).select(F.col("r.id").alias("rule_id"), "article_id", "r.reason")


def scan(articles: DataFrame, rules: DataFrame, mentions: DataFrame, already: DataFrame, cursor: str | None, at: str = "discovered_at", texts: DataFrame | None = None) -> DataFrame:
    """The same for articles past a cursor; those at the cursor itself are looked at again, which already known pairs make harmless."""
    fresh = lambda df: df.where(F.col(at).isNull() | (F.col(at) >= F.lit(cursor).cast("timestamp_ntz"))) if cursor else df
    return match(fresh(articles), rules, mentions, already, None if texts is None else fresh(texts))


def listed(found: DataFrame, articles: DataFrame, rules: DataFrame, sources: DataFrame, unread_only: bool = False, limit: int = 100) -> DataFrame:
    """Alerts (id, rule_id, article_id, reason, read, created_at) with their rule, article and source, the newest first; 1 to 500 of them."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    rows = found.where(~F.col("read")) if unread_only else found
    top = rows.join(rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule")), "rule_id")
    top = top.join(articles.select(F.col("id").alias("article_id"), "title", "language", "sentiment_label", "published_at", "source_id"), "article_id")
    top = top.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    return top.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)
