"""DuckDB definitions of the views in brindle.sources.views."""

from brindle.sources.views import LEAST_CHARS, NAME

SPACES = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PRELUDE = f"""
WITH raw AS (
  SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS BIGINT) AS source_id, substr(split_part(d.text, chr(10), 1), 1, 500) AS title,
         d.text AS content, d.lang AS language, sha256(regexp_replace(regexp_replace(d.text, '^{SPACES}+', ''), '{SPACES}+$', '')) AS content_hash, d.n_chars,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id * 97 AS BIGINT)) AS discovered_at,
         CASE WHEN d.lang <> 'en' THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id * 97 AS BIGINT)) - to_hours(CAST(d.n_chars % 48 AS BIGINT)) END AS published_at,
         CASE WHEN l.toxic = 1 THEN 'neg' WHEN l.quality = 1 THEN 'pos' WHEN l.quality = 0 THEN 'neutral' END AS sentiment_label,
         CASE WHEN l.toxic = 1 THEN -0.6::DOUBLE WHEN l.quality = 1 THEN 0.6::DOUBLE WHEN l.quality = 0 THEN 0.0::DOUBLE END AS sentiment_score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
firsts AS (SELECT *, min(id) OVER (PARTITION BY content_hash) AS first_id FROM raw),
articles AS (SELECT * EXCLUDE (first_id), CASE WHEN id > first_id THEN 'duplicate' WHEN length(content) < {LEAST_CHARS} THEN 'failed' ELSE 'analyzed' END AS status,
         CASE WHEN id > first_id THEN first_id END AS duplicate_of_id FROM firsts),
visible AS (SELECT * FROM articles WHERE status NOT IN ('failed', 'duplicate')),
sources AS (SELECT source_id AS id, 'source ' || source_id AS name, source_id <> 7 AS enabled, max(discovered_at) AS last_scanned_at FROM articles GROUP BY source_id),
found AS (SELECT id, content, discovered_at, status, unnest(list_distinct(regexp_extract_all(content, '{NAME}'))) AS text FROM articles),
named AS (SELECT *, CASE length(text) % 3 WHEN 0 THEN 'PER' WHEN 1 THEN 'ORG' ELSE 'LOC' END AS label, instr(content, text) - 1 AS start FROM found),
mentions AS (SELECT id AS article_id, text, label, start::BIGINT AS start, (start + length(text))::BIGINT AS stop, 0.5::DOUBLE + (length(text) % 5)::DOUBLE / 10 AS confidence,
         lower(text) AS canonical, label || ':' || lower(text) AS node, discovered_at, status FROM named),
nodes AS (SELECT node, canonical, label, count(*) AS mention_count, min(discovered_at) AS first_seen, max(discovered_at) AS last_seen FROM mentions GROUP BY ALL),
pairs AS (SELECT DISTINCT article_id, node FROM mentions),
edges AS (SELECT x.node AS a, y.node AS b, count(*) AS weight FROM pairs x JOIN pairs y ON x.article_id = y.article_id AND x.node < y.node GROUP BY x.node, y.node),
near AS (SELECT *, lead(node) OVER w AS object, lead(start) OVER w AS next, lead(confidence) OVER w AS cb FROM mentions WINDOW w AS (PARTITION BY article_id ORDER BY start, text)),
triples AS (SELECT node AS subject, object, CASE WHEN next - stop < 20 THEN 'stated' WHEN next - stop < 80 THEN 'met_with' ELSE 'located_in' END AS predicate, article_id,
         max(round_even(least(confidence, cb) * 0.8, 3)) AS confidence FROM near WHERE object IS NOT NULL GROUP BY ALL),
keyed AS (SELECT id AS article_id, lower(regexp_extract(title, '({NAME})', 1)) AS key FROM visible),
story_articles AS (SELECT min(article_id) OVER (PARTITION BY key) AS story_id, article_id FROM keyed WHERE key <> '' QUALIFY count(*) OVER (PARTITION BY key) > 1),
titles AS (SELECT id AS article_id, discovered_at, lower(unnest(list_distinct(regexp_extract_all(title, '{NAME}')))) AS node FROM visible)
"""


def over(sql: str) -> str:
    return PRELUDE + sql
