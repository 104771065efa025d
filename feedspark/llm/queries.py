"""The registered queries of this subpackage: one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def _held_out(parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this rest; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~_held_out(4, 2)))
    return identify(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~_held_out(5, 0)))
    return score(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from feedspark.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.warc import roundtrip

    return roundtrip(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


#: Dated entries of four lists: list, kind, pattern, action, event, day, seq.
URL_ENTRIES = [
    ("spam", "domain", "cheap-pills.example.com", "block", "add", "2024-01-01", 1),
    ("spam", "domain", "cheap-pills.example.com", "block", "remove", "2024-09-01", 2),
    ("spam", "host", "tionsh.example.net", "block", "add", "2024-02-10", 3),
    ("spam", "host", "tionsh.example.net", "block", "remove", "2024-03-10", 4),
    ("spam", "host", "tionsh.example.net", "block", "add", "2024-07-01", 5),
    ("optout", "prefix", "tionsh.example.net/de/", "block", "add", "2024-04-01", 6),
    ("optout", "prefix", "ththon.example.com/en/", "block", "add", "2024-01-15", 7),
    ("optout", "domain", "ththre.example.org", "block", "add", "2024-05-05", 8),
    ("optout", "domain", "ththre.example.org", "block", "remove", "2024-05-05", 9),
    ("optout", "domain", "thther.example.org", "block", "add", "2024-06-01", 10),
    ("adult", "domain", "example.org", "block", "add", "2024-10-01", 11),
    ("adult", "domain", "example.org", "block", "remove", "2024-11-15", 12),
    ("trusted", "host", "blog.ththth.example.org", "allow", "add", "2024-01-01", 13),
    ("trusted", "prefix", "tionsh.example.net/en/", "allow", "add", "2024-08-01", 14),
    ("trusted", "domain", "thther.example.org", "allow", "add", "2024-11-01", 15),
]
_ENTRY_ROWS = ", ".join(f"('{li}', '{ki}', '{pa}', '{ac}', '{ev}', TIMESTAMP '{day} 00:00:00', {seq})" for li, ki, pa, ac, ev, day, seq in URL_ENTRIES)
#: A page's fetch time, which the table lacks: a day of 2024 that depends on its id.
FETCH_EPOCH, FETCH_STEP, FETCH_DAYS = 1704067200, 37, 365


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.url_filters import filter_captures

    at = F.timestamp_seconds(FETCH_EPOCH + F.pmod(F.col("page_id") * FETCH_STEP, F.lit(FETCH_DAYS)) * 86400)
    entries = spark.sql(f"SELECT * FROM VALUES {_ENTRY_ROWS} AS t(list, kind, pattern, action, event, at, seq)")
    found = filter_captures(table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at")), entries)
    return found.withColumn("fetched_at", F.unix_seconds("fetched_at"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedspark.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("notices")


OP9_SQL = f"""
WITH entries AS (SELECT * FROM (VALUES {_ENTRY_ROWS}) t(list, kind, pattern, action, event, at_, seq)),
valid AS (
  SELECT * FROM (SELECT *, lead(at_) OVER (PARTITION BY list, kind, pattern ORDER BY at_, seq) AS until_ FROM entries)
  WHERE event = 'add' AND (until_ IS NULL OR until_ > at_)
),
captures AS (
  SELECT page_id, url, {FETCH_EPOCH} + (page_id * {FETCH_STEP} % {FETCH_DAYS}) * 86400 AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
matched AS (
  SELECT c.page_id, v.list, v.kind, v.pattern, v.action
  FROM captures c JOIN valid v ON epoch(v.at_) <= c.fetched_at AND (v.until_ IS NULL OR c.fetched_at < epoch(v.until_))
   AND CASE v.kind WHEN 'host' THEN c.host = v.pattern
                   WHEN 'domain' THEN c.host = v.pattern OR ends_with(c.host, '.' || v.pattern)
                   ELSE starts_with(c.host || lower(c.path), v.pattern) END
),
best AS (
  SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
         max({{'k': CASE kind WHEN 'domain' THEN 1 WHEN 'host' THEN 2 ELSE 3 END, 'l': length(pattern), 'a': action = 'allow', 'e': kind || ':' || pattern}}) AS b
  FROM matched GROUP BY page_id
)
SELECT c.page_id, c.host, CAST(c.fetched_at AS BIGINT) AS fetched_at, coalesce(b.n_entries, 0) AS n_entries, coalesce(b.lists, '') AS lists,
       b.b.e AS entry, CASE WHEN b.b IS NULL OR b.b.a THEN 'keep' ELSE 'block' END AS decision
FROM captures c LEFT JOIN best b USING (page_id)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP3_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words
),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS meet FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * meet >= 85 * (p.n + q.n - meet)
),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN arcs e ON e.a = r.b)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""

OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))
),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
hits AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON v.n = p.n AND v.x = p.x),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT *, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda k: substr('{_BASE32}', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS INTEGER)) & 31) AS INTEGER), 1)), lambda a, c: a || c) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


def queries() -> dict[str, Query]:
    found = [op1_language_id, op2_toxicity, op3_near_dedup, op4_decontamination, op5_token_counts, op6_neighbours, op7_warc, op8_mixing, op9_url_filters, op10_license_scan]
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op7_warc": OP7_SQL, "op9_url_filters": OP9_SQL}
