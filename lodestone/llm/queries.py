"""The queries opN_<name>: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann, audit, fingerprints, html, mixing, packing, quality, runs, setsketch, substrings, suffixes, urls, warc
from lodestone.llm.common import table


def op1_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))[1]


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return substrings.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return suffixes.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return runs.summary(runs.find(docs.withColumn("text", runs.with_planted_repeats(F.col("text"), F.col("doc_id")))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract_html": op1_extract_html,
    "op2_pack_documents": op2_pack_documents,
    "op3_warc_archive": op3_warc_archive,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filters": op13_url_filters,
}

#: Archives hold each page's record; which page a repeated payload is stored under is a window over digests.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM k
"""

#: Masks by part; an order is five letters, what it has applied before a step is a mask of bits.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
m AS (
  SELECT doc_id, part,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(first < doc_id, false)::INT AS mask
  FROM d),
j AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN j ON m.doc_id = j.doc_id GROUP BY part, mask),
f AS (SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM range(5) r(i)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k::INT AS step, bits[k] AS bit, list_sum(bits[1:k - 1])::INT AS before FROM o, range(1, 6) r(k)),
t AS (SELECT filter_order, step, bit, CASE WHEN step = 1 THEN 0 ELSE before END AS before FROM s),
w AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, t GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM w
"""

#: The tokens of FP-growth's transactions are enumerated as subsets; thresholds are those of ``urls``.
OP13_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM u),
x AS (
  SELECT row_number() OVER () AS row, page_id, host, path, list_distinct([CASE WHEN length(t) > 64 THEN 'md5=' || md5(t) ELSE t END FOR t IN list_concat(
    [t FOR t IN [CASE WHEN host <> '' THEN 'host=' || host END, CASE WHEN contains(host, '.') THEN 'domain=' || regexp_extract(host, '([^.]*\.[^.]*)$', 1) END,
                 CASE WHEN host <> '' THEN 'top=' || regexp_extract(host, '([^.]*)$', 1) END] IF t IS NOT NULL],
    ['dir=' || regexp_replace(d, '[0-9]+', '0', 'g') FOR d IN string_split(path, '/') IF d <> ''],
    ['key=' || regexp_replace(regexp_extract(d, '^([^=]*)', 1), '[0-9]+', '0', 'g') FOR d IN string_split(query, '&') IF d <> ''])]) AS tokens
  FROM h),
j AS (SELECT doc_id, max(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS blocked FROM labels GROUP BY doc_id),
l AS (SELECT row, tokens, blocked FROM x JOIN j ON x.page_id = j.doc_id),
b AS (SELECT greatest(5, ceil(count(*) * 0.005)) AS enough FROM l),
o AS (SELECT token, count(*) AS n, count(*) FILTER (blocked) AS hits FROM (SELECT blocked, unnest(tokens) AS token FROM l) GROUP BY token),
p AS (
  SELECT row, y.token, row_number() OVER (PARTITION BY row ORDER BY hits / n DESC, n DESC, y.token) AS place
  FROM (SELECT row, unnest(tokens) AS token FROM l WHERE blocked) y JOIN o ON y.token = o.token WHERE hits >= (SELECT enough FROM b)),
k AS (SELECT row, list(token ORDER BY token) AS best FROM p WHERE place <= 8 GROUP BY row),
g AS (
  SELECT items FROM (SELECT [best[i] FOR i IN range(1, len(best) + 1) IF (mask >> (i - 1)) & 1 = 1] AS items FROM k, range(1, 256) r(mask) WHERE mask < 1 << len(best))
  GROUP BY items HAVING count(*) >= (SELECT enough FROM b)),
c AS (
  SELECT items, count(*) AS n, count(*) FILTER (blocked) AS hits FROM g, l WHERE list_has_all(tokens, items)
  GROUP BY items HAVING count(*) FILTER (blocked) >= (SELECT enough FROM b) AND count(*) FILTER (blocked) * 10 >= count(*) * 8),
r AS (
  SELECT items, n, hits FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c q WHERE len(q.items) < len(c.items) AND list_has_all(c.items, q.items) AND q.hits * c.n >= c.hits * q.n)),
w AS (
  SELECT x.*, CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                   WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                   WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                   WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                   WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM x),
v AS (
  SELECT row, first(array_to_string(items, ' ') ORDER BY hits / n DESC, hits DESC, array_to_string(items, ' ')) AS because
  FROM w JOIN r ON list_has_all(tokens, items) WHERE rule IS NULL GROUP BY row)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR because IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, because
FROM w LEFT JOIN v ON w.row = v.row
"""

ORACLES: dict[str, str] = {"op3_warc_archive": OP3_SQL, "op12_filter_audit": OP12_SQL, "op13_url_filters": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
