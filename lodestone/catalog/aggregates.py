"""Roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.operators import aggregates as op
from lodestone.operators import reconcile

STATUS = """CASE WHEN user_id % 17 = 0 THEN 'INDEXED' WHEN user_id % 17 = 1 THEN 'REVIEW_REJECTED' WHEN user_id % 17 = 2 THEN 'CANCELLED'
 WHEN user_id % 17 = 3 AND event_id % 2 = 0 THEN 'CANCELLED' WHEN user_id % 17 IN (3, 4) THEN CASE WHEN event_id % 3 = 0 THEN 'INDEXED' ELSE 'PARSE_FAILED' END
 WHEN user_id % 17 = 5 THEN 'CHUNK_FAILED' WHEN user_id % 17 = 6 THEN CASE event_type WHEN 'error' THEN 'NORMALIZE_FAILED' WHEN 'view' THEN 'INDEXED' ELSE 'PARSE_RUNNING' END
 WHEN user_id % 17 = 7 THEN CASE event_type WHEN 'click' THEN 'CHUNK_RUNNING' ELSE 'REVIEW_PENDING' END WHEN user_id % 17 = 8 THEN CASE event_type WHEN 'click' THEN 'NORMALIZE_RUNNING' ELSE 'REVIEW_PENDING' END
 WHEN user_id % 17 = 9 THEN CASE event_type WHEN 'click' THEN 'NORMALIZE_PENDING' ELSE 'PARSE_PENDING' END WHEN user_id % 17 = 10 THEN 'PARSE_PENDING' WHEN user_id % 17 = 11 THEN NULL ELSE 'UPLOADED' END"""


def statuses(spark, d):
    return read(spark, d, "events").withColumn("status", F.expr(STATUS))


@query("stats_counts", "SELECT count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars > 2000) AS long_documents, coalesce(sum(n_chars // 4), 0)::bigint AS tokens, coalesce(sum(n_chars), 0)::bigint AS chars FROM documents")
def _(spark, d):
    """A1, A16."""
    return read(spark, d, "documents").agg(F.count("*").alias("documents"), op.count_if(F.col("lang") == "en").alias("english"), op.count_if(F.col("n_chars") > 2000).alias("long_documents"), F.coalesce(F.sum(F.expr("n_chars div 4")), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("chunk_stats", "SELECT count(*) AS chunks, count(DISTINCT source) AS documents, round(avg(n_chars), 6) AS mean_chars, round(avg(n_chars // 4), 6) AS mean_tokens, sum(n_chars)::bigint AS chars FROM documents")
def _(spark, d):
    """A2."""
    return read(spark, d, "documents").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("documents"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.avg(F.expr("n_chars div 4")), 6).alias("mean_tokens"), F.sum("n_chars").alias("chars"))


@query("group_count_by_model", "SELECT event_type AS model, count(*) AS chunks FROM events GROUP BY 1 ORDER BY chunks DESC, model")
def _(spark, d):
    """A3."""
    return read(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "model")


@query("doc_type_breakdown", "SELECT coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE lang END, ''), CASE WHEN doc_id % 2 = 0 THEN source END, 'unknown') AS doc_type, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    """A4."""
    lang = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("lang"))
    return read(spark, d, "documents").groupBy(F.coalesce(F.nullif(lang, F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"))


@query("chunks_per_file", "SELECT source AS filename, count(*) AS chunks, arg_min(lang, doc_id) AS doc_type FROM documents GROUP BY source ORDER BY source")
def _(spark, d):
    """A5."""
    return read(spark, d, "documents").groupBy(F.col("source").alias("filename")).agg(F.count("*").alias("chunks"), F.min_by("lang", "doc_id").alias("doc_type")).orderBy("filename")


@query("legacy_rollup", "SELECT source AS filename, count(*) AS chunk_count, string_agg(DISTINCT lang, ',' ORDER BY lang) AS aliases, arg_min(lang, (length(text), doc_id)) AS shortest, arg_min(doc_id, doc_id) FILTER (WHERE lang <> 'en') AS first_other FROM documents GROUP BY source")
def _(spark, d):
    """A6."""
    return read(spark, d, "documents").groupBy(F.col("source").alias("filename")).agg(F.count("*").alias("chunk_count"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("aliases"), F.min_by("lang", F.struct(F.length("text"), "doc_id")).alias("shortest"), F.min(F.when(F.col("lang") != "en", F.col("doc_id"))).alias("first_other"))


@query(
    "batch_status_rollup",
    f"""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE s = 'INDEXED') AS indexed, count(*) FILTER (WHERE ends_with(s, '_FAILED')) AS failed,
    count(*) FILTER (WHERE (ends_with(s, '_RUNNING') OR ends_with(s, '_PENDING')) AND s <> 'REVIEW_PENDING') AS in_progress, count(*) FILTER (WHERE s = 'REVIEW_PENDING') AS pending_review
    FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY user_id""",
)
def _(spark, d):
    """A7."""
    return op.status_counts(statuses(spark, d), "user_id")


_T = "s IN ('INDEXED', 'REVIEW_REJECTED', 'CANCELLED', 'PARSE_FAILED', 'NORMALIZE_FAILED', 'CHUNK_FAILED')"


@query(
    "derive_batch_status",
    f"""SELECT user_id, CASE WHEN count(s) = 0 THEN 'DRAFT' WHEN bool_and(coalesce(s = 'INDEXED', false)) THEN 'COMPLETE' WHEN bool_and(coalesce(s = 'REVIEW_REJECTED', false)) THEN 'FAILED' WHEN bool_and(coalesce(s = 'CANCELLED', false)) THEN 'CANCELLED'
    WHEN bool_or(coalesce(s = 'CANCELLED', false)) AND bool_and(coalesce({_T}, false)) THEN 'CANCELLED' WHEN bool_and(coalesce(ends_with(s, '_FAILED'), false)) THEN 'FAILED' WHEN bool_and(coalesce({_T}, false)) AND bool_or(coalesce(s = 'INDEXED', false)) THEN 'PARTIALLY_COMPLETE'
    WHEN bool_or(coalesce(s = 'INDEXED', false)) AND bool_or(coalesce(ends_with(s, '_FAILED'), false)) THEN 'PARTIALLY_COMPLETE' WHEN bool_or(coalesce(starts_with(s, 'CHUNK'), false)) THEN 'CHUNKING' WHEN bool_or(coalesce(starts_with(s, 'REVIEW'), false)) THEN 'REVIEW_PENDING'
    WHEN bool_or(coalesce(starts_with(s, 'NORMALIZE'), false)) THEN 'NORMALIZING' WHEN bool_or(coalesce(starts_with(s, 'PARSE'), false)) THEN 'PARSING' ELSE 'SUBMITTED' END AS status
    FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY user_id""",
)
def _(spark, d):
    """A8, A12."""
    return statuses(spark, d).groupBy("user_id").agg(op.batch_status(F.col("status")).alias("status"))


@query("completion_time", "SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN NULL WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS completed_at FROM orders")
def _(spark, d):
    """A9."""
    old = F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus"))
    return read(spark, d, "orders").select("o_orderkey", op.completion_time(old, F.col("o_orderstatus"), F.col("o_orderdate"), F.lit("2030-01-01").cast("timestamp"), ["F", "P"]).cast("timestamp_ntz").alias("completed_at"))


@query("distinct_label", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'mix' ELSE max(o_orderstatus) || '_docs' END AS label FROM orders GROUP BY o_custkey")
def _(spark, d):
    """A10."""
    return read(spark, d, "orders").groupBy("o_custkey").agg(op.kind_label(F.col("o_orderstatus")).alias("label"))


@query("distinct_files", "SELECT DISTINCT source AS filename FROM documents ORDER BY 1")
def _(spark, d):
    """A11."""
    return read(spark, d, "documents").select(F.col("source").alias("filename")).distinct().orderBy("filename")


@query("extension_summary", "SELECT count(*) AS files, count(*) FILTER (WHERE url LIKE 'https:%') AS secure, count(*) FILTER (WHERE contains(url, '?')) AS with_query, sum(strlen(html))::bigint AS bytes FROM pages")
def _(spark, d):
    """A13."""
    return read(spark, d, "pages").agg(F.count("*").alias("files"), op.count_if(F.col("url").startswith("https:")).alias("secure"), op.count_if(F.contains("url", F.lit("?"))).alias("with_query"), F.sum(F.octet_length("html")).alias("bytes"))


@query(
    "vector_stats_detail",
    """SELECT s.n AS store_chunks, m.n AS mirror_chunks, m.docs AS documents, round(coalesce(s.n / nullif(m.docs, 0), 0), 6) AS mean_chunks, CASE WHEN m.n > 0 AND s.n <> m.n THEN 'mirror_mismatch' END AS warning
    FROM (SELECT count(*) AS n FROM embeddings) s, (SELECT count(*) AS n, count(DISTINCT source) AS docs FROM documents) m""",
)
def _(spark, d):
    """Two one-row aggregates side by side."""
    store = read(spark, d, "embeddings").agg(F.count("*").alias("store_chunks"))
    mirror = read(spark, d, "documents").agg(F.count("*").alias("mirror_chunks"), F.count_distinct("source").alias("documents"))
    both = store.crossJoin(mirror)
    warning = F.when((F.col("mirror_chunks") > 0) & (F.col("store_chunks") != F.col("mirror_chunks")), "mirror_mismatch")
    return both.select("store_chunks", "mirror_chunks", "documents", F.round(F.coalesce(F.try_divide("store_chunks", "documents"), F.lit(0)), 6).alias("mean_chunks"), warning.alias("warning"))


@query(
    "stage_funnel",
    f"SELECT user_id, count(*) FILTER (WHERE s NOT IN ('UPLOADED', 'PARSE_PENDING', 'PARSE_RUNNING')) AS parsed, count(*) FILTER (WHERE s IN ('INDEXED', 'REVIEW_PENDING', 'REVIEW_REJECTED', 'CHUNK_RUNNING', 'CHUNK_FAILED')) AS normalised, count(*) FILTER (WHERE s = 'INDEXED') AS indexed FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY user_id",
)
def _(spark, d):
    """A15."""
    s = F.col("status")
    return statuses(spark, d).groupBy("user_id").agg(op.count_if(~s.isin("UPLOADED", "PARSE_PENDING", "PARSE_RUNNING")).alias("parsed"), op.count_if(s.isin("INDEXED", "REVIEW_PENDING", "REVIEW_REJECTED", "CHUNK_RUNNING", "CHUNK_FAILED")).alias("normalised"), op.count_if(s == "INDEXED").alias("indexed"))


@query("argmax_dominant_group", "SELECT lang, arg_max(source, (n, best, source)) AS dominant FROM (SELECT lang, source, count(*) AS n, max(n_chars) AS best FROM documents GROUP BY ALL) GROUP BY lang")
def _(spark, d):
    """A17."""
    groups = read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("n_chars").alias("best"))
    return groups.groupBy("lang").agg(F.max_by("source", F.struct("n", "best", "source")).alias("dominant"))


@query("latency_summary", "SELECT event_type, min(ms) AS best, max(ms) AS worst, floor(avg(ms))::bigint AS mean, count(*) FILTER (WHERE ms <= 5000) AS within_5s, count(*) FILTER (WHERE ms <= 7000) AS within_7s FROM (SELECT event_type, nullif(CAST(floor(value * 100) AS BIGINT), 0) AS ms FROM events WHERE value >= 0) GROUP BY 1")
def _(spark, d):
    """A18."""
    return read(spark, d, "events").where("value >= 0").groupBy("event_type").agg(*op.latency(F.floor(F.col("value") * 100)))


@query("check_totals", "SELECT event_type, count(*) AS turns, sum(passed)::bigint AS passed, sum(n)::bigint AS total, count(*) FILTER (WHERE passed < n) AS failed_turns FROM (SELECT event_type, user_id, count(*) FILTER (WHERE value > 20) AS passed, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    """A19."""
    turns = read(spark, d, "events").groupBy("event_type", "user_id").agg(op.count_if(F.col("value") > 20).alias("passed"), F.count("*").alias("n"))
    return turns.groupBy("event_type").agg(F.count("*").alias("turns"), F.sum("passed").alias("passed"), F.sum("n").alias("total"), op.count_if(F.col("passed") < F.col("n")).alias("failed_turns"))


@query(
    "sequence_gap_detect",
    "SELECT user_id, len(a) >= 6 AND list_min(a) IN (1, 2) AND list_max(a) - list_min(a) >= 5 AND len(list_filter(range(list_min(a), list_max(a) + 1), lambda x: NOT list_contains(a, x))) > 0 AS gap FROM (SELECT user_id, list_distinct(list((event_id % 40)::bigint)) AS a FROM events GROUP BY 1)",
)
def _(spark, d):
    """A20."""
    return read(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 40).alias("a")).select("user_id", op.has_gap(F.col("a")).alias("gap"))


@query("ordered_string_agg", "SELECT conv_id, string_agg(role || '#' || turn, ' > ' ORDER BY turn, role) AS path FROM conversations GROUP BY conv_id")
def _(spark, d):
    """A21, SC12."""
    turns = read(spark, d, "conversations").withColumn("step", F.concat_ws("#", "role", F.col("turn").cast("string")))
    return turns.groupBy("conv_id").agg(op.joined_in_order("step", ["turn", "role"], " > ").alias("path"))


@query("rollup_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    """Extension: grouping sets."""
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("duration_ms", "SELECT user_id, event_id, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS duration_ms FROM events")
def _(spark, d):
    """Z1, Z2."""
    ms = F.unix_millis("ts")
    return read(spark, d, "events").select("user_id", "event_id", F.coalesce(ms - F.lag(ms).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0)).alias("duration_ms"))


@query(
    "mirror_difference",
    """WITH m AS (SELECT doc_id, CASE WHEN quality = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality, toxic FROM labels) USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
    b AS (SELECT doc_id, n_chars, 1 AS s FROM documents UNION ALL SELECT doc_id, n_chars, -1 FROM m)
    SELECT doc_id, n_chars, CASE WHEN sum(s) > 0 THEN 'left' ELSE 'right' END AS side, abs(sum(s))::bigint AS times FROM b GROUP BY doc_id, n_chars HAVING sum(s) <> 0""",
)
def _(spark, d):
    """Documents against a mirror that lost the toxic ones and has another length of those of no quality."""
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    marks = read(spark, d, "labels").select("doc_id", "quality", "toxic").distinct()
    mirror = docs.join(marks, "doc_id", "left").where("coalesce(toxic, 0) <> 1").select("doc_id", F.expr("CASE WHEN quality = 0 THEN n_chars + 1 ELSE n_chars END").alias("n_chars"))
    return reconcile.differing(docs, mirror, ["doc_id", "n_chars"])
