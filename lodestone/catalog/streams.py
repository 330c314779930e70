"""Batch forms of the stream rules; tests hold the streaming forms against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.sources import files
from lodestone.streaming import rules, throttle


@query(
    "throttle_events",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts FROM events), a AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM e GROUP BY user_id
    UNION ALL SELECT e.user_id, arg_min(e.event_id, (e.ts, e.event_id)), min(e.ts) FROM a JOIN e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 6 HOUR GROUP BY e.user_id) SELECT user_id, event_id FROM a""",
)
def _(spark, d):
    """ST2: users with very many events are spread over tasks."""
    return throttle.throttled_any(read(spark, d, "events"), "user_id", "ts", "event_id", 6 * 3600)


@query(
    "stability_gate",
    """WITH p AS (SELECT user_id AS path, event_id AS attempt, (value::bigint // 60) AS size FROM events), r AS (SELECT *, CASE WHEN size IS NOT DISTINCT FROM lag(size) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM p WINDOW w AS (PARTITION BY path ORDER BY attempt)),
    s AS (SELECT *, sum(nw) OVER (PARTITION BY path ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS run FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY path, run ORDER BY attempt) AS n FROM s)
    SELECT path, min(attempt) AS stable_at FROM t WHERE size > 0 AND n > 2 GROUP BY path""",
)
def _(spark, d):
    """ST4."""
    polls = read(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("attempt"), F.floor(F.round("value").cast("long") / 60).alias("size"))
    return rules.stable(polls, "path", "attempt", "size")


@query(
    "settled_files",
    """WITH p AS (SELECT user_id AS path, event_id, ts, round(value)::bigint // 60 AS size FROM events), c AS (SELECT * FROM p QUALIFY size IS DISTINCT FROM lag(size) OVER (PARTITION BY path ORDER BY ts, event_id)),
    n AS (SELECT path, size, epoch_us(ts) // 1000 + 3600000 AS passed_ms, lead(epoch_us(ts)) OVER (PARTITION BY path ORDER BY ts, event_id) AS next FROM c)
    SELECT path, size, passed_ms FROM n WHERE size > 0 AND (next IS NULL OR passed_ms * 1000 <= next)""",
)
def _(spark, d):
    """ST4: a size stands when it has not changed for an hour; the stream form lets a file pass by a timer."""
    seen = read(spark, d, "events").select(F.col("user_id").alias("path"), "event_id", "ts", F.floor(F.round("value").cast("long") / 60).alias("size"))
    return rules.settled(seen, "path", "ts", "event_id", "size", 3_600_000)


@query(
    "live_log_admit",
    """SELECT event_id FROM (SELECT *, coalesce(last_value(CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR event_type = 'signup' AS o FROM events) WHERE o OR event_type = 'error'""",
)
def _(spark, d):
    """ST8."""
    kind = F.col("event_type")
    return rules.admitted(read(spark, d, "events"), "user_id", "ts", "event_id", kind == "signup", kind == "purchase", kind == "error").select("event_id")


@query("bounded_queue_tail", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def _(spark, d):
    """ST6."""
    return rules.newest(read(spark, d, "events"), "user_id", "event_id", 10).select("user_id", "event_id")


@query("node_latency", "SELECT user_id, event_type, count(*) AS events, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS span_ms FROM events GROUP BY ALL")
def _(spark, d):
    """ST10."""
    return rules.node_latency(read(spark, d, "events"), ["user_id", "event_type"], "ts")


@query(
    "recover_jobs",
    "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS attempt, 'QUEUED' AS status FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey % 5 <> 0 AND o_custkey IN (SELECT doc_id FROM documents)",
)
def _(spark, d):
    """ST9."""
    status = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETE")
    jobs = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("document_id"), status.alias("status"), F.when(F.col("o_custkey") % 5 == 0, 1).alias("cancel_requested"), F.lit(1).alias("attempt"))
    return rules.recoverable(jobs, read(spark, d, "documents").select(F.col("doc_id").alias("document_id"))).select("job_id", "attempt", "status")


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    """Extension."""
    return rules.tumbling(read(spark, d, "events"), "ts", "1 day", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "session_windows",
    "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY user_id, s",
)
def _(spark, d):
    """Extension: sessions end after two quiet hours."""
    sessions = read(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("merge_pages", "SELECT conv_id, string_agg('<!-- page ' || turn || ' -->' || chr(10) || CASE WHEN trim(text) = '' THEN '[unclear]' ELSE trim(text) END, chr(10) || chr(10) ORDER BY turn, text) AS markdown FROM conversations GROUP BY conv_id")
def _(spark, d):
    """SC12."""
    return files.pages_to_markdown(read(spark, d, "conversations"), ["turn", "text"], "text", "conv_id")


@query("rows_to_table", "SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_name) AS md FROM nation GROUP BY n_regionkey")
def _(spark, d):
    """SC11."""
    rows = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array("n_name", F.col("n_nationkey").cast("string")))).alias("r"))
    head = F.array(F.array(F.lit("name"), F.lit("key")))
    return rows.select("n_regionkey", files.rows_to_table(F.concat(head, F.col("r"))).alias("md"))
