"""Filters, joins, pages, mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.operators import pages
from lodestone.operators import relational as op


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 32")
def _(spark, d):
    """SC1."""
    return read(spark, d, "orders").where("o_orderkey = 32").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("logs_filter_equal", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND user_id = 7")
def _(spark, d):
    """F1."""
    return read(spark, d, "events").where(op.where({"event_type": "error", "user_id": 7})).select("event_id", "user_id", "event_type")


@query("logs_filter_in_ilike", "SELECT event_id, event_type, props FROM events WHERE event_type IN ('error', 'click') AND (coalesce(props, '') ILIKE '%1_%' OR coalesce(event_type, '') ILIKE '%1_%')")
def _(spark, d):
    """F2, F3."""
    return read(spark, d, "events").where(op.in_list("event_type", " error, ,click") & op.like_any(["props", "event_type"], "1_")).select("event_id", "event_type", "props")


@query("logs_page_offset", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view' ORDER BY ts DESC NULLS LAST, event_id LIMIT 25 OFFSET 50")
def _(spark, d):
    """L1, L5."""
    return op.page(read(spark, d, "events").where("event_type = 'view'"), [F.desc("ts"), F.asc("event_id")], 3, 25).select("event_id", "user_id", "event_type")


@query("logs_page_total", "SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id LIMIT 10")
def _(spark, d):
    """L1 with L4 put right: the total counts all matches."""
    return op.page_with_total(read(spark, d, "events").where("event_type = 'error'"), [F.desc("ts"), F.asc("event_id")], 1, 10).select("event_id", "total")


@query("doc_search_multi_field", "SELECT doc_id, source, lang FROM documents WHERE contains(lower(coalesce(source, '')), 'rc1') OR contains(lower(coalesce(lang, '')), 'rc1') OR contains(lower(coalesce(text, '')), 'rc1') OR contains(lower(coalesce(doc_id::varchar, '')), 'rc1')")
def _(spark, d):
    """F4, F5."""
    return read(spark, d, "documents").where(op.contains_any(["source", "lang", "text", "doc_id"], "RC1")).select("doc_id", "source", "lang")


@query("nullsafe_exists", "SELECT (SELECT count(*) > 0 FROM labels WHERE toxic IS NOT DISTINCT FROM 1 AND doc_id IS NOT NULL) AS found, (SELECT count(*) > 0 FROM labels WHERE toxic IS NOT DISTINCT FROM NULL) AS found_null")
def _(spark, d):
    """F6."""
    found = read(spark, d, "labels")
    return found.agg(F.coalesce(F.bool_or(F.col("toxic").eqNullSafe(1) & F.col("doc_id").isNotNull()), F.lit(False)).alias("found"), F.coalesce(F.bool_or(F.col("toxic").eqNullSafe(None)), F.lit(False)).alias("found_null"))


@query("flag_filter", "SELECT doc_id, quality FROM labels WHERE NOT (toxic = 1)")
def _(spark, d):
    """F7."""
    return read(spark, d, "labels").where(~(F.col("toxic") == 1)).select("doc_id", "quality")


@query("metadata_where", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5) AND (vec_id < 100 OR vec_id >= 300) AND label <> 3")
def _(spark, d):
    """F8."""
    clause = {"$and": [{"label": {"$in": [1, 3, 5]}}, {"$or": [{"vec_id": {"$lt": 100}}, {"vec_id": {"$gte": 300}}]}, {"label": {"$ne": 3}}]}
    return read(spark, d, "embeddings").where(op.where(clause)).select("vec_id", "label")


@query("min_length_filter", r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 40")
def _(spark, d):
    """F9, as its complement: what is noise."""
    return read(spark, d, "documents").where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) < 40).select("doc_id")


@query("json_extract_filter", "SELECT event_id, props::JSON ->> '$.k' AS k, (props::JSON ->> '$.k') IS NOT NULL AS has_k, json_valid(coalesce(props, '')) AS valid FROM events")
def _(spark, d):
    """SC2, N3."""
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", k.alias("k"), k.isNotNull().alias("has_k"), F.try_parse_json(F.coalesce("props", F.lit(""))).isNotNull().alias("valid"))


@query("fallback_projection", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), c_name) AS label FROM customer")
def _(spark, d):
    """F14, F15."""
    rows = read(spark, d, "customer").withColumn("segment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    return rows.select("c_custkey", op.first_present("segment", "c_name").alias("label"))


@query("file_filter", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name, url ILIKE 'https%' AND NOT regexp_matches(url, '[#?]') AS taken FROM pages")
def _(spark, d):
    """F13, F16."""
    return read(spark, d, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("name"), (F.col("url").ilike("https%") & ~F.col("url").rlike("[#?]")).alias("taken"))


@query("config_overlay", "SELECT c_custkey, coalesce(CASE WHEN c_nationkey = 3 THEN 'qna' END, 'general') AS doc_type, 50 AS batch_size, c_mktsegment AS parser FROM customer")
def _(spark, d):
    """F17, F18."""
    rows = read(spark, d, "customer").withColumn("kind", F.when(F.col("c_nationkey") == 3, "qna"))
    return rows.select("c_custkey", *op.overlay({"doc_type": "general", "batch_size": 50, "parser": "docling"}, {"doc_type": "kind", "parser": "c_mktsegment"}))


@query("left_join_docs_labels", "SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en'")
def _(spark, d):
    """J1."""
    docs = read(spark, d, "documents").where("lang = 'en'").select("doc_id", "source")
    return docs.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("anti_join_unlabelled", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, d):
    """J3."""
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("semi_join_labelled", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def _(spark, d):
    """J12."""
    return read(spark, d, "documents").join(read(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("parent_child_nested", "SELECT o_orderkey, count(l_linenumber) AS n_lines, coalesce(string_agg(l_linenumber::varchar || ':' || l_linestatus, ',' ORDER BY l_linenumber, l_linestatus), '') AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(spark, d):
    """Orders with their lines, in order."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus")
    rows = op.nested(read(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linestatus"], ["l_linenumber"], "lines")
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_linestatus"])), ",")
    return rows.select("o_orderkey", F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.coalesce(text, F.lit("")).alias("lines"))


@query(
    "fallback_lookup_join",
    """WITH runs AS (SELECT o_custkey AS name, o_orderstatus AS path, o_orderdate AS age, o_orderkey AS run FROM orders),
    exact AS (SELECT name, path, arg_max(run, age) AS run FROM (SELECT name, path, age, max(run) AS run FROM runs GROUP BY ALL) GROUP BY ALL),
    newest AS (SELECT name, arg_max(run, (age, path, run)) AS run FROM runs GROUP BY name)
    SELECT c_custkey, coalesce(e.run, n.run) AS run FROM customer LEFT JOIN exact e ON e.name = c_custkey AND e.path = 'F' LEFT JOIN newest n ON n.name = c_custkey""",
)
def _(spark, d):
    """J4."""
    runs = read(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("path"), F.struct("o_orderdate", "o_orderstatus", "o_orderkey").alias("age"), F.col("o_orderkey").alias("run"))
    rows = read(spark, d, "customer").select(F.col("c_custkey"), F.col("c_custkey").alias("name"), F.lit("F").alias("path"))
    return op.exact_else_newest(rows, runs, "name", "path", "age", "run").select("c_custkey", "run")


@query(
    "upsert_latest",
    """WITH cur AS (SELECT doc_id, quality, toxic FROM labels), new AS (SELECT doc_id, 1 AS quality, 9 AS toxic FROM documents WHERE lang = 'fr')
    SELECT coalesce(c.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, c.quality) AS quality, coalesce(c.toxic, n.toxic) AS toxic FROM cur c FULL JOIN new n ON c.doc_id = n.doc_id""",
)
def _(spark, d):
    """SK5: the first toxic flag is kept, the quality is updated."""
    fresh = read(spark, d, "documents").where("lang = 'fr'").select("doc_id", F.lit(1).alias("quality"), F.lit(9).alias("toxic"))
    return op.upsert(read(spark, d, "labels").select("doc_id", "quality", "toxic"), fresh, ["doc_id"], ["toxic"])


@query("insert_or_ignore", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 0 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, d):
    """SK6."""
    return op.insert_or_ignore(read(spark, d, "labels").select("doc_id", "quality"), read(spark, d, "documents").select("doc_id", F.lit(0).alias("quality")), ["doc_id"])


@query("replace_by_key", "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 7 <> 0 UNION ALL SELECT DISTINCT conv_id, 0, 'summary' FROM conversations WHERE conv_id % 7 = 0")
def _(spark, d):
    """SK4."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role")
    fresh = turns.where("conv_id % 7 = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("summary").alias("role")).distinct()
    return op.replace_by_key(turns, fresh, "conv_id")


@query("delete_by_predicate", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 30000)")
def _(spark, d):
    """SK2."""
    docs = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    return op.delete_where(docs, docs.where("n_chars > 30000"), "source").select("doc_id", "source")


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def _(spark, d):
    """SK10."""
    alive = read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return op.cascade(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), alive, "l_orderkey")


@query("cancel_jobs", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 AND s IN ('QUEUED', 'RUNNING') THEN 'CANCELLED' ELSE s END AS status, CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS cancel_requested FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'P' THEN 'RUNNING' ELSE 'COMPLETE' END AS s FROM orders)")
def _(spark, d):
    """SK7."""
    status = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETE")
    jobs = read(spark, d, "orders").select("o_orderkey", "o_custkey", status.alias("status"), F.lit(0).alias("cancel_requested"))
    return op.cancel_jobs(jobs, F.col("o_custkey") % 10 == 0).select("o_orderkey", "status", "cancel_requested")


_RULES = [("retry_parse", "PARSE_FAILED", "PARSE_PENDING"), ("reject", "REVIEW_PENDING", "REVIEW_REJECTED"), ("delete", "INDEXED", "DELETED")]
_STATUS = "CASE event_type WHEN 'error' THEN 'PARSE_FAILED' WHEN 'view' THEN 'REVIEW_PENDING' WHEN 'purchase' THEN 'INDEXED' ELSE 'UPLOADED' END"
_ACTION = "CASE user_id % 3 WHEN 0 THEN 'retry_parse' WHEN 1 THEN 'reject' ELSE 'delete' END"


@query(
    "guarded_transitions",
    f"""WITH r(action, f, t) AS (VALUES {', '.join(map(str, _RULES))}), e AS (SELECT event_id, {_STATUS} AS status, {_ACTION} AS action FROM events)
    SELECT event_id, e.action, status, t AS to_status, t IS NOT NULL AS accepted FROM e LEFT JOIN r ON e.action = r.action AND status = f""",
)
def _(spark, d):
    """SK9, SK16, SK17: accepted and refused commands."""
    rows = read(spark, d, "events").select("event_id", F.expr(_STATUS).alias("status"), F.expr(_ACTION).alias("action"))
    done, refused = op.transitions(rows.select("event_id", "status"), rows.select("event_id", "action"), spark.createDataFrame(_RULES, "action string, from_status string, to_status string"), "event_id")
    return done.withColumn("accepted", F.lit(True)).unionByName(refused.select("event_id", "action", "status", F.lit(None).cast("string").alias("to_status"), F.lit(False).alias("accepted")))


@query("fan_out_insert", "SELECT doc_id, unnest(CASE WHEN lang = 'de' THEN ['pdf', 'ocr'] ELSE ['docling'] END) AS parser FROM documents")
def _(spark, d):
    """SK15."""
    parsers = F.when(F.col("lang") == "de", F.array(F.lit("pdf"), F.lit("ocr")))
    return read(spark, d, "documents").select("doc_id", F.explode(F.coalesce(parsers, F.array(F.lit("docling")))).alias("parser"))


@query("append_with_parent_time", "SELECT conv_id, max(turn) AS last_turn, count(*) AS n_messages FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT DISTINCT conv_id, 1000 FROM conversations) GROUP BY conv_id")
def _(spark, d):
    """SK1, SK12, SK13: append, then the parent's time of change."""
    turns = read(spark, d, "conversations").select("conv_id", "turn")
    more = turns.select("conv_id", F.lit(1000).cast("long").alias("turn")).distinct()
    return turns.unionByName(more).groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_messages"))


@query(
    "selected_variant",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rk, event_id) AS n FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END AS rk FROM events) WHERE rk IS NOT NULL) WHERE n = 1",
)
def _(spark, d):
    """J16, SK14: by three tiers of priority."""
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 3).otherwise(0)
    return op.resolve_by_rank(read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], rank, F.asc("event_id"))


@query("set_difference_refresh", "SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND value >= 97 EXCEPT SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-16' AND value >= 97")
def _(spark, d):
    """Users with a high value in the second half of the month only."""
    high = read(spark, d, "events").where("value >= 97")
    return high.where("ts >= timestamp'2024-01-16'").select("user_id").distinct().join(high.where("ts < timestamp'2024-01-16'").select("user_id"), "user_id", "left_anti")


@query("union_admin_legacy", "SELECT * FROM (SELECT doc_id AS id, source AS name, 'admin' AS origin, n_chars AS amount FROM documents UNION ALL SELECT page_id, url, 'legacy', NULL FROM pages) ORDER BY coalesce(amount, 0) DESC, name DESC, id LIMIT 40")
def _(spark, d):
    """U1, U2, L3."""
    admin = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.lit("admin").alias("origin"), F.col("n_chars").alias("amount"))
    legacy = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"), F.lit("legacy").alias("origin"))
    return admin.unionByName(legacy, allowMissingColumns=True).orderBy(F.coalesce("amount", F.lit(0)).desc(), F.desc("name"), "id").limit(40)


@query("zip_positions", "SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS position, unnest(embedding)::double AS value FROM embeddings")
def _(spark, d):
    """Parallel arrays by position."""
    places = F.sequence(F.lit(1).cast("long"), F.size("embedding").cast("long"))
    values = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, d, "embeddings").where(F.size("embedding") > 0).select("vec_id", F.inline(F.arrays_zip(places.alias("position"), values.alias("value"))))


@query("list_capped", "SELECT *, count(*) OVER () AS total FROM (SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 200)")
def _(spark, d):
    """L2: the total is that of the rows returned."""
    return op.capped(read(spark, d, "events").where("event_type = 'error'"), [F.desc("ts"), F.asc("event_id")], 200).select("event_id", "user_id", "total")


@query(
    "partial_update",
    r"""SELECT doc_id, CASE WHEN n IS NULL THEN 'PENDING' ELSE n END AS status, CASE WHEN n IS NULL OR (n LIKE '%\_FAILED' ESCAPE '\' AND doc_id % 4 <> 1) THEN 'e' || doc_id WHEN doc_id % 4 = 1 THEN 'new' END AS error_summary, CASE WHEN n IS NOT NULL AND doc_id % 5 = 0 THEN 7 ELSE n_chars END AS chunk_count
    FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'PARSE_FAILED' ELSE 'INDEXED' END END AS n FROM documents)""",
)
def _(spark, d):
    """SK8."""
    docs = read(spark, d, "documents")
    rows = docs.select("doc_id", F.lit("PENDING").alias("status"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("error_summary"), F.col("n_chars").alias("chunk_count"))
    status = F.when(F.col("doc_id") % 2 == 0, "PARSE_FAILED").otherwise("INDEXED")
    changes = docs.where("doc_id % 3 = 0").select("doc_id", status.alias("status"), F.when(F.col("doc_id") % 4 == 1, "new").alias("error_summary"), F.when(F.col("doc_id") % 5 == 0, F.lit(7).cast("long")).alias("chunk_count"))
    return op.set_status(rows, changes, "doc_id")


MESSAGES = "SELECT row_number() OVER (ORDER BY conv_id, turn, role) AS id, conv_id AS session_id, conv_id % 7 AS owner, role FROM conversations"


def messages(spark, d):
    from pyspark.sql import Window

    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 7).alias("owner"), "turn", "role")
    return rows.withColumn("id", F.col("session_id") * 1000 + F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "role")))


@query("session_list", f"SELECT *, row_number() OVER (PARTITION BY owner ORDER BY session_id DESC) AS position FROM (SELECT owner, session_id, count(*) AS messages FROM ({MESSAGES}) GROUP BY owner, session_id)")
def _(spark, d):
    """SC13."""
    return op.sessions(messages(spark, d), "owner").select("owner", "session_id", "messages", "position")


@query("session_history", "SELECT event_id, user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.page') END AS page FROM events")
def _(spark, d):
    """SC13: every third message's JSON is broken off."""
    broken = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    rows = read(spark, d, "events").select("event_id", F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), broken.alias("thoughts"))
    return op.history(rows, "thoughts", "page string").select("event_id", "session_id", "position", F.col("thoughts.page").alias("page"))


@query("include_projection", "SELECT vec_id, label FROM embeddings")
def _(spark, d):
    """SC8: vectors are not read."""
    return op.including(read(spark, d, "embeddings"), "vec_id", ["label", "documents"])


@query("map_overlay", "SELECT doc_id, 'chunk=' || (doc_id % 5) || ',lang=' || CASE WHEN doc_id % 2 = 0 THEN 'over' ELSE lang END || ',source=' || source AS config FROM documents")
def _(spark, d):
    """The overlay wins, and markdown is left out."""
    base = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("markdown"), F.col("text"))
    over = F.map_filter(F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 2 == 0, "over"), F.lit("chunk"), (F.col("doc_id") % 5).cast("string")), lambda k, v: v.isNotNull())
    pairs = F.array_sort(F.transform(F.map_entries(op.overlaid(base, over, ["markdown"])), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return read(spark, d, "documents").select("doc_id", F.array_join(pairs, ",").alias("config"))


@query(
    "deep_page",
    """SELECT * FROM (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_type NULLS FIRST, value DESC NULLS LAST, event_id NULLS FIRST) AS position FROM events)
    WHERE (position - 1) // 50 = (SELECT count(*) // 100 FROM events)""",
)
def _(spark, d):
    """The page of 50 in the middle of all events."""
    events = read(spark, d, "events").select("event_id", "event_type", "value")
    order = [pages.By("event_type"), pages.By("value", descending=True), pages.By("event_id")]
    return pages.deep_page(events, order, events.count() // 100 + 1, 50)
