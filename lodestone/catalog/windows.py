"""Ranks, links, budgets, dedupe."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.operators import scans
from lodestone.operators import windows as op


@query("link_indices", "SELECT doc_id, i AS chunk_index, coalesce(lag(i) OVER w, -1) AS prev_index, coalesce(lead(i) OVER w, -1) AS next_index FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def _(spark, d):
    """W1."""
    return scans.link_indices(read(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"]).drop("source")


@query("fragment_totals", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS fragment_index, count(*) OVER (PARTITION BY l_orderkey) AS total_fragments, count(*) OVER (PARTITION BY l_orderkey) > 1 AS is_fragment FROM lineitem")
def _(spark, d):
    """W2."""
    return op.fragments(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query("rank_top_per_group", "SELECT * FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 5")
def _(spark, d):
    """W3, L10."""
    return op.top_per_group(read(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.asc("event_id")], 5).drop("value")


@query(
    "budget_prefix",
    """SELECT doc_id, source, length(CASE WHEN nth = 1 AND tokens > 700 THEN text[1:2800] || ' [truncated]' ELSE text END) AS n FROM (
    SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth
    FROM (SELECT *, greatest(1, length(text) // 4) AS tokens FROM documents)) WHERE upto <= 700 OR (nth = 1 AND tokens > 700)""",
)
def _(spark, d):
    """W5."""
    return op.budget_prefix(read(spark, d, "documents").select("doc_id", "source", "text"), ["source"], ["doc_id"], "text", 700).select("doc_id", "source", F.length("text").alias("n"))


@query("budget_suffix_history", "SELECT conv_id, turn FROM (SELECT *, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 300")
def _(spark, d):
    """W6."""
    return op.budget_suffix(read(spark, d, "conversations"), ["conv_id"], ["turn", "role"], "text", 300).select("conv_id", "turn")


@query("recent_user_questions", r"SELECT conv_id, string_agg(q, ' / ' ORDER BY turn) AS questions FROM (SELECT conv_id, turn, regexp_replace(trim(text[1:180]), '\s+', ' ', 'g') AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n BETWEEN 2 AND 3 GROUP BY conv_id")
def _(spark, d):
    """The two questions before the latest."""
    said = read(spark, d, "conversations").where("role = 'user'").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    text = F.regexp_replace(F.trim(F.substring("text", 1, 180)), r"\s+", " ")
    return said.where("n BETWEEN 2 AND 3").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("q")))), lambda x: x["q"]), " / ").alias("questions"))


@query("last_target_lookup", "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' AND turn % 3 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS target FROM conversations")
def _(spark, d):
    """J15, ST12."""
    value = F.when((F.col("role") == "user") & (F.col("turn") % 3 == 0), F.col("turn"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", op.last_before(value, ["conv_id"], ["turn", "role"], 8).alias("target"))


@query("score_threshold", "SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS best FROM events) WHERE best >= 60 OR user_id % 2 = 0")
def _(spark, d):
    """Without targets a weak best empties the query, with targets rows stay."""
    events = op.with_best(read(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value")
    return events.where("best >= 60 OR user_id % 2 = 0").select("user_id", "event_id")


@query("dedupe_keep_max", "SELECT source, doc_id, pos AS position FROM (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, text[1:160]) AS pos, row_number() OVER (PARTITION BY source, text[1:160] ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS n FROM documents) WHERE n = 1")
def _(spark, d):
    """D1."""
    docs = read(spark, d, "documents").select("source", "doc_id", "n_chars", F.substring("text", 1, 160).alias("head"))
    return op.keep_best(docs, ["source", "head"], ["n_chars"], "doc_id").select("source", "doc_id", "position")


@query("dedupe_text_prefix", r"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(text, '\s+', ' ', 'g')[1:500] ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def _(spark, d):
    """D2, U3."""
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 500)).alias("head"))
    return docs.groupBy("head").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("dedupe_ignore_case", "SELECT conv_id, count(DISTINCT lower(role || turn % 2)) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    """D3."""
    label = F.lower(F.concat("role", (F.col("turn") % 2).cast("string")))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct(label).alias("n"))


@query(
    "target_coverage_topn",
    """SELECT lang, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, CASE WHEN p THEN source END NULLS FIRST, CASE WHEN p THEN nth END NULLS FIRST, n_chars DESC, doc_id) AS rank FROM
    (SELECT *, nth <= 1 AS p FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS nth FROM documents))) WHERE rank <= 8""",
)
def _(spark, d):
    """The sources are the targets."""
    return op.target_coverage(read(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), "lang", "source", "n_chars", "doc_id", 8).select("lang", "doc_id", "rank")


@query(
    "source_precision",
    """WITH r AS (SELECT l_orderkey, l_suppkey::varchar AS src, l_quantity / 50.0 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem),
    s AS (SELECT l_orderkey, src, count(*) AS n, max(score) AS top FROM r WHERE score >= 0.65 GROUP BY ALL),
    dm AS (SELECT l_orderkey, arg_max(struct_pack(name := src, top := top), (n, top, src)) AS dom FROM s GROUP BY 1),
    j AS (SELECT r.*, dom, coalesce(src = dom.name, false) AS own FROM r LEFT JOIN dm USING (l_orderkey)),
    a AS (SELECT *, coalesce(dom.name <> '' AND count(*) FILTER (WHERE own) OVER (PARTITION BY l_orderkey) >= 2, false) AS app FROM j)
    SELECT l_orderkey, pos FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN app AND own THEN 0 ELSE 1 END, pos) AS rk FROM a WHERE NOT app OR own OR score >= dom.top - 0.08) WHERE rk <= 3""",
)
def _(spark, d):
    """S7."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("src"), (F.col("l_quantity") / 50.0).alias("score"), F.row_number().over(w).alias("pos"))
    return op.source_precision(rows, "l_orderkey", "src", "score", F.col("score") >= 0.65, "pos", 3).select("l_orderkey", "pos")


@query("token_intersection", "SELECT o_orderkey, list_sort(list_intersect(list_distinct(string_split(o_orderstatus || ' ' || o_custkey, ' ')), ['F', 'O', '37', '370'])) AS shared FROM orders")
def _(spark, d):
    """I1, U4."""
    words = F.split(F.concat_ws(" ", "o_orderstatus", F.col("o_custkey").cast("string")), " ")
    wanted = F.array_union(F.array(F.lit("F"), F.lit("O")), F.array(F.lit("37"), F.lit("370"), F.lit("F")))
    return read(spark, d, "orders").select("o_orderkey", F.array_sort(F.array_intersect(words, wanted)).alias("shared"))


@query(
    "neighbor_self_join",
    """WITH c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, length(text) AS n FROM documents),
    s AS (SELECT source, i, 0.5 AS score FROM c WHERE i % 5 = 0 AND n < 1200)
    SELECT DISTINCT c.source, c.i AS chunk_index, round(greatest(0, score - 0.06), 6)::double AS score FROM s JOIN c ON c.source = s.source AND (c.i = s.i - 1 OR c.i = s.i + 1) WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.source = c.source AND x.i = c.i)""",
)
def _(spark, d):
    """An equi-join on the exploded neighbours, without those already seen."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    chunks = scans.link_indices(docs, ["source"], ["doc_id"])
    seen = chunks.where("chunk_index % 5 = 0 AND n < 1200").withColumn("score", F.lit(0.5))
    wanted = seen.select("source", F.explode(F.array("prev_index", "next_index")).alias("chunk_index"), "score").where("chunk_index >= 0")
    found = wanted.join(seen.select("source", "chunk_index"), ["source", "chunk_index"], "left_anti").join(chunks.select("source", "chunk_index"), ["source", "chunk_index"])
    return found.select("source", "chunk_index", F.round(F.greatest(F.lit(0), F.col("score") - 0.06), 6).alias("score")).distinct()
