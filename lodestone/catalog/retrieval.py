"""Search, hybrid retrieval, understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.functions import scoring as sc
from lodestone.functions import text as fn
from lodestone.operators import scans
from lodestone.operators import windows as op
from lodestone.plans import quantised
from lodestone.plans import retrieval as plan
from lodestone.plans import understanding as know

SIM = "list_cosine_similarity(q.embedding::double[], v.embedding::double[])"
TOK = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9&./-]*')"


def questions(spark, d):
    """Every fiftieth vector, against all."""
    return read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vector"))


@query("knn_cosine_topk", f"SELECT qid, vec_id, rank, round(score, 6) AS vector_score FROM (SELECT q.vec_id AS qid, v.vec_id, greatest(0, {SIM}) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, {SIM}) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 10")
def _(spark, d):
    """J5, S1, W3."""
    return plan.knn(questions(spark, d), read(spark, d, "embeddings").select("vec_id", "embedding"), 10).select("qid", "vec_id", "rank", F.round("vector_score", 6).alias("vector_score"))


@query("knn_quantised")
def _(spark, d):
    """J5 at scale: codes of a byte for four numbers, and an exact rerank; a test holds its recall against the exact search."""
    index = quantised.build(read(spark, d, "embeddings"), "vec_id", "embedding")
    found = quantised.search(index, questions(spark, d))
    return found.select("qid", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("vector_score"))


@query("knn_filtered_topk", f"SELECT qid, vec_id, rank FROM (SELECT q.vec_id AS qid, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, {SIM}) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.label IN (1, 2)) WHERE rank <= 3")
def _(spark, d):
    """Filtered before the search."""
    return plan.knn(questions(spark, d), read(spark, d, "embeddings"), 3, keep=F.col("label").isin(1, 2)).select("qid", "vec_id", "rank")


@query("knn_planned_targets", f"SELECT qid, vec_id, rank FROM (SELECT q.vec_id AS qid, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, {SIM}) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND (q.vec_id % 100 = 0 OR q.label = v.label)) WHERE rank <= 3")
def _(spark, d):
    """Plan rows with and without a target."""
    q = read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vector"), F.when(F.col("vec_id") % 100 != 0, F.col("label")).alias("target"))
    return plan.knn(q, read(spark, d, "embeddings").withColumnRenamed("label", "filename"), 3).select("qid", "vec_id", "rank")


@query(
    "hybrid_topk",
    f"""WITH q AS (SELECT e.vec_id AS qid, e.embedding, list_distinct(list_filter({TOK.format('d.text')}, lambda x: length(x) > 2)) AS toks FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 50 = 0),
    cand AS (SELECT q.qid, v.vec_id, d.source, d.text, q.toks, greatest(0, {SIM}) AS sim FROM q, embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE length(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) >= 40),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS n FROM cand) WHERE n <= 40),
    sc AS (SELECT *, round(sim + 0.45 * len(list_filter(toks, lambda t: contains(lower(text), t))) / greatest(len(toks), 1), 6) AS score FROM near),
    dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source, text[1:160] ORDER BY score DESC, sim DESC, vec_id) AS m FROM sc) WHERE m = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk FROM dd)
    SELECT qid, vec_id, score, rk AS rank, '[Source: ' || source || ' | Section: Root]' || chr(10) || text AS passage FROM r WHERE rk <= 5""",
)
def hybrid_topk(spark, d):
    """Flagship: nearest vectors, noise filter, hybrid score, dedupe, top five, envelope.

    The search goes over ids and vectors, with a flag for texts that are long enough; only texts found are joined.
    """
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    words = F.array_distinct(fn.tokens("text", 2))
    asked = vectors.where("vec_id % 50 = 0").join(docs, "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vector"), words.alias("words"))
    corpus = vectors.join(docs.where(F.length(fn.strip("text")) >= 40).select("vec_id"), "vec_id")
    near = plan.knn(asked.select("qid", "q_vector"), corpus, 40).drop("rank").join(docs, "vec_id").join(asked.select("qid", "words"), "qid")
    scored = near.withColumn("score", F.round(F.col("vector_score") + 0.45 * sc.share_contained(F.col("words"), F.lower("text")), 6))
    best = op.keep_best(scored.withColumn("_head", F.substring("text", 1, 160)), ["qid", "source", "_head"], ["score", "vector_score"], "vec_id")
    top = op.top_per_group(best, ["qid"], [F.desc("score"), F.asc("vec_id")], 5)
    return top.select("qid", "vec_id", "score", "rank", fn.envelope(F.col("source"), F.lit(None).cast("string"), F.col("text")).alias("passage"))


@query(
    "probe_rerank",
    f"""SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY final DESC, vec_id) AS rerank_rank FROM (SELECT q.vec_id AS qid, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0, {SIM}) DESC, v.vec_id) AS rank, round(greatest(0, {SIM}), 6) + 0.1 * (v.vec_id % 3) AS final FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 12
    QUALIFY rerank_rank <= 5""",
)
def _(spark, d):
    """A reranker sees twelve and keeps five; its score here is a stand-in."""
    found = plan.knn(questions(spark, d), read(spark, d, "embeddings").select("vec_id", "embedding"), 12)
    final = found.withColumn("final", F.round("vector_score", 6) + 0.1 * (F.col("vec_id") % 3)).drop("rank")
    return op.top_per_group(final, ["qid"], [F.desc("final"), F.asc("vec_id")], 5, "rerank_rank").select("qid", "vec_id", "rerank_rank")


@query("intro_lookup", "SELECT l.label AS target, v.vec_id, v.i AS chunk_index, 0.35::double AS score FROM (SELECT DISTINCT label FROM embeddings) l JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings) v ON v.label = l.label AND v.i < 2")
def _(spark, d):
    """J9."""
    chunks = scans.link_indices(read(spark, d, "embeddings").select("vec_id", F.col("label").alias("filename")), ["filename"], ["vec_id"]).select("vec_id", "filename", "chunk_index")
    targets = chunks.select(F.col("filename").alias("target")).distinct()
    return plan.intro_rows(targets, chunks).select("target", "vec_id", "chunk_index", "score")


@query("stitch_adjacent")
def _(spark, d):
    """Whole texts of each source, with a gap after every third."""
    chunks = scans.link_indices(read(spark, d, "documents").select("doc_id", F.col("source").alias("filename"), "text"), ["filename"], ["doc_id"])
    gaps = chunks.withColumns({"chunk_index": F.col("chunk_index") + F.floor(F.col("chunk_index") / 3).cast("int"), "qid": F.lit(0)})
    return plan.stitch(gaps).select("filename", "chunk_index", "stitched_from", "text")


@query("stitch_qna", "SELECT conv_id AS qa_pair_id, count(*) AS stitched_from, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    """T23."""
    return plan.stitch_pairs(read(spark, d, "conversations").select(F.col("conv_id").alias("qa_pair_id"), F.col("turn").alias("fragment_index"), "text"))


@query(
    "mention_join",
    """SELECT qid, filename, tier, row_number() OVER (PARTITION BY qid ORDER BY tier, length(filename) DESC, filename) AS rank FROM (SELECT qid, filename, CASE WHEN contains(q, '@' || lower(filename)) THEN 1 WHEN contains(q, lower(filename)) THEN 2 END AS tier
    FROM (SELECT DISTINCT source || '.md' AS filename FROM documents), (SELECT doc_id AS qid, lower('compare @' || source || '.md and src' || doc_id % 25 || '.md') AS q FROM documents)) WHERE tier IS NOT NULL""",
)
def _(spark, d):
    """J10, L11."""
    docs = read(spark, d, "documents")
    asked = docs.select(F.col("doc_id").alias("qid"), F.concat(F.lit("compare @"), "source", F.lit(".md and src"), (F.col("doc_id") % 25).cast("string"), F.lit(".md")).alias("question"))
    return know.mentions(asked, docs.select(F.concat("source", F.lit(".md")).alias("filename"))).where("tier < 3").select("qid", "filename", "tier", "rank")


@query(
    "named_doc_join",
    "SELECT qid, filename FROM (SELECT DISTINCT source || '.md' AS filename, source AS stem FROM documents), (SELECT doc_id AS qid, 'what does ' || source || ' say' AS q FROM documents) WHERE contains(' ' || regexp_replace(q, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || stem || ' ')",
)
def _(spark, d):
    """By stem."""
    docs = read(spark, d, "documents")
    asked = docs.select(F.col("doc_id").alias("qid"), F.concat(F.lit("what does "), "source", F.lit(" say")).alias("question"))
    return know.mentions(asked, docs.select(F.concat("source", F.lit(".md")).alias("filename"))).select("qid", "filename")


@query(
    "resolve_targets",
    """WITH f AS (SELECT DISTINCT source || '.md' AS filename FROM documents), t AS (SELECT unnest(['src3.md', 'SRC-4', 'the src5 file', 'zzz']) AS target),
    j AS (SELECT target, filename, regexp_replace(lower(regexp_replace(target, '\\.[A-Za-z0-9]+$', '')), '[^a-z0-9]+', '', 'g') AS a, regexp_replace(lower(regexp_replace(filename, '\\.[A-Za-z0-9]+$', '')), '[^a-z0-9]+', '', 'g') AS b FROM t, f)
    SELECT target, coalesce(arg_min(filename, (tier, filename)) FILTER (WHERE tier IS NOT NULL), target) AS resolved FROM (SELECT *, CASE WHEN target = filename THEN 1 WHEN a = b THEN 2 WHEN a <> '' AND (contains(a, b) OR contains(b, a)) THEN 3 END AS tier FROM j) GROUP BY target""",
)
def _(spark, d):
    """J11."""
    files = read(spark, d, "documents").select(F.concat("source", F.lit(".md")).alias("filename"))
    return know.resolve_target(spark.createDataFrame([("src3.md",), ("SRC-4",), ("the src5 file",), ("zzz",)], "target string"), files)


@query("acronym_semi_join", r"WITH a AS (SELECT DISTINCT lower(unnest(regexp_extract_all(regexp_replace(html, '[^ -~]', ' ', 'g'), '\b[A-Z][A-Z0-9&/-]{1,7}\b'))) AS acronym FROM pages), t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS acronym FROM benchmark) SELECT item_id, acronym FROM t WHERE acronym IN (SELECT acronym FROM a)")
def _(spark, d):
    """Question tokens that are acronyms of the corpus."""
    known = know.indexed_acronyms(read(spark, d, "pages").select(F.regexp_replace("html", "[^ -~]", " ").alias("t")), "t")
    asked = read(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("acronym"))
    return asked.join(known, "acronym", "left_semi").select("item_id", "acronym")


@query(
    "follow_up_queries",
    rf"""SELECT conv_id, turn, CASE WHEN (regexp_matches(lower(q), '\b(it|this|that|they|them|those|these|he|she|above|same|more)\b') OR len({TOK.format('q')}) < 4) AND p IS NOT NULL THEN p || ' ' || q ELSE q END AS asked FROM (SELECT *, lag(q) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS q FROM conversations WHERE role = 'user'))""",
)
def _(spark, d):
    """X11, J15."""
    from pyspark.sql import Window

    said = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "").alias("q"))
    return said.select("conv_id", "turn", know.follow_up(F.col("q"), F.lag("q").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("asked"))


@query("query_variants")
def _(spark, d):
    """X11: at most two forms of each question; a row each."""
    return read(spark, d, "benchmark").select("item_id", F.posexplode(know.variants(F.col("text")))).select("item_id", F.col("pos").alias("variant"), F.col("col").alias("question"))
