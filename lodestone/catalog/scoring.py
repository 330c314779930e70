"""Scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.functions import scoring as sc
from lodestone.functions import text as fn
from lodestone.plans import lexical

TOK = "list_filter(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9&./-]*'), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{x}'" for x in fn.STOP) + "], x))"


def questions(spark, d):
    """All benchmark items, whole; documents are dealt among them by doc_id."""
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("q"))
    docs = read(spark, d, "documents").select("doc_id", "text", "lang", "source").withColumn("item", F.pmod("doc_id", F.lit(q.count())))
    return docs.join(q, "item")


PAIRS_SQL = "(SELECT doc_id, d.text, lang, source, item_id, b.text AS q FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
NORM = "(' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')) || ' ')"


@query("query_coverage", f"SELECT doc_id, round(len(list_filter(t, lambda x: contains(lower(text), x))) / greatest(len(t), 1), 6) AS coverage FROM (SELECT *, list_filter({TOK.format('q')}, lambda x: length(x) >= 5) AS t FROM {PAIRS_SQL})")
def _(spark, d):
    """W10."""
    words = F.filter(fn.tokens("q", 2, fn.STOP), lambda x: F.length(x) >= 5)
    return questions(spark, d).select("doc_id", F.round(sc.share_contained(words, F.lower("text")), 6).alias("coverage"))


@query(
    "hybrid_score",
    f"""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.4 ELSE 0.4 + 0.45 * len(list_filter(w, lambda x: contains(hay, x))) / greatest(len(w), 1) + 0.06 * len(list_filter(w, lambda x: contains(title, x)))
    + CASE WHEN lang = 'en' AND len(list_filter(w, lambda x: contains(hay, x))) > 0 THEN 0.08 ELSE 0 END
    + CASE WHEN doc_id % 3 = 0 AND len(list_filter(w, lambda x: contains(hay, x))) > 0 THEN 0.18 ELSE 0 END
    - CASE WHEN doc_id % 7 = 0 AND len(list_filter(w, lambda x: contains(hay, x))) = 0 THEN 0.04 ELSE 0 END
    + CASE WHEN doc_id % 11 < 2 THEN 0.55 ELSE 0 END + least(0.45 * (doc_id % 4), 0.95) END, 6)::double AS score
    FROM (SELECT *, list_distinct({TOK.format("q || ' overview'")}) AS w, lower(source) AS title, lower(text) || ' ' || lower(source) AS hay FROM {PAIRS_SQL})""",
)
def _(spark, d):
    """S2."""
    kind = F.when(F.col("doc_id") % 3 == 0, "table_row").otherwise("section")
    score = sc.hybrid(F.concat("q", F.lit(" overview")), F.lit(0.4), F.col("text"), F.col("source"), F.when(F.col("lang") == "en", "qna").otherwise("general"), kind, F.col("doc_id") % 11, F.col("doc_id") % 7 == 0, (F.col("doc_id") % 4).cast("double"))
    return questions(spark, d).select("doc_id", F.round(score, 6).alias("score"))


_FORM = "CASE WHEN ends_with(t, 'ies') AND length(t) > 4 THEN t[1:length(t) - 3] || 'y' WHEN ends_with(t, 's') AND length(t) > 4 THEN t[1:length(t) - 1] ELSE t END"
_HAS = f"(contains(hay, ' ' || trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) || ' ') OR contains(hay, ' ' || trim(regexp_replace({_FORM}, '[^a-z0-9]+', ' ', 'g')) || ' '))"


@query(
    "lexical_score",
    f"""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda t: {_HAS})) / greatest(len(w), 1)
    + coalesce(list_sum(list_transform(p, lambda x: CASE WHEN contains(head, {NORM.format('x')}) THEN 1.3 WHEN contains(hay, {NORM.format('x')}) THEN 0.7 ELSE 0 END)), 0)
    + 0.55 * len(list_filter(w, lambda t: length(t) >= 5 AND {_HAS})) END, 6)::double AS score
    FROM (SELECT *, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM (SELECT doc_id, {TOK.format('lower(q)')} AS w, {NORM.format('source')} AS head, {NORM.format("source || chr(10) || text")} AS hay FROM {PAIRS_SQL}))""",
)
def _(spark, d):
    """S3; the questions are in lower case here, so none has an acronym."""
    return questions(spark, d).select("doc_id", F.round(sc.lexical(F.lower("q"), F.col("source"), F.col("text")), 6).alias("score"))


@query(
    "lexical_topk",
    f"""WITH p AS (SELECT item_id, text AS q, {TOK.format('text')} AS w, list_distinct(list_transform(regexp_extract_all(text, '\\b[A-Z][A-Z0-9&/-]{{1,7}}\\b'), lambda x: lower(x))) AS a FROM benchmark),
    d AS (SELECT doc_id, {NORM.format("coalesce(source, '')")} AS head, {NORM.format("concat_ws(chr(10), source, text)")} AS hay FROM documents),
    s AS (SELECT item_id, doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda t: {_HAS})) / greatest(len(w), 1)
    + coalesce(list_sum(list_transform(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda x: CASE WHEN contains(head, {NORM.format('x')}) THEN 1.3 WHEN contains(hay, {NORM.format('x')}) THEN 0.7 ELSE 0 END)), 0)
    + 0.55 * len(list_filter(w, lambda t: length(t) >= 5 AND {_HAS}))
    + coalesce(list_sum(list_transform(a, lambda x: CASE WHEN contains(head, {NORM.format('x')}) THEN 1.0 WHEN contains(hay, {NORM.format('x')}) THEN 0.5 ELSE 0 END)), 0) END, 6)::double AS score FROM p, d)
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
)
def _(spark, d):
    """Every benchmark item's best ten of all documents: up to a thousand items in one scan of the texts, more by an inverted index."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    found = lexical.top(read(spark, d, "documents"), "doc_id", "source", "text", asked)
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


@query(
    "rerank_blend",
    r"""SELECT doc_id, round(0.2 + 0.15 * n / greatest(len(w), 1) + 5.0 * n / greatest(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')), 1), 6)::double AS score FROM (SELECT *, len(list_filter(w, lambda x: contains(lower(text), x))) AS n FROM
    (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(q), '\s+'), lambda x: length(x) > 2) AS w FROM """ + PAIRS_SQL + "))",
)
def _(spark, d):
    """S4, F11."""
    return questions(spark, d).select("doc_id", F.round(sc.rerank(F.lit(0.2), F.col("q"), F.col("text")), 6).alias("score"))


@query("grounding_score", f"SELECT doc_id, len(list_filter(list_distinct({TOK.format('q')}), lambda x: contains(lower(text), x))) AS found FROM {PAIRS_SQL}")
def _(spark, d):
    """S9, S11."""
    return questions(spark, d).select("doc_id", sc.grounding(F.array_distinct(fn.tokens("q", 2, fn.STOP)), F.col("text")).cast("long").alias("found"))


@query("guardrail_route", "SELECT event_id, CASE WHEN value IS NULL OR value / 100 > 0.85 THEN 'chat' ELSE 'rag' END AS route FROM events")
def _(spark, d):
    """F12."""
    return read(spark, d, "events").select("event_id", sc.route(F.col("value") / 100).alias("route"))


@query("effective_top_k", r"SELECT conv_id, turn, role, CASE WHEN turn % 5 = 0 THEN 10 WHEN regexp_matches(lower(text || CASE WHEN turn % 2 = 0 THEN ' in detail' ELSE '' END), '\b(in detail|detailed|comprehensive|in depth|elaborate|step by step)\b') THEN 8 ELSE 5 END AS k FROM conversations")
def _(spark, d):
    """L7."""
    q = F.concat("text", F.when(F.col("turn") % 2 == 0, " in detail").otherwise(""))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", sc.effective_top_k(q, F.col("turn") % 5 == 0).alias("k"))


@query("fuzzy_tiers", "SELECT c_custkey, score FROM (SELECT c_custkey, CASE WHEN t = '12' THEN 10000.0 WHEN instr(t, '12') = 1 THEN 8000.0 - length(t) WHEN instr(t, '12') > 1 THEN 6500.0 - 8 * (instr(t, '12') - 1) - length(t) END::double AS score FROM (SELECT c_custkey, c_custkey::varchar AS t FROM customer)) WHERE score IS NOT NULL")
def _(spark, d):
    """S5, first three tiers."""
    names = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("t")).where(F.contains("t", F.lit("12")))
    return names.select("c_custkey", sc.fuzzy(F.lit("12"), F.col("t")).alias("score"))


@query("fuzzy_subsequence")
def _(spark, d):
    """Letters in order, not side by side."""
    return read(spark, d, "pages").select("page_id", sc.fuzzy(F.lit("exm com"), F.col("url")).alias("score")).where("score IS NOT NULL")


@query("fuzzy_file_match", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), 'e.*x.*c.*m')")
def _(spark, d):
    """S6."""
    return read(spark, d, "pages").where(F.lower("url").rlike("e.*x.*c.*m")).select("page_id")


@query("clamped_caps", "SELECT conv_id, turn, role, least(12, greatest(k * 2, k + 4)) AS per_query_targeted, least(18, greatest(k * 3, k + 4)) AS per_query_global, least(36, least(12, greatest(k * 2, k + 4)) * 3) AS pool FROM (SELECT *, turn + 1 AS k FROM conversations)")
def _(spark, d):
    """Caps on what each message may fetch, if it asks for as many as it has turns behind it and one."""
    k = F.col("turn") + 1
    targeted, everything = F.least(F.lit(12), F.greatest(k * 2, k + 4)), F.least(F.lit(18), F.greatest(k * 3, k + 4))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", targeted.alias("per_query_targeted"), everything.alias("per_query_global"), F.least(F.lit(36), targeted * 3).alias("pool"))


@query(
    "turn_checks",
    f"""WITH p AS (SELECT doc_id, lower(coalesce(text, '')) AS low, length(trim(coalesce(text, ''))) AS n, lang, source, list_distinct(list_filter({TOK.format('q')}, lambda x: length(x) >= 8)) AS must, list_distinct(list_filter({TOK.format('q')}, lambda x: length(x) = 5)) AS never FROM {PAIRS_SQL})
    SELECT doc_id, 'no_stream_error' AS name, NULL AS about, true AS passed FROM p UNION ALL SELECT doc_id, 'non_empty_answer', n::varchar, n >= CASE WHEN lang = 'chat' THEN 10 ELSE 40 END FROM p
    UNION ALL SELECT doc_id, 'expected_intent', lang, lang IN ('en', 'de') FROM p UNION ALL SELECT doc_id, 'expected_source', 'src1', source = 'src1' FROM p UNION ALL SELECT doc_id, 'forbidden_source_absent', 'src2', source <> 'src2' FROM p
    UNION ALL SELECT doc_id, 'required_term', x, contains(low, x) FROM (SELECT doc_id, low, unnest(must) AS x FROM p) UNION ALL SELECT doc_id, 'forbidden_term_absent', x, NOT contains(low, x) FROM (SELECT doc_id, low, unnest(never) AS x FROM p)""",
)
def _(spark, d):
    """Documents as answers to benchmark items: long words of the item are asked for, words of five letters are not to be there."""
    words = F.array_distinct(fn.tokens("q", 2, fn.STOP))
    spec = F.struct(
        F.array(F.lit("en"), F.lit("de")).alias("expected_intents"), F.array(F.lit("src1")).alias("expected_sources"), F.array(F.lit("src2")).alias("forbidden_sources"),
        F.filter(words, lambda x: F.length(x) >= 8).alias("required_terms"), F.filter(words, lambda x: F.length(x) == 5).alias("forbidden_terms"),
    )
    checks = sc.turn_checks(F.col("text"), F.col("lang"), F.array("source"), F.lit(None).cast("string"), spec)
    return questions(spark, d).select("doc_id", F.inline(checks))
