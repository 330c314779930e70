"""Text scalars and the planner's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.functions import text as fn
from lodestone.sources import office

STOP_SQL = "[" + ", ".join(f"'{x}'" for x in fn.STOP) + "]"


@query("tokenize", "SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9&./-]*') AS t FROM documents) WHERE len(t) > 0")
def _(spark, d):
    """X1."""
    return read(spark, d, "documents").select("doc_id", fn.tokens("text").alias("t")).where(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("keyword_query", f"SELECT item_id, list_aggregate(list_filter(t, lambda x, i: list_position(t, x) = i)[1:12], 'string_agg', ' ') AS q FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9&./-]*'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x)) AS t FROM benchmark)")
def _(spark, d):
    """X1, X11."""
    return read(spark, d, "benchmark").select("item_id", fn.keyword_query("text").alias("q"))


@query("estimate_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(spark, d):
    """X13."""
    return read(spark, d, "documents").select("doc_id", fn.estimated_tokens("text").alias("tokens"))


@query("word_count_unicode", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS words FROM documents")
def _(spark, d):
    """X7, X15."""
    return read(spark, d, "documents").select("doc_id", fn.word_count("text").cast("long").alias("words"))


@query("slugify_doc_id", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def _(spark, d):
    """X8."""
    return read(spark, d, "pages").select("page_id", fn.slug("url").alias("slug"))


@query("safe_names", r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9._ -]+', '_', 'g') AS name FROM pages")
def _(spark, d):
    """X8."""
    return read(spark, d, "pages").select("page_id", fn.safe_name("url").alias("name"))


@query("toc_slug", r"SELECT item_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g') AS anchor FROM benchmark")
def _(spark, d):
    """X7."""
    return read(spark, d, "benchmark").select("item_id", fn.anchor_slug("text").alias("anchor"))


@query(
    "html_strip",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\*\*|~~', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""",
)
def _(spark, d):
    """X2, SC9."""
    return read(spark, d, "pages").select("page_id", F.md5(fn.plain("html")).alias("text_md5"))


@query("html_markdown")
def _(spark, d):
    """SC9: pages as markdown, with headings, lists and tables."""
    pages = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    named = pages.withColumn("path", F.concat("path", F.lit(".html")))
    found = office.office_markdown(named)
    return found.select(F.regexp_extract("path", "^(.*).html$", 1).cast("long").alias("page_id"), "markdown", "error")


@query("shorten_titles", r"SELECT item_id, CASE WHEN length(text) <= 40 THEN text WHEN regexp_extract(text[1:41], '(?s)^(.*)\s', 1) <> '' THEN regexp_extract(text[1:41], '(?s)^(.*)\s', 1) ELSE text[1:40] END AS title FROM benchmark")
def _(spark, d):
    """X2, T5, L9."""
    return read(spark, d, "benchmark").select("item_id", fn.shortened("text", 40).alias("title"))


@query("strip_whitespace", r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM documents")
def _(spark, d):
    """Section 1.4: strip."""
    return read(spark, d, "documents").select("doc_id", F.length(fn.strip("text")).cast("long").alias("n"))


@query("literal_repairs", "SELECT doc_id, md5(replace(replace(replace(text, '###', '—'), '&&&', ' & '), '***', '')) AS fixed FROM documents")
def _(spark, d):
    """X6, X7."""
    return read(spark, d, "documents").select("doc_id", F.md5(fn.replaced("text", [("###", "—"), ("&&&", " & "), ("***", "")])).alias("fixed"))


@query("md5_keys", "SELECT doc_id, md5(text)[1:12] AS signature, sha256(source || chr(1) || lang)[1:16] AS legacy_id FROM documents")
def _(spark, d):
    """X14, X13."""
    return read(spark, d, "documents").select("doc_id", F.substring(F.md5("text"), 1, 12).alias("signature"), F.substring(F.sha2(F.concat("source", F.lit("\x01"), "lang"), 256), 1, 16).alias("legacy_id"))


@query("format_envelope", "SELECT doc_id, md5('[Source: ' || source || ' | Section: ' || coalesce(CASE WHEN lang = 'en' THEN lang END, 'Root') || ']' || chr(10) || text) AS env FROM documents")
def _(spark, d):
    """X9."""
    return read(spark, d, "documents").select("doc_id", F.md5(fn.envelope(F.col("source"), F.when(F.col("lang") == "en", F.col("lang")), F.col("text"))).alias("env"))


@query("rewrite_label", "SELECT doc_id, '[Doc: final.md | ' || source || '] ' || text AS label FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1")
def _(spark, d):
    """X9."""
    old = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[Doc: old.md | "), F.col("source"), F.lit("] "), F.col("text"))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", fn.relabelled(old, F.lit("final.md")).alias("label"))


@query("source_name", "SELECT doc_id, source AS name FROM documents")
def _(spark, d):
    """The inverse of the envelope."""
    return read(spark, d, "documents").select("doc_id", fn.source_name(fn.envelope(F.col("source"), F.col("lang"), F.col("text"))).alias("name"))


@query(
    "title_from_exchange",
    rf"""SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '(?i){fn.GREETING}') OR t = '' THEN 'New Chat' ELSE t END AS title FROM (SELECT *, coalesce(list_aggregate(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ')[1:60], '') AS t
    FROM (SELECT *, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({STOP_SQL}, x)) AS w FROM conversations))""",
)
def _(spark, d):
    """X10."""
    return read(spark, d, "conversations").select("conv_id", "turn", "role", fn.session_title("text").alias("title"))


_CHAT, _RAG = ("joke", "weather", "ed"), ("the", "document", "policy")


@query("intent_rules", rf"SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '(?i){fn.GREETING}') THEN 'greeting' WHEN regexp_matches(text, '(?i)\b(the|document|policy)\b') THEN 'rag' WHEN regexp_matches(text, '(?i)\b(joke|weather|ed)\b') THEN 'chat' ELSE 'open' END AS intent FROM (SELECT conv_id, turn, role, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM conversations)")
def _(spark, d):
    """X12."""
    ascii_text = F.regexp_replace("text", "[^ -~]", "")  # \b means the same in all dialects
    return read(spark, d, "conversations").select("conv_id", "turn", "role", fn.intent(ascii_text, _CHAT, _RAG).alias("intent"))


@query("acronym_extract", r"SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(html, '[^ -~]', ' ', 'g'), '\b[A-Z][A-Z0-9&/-]{1,7}\b'), lambda x: lower(x)))) AS acronyms FROM pages")
def _(spark, d):
    """J12."""
    return read(spark, d, "pages").select("page_id", F.array_sort(fn.acronyms(F.regexp_replace("html", "[^ -~]", " "))).alias("acronyms"))


@query("status_tone", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'danger' WHEN event_type = 'view' THEN 'warning' WHEN event_type = 'click' THEN 'active' ELSE 'neutral' END AS tone, CASE event_type WHEN 'view' THEN 'Review Pending' WHEN 'click' THEN 'Parse Running' WHEN 'error' THEN 'Error' ELSE upper(event_type[1]) || event_type[2:] END AS label FROM events")
def _(spark, d):
    """X17."""
    status = F.when(F.col("event_type") == "view", "REVIEW_PENDING").when(F.col("event_type") == "click", "PARSE_RUNNING").otherwise(F.upper("event_type"))
    return read(spark, d, "events").select("event_id", fn.status_tone(status).alias("tone"), fn.compact_status(status).alias("label"))


@query("human_bytes", "SELECT page_id, CASE WHEN n >= 1024 * 1024 THEN printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) WHEN n >= 1024 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE n || ' B' END AS size FROM (SELECT page_id, strlen(html) * (page_id % 300) AS n FROM pages)")
def _(spark, d):
    """X17."""
    return read(spark, d, "pages").select("page_id", fn.human_bytes(F.octet_length("html").cast("long") * (F.col("page_id") % 300)).alias("size"))


@query("model_matches", "SELECT a.r_name AS a, b.r_name AS b, a.r_name = b.r_name OR split_part(a.r_name, 'A', 1) = split_part(b.r_name, 'A', 1) AS same FROM region a, region b WHERE a.r_regionkey <= b.r_regionkey")
def _(spark, d):
    """over the pairs of a fixed table of five rows."""
    region = read(spark, d, "region").select(F.replace("r_name", F.lit("A"), F.lit(":")).alias("n"), "r_regionkey", "r_name")
    a, b = region.alias("a"), F.broadcast(region.alias("b"))
    return a.join(b, F.col("a.r_regionkey") <= F.col("b.r_regionkey")).select(F.col("a.r_name").alias("a"), F.col("b.r_name").alias("b"), fn.model_matches(F.col("a.n"), F.col("b.n")).alias("same"))


@query("coerce_and_map", "SELECT event_id, event_type IN ('click', 'view') AS flag, CASE event_type WHEN 'click' THEN 'text/markdown' WHEN 'view' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media FROM events")
def _(spark, d):
    """F17, F20."""
    word = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "view", "ON").otherwise("no")
    return read(spark, d, "events").select("event_id", fn.as_bool(word).alias("flag"), fn.mapped(F.col("event_type"), {"click": "text/markdown", "view": "application/pdf"}, "application/octet-stream").alias("media"))


@query("date_buckets", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    """Z1."""
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
