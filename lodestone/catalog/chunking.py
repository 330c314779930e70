"""Structure and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.functions import markdown as md
from lodestone.functions import models
from lodestone.operators import windows as op
from lodestone.plans import chunking as plan
from lodestone.plans import sections

#: The corpus has no markdown, so documents are given some, the same way in both engines.
MD_SQL = "'# ' || lang || chr(10) || 'intro ' || doc_id || chr(10) || '### ' || source || chr(10) || '| k | v |' || chr(10) || '|---|---|' || chr(10) || '| ' || source || ' | ' || n_chars || ' |' || chr(10) || '### deep' || chr(10) || text || chr(10) || '## end' || chr(10) || 'Q1: what is ' || lang || chr(10) || 'A: it is' || chr(10) || source || chr(10) || 'Q2: none' || chr(10) || '1. a' || chr(10) || '2. b'"
LINES = f"(SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS no FROM (SELECT doc_id, string_split({MD_SQL}, chr(10)) AS l FROM documents))"


def marked(spark, d):
    return read(spark, d, "documents").withColumn("md", F.expr(MD_SQL.replace("chr(10)", "'\\n'")))


#: Documents of four kinds by turn: tables, questions and answers, text with a small table, plain text.
KINDS_SQL = """CASE doc_id % 4
WHEN 0 THEN '# ' || source || chr(10) || '| item | lang |' || chr(10) || '|---|---|' || chr(10) || '| ' || source || ' | ' || lang || ' |' || chr(10) || '| ' || doc_id % 90 || ' Casual Leave | ' || n_chars || ' |'
WHEN 1 THEN 'Q0: zero' || chr(10) || 'A: z' || chr(10) || '# ' || lang || chr(10) || 'Q1: one' || chr(10) || 'A: ' || source || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '### deep' ELSE '## mid' END || chr(10) || '**Question 2: two**' || chr(10) || '- A: two' || chr(10) || 'and more' || chr(10) || '# ' || source || chr(10) || '## Q3: three' || chr(10) || 'A: three'
WHEN 2 THEN '# ' || lang || chr(10) || text || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' ELSE text END"""


def of_kinds(spark, d):
    return read(spark, d, "documents").withColumn("md", F.expr(KINDS_SQL.replace("chr(10)", "'\\n'")))


@query("split_lines_chunks", "SELECT doc_id, unnest(range(0, len(l))) AS line_no, length(unnest(l)) AS n FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def _(spark, d):
    """SC3, section 1.4: lines."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(md.lines("text")).alias("line_no", "line")).select("doc_id", "line_no", F.length("line").alias("n"))


@query("table_islands", f"SELECT doc_id, no AS line_no, 1 AS table_index, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS row_index FROM {LINES} WHERE line LIKE '|%' AND line NOT LIKE '|---%'")
def _(spark, d):
    """T1, T9; the SQL holds where no text has tables of its own."""
    return md.table_rows(marked(spark, d), "doc_id", "md").select("doc_id", "line_no", "table_index", "row_index")


@query("linear_tables", "SELECT doc_id, '- k: ' || source || '; v: ' || n_chars AS line FROM documents")
def _(spark, d):
    """T3, SC11: each row beside its headers; the SQL holds where no text has tables of its own."""
    rows = md.table_rows(marked(spark, d), "doc_id", "md")
    head = rows.where("row_index = 1").select("doc_id", "table_index", F.col("cells").alias("headers"))
    return rows.where("row_index > 1").join(head, ["doc_id", "table_index"]).select("doc_id", md.linear_row(F.col("headers"), F.col("cells")).alias("line"))


@query(
    "section_paths",
    "SELECT doc_id, p[1] AS section_path, p[2]::int AS heading_level FROM (SELECT doc_id, unnest([[lang, '1'], [lang || ' > ' || source, '3'], [lang || ' > ' || source || ' > deep', '3'], [lang || ' > end', '2']]) AS p FROM documents)",
)
def _(spark, d):
    """The list-stack breadcrumb, in which a skipped depth goes below."""
    return md.section_rows(marked(spark, d), "doc_id", "md").select("doc_id", "section_path", "heading_level")


@query(
    "level_paths",
    f"""WITH l AS (SELECT *, CASE WHEN no = 0 THEN 1 WHEN line LIKE '### %' THEN 3 WHEN line = '## end' THEN 2 END AS lv FROM {LINES}),
    t AS (SELECT *, last_value(CASE WHEN lv = 1 THEN line[3:] END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN lv = 2 THEN line[4:] END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN lv = 3 THEN line[5:] END IGNORE NULLS) OVER w AS t3, coalesce(max(CASE WHEN lv = 2 THEN no END) OVER w, -1) AS l2, coalesce(max(CASE WHEN lv = 3 THEN no END) OVER w, -1) AS l3 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY no))
    SELECT doc_id, no AS line_no, concat_ws(' > ', t1, t2, CASE WHEN l3 > l2 THEN t3 END) AS section_path FROM t""",
)
def _(spark, d):
    """The level-dictionary breadcrumb, by windows."""
    rows = marked(spark, d).select("doc_id", F.posexplode(md.lines("md")).alias("line_no", "line"))
    return md.level_paths(rows, "doc_id", "line_no", "line", 3).select("doc_id", "line_no", "section_path")


@query("pack_greedy")
def _(spark, d):
    """Lines packed to 2200 characters; a row a chunk, linked."""
    chunks = read(spark, d, "documents").select("doc_id", F.posexplode(md.packed(md.lines("text"), 2200)).alias("pos", "text"))
    return op.link_indices(chunks, ["doc_id"], ["pos"]).select("doc_id", "chunk_index", "prev_index", "next_index", F.length("text").cast("long").alias("n_chars"))


@query("chunk_documents")
def _(spark, d):
    """Sections, packed, labelled with their file and path, linked over the document."""
    sections = md.section_rows(marked(spark, d), "doc_id", "md").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    pieces = sections.select("doc_id", "source", "section", "section_path", F.posexplode(md.packed(md.lines("text"), 1500)).alias("pos", "piece"))
    label = F.concat(F.lit("[Doc: "), "source", F.lit(" | Section: "), "section_path", F.lit("]\n"), "piece")
    linked = op.link_indices(op.fragments(pieces, ["doc_id", "section"], ["pos"]), ["doc_id"], ["section", "pos"])
    return linked.select("doc_id", "section_path", "chunk_index", "prev_index", "next_index", "fragment_index", "total_fragments", label.alias("text"))


@query("section_fragments")
def _(spark, d):
    """Sections in fragments of 1500 characters with whole tables, that begin with the last sentences of the one before."""
    return sections.fragment_rows(md.section_rows(marked(spark, d), "doc_id", "md").select("doc_id", "section", "section_path", "text"), "text")


@query("heading_batches")
def _(spark, d):
    """Batches of 4000 characters that begin at headings and share 300, and the text that they give put together again."""
    cut = marked(spark, d).where("md IS NOT NULL").select("doc_id", sections.heading_batches(F.col("md"), 4000, 300).alias("batches"))
    return cut.select("doc_id", F.size("batches").alias("n"), F.md5(F.array_join("batches", "\f")).alias("batches_md5"), F.md5(sections.batches_joined(F.col("batches"), 300)).alias("whole_md5"))


@query("kind_chunks")
def _(spark, d):
    """Blocks of documents of four kinds, packed whole."""
    return sections.kind_chunks(of_kinds(spark, d).where("doc_id IS NOT NULL"), "doc_id", "md", "source")


@query("chunk_markdown_sql", "SELECT doc_id, count(*) AS headings FROM " + LINES + " WHERE regexp_matches(line, '^#{1,6}[ \t]+[^ \t]') GROUP BY doc_id")
def _(spark, d):
    """T16 from SQL: a lateral join with the table function; of its rows the sections under a heading."""
    sections.register(spark)
    marked(spark, d).createOrReplaceTempView("marked_documents")
    return spark.sql("SELECT doc_id, count(DISTINCT c.section) FILTER (WHERE c.section_path <> 'Root') AS headings FROM marked_documents m, LATERAL chunk_markdown(m.md, 1500, 200) c GROUP BY doc_id")


#: X15 worked out from lines, for the text of a column ``m``.
DIAGNOSIS_SQL = r"""WITH m AS (SELECT doc_id, MARKDOWN AS m FROM documents), l AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS no FROM (SELECT doc_id, list_transform(string_split(m, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM m)),
    p AS (SELECT *, line LIKE '|%' AS pipe, list_transform(regexp_split_to_array(trim(line, '|'), '\|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS cells FROM l),
    f AS (SELECT *, pipe AND NOT coalesce(lag(pipe) OVER (PARTITION BY doc_id ORDER BY no), false) AS opens, CASE WHEN pipe THEN (len(cells) <= 1)::int + (len(list_filter(cells, lambda x: lower(x) IN ('col2', 'col3', 'col4'))) > 0)::int + (len(cells) >= 2 AND cells[1] <> '' AND cells[1] = cells[2])::int END AS faults FROM p),
    s AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^#{1,6}\s+.*\S\s*$')) AS headings, count(*) FILTER (WHERE opens) AS tables, count(*) FILTER (WHERE pipe) AS table_rows, coalesce(sum(faults) / nullif(count(*) FILTER (WHERE pipe), 0), 0) AS broken FROM f GROUP BY doc_id)
    SELECT doc_id, length(m) AS chars, len(regexp_extract_all(m, '[\p{L}\p{M}\p{N}_]+')) AS words, headings, tables, table_rows, round_even(broken, 3)::double AS broken FROM m JOIN s USING (doc_id)"""


@query("diagnose_markdown", DIAGNOSIS_SQL.replace("MARKDOWN", MD_SQL))
def _(spark, d):
    """X15; texts with tables of their own are diagnosed too."""
    rows = marked(spark, d).where("text IS NOT NULL").select("doc_id", md.diagnosis("md").alias("x"))
    return rows.select("doc_id", *(F.col(f"x.{c}").alias(c) for c in ("chars", "words", "headings", "tables", "table_rows", "broken")))


@query("diagnose_kinds", DIAGNOSIS_SQL.replace("MARKDOWN", KINDS_SQL))
def _(spark, d):
    """Documents of four kinds."""
    rows = of_kinds(spark, d).where("md IS NOT NULL").select("doc_id", md.diagnosis("md").alias("x"))
    return rows.select("doc_id", *(F.col(f"x.{c}").alias(c) for c in ("chars", "words", "headings", "tables", "table_rows", "broken")))


@query("qa_pairs", "SELECT doc_id, pair_index, q AS question, CASE WHEN pair_index = 1 THEN 'z' || chr(10) || '# ' || lang ELSE a END AS answer FROM (SELECT doc_id, lang, unnest([1, 2, 3, 4]) AS pair_index, unnest(['zero', 'one', 'two', 'three']) AS q, unnest(['', source || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '### deep' ELSE '## mid' END, 'two' || chr(10) || 'and more' || chr(10) || '# ' || source, 'three']) AS a FROM documents WHERE doc_id % 4 = 1)")
def _(spark, d):
    """Pairs of four layouts; answers go on to the next question."""
    return md.qa_pairs(of_kinds(spark, d).where(plan.route("md") == "qna"), "doc_id", "md").select("doc_id", F.col("pair_index").cast("int").alias("pair_index"), "question", "answer")


@query("qna_documents", "SELECT doc_id, coalesce(doc_id % 4 = 1, false) AS qna FROM documents")
def _(spark, d):
    """Four questions are enough, none are not."""
    return of_kinds(spark, d).select("doc_id", md.is_qna("md").alias("qna"))


@query("summaries", "SELECT doc_id, string_agg(h, ', ' ORDER BY no) AS headings FROM (SELECT doc_id, no, regexp_replace(line, '^#+ ', '') AS h, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS n FROM " + LINES + " WHERE regexp_matches(line, '^#{1,6}[ \t]+[^ \t]')) WHERE n <= 3 GROUP BY doc_id")
def _(spark, d):
    """T5, L9."""
    titles = F.transform(F.filter(md.lines("md"), lambda x: md.level(x) > 0), md.title)
    return marked(spark, d).select("doc_id", F.array_join(F.slice(titles, 1, 3), ", ").alias("headings"))


@query("overlap_batches", "SELECT doc_id, n AS batches, length(text) - (n - 1) * 900 AS last_size, md5(text[(n - 1) * 900 + 1:]) AS last_md5, true AS restored FROM (SELECT *, greatest(1, ceil((length(text) - 100) / 900.0))::bigint AS n FROM documents WHERE length(text) > 0)")
def _(spark, d):
    """Pieces of 1000 that share 100, and put together again."""
    pieces = md.overlapping("text", 1000, 100)
    back = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substring(p, 101, 900)), ""))
    last = F.element_at(pieces, -1)
    return read(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.size(pieces).cast("long").alias("batches"), F.length(last).cast("long").alias("last_size"), F.md5(last).alias("last_md5"), (back == F.col("text")).alias("restored"))


@query("clean_artifacts")
def _(spark, d):
    """X3, X4, X6."""
    return read(spark, d, "documents").select("doc_id", F.md5(md.header_depths(md.cleaned("text"))).alias("cleaned"))


@query("normaliser_checks")
def _(spark, d):
    """A result that lost half of its lines."""
    half = F.array_join(F.filter(md.lines("text"), lambda x: F.length(x) % 2 == 0), "\n")
    return read(spark, d, "documents").select("doc_id", md.normaliser_warnings(F.col("text"), half).alias("warnings"))


@query("viterbi_segment")
def _(spark, d):
    """Words run together, split by the most likely path over all words of the corpus; each text meets those it could hold."""
    words = read(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").count()
    items = read(spark, d, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^a-z]+", "").alias("joined"))
    held = items.select("item_id", F.explode(models.substrings("joined")).alias("w")).join(op.word_ranks(words, "w", "count"), "w")
    held = held.groupBy("item_id").agg(F.collect_list(F.struct("w", "rank")).alias("held"))  # at most twenty a letter
    rows = items.join(held, "item_id", "left").crossJoin(F.broadcast(words.agg(F.count("*").alias("n"))))  # one row
    return rows.select("item_id", models.segmented_by()(F.col("joined"), F.col("held.w"), F.col("held.rank"), F.col("n")).alias("text"))


@query("embed_batches")
def _(spark, d):
    """A deterministic embedding of each text, in Arrow batches; any model fits the same place."""
    return read(spark, d, "documents").select("doc_id", models.hashed_embedding(16)(F.col("text")).alias("embedding"))


@query("keyword_lines", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'license') GROUP BY doc_id")
def _(spark, d):
    """A gate that only looks at lines."""
    return read(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit("license")))).cast("long").alias("n")).where("n > 0")


ROUTES_SQL = rf"""WITH l AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS no FROM (SELECT doc_id, list_transform(string_split({KINDS_SQL}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM documents)),
    t AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id, line LIKE '|%' ORDER BY no) AS island FROM l),
    u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line LIKE '|%', island) AS run FROM t),
    s AS (SELECT doc_id, count(*) FILTER (WHERE line LIKE '|%' AND run > 1 AND NOT regexp_matches(line, '^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$')) AS n_rows, count(*) FILTER (WHERE line LIKE '|%') / greatest(count(*) FILTER (WHERE line <> ''), 1) AS ratio, count(*) FILTER (WHERE line LIKE '#%') AS headings FROM u GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'qna' WHEN n_rows >= 2 AND ratio >= 0.45 AND headings <= 8 THEN 'table_rows' ELSE 'body' END AS route FROM s"""


@query("chunk_routes", ROUTES_SQL)
def _(spark, d):
    """T18, T2."""
    return of_kinds(spark, d).select("doc_id", plan.route("md").alias("route"))


#: Rows of the documents that are mostly a table: all of the first kind, and short texts with a small table.
_ROWS = "SELECT doc_id, source, 1 AS table_index, row_index, cells[1] AS a, cells[2] AS b FROM (SELECT doc_id, source, unnest([[ 'item', 'lang'], [source, lang], [doc_id % 90 || ' Casual Leave', n_chars::varchar]]) AS cells, unnest([1, 2, 3]) AS row_index FROM documents WHERE doc_id % 4 = 0)"
_SMALL = f"SELECT doc_id, source, 1 AS table_index, unnest([1, 2]) AS row_index, unnest(['a', '1']) AS a, unnest(['b', '2']) AS b FROM documents JOIN ({ROUTES_SQL}) USING (doc_id) WHERE doc_id % 4 = 2 AND route = 'table_rows'"


@query(
    "table_row_chunks",
    f"SELECT doc_id, table_index, row_index, '[Doc: ' || source || ' | Section: Table 1 > ' || title || ' | Table Row: ' || row_index || ']' || chr(10) || '# ' || title || chr(10) || 'Column 1: ' || a || chr(10) || 'Column 2: ' || b AS text FROM (SELECT *, CASE WHEN row_index = 3 THEN doc_id % 90 || '. Casual Leave' ELSE a || ' ' || b END AS title FROM ({_ROWS} UNION ALL {_SMALL}))",
)
def _(spark, d):
    """Documents that are mostly a table."""
    docs = of_kinds(spark, d).where(plan.route("md") == "table_rows")
    return plan.row_chunks(docs, "doc_id", "md", "source").select("doc_id", "table_index", "row_index", "text")


_PAIRS = "SELECT doc_id, source, unnest([1, 2, 3, 4]) AS pair_index, unnest(['Root', lang, lang || CASE WHEN doc_id % 3 = 0 THEN ' > deep' ELSE ' > mid' END, source]) AS section_path, unnest(['zero', 'one', 'two', 'three']) AS q, unnest(['z', source || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '### deep' ELSE '## mid' END, 'two' || chr(10) || 'and more' || chr(10) || '# ' || source, 'three']) AS a FROM documents WHERE doc_id % 4 = 1"


@query("question_sections", f"SELECT doc_id, pair_index, section_path FROM ({_PAIRS})")
def _(spark, d):
    """The headings before the question's line."""
    return plan.pair_sections(of_kinds(spark, d).where(plan.route("md") == "qna"), "doc_id", "md").select("doc_id", F.col("pair_index").cast("int").alias("pair_index"), "section_path")


@query("qna_chunks", f"SELECT doc_id, pair_index, '[Doc: ' || source || ' | Section: ' || section_path || ' | Q&A: q' || pair_index || ' | Part 1/1]' || chr(10) || 'Q: ' || q || chr(10) || chr(10) || 'A: ' || CASE WHEN pair_index = 1 THEN 'z' || chr(10) || '# ' || (SELECT lang FROM documents x WHERE x.doc_id = p.doc_id) ELSE a END AS text FROM ({_PAIRS}) p")
def _(spark, d):
    """T13."""
    return plan.qna_chunks(of_kinds(spark, d).where(plan.route("md") == "qna"), "doc_id", "md", "source").select("doc_id", F.col("pair_index").cast("int").alias("pair_index"), "text")


#: Numbered rows over two pages, and a described figure.
PAGED_SQL = "'# t' || chr(10) || 'before' || chr(10) || '1. ' || lang || chr(10) || 'more ' || source || chr(10) || chr(10) || '2) two' || chr(10) || '<!-- page:' || (doc_id % 9 + 2) || ' -->' || chr(10) || 'lost' || chr(10) || '3. three' || chr(10) || '[Visual: Chart | page ' || (doc_id % 9 + 2) || ']' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || source || chr(10) ELSE '' END || 'bars' || chr(10) || '[/Visual]' || chr(10)"


@query("numbered_rows", "SELECT doc_id, unnest([1, 2, 3]) AS row_index, unnest([1, 1, doc_id % 9 + 2])::int AS page, unnest(['1. ' || lang || chr(10) || 'more ' || source, '2) two', '3. three' || chr(10) || '[Visual: Chart | page ' || (doc_id % 9 + 2) || ']' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || source || chr(10) ELSE '' END || 'bars' || chr(10) || '[/Visual]']) AS text FROM documents")
def _(spark, d):
    """T10."""
    docs = read(spark, d, "documents").select("doc_id", F.expr(PAGED_SQL.replace("chr(10)", "'\\n'")).alias("md"))
    return plan.numbered_rows(docs, "doc_id", "md").select("doc_id", "row_index", "page", "text")


@query("visual_chunks", "SELECT doc_id, page, title, '[Doc: ' || source || ' | Section: Page ' || page || ' > ' || title || ' | Visual]' || chr(10) || '# ' || title || chr(10) || '[Visual: chart | page ' || page || ']' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || source || chr(10) ELSE '' END || 'bars' || chr(10) || '[/Visual]' AS text FROM (SELECT *, (doc_id % 9 + 2)::int AS page, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Chart on page ' || (doc_id % 9 + 2) END AS title FROM documents)")
def _(spark, d):
    """T10."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.expr(PAGED_SQL.replace("chr(10)", "'\\n'")).alias("md"))
    return plan.visual_chunks(docs, "doc_id", "md", "source").select("doc_id", "page", "title", "text")
