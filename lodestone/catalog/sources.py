"""Files and tables written to the shared folder and read again, page layout, blocks of markdown."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog.base import query, read
from lodestone.functions import markdown as md
from lodestone.sources import files, keyed, layout


def chunk_rows(spark, d):
    """Each document as a chunk of its source (the document) and language (the parser)."""
    return read(spark, d, "documents").select(
        F.coalesce("source", F.lit("none")).alias("document"), F.coalesce("lang", F.lit("none")).alias("parser"), F.coalesce("text", F.lit("")).alias("text"),
        F.struct("source", F.col("doc_id").cast("string").alias("doc_id")).alias("metadata"),
    )


WRITTEN = "SELECT coalesce(source, 'none') AS document, coalesce(lang, 'none') AS parser, doc_id, coalesce(text, '') AS text FROM documents"


@query("artifact_chunks", f"SELECT doc_id, md5(text) AS text_md5, len(string_split_regex(trim(text), '\\s+'))::int AS token_count FROM ({WRITTEN})")
def _(spark, d):
    """SK11, SC4: chunks as JSON lines, a folder a document and parser, and all of them read again."""
    path = files.shared_path(spark, "chunks")
    files.write_chunks(chunk_rows(spark, d), path)
    rows = files.chunk_files(spark, path, "text string, metadata struct<doc_id string>", "part-*.json")
    return rows.select(F.col("metadata.doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "token_count")


@query("artifact_runs", f"SELECT document, parser, count(*)::int AS chunk_count, 1 AS files FROM ({WRITTEN}) GROUP BY ALL")
def _(spark, d):
    """SC5, SK11: a manifest a folder, read with the files beside it."""
    path = files.shared_path(spark, "manifests")
    files.write_manifests(chunk_rows(spark, d), path)
    return files.artifact_runs(spark, path, [".json"], name="part-*.json").select("document", "parser", "chunk_count", F.size("files").alias("files"))


@query("artifact_listing", f"SELECT DISTINCT document, parser FROM ({WRITTEN})")
def _(spark, d):
    """SC6: the folders that hold a listed file; contents are not read."""
    path = files.shared_path(spark, "listing")
    files.write_manifests(chunk_rows(spark, d), path)
    found = files.listing(spark, path, [".json"])
    return found.select(*(F.url_decode(F.regexp_extract("path", f"/{c}_folder=([^/]*)/", 1)).alias(c) for c in ("document", "parser"))).distinct()


@query("clear_table", "SELECT vec_id, label FROM embeddings WHERE label < 3")
def _(spark, d):
    """SK3, SK1: a table that is cleared has its columns still, and takes new rows."""
    path, rows = files.shared_path(spark, "vectors"), read(spark, d, "embeddings").select("vec_id", "label")
    files.append_vectors(rows, path)
    files.clear(spark, path)
    files.append_vectors(rows.where("label < 3"), path)
    return spark.read.parquet(path)


@query("arriving_files", "SELECT role, sum(length(coalesce(text, '')) + 1)::bigint AS n_chars FROM conversations GROUP BY role")
def _(spark, d):
    """ST1, ST3, ST5: new files as a stream, each once, into a table; files are of bounded size."""
    path = files.shared_path(spark, "arriving")
    read(spark, d, "conversations").select("role", F.coalesce("text", F.lit("")).alias("text")).write.option("maxRecordsPerFile", 10_000).partitionBy("role").text(f"{path}/in")
    came = files.drain(files.once(files.new_files(spark, f"{path}/in", 64)), path)
    return came.groupBy(F.url_decode(F.regexp_extract("path", "/role=([^/]*)/", 1)).alias("role")).agg(F.sum(F.length("text")).alias("n_chars"))


_PLACED = "SELECT user_id, event_id, event_id % 3 + 1 AS page, (event_id % 11) / 4.0 AS y, (event_id % 5) / 4.0 AS x, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE ' ' || event_type || event_id END AS text FROM events"


@query(
    "layout_pages",
    f"""SELECT user_id, string_agg('<!-- page:' || page || ' -->' || chr(10) || chr(10) || '## Page ' || page || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY page) AS markdown
    FROM (SELECT user_id, page, string_agg(trim(text), chr(10) || chr(10) ORDER BY round_even(y, 1), round_even(x, 1), event_id, text) AS body FROM ({_PLACED}) WHERE trim(text) <> '' GROUP BY user_id, page) GROUP BY user_id""",
)
def _(spark, d):
    """SC10: a user is a document, whose pages are put in order and joined."""
    spot = F.col("event_id")
    blocks = read(spark, d, "events").select(
        "user_id", "event_id", (spot % 3 + 1).alias("page"), (spot % 11 / 4.0).alias("y"), (spot % 5 / 4.0).alias("x"), F.when(spot % 13 == 0, " ").otherwise(F.concat(F.lit(" "), "event_type", spot.cast("string"))).alias("text"),
    )
    return files.layout_pages(blocks, "user_id", "page", "x", "y", "event_id", "text")


@query(
    "layout_tables",
    """SELECT l_orderkey, 1::bigint AS page, '<!-- page:1 -->' || chr(10) || chr(10) || '## Page 1' || chr(10) || chr(10) || 'Order ' || l_orderkey || chr(10) || chr(10) || '| part | quantity | supplier |' || chr(10) || '| --- | --- | --- |' || chr(10)
    || string_agg('| ' || l_partkey || ' | ' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_quantity::bigint::varchar END || ' | ' || l_suppkey || ' |', chr(10) ORDER BY l_linenumber) AS markdown FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1) GROUP BY l_orderkey""",
)
def _(spark, d):
    """SC10: an order is a page with a title and a table without rules, some cells empty, as a PDF has it: blocks with places."""
    # both windows, the blocks and their pages share one shuffle by the order; its title comes from its first line
    last = ["l_partkey", "l_suppkey", "l_quantity"]
    items = read(spark, d, "lineitem").withColumn("first", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *last)) == 1)
    items = items.withColumn("_n", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*last))).where("_n = 1")

    def block(left: int, text, top, wide: int = 60):
        return F.struct(F.lit(left).alias("left"), top.cast("double").alias("top"), F.lit(left + wide).alias("right"), (top + 10).cast("double").alias("bottom"), text.cast("string").alias("text"))

    top = F.col("l_linenumber") * 14 + 40
    row = F.array(block(20, F.col("l_partkey"), top), block(120, F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("long")), top), block(220, F.col("l_suppkey"), top))
    title = F.array(block(20, F.concat(F.lit("Order "), "l_orderkey"), F.lit(10), 300), *(block(x, F.lit(t), F.lit(34)) for x, t in ((20, "part"), (120, "quantity"), (220, "supplier"))))
    blocks = items.select("l_orderkey", F.explode(F.when(F.col("first"), F.concat(title, row)).otherwise(row)).alias("b")).select("l_orderkey", F.lit(1).cast("long").alias("page"), "b.*").withColumn("n", F.lit(0))
    return layout.layout_tables(blocks, "l_orderkey", "page", "n", "text")


#: Fences after a paragraph and on their own, headings and tables within and without, figures, and the whole text.
BLOCKS_SQL = "'# ' || lang || chr(10) || 'open' || chr(10) || '```py' || chr(10) || chr(10) || '# ' || source || chr(10) || '```' || chr(10) || '| a |' || chr(10) || '| b |' || chr(10) || '[Figure 1] x' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || '| in |' || chr(10) || '```' || chr(10) ELSE chr(10) END || text || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '| t |' || chr(10) || '```' || chr(10) || 'never closed' ELSE '  ```' || chr(10) || source || chr(10) || '```' END"


@query(
    "markdown_blocks",
    rf"""WITH l AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split({BLOCKS_SQL}, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
    s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l), f AS (SELECT *, t LIKE '```%' AS fence, count(*) FILTER (WHERE t LIKE '```%') OVER (PARTITION BY doc_id ORDER BY no) AS nf FROM s),
    k AS (SELECT *, CASE WHEN fence OR nf % 2 = 1 THEN 'code' WHEN regexp_matches(t, '^#{{1,6}}\s+.') THEN 'heading' WHEN t LIKE '|%' THEN 'table' WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '(?i)^\[(figure|visual|image description)\b') THEN 'figure' ELSE 'paragraph' END AS kind FROM f),
    p AS (SELECT *, coalesce(lag(kind) OVER w, 'blank') AS before, lag(nf) OVER w AS nb FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
    n AS (SELECT *, sum((CASE WHEN kind = 'heading' THEN true WHEN kind = 'code' THEN fence AND nf % 2 = 1 AND before IN ('blank', 'heading', 'code') ELSE kind <> before END)::int) OVER (PARTITION BY doc_id ORDER BY no) AS b FROM p)
    SELECT doc_id, arg_min(kind, no) AS kind, min(no)::int AS start_line, max(no)::int AS end_line, md5(regexp_replace(string_agg(line, chr(10) ORDER BY no), '^\s+|\s+$', '', 'g')) AS text_md5 FROM n WHERE kind <> 'blank' GROUP BY doc_id, b""",
)
def _(spark, d):
    """T7."""
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.expr(BLOCKS_SQL.replace("chr(10)", "'\\n'")).alias("md"))
    return md.blocks(docs, "doc_id", "md").select("doc_id", "kind", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query(
    "keyed_changes",
    """WITH a AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4))
    SELECT conv_id, turn, role FROM a WHERE conv_id % 7 <> 0 UNION ALL SELECT DISTINCT conv_id, 0, 'summary' FROM a WHERE conv_id % 7 = 0""",
)
def _(spark, d):
    """SK2, SK4: conversations as a keyed table; long ones are deleted, then every seventh is replaced by a summary, and the table is read."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role")
    table = keyed.Keyed.create(turns, files.shared_path(spark, "keyed"), ["conv_id"])
    table.delete(turns.where("turn >= 4"))
    table.replace(table.load().where("conv_id % 7 = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("summary").alias("role")).distinct())
    return table.load()


@query(
    "keyed_upsert",
    """WITH new AS (SELECT doc_id, 1 AS quality, 9 AS toxic FROM documents WHERE lang = 'fr')
    SELECT coalesce(c.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, c.quality) AS quality, coalesce(c.toxic, n.toxic) AS toxic FROM labels c FULL JOIN new n ON c.doc_id = n.doc_id""",
)
def _(spark, d):
    """SK5 on a keyed table: as upsert_latest, written to its buckets."""
    labels = read(spark, d, "labels").select("doc_id", "quality", "toxic")
    table = keyed.Keyed.create(labels, files.shared_path(spark, "keyed"), ["doc_id"])
    fresh = read(spark, d, "documents").where("lang = 'fr'").select("doc_id", F.lit(1).alias("quality"), F.lit(9).alias("toxic"))
    table.upsert(fresh, ["toxic"])
    return table.load()
