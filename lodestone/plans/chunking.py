"""Chunks of documents by their kind: question-answer pairs, table rows, or sections of body text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import markdown as md
from lodestone.functions import text as fn


def route(c: Column | str) -> Column:
    """Qna, table_rows (two rows at least, 45 % of the lines that are not blank, eight headings at most) or body."""

    def step(s: Column, line: Column) -> Column:
        pipe = line.startswith("|")
        ended = F.when(~pipe & (s["run"] > 1), s["run"] - s["rules"]).otherwise(0)
        return F.struct(
            F.when(pipe, s["run"] + 1).otherwise(0).alias("run"), F.when(pipe, s["rules"] + md.is_separator(line).cast("int")).otherwise(0).alias("rules"),
            (s["rows"] + ended).alias("rows"),
        )

    def judged(s: Column) -> Column:
        full = F.filter(s["lines"], lambda x: x != "")
        tables, headings = F.size(F.filter(full, lambda x: x.startswith("|"))), F.size(F.filter(full, lambda x: x.startswith("#")))
        start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("rules"), F.lit(0).alias("rows"))
        rows = F.aggregate(F.concat(s["lines"], F.array(F.lit(""))), start, step)["rows"]
        ratio = tables / F.greatest(F.size(full), F.lit(1))
        return F.when(md.is_qna(c), "qna").when((rows >= 2) & (ratio >= 0.45) & (headings <= 8), "table_rows").otherwise("body")

    return F.when(fn.col(c).isNotNull(), fn.bound(judged, lines=F.transform(md.lines(c), fn.strip)))


def truncated_title(c: Column, most: int = 80) -> Column:
    """Spaces collapsed, dots, colons and dashes off the ends, cut at the last space before the limit."""
    marks = F.lit(" .:-")

    def cut(s: Column) -> Column:
        head = F.substring(s["t"], 1, most)
        at = F.length(head) - F.instr(F.reverse(head), " ")
        return F.when(F.length(s["t"]) <= most, s["t"]).otherwise(F.btrim(F.when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), at)).otherwise(head), marks))

    return fn.bound(cut, t=F.btrim(F.regexp_replace(c, r"\s+", " "), marks))


def row_title(cells: Column, fallback: Column) -> Column:
    """A number with the capitalised words after it, else the whole row, else the fallback."""
    pattern = r"\b(\d{1,2})[.)]?\s+([A-Z][A-Za-z ]{2,120}(?:\([A-Z]+\))?)"

    def title(s: Column) -> Column:
        number, words = F.regexp_extract(s["joined"], pattern, 1), F.regexp_extract(s["joined"], pattern, 2)
        plain = fn.collapse(s["joined"])
        return truncated_title(F.when(number != "", F.concat(number, F.lit(". "), fn.strip(words))).when(plain != "", plain).otherwise(fallback))

    return fn.bound(title, joined=F.array_join(cells, " "))


def split_row(prefix: Column, body: Column, limit: int) -> Column:
    """The lines of a long table row in parts, each under the same two-line prefix."""
    full = F.filter(body, lambda x: fn.strip(x) != "")

    def step(s: Column, line: Column) -> Column:
        close = (s["n"] > 0) & (s["size"] + F.length(line) + 1 > limit)
        return F.struct(
            F.when(close, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(close | (s["n"] == 0), line).otherwise(F.concat(s["now"], F.lit("\n"), line)).alias("now"),
            (F.when(close, F.length(prefix)).otherwise(s["size"]) + F.length(line) + 1).alias("size"), F.lit(1).alias("n"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.length(prefix).alias("size"), F.lit(0).alias("n"))
    whole = F.concat_ws("\n", prefix, F.array_join(body, "\n"))
    parts = fn.bound(lambda s: F.concat(s["end"]["done"], F.array(s["end"]["now"])), end=F.aggregate(full, start, step))
    return F.when((F.length(whole) <= limit) | (F.size(full) == 0), F.array(whole)).otherwise(F.transform(parts, lambda p: F.concat(prefix, F.lit("\n"), p)))


def row_chunks(docs: DataFrame, key: str, text: str, name: str, limit: int = 2200) -> DataFrame:
    """A chunk a table row, labelled with document, table and title; long rows in marked fragments."""
    rows = md.table_rows(docs.select(key, text), key, text).join(docs.select(key, F.col(name).alias("_name")), key)
    number = F.col("table_index").cast("string")
    fallback = F.concat(F.lit("Table "), number, F.lit(" Row "), F.col("row_index").cast("string"))
    rows = rows.withColumn("title", row_title(F.col("cells"), fallback))
    head = F.concat(F.lit("[Doc: "), "_name", F.lit(" | Section: Table "), number, F.lit(" > "), "title", F.lit(" | Table Row: "), F.col("row_index").cast("string"), F.lit("]\n# "), "title")
    body = F.when(F.size("cells") == 1, F.col("cells")).otherwise(F.transform("cells", lambda c, i: F.concat(F.lit("Column "), (i + 1).cast("string"), F.lit(": "), c)))
    parts = split_row(head, body, limit)
    out = rows.select(key, "table_index", "row_index", F.size(parts).alias("total_fragments"), F.posexplode(parts).alias("fragment_index", "part"))
    mark = F.concat(F.lit("\n\n[Table row fragment "), (F.col("fragment_index") + 1).cast("string"), F.lit("/"), F.col("total_fragments").cast("string"), F.lit("]"))
    return out.select(key, "table_index", "row_index", "fragment_index", "total_fragments", F.when(F.col("total_fragments") > 1, F.concat("part", mark)).otherwise(F.col("part")).alias("text"))


def pair_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Question-answer pairs with the path of the headings before the question's line; without one, Root."""
    pairs = md.qa_pairs(docs, key, text)
    asked = docs.select(key, F.posexplode(F.arrays_zip(md.lines(text).alias("line"), md.breadcrumbs(md.lines(text)).alias("path"))).alias("line_no", "x")).select(key, "line_no", "x.line", "x.path")
    order = Window.partitionBy(key).orderBy("line_no")
    asked = asked.withColumns({"section_path": F.coalesce(F.nullif(F.lag("path").over(order), F.lit("")), F.lit("Root")), "is_question": F.col("line").rlike(md.QUESTION)})
    asked = asked.withColumn("pair_index", F.sum(F.col("is_question").cast("int")).over(order)).where("is_question")
    return pairs.join(asked.select(key, "pair_index", "section_path"), [key, "pair_index"])


def qna_chunks(docs: DataFrame, key: str, text: str, name: str, limit: int = 2000) -> DataFrame:
    """A chunk a pair; where it is longer than ``limit`` the answer's lines go in fragments, each under the question."""
    pairs = pair_sections(docs, key, text).join(docs.select(key, F.col(name).alias("_name")), key)
    room = limit - F.length("question") - 20
    whole = F.length("question") + F.length("answer") + len("Q: \n\nA: ") <= limit
    fragments = F.when(whole, F.array("answer")).otherwise(F.transform(md.packed(md.lines("answer"), room, 1), fn.strip))
    rows = pairs.select(key, "pair_index", "section_path", "question", "_name", F.size(fragments).alias("total_fragments"), F.posexplode(fragments).alias("fragment_index", "fragment"))
    part = F.concat(F.lit(" | Part "), (F.col("fragment_index") + 1).cast("string"), F.lit("/"), F.col("total_fragments").cast("string"), F.lit("]\nQ: "))
    label = F.concat(F.lit("[Doc: "), "_name", F.lit(" | Section: "), "section_path", F.lit(" | Q&A: q"), F.col("pair_index").cast("string"), part)
    said = F.concat(F.lit("\n\nA"), F.when(F.col("fragment_index") > 0, " continued").otherwise(""), F.lit(": "))
    return rows.select(key, "pair_index", "section_path", "fragment_index", "total_fragments", F.concat(label, "question", said, "fragment").alias("text"))


def numbered_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of lines that start with a numbered one, with their page; page anchors end a run, headings and blank lines are left out."""
    page = F.coalesce(F.nullif(F.regexp_extract("line", r"<!--\s*page:(\d+)\s*-->", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"(?i)^##\s+Page\s+(\d+)\b", 1), F.lit("")))
    order = Window.partitionBy(key).orderBy("line_no")
    rows = docs.select(key, F.posexplode(F.transform(md.lines(text), fn.strip)).alias("line_no", "line")).withColumn("anchor", page.cast("int"))
    rows = rows.where(F.col("anchor").isNotNull() | ((F.col("line") != "") & ~F.col("line").startswith("#")))
    starts = F.col("anchor").isNull() & F.col("line").rlike(r"^\d{1,2}\s*[.)]\s+\S")
    rows = rows.withColumns({"page": F.coalesce(F.last("anchor", ignorenulls=True).over(order), F.lit(1)), "run": F.sum((starts | F.col("anchor").isNotNull()).cast("int")).over(order), "starts": starts})
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    runs = rows.where("anchor IS NULL").groupBy(key, "run").agg(F.max("starts").alias("starts"), F.min("page").alias("page"), F.min("line_no").alias("line_no"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text")).where("starts")
    return runs.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line_no")).alias("row_index"), "page", "line_no", "text")


VISUAL = r"(?ms)^\[Visual:\s*([^\]|]+?)\s*\|\s*page\s*(\d+)\]\s*(.*?)^\[/Visual\]"


def visual_chunks(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """Described figures as chunks, with type, page and title (a Title field, else type and page)."""
    groups = F.arrays_zip(*(F.regexp_extract_all(fn.col(text), F.lit(VISUAL), F.lit(k)).alias(n) for k, n in ((1, "kind"), (2, "page"), (3, "body"))))
    rows = docs.select(key, F.col(name).alias("_name"), F.posexplode(groups).alias("pos", "x")).select(key, "_name", "pos", F.lower("x.kind").alias("kind"), F.col("x.page").cast("int").alias("page"), fn.strip(F.col("x.body")).alias("body"))
    said = fn.strip(F.regexp_extract("body", r"(?im)^Title:\s*(.+)$", 1))
    title = F.when(~F.lower(said).isin("", "[none]", "none", "[unclear]"), said).otherwise(F.concat(F.initcap("kind"), F.lit(" on page "), F.col("page").cast("string")))
    rows = rows.withColumn("title", title)
    where = F.concat(F.lit("[Doc: "), "_name", F.lit(" | Section: Page "), F.col("page").cast("string"), F.lit(" > "), "title", F.lit(" | Visual]\n# "), "title")
    block = F.concat(F.lit("\n[Visual: "), "kind", F.lit(" | page "), F.col("page").cast("string"), F.lit("]\n"), "body", F.lit("\n[/Visual]"))
    return rows.select(key, "pos", "kind", "page", "title", F.concat(where, block).alias("text"))
