"""Structure of markdown-like text, as column expressions and folds over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as fn

HEADING = r"^(#{1,6})\s+(.*\S)\s*$"


def lines(c: Column | str) -> Column:
    """Lines without a last empty one."""
    parts = F.split(F.regexp_replace(fn.col(c), "\r\n?", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def level(line: Column) -> Column:
    """Depth of a heading line, 0 for others."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def title(line: Column) -> Column:
    return F.regexp_extract(line, HEADING, 2)


def breadcrumbs(all_lines: Column) -> Column:
    """Of each line the path of headings above it; a heading of depth n keeps the first n - 1 names of the path.

    A fold: when a depth is skipped the path is shorter than the depth, and the next heading of it goes below.
    """
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, line: Column) -> Column:
        deeper = F.concat(F.slice(s["stack"], F.lit(1), F.greatest(level(line) - 1, F.lit(0))), F.array(title(line)))
        stack = F.when(level(line) > 0, deeper).otherwise(s["stack"])
        return F.struct(stack.alias("stack"), F.concat(s["paths"], F.array(F.array_join(stack, " > "))).alias("paths"))

    return F.aggregate(all_lines, start, step)["paths"]


def section_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row a section: path, title, level, lines, text. Sections start at headings; what comes before is Root."""
    rows = docs.select(key, F.posexplode(F.arrays_zip(lines(text).alias("line"), breadcrumbs(lines(text)).alias("path"))).alias("line_no", "x")).select(key, "line_no", "x.line", "x.path")
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("section", F.sum(F.when(level(F.col("line")) > 0, 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = rows.groupBy(key, "section").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min_by("path", "line_no").alias("section_path"),
        F.max(level(F.col("line"))).alias("heading_level"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"),
    )
    return out.withColumn("section_path", F.when(F.col("section_path") == "", "Root").otherwise(F.col("section_path")))


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row a block: kind (code, heading, table, figure, paragraph), first and last line from 1, text; ``key`` tells documents apart.

    A fence is a line that starts with three backticks; every second one closes. What is fenced goes on with a block that is open
    before it, and blank lines end blocks elsewhere. A null or blank text has no blocks. Windows over lines, so nothing is folded.
    """
    rows = docs.select(key, F.posexplode(lines(text)).alias("_at", "line")).withColumn("_s", fn.strip(F.col("line")))
    w = Window.partitionBy(key).orderBy("_at")
    fence = F.col("_s").startswith("```")
    rows = rows.withColumn("_fences", F.sum(fence.cast("int")).over(w))
    kind = (
        F.when(fence | (F.col("_fences") % 2 == 1), "code").when(F.col("_s").rlike(r"^#{1,6}\s+."), "heading").when(F.col("_s").startswith("|"), "table")
        .when(F.col("_s") == "", "blank").when(F.col("_s").rlike(r"(?i)^\[(Figure|Visual|Image description)\b"), "figure").otherwise("paragraph")
    )
    rows = rows.withColumns({"kind": kind, "_opens": fence & (F.col("_fences") % 2 == 1)})
    rows = rows.withColumn("_before", F.when(F.lag("_fences").over(w) % 2 == 0, F.when(F.lag("kind").over(w) == "code", "closed").otherwise(F.lag("kind").over(w))))
    fresh = F.when(F.col("_opens"), F.coalesce(F.col("_before"), F.lit("blank")).isin("blank", "heading", "closed")).otherwise(
        (F.col("kind") == "heading") | ((F.col("kind") != "code") & ~F.col("kind").eqNullSafe(F.col("_before")))
    )
    rows = rows.withColumn("_block", F.sum(fresh.cast("int")).over(w)).where("kind <> 'blank'")
    parts = F.array_sort(F.collect_list(F.struct("_at", "line")))
    out = rows.groupBy(key, "_block").agg(
        F.min_by("kind", "_at").alias("kind"), (F.min("_at") + 1).alias("start_line"), (F.max("_at") + 1).alias("end_line"),
        fn.strip(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("text"),
    )
    return out.drop("_block")


def level_paths(rows: DataFrame, key: str, order: str, line: str, depth: int = 6) -> DataFrame:
    """Breadcrumbs in which a heading clears the deeper ones, by windows: a title counts while no shallower heading follows it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = level(F.col(line))
    for n in range(1, depth + 1):
        rows = rows.withColumns({f"_t{n}": F.last(F.when(here == n, title(F.col(line))), ignorenulls=True).over(w), f"_l{n}": F.coalesce(F.max(F.when(here == n, F.col(order))).over(w), F.lit(-1))})
    names = []
    for n in range(1, depth + 1):
        above = F.greatest(F.lit(-1), F.lit(-1), *(F.col(f"_l{m}") for m in range(1, n)))
        names.append(F.when(F.col(f"_l{n}") > above, F.col(f"_t{n}")) if n > 1 else F.col("_t1"))
    return rows.withColumn("section_path", F.concat_ws(" > ", *names)).drop(*(f"_{x}{n}" for x in "tl" for n in range(1, depth + 1)))


def cells(row: Column) -> Column:
    """The cells of a table line, stripped; blank ones stay in their place."""
    return F.transform(F.split(F.regexp_replace(fn.strip(row), r"^\||\|$", ""), r"\|"), fn.strip)


def is_separator(row: Column) -> Column:
    return row.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")


def table_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of two or more lines that start with a pipe, as rows with table number and cells; separators are dropped."""
    rows = docs.select(key, F.posexplode(lines(text)).alias("line_no", "line")).where(F.ltrim("line").startswith("|"))
    rows = rows.withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(key, "island"))).where("n > 1")
    rows = rows.where(~is_separator(F.col("line"))).withColumns({"table_index": F.dense_rank().over(Window.partitionBy(key).orderBy("island")), "row_index": F.row_number().over(Window.partitionBy(key, "island").orderBy("line_no"))})
    return rows.select(key, "table_index", "row_index", "line_no", cells(F.col("line")).alias("cells"))


def linear_row(headers: Column, row: Column) -> Column:
    """``- header: value; ...`` where the widths agree, else the values alone."""
    named = F.array_join(F.filter(F.zip_with(headers, row, lambda h, v: F.when(v != "", F.concat_ws(": ", F.nullif(h, F.lit("")), v))), lambda x: x.isNotNull()), "; ")
    alone = F.array_join(F.filter(row, lambda v: v != ""), "; ")
    return F.concat(F.lit("- "), F.when((F.size(headers) == F.size(row)) & (F.size(row) > 1), named).otherwise(alone))


def packed(items: Column, limit: int | Column, extra: int = 0, separator: str = "\n") -> Column:
    """Consecutive items as chunks of at most ``limit`` characters; an oversize item is a chunk of its own.

    A chunk closes when it holds something and the next item would go beyond the limit; ``extra`` counts for each item.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"), F.lit(0).alias("n"))

    def step(s: Column, item: Column) -> Column:
        size = F.length(item) + extra
        close = (s["n"] > 0) & (s["size"] + size > limit)
        return F.struct(
            F.when(close, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(close | (s["n"] == 0), item).otherwise(F.concat(s["now"], F.lit(separator), item)).alias("now"),
            F.when(close, size).otherwise(s["size"] + size).alias("size"),
            F.when(close, 1).otherwise(s["n"] + 1).alias("n"),
        )

    end = F.aggregate(items, start, step)
    return F.when(end["n"] > 0, F.concat(end["done"], F.array(end["now"]))).otherwise(end["done"])


def diagnosis(c: Column | str) -> Column:
    """Counts, the share of broken table rows, and warnings, as a struct. Lines, rows and faults are each taken once."""

    def faults(row: Column) -> Column:
        def count(s: Column) -> Column:
            parts = s["parts"]
            first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
            return (
                F.when(F.size(parts) <= 1, 1).otherwise(0) + F.when(F.exists(parts, lambda p: F.lower(p).isin("col2", "col3", "col4")), 1).otherwise(0)
                + F.when((F.size(parts) >= 2) & (first != "") & (first == second), 1).otherwise(0)
            )

        return fn.bound(count, parts=F.transform(F.split(F.btrim(row, F.lit("|")), r"\|"), fn.strip))

    def counted(s: Column) -> dict[str, Column]:
        all_lines = s["lines"]
        rows = F.filter(all_lines, lambda x: x.startswith("|"))
        tables = F.aggregate(all_lines, F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), lambda t, x: F.struct((t["n"] + F.when(x.startswith("|") & ~t["inside"], 1).otherwise(0)).alias("n"), x.startswith("|").alias("inside")))["n"]
        numbers = F.array_sort(F.array_distinct(F.transform(F.filter(all_lines, lambda x: x.rlike(r"^\|?\s*\d{1,2}[.)|\s]")), lambda x: F.regexp_extract(x, r"^\|?\s*(\d{1,2})", 1).cast("int"))))
        return {"n_rows": F.size(rows), "bad": F.aggregate(rows, F.lit(0), lambda n, r: n + faults(r)), "tables": tables, "numbers": numbers, "headings": F.size(F.filter(all_lines, lambda x: level(x) > 0))}

    def judged(s: Column) -> Column:
        share = F.coalesce(F.try_divide(s["bad"].cast("double"), s["n_rows"]), F.lit(0.0))
        numbers = s["numbers"]
        gaps = (F.size(numbers) >= 6) & F.array_min(numbers).isin(1, 2) & (F.array_max(numbers) - F.array_min(numbers) >= 5) & (F.size(numbers) < F.array_max(numbers) - F.array_min(numbers) + 1)
        gaps = F.coalesce(gaps, F.lit(False))
        warnings = F.array_compact(F.array(F.when(share > 0.25, "table_structure_suspect"), F.when(F.length(fn.strip(c)) < 100, "very_low_text"), F.when(gaps, "numbered_row_gaps")))
        return F.struct(
            F.length(fn.col(c)).cast("long").alias("chars"), fn.word_count(c).cast("long").alias("words"), s["headings"].cast("long").alias("headings"),
            s["tables"].cast("long").alias("tables"), s["n_rows"].cast("long").alias("table_rows"), F.bround(share, 3).alias("broken"), warnings.alias("warnings"),
            ((F.length(fn.col(c)) < 100) | ((s["n_rows"] >= 5) & ((share > 0.45) | gaps))).alias("fallback"),
        )

    return fn.bound(lambda s: fn.bound(judged, **counted(s)), lines=F.transform(lines(c), fn.strip))


QUESTION = r"(?i)^\s*(?:\*\*|#+\s*|[-*]\s+)?Q(?:uestion)?\s*\d*\s*[:.)]\s*(.*?)(?:\*\*)?\s*$"
ANSWER = r"(?i)^\s*(?:\*\*|[-*]\s+)?A(?:nswer)?\s*\d*\s*[:.)]\s*(?:\*\*)?\s*(.*)$"


def qa_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Question, answer and their number; a pair runs from one question line to the next, and needs both parts."""
    rows = docs.select(key, F.posexplode(lines(text)).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    is_q, is_a = F.col("line").rlike(QUESTION), F.col("line").rlike(ANSWER)
    rows = rows.withColumn("pair", F.sum(F.when(is_q, 1).otherwise(0)).over(w)).where("pair > 0")
    answered = F.max(F.when(is_a, 1).otherwise(0)).over(Window.partitionBy(key, "pair").orderBy("line_no"))
    rows = rows.withColumns({"said": F.when(is_q, F.regexp_extract("line", QUESTION, 1)).when(is_a, F.regexp_extract("line", ANSWER, 1)).otherwise(F.col("line")), "answer": answered == 1})

    def joined(condition: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(condition, F.struct("line_no", "said"))))
        return fn.strip(F.array_join(F.transform(parts, lambda x: x["said"]), "\n"))

    pairs = rows.groupBy(key, "pair").agg(joined(~F.col("answer")).alias("question"), joined(F.col("answer")).alias("answer_text"))
    return pairs.where("question <> '' AND answer_text <> ''").select(key, F.col("pair").alias("pair_index"), "question", F.col("answer_text").alias("answer"))


def question_count(c: Column | str) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.rlike(QUESTION)))


def is_qna(c: Column | str, least: float = 0.3) -> Column:
    """Three questions at least, and so many to the paragraphs."""
    paragraphs = F.greatest(F.size(F.filter(F.split(fn.col(c), r"\n\s*\n"), lambda p: fn.strip(p) != "")), F.lit(1))
    n = question_count(c)
    return (n >= 3) & (n / paragraphs >= least)


def cleaned(c: Column | str) -> Column:
    """Page numbers, hyphenated line ends, dotted contents lines, runs of blank lines and spaces, in that order."""
    text = F.regexp_replace(fn.col(c), "\r\n?", "\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:Page\s+)?\d{1,4}(?:\s+of\s+\d{1,4})?[ \t]*$\n?", "")
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"(?m)^.*\.{4,}\s*\d+[ \t]*$\n?", "")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return fn.strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def header_depths(c: Column | str) -> Column:
    """Numbered headings get the depth of their number; bare upper-case lines become level 2."""
    def fix(line: Column) -> Column:
        number = F.regexp_extract(line, r"^#{1,6}\s+(\d+(?:\.\d+)*)\.?\s", 1)
        numbered = F.concat(F.repeat(F.lit("#"), F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6))), F.lit(" "), title(line))
        upper = (level(line) == 0) & line.rlike(r"^[A-Z][A-Z0-9 &/-]{3,80}$") & (F.size(F.split(line, " ")) <= 12)
        return F.when(number != "", numbered).when(upper, F.concat(F.lit("## "), line)).otherwise(line)

    return F.array_join(F.transform(lines(c), fix), "\n")


def merged(a: Column, b: Column, most: int = 500) -> Column:
    """Two texts, the longest overlap (the end of one is the start of the other, up to ``most``) taken once."""
    sizes = F.sequence(F.least(F.length(a), F.length(b), F.lit(most)), F.lit(0), F.lit(-1))
    overlap = F.element_at(F.filter(sizes, lambda n: F.substring(a, F.length(a) - n + 1, n) == F.substring(b, F.lit(1), n)), 1)
    return F.when(overlap > 0, F.concat(a, F.substring(b, overlap + 1, F.length(b)))).otherwise(F.concat(a, F.lit("\n"), b))


def joined_smartly(a: Column, b: Column, most: int = 500) -> Column:
    """``b`` after ``a``: a table header that both start with stands once, and text that ends ``a`` and starts ``b`` is taken once.

    The overlap is sought by the first 100 characters of the last ``most`` of ``a``; without one, a line end goes between.
    """

    def headed(s: Column) -> Column:
        la, lb = lines(s["a"]), lines(s["b"])
        same = F.contains(s["a"], F.lit("|")) & F.contains(s["b"], F.lit("|")) & (F.size(la) >= 2) & (F.size(lb) >= 2) & (F.slice(la, 1, 2) == F.slice(lb, 1, 2))
        rest = F.array_join(F.slice(lb, F.lit(3), F.greatest(F.size(lb) - 2, F.lit(0))), "\n")
        return F.struct(s["a"].alias("a"), F.when(same, F.ltrim(rest)).otherwise(s["b"]).alias("b"), F.substring(s["a"], F.greatest(F.length(s["a"]) - most, F.lit(0)) + 1, F.lit(most)).alias("tail"))

    def placed(s: Column) -> Column:
        x = s["x"]
        sought = fn.strip(F.substring(x["tail"], 1, 100))
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), x["tail"].alias("tail"), sought.alias("sought"), F.instr(x["b"], sought).alias("at"))

    def put(s: Column) -> Column:
        x = s["x"]
        overlap = F.substring(x["b"], x["at"], F.greatest(F.length(x["tail"]) - x["at"] + 1, F.lit(0)))
        fits = (x["sought"] != "") & (x["at"] > 0) & F.endswith(x["a"], overlap)
        return F.when(fits, F.concat(x["a"], F.substring(x["b"], F.length(overlap) + 1, F.length(x["b"])))).otherwise(F.concat(x["a"], F.lit("\n"), x["b"]))

    return fn.bound(lambda s: fn.bound(lambda t: fn.bound(put, x=placed(t)), x=headed(s)), a=a, b=b)


def overlapping(c: Column | str, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters that share ``overlap`` with the one before."""
    c = fn.col(c)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - overlap), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(c, s, F.lit(size)))


def normaliser_warnings(source: Column, result: Column) -> Column:
    """Too few words kept, too little text, an open code fence, lost questions."""
    kept = F.coalesce(F.try_divide(fn.word_count(result).cast("double"), fn.word_count(source)), F.lit(1.0))
    fences = F.regexp_count(result, F.lit("```"))
    lost = (question_count(source) > 0) & (question_count(result) < 0.8 * question_count(source))
    return F.array_compact(F.array(F.when(kept < 0.55, "words_lost"), F.when(fn.word_count(result) < 50, "very_short"), F.when(fences % 2 != 0, "open_fence"), F.when(lost, "questions_lost")))
