"""Files in and out: text, JSON lines, manifests, listings, and the artefacts of a document."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "text string, metadata struct<filename string, doc_id string, doc_type string, chunk_kind string, chunk_index int, prev_index int, next_index int, section_path string, heading_level int, has_table boolean, parser string>"
MANIFEST_SCHEMA = "document string, parser string, run_id string, created_at string, chunk_count int"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, ``spark.checkpoint.dir``; it goes when the application ends.

    Unset, it is a temporary folder with a ``local[...]`` master and an error elsewhere.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        root = sc.getCheckpointDir()
    path = f"{root.rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its lineage is cut, and the loss of an executor costs nothing of it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """SC3: a row a file: path, text."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def chunk_files(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA, name: str = "chunks.jsonl") -> DataFrame:
    """SC4: all chunk files below a path (``name`` may be a glob); blank and malformed lines are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return rows.select("*", F.input_file_name().alias("path"), F.size(F.split(F.trim("text"), r"\s+")).alias("token_count"))


def listing(spark: SparkSession, path: str, extensions: Sequence[str], limit: int | None = None) -> DataFrame:
    """SC6, F13: files with an allowed extension, newest first; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    allowed = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*extensions)
    hidden = name.startswith(".") | name.startswith("~$") | name.rlike(r"\.(tmp|crdownload)$")
    files = files.where(allowed & ~hidden).orderBy(F.desc("modificationTime"), "path")
    return files.limit(limit) if limit else files


def manifests(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA, name: str = "manifest.json") -> DataFrame:
    """SC5: every manifest (``name`` may be a glob) with its fields and folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "modificationTime", F.from_json(F.col("content").cast("string"), schema).alias("m")).select("folder", "modificationTime", "m.*")


def artifact_runs(spark: SparkSession, path: str, extensions: Sequence[str], limit: int | None = None, name: str = "manifest.json") -> DataFrame:
    """SC5: a row a manifest, newest first, with the files of its folder by name; a folder holds few files."""
    beside = listing(spark, path, extensions).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "path")
    beside = beside.groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("name", "path"))).alias("files"))
    runs = manifests(spark, path, name=name).join(beside, "folder", "left").orderBy(F.desc("modificationTime"), "folder")
    return runs.limit(limit) if limit else runs


def layout_page_rows(blocks: DataFrame, key: str, page: str, x: str, y: str, order: str, text: str) -> DataFrame:
    """SC10: a row a page: its blocks from top to bottom, then left to right, as a paragraph each under the page's anchor and heading.

    Places are compared to a tenth, and blocks at one place stay in ``order``. Blank blocks are left out, and so are pages without any other.
    """
    body = F.trim(text)
    place = F.struct(F.bround(y, 1).alias("y"), F.bround(x, 1).alias("x"), F.col(order).alias("o"), body.alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(place)), lambda b: b["t"])
    pages = blocks.where(body != "").groupBy(key, page).agg(parts.alias("_parts"))
    number = F.col(page).cast("string")
    head = F.array(F.concat(F.lit("<!-- page:"), number, F.lit(" -->")), F.concat(F.lit("## Page "), number))
    return pages.select(key, page, F.array_join(F.concat(head, "_parts"), "\n\n").alias("markdown"))


def layout_pages(blocks: DataFrame, key: str, page: str, x: str, y: str, order: str, text: str) -> DataFrame:
    """SC10: the pages of a document, in order, as one text: for keys that are documents, whose pages fit in a row."""
    pages = layout_page_rows(blocks, key, page, x, y, order, text)
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "markdown"))), lambda p: p["markdown"]), "\n\n").alias("markdown"))


def pages_to_markdown(pages: DataFrame, order: Sequence[str], text: str, key: str) -> DataFrame:
    """SC12, SC10: the pages of a document in order, each under an anchor; an empty one is marked."""
    body = F.when(F.trim(text) == "", F.lit("[unclear]")).otherwise(F.trim(text))
    part = F.concat(F.lit("<!-- page "), F.col(order[0]).cast("string"), F.lit(" -->\n"), body)
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("_p")))), lambda x: x["_p"]), "\n\n").alias("markdown"))


def rows_to_table(rows: Column) -> Column:
    """SC11: an array of rows of cells as a pipe table, padded to the widest row; empty rows are dropped."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))

    def line(r: Column) -> Column:
        padded = F.concat(F.transform(r, lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), width - F.size(r)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    drawn = F.transform(full, line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.when(F.size(full) > 0, F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, F.lit(2), F.greatest(F.size(drawn) - 1, F.lit(0)))), "\n")).otherwise("")


def write_chunks(chunks: DataFrame, path: str, by: Sequence[str] = ("document", "parser")) -> None:
    """SK11: JSON lines, a folder a document and parser; a document that is written again is replaced, others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def write_manifests(chunks: DataFrame, path: str, by: Sequence[str] = ("document", "parser")) -> None:
    """SK11: a manifest for each folder of ``write_chunks``, with its keys and number of chunks; below a path of its own."""
    counts = chunks.groupBy(*by).agg(F.count("*").alias("chunk_count"))
    folders = [F.col(c).alias(f"{c}_folder") for c in by]
    counts.select("*", *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(f"{c}_folder" for c in by)).json(path)


def append_vectors(rows: DataFrame, path: str) -> None:
    """SK1."""
    rows.write.mode("append").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """SK3: an empty table with the same columns."""
    kept = spark.read.parquet(path).schema
    spark.createDataFrame([], kept).write.mode("overwrite").parquet(path)


def new_files(spark: SparkSession, path: str, per_trigger: int = 4) -> DataFrame:
    """ST1, ST5: a stream of new text files, so many at a time."""
    stream = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path, wholetext=True, recursiveFileLookup=True)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def once(arrivals: DataFrame, within: str = "10 minutes") -> DataFrame:
    """ST3: one arrival of each version (path and time) of a file; a repeat that comes ``within`` is passed over, state older than that goes.

    A file that is written again has another time and so comes through.
    """
    return arrivals.withWatermark("modified", within).dropDuplicatesWithinWatermark(["path", "modified"])


def drain(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream has now, as a table below ``path``, which also keeps the stream's progress."""
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
