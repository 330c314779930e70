"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME`` bytes; a bundle ends in a skippable frame
with the seek table (compressed and plain size of each frame), so any frame can be found from the end
of the file and decompressed alone.  The index maps a record's identifier to bundle, frame, and the
offset and length inside the decompressed frame.

Records are read back by seeking: of a bundle its last bytes, which hold the seek table, and then the frames that are
asked for, each by its range; a frame is opened once for all records wanted from it.

Equal payloads of at least ``min_bytes`` are stored once, under the largest page_id; the other records
are revisits that name it.  Which payloads repeat comes from a grouped count of digests.  Digests that more than one page
in ``FEW`` shares are ``FEW`` at most, so they are broadcast; the others are joined by digest, each a small share of the rows.

Defined cases: a null payload is empty; a null url leaves the header out; a null page_id is smaller than
all others and is written as ``null``; rows that agree in page_id and payload are each a response;
an empty table makes no bundle and no row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, materialize_with_path, scratch_path

FRAME = 256 << 10
BUNDLE = 8 << 20
FEW = 1000
SEEK_MAGIC, SKIPPABLE = 0x8F92EAB1, 0x184D2A5E
PREFIX = "urn:lodestone:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, length long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def roles(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of each page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    repeated = large.groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated, "warc-digests")
    common = F.col("n") > F.lit(pages.count()) / FEW
    hot = repeated.where(common).select(F.col("d").alias("hot_d"), F.col("b").alias("hot_b"), F.col("keeper").alias("hot_keeper"))
    rows = rows.join(F.broadcast(hot), (rows.payload_digest == F.col("hot_d")) & (rows.payload_bytes == F.col("hot_b")), "left")  # fewer than FEW rows
    # a row that has its keeper, or needs none, looks for a digest of its own, so that it is dealt out evenly
    sought = F.when((F.col("payload_bytes") >= min_bytes) & F.col("hot_d").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "payload_digest").cast("string")))
    cold = repeated.where(~common).select("d", "b", "keeper")
    rows = rows.withColumn("sought", sought)
    joined = rows.join(cold, (rows.sought == cold.d) & (rows.payload_bytes == cold.b), "left").withColumn("keeper", F.coalesce("hot_keeper", "keeper"))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; the block of a revisit keeps the HTTP header, with the full length, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{PREFIX}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PREFIX}{refers_to}>"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames; ``finish`` gives the bytes of the bundle, seek table included."""

    def __init__(self, level: int = 3):
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_size = self.packed_size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset inside the frame."""
        if self.open_size and self.open_size + len(data) > FRAME:
            self.close_frame()
        place = len(self.frames), self.open_size
        self.open.append(data)
        self.open_size += len(data)
        return place

    def close_frame(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_size))
            self.packed_size += len(packed)
            self.open, self.open_size = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(file) -> list[tuple[int, int, int]]:
    """Of each frame: where it starts, its compressed and its plain size; from the end of an open file."""
    size = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    table = file.read_at(count * width, size - 9 - count * width)
    start, out = 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(file, table: list[tuple[int, int, int]], frame: int) -> bytes:
    """One frame, by its range."""
    start, packed, plain = table[frame]
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, start), max_output_size=plain)


def parse(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, frame[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix(PREFIX)
    return None if name == "null" else int(name)


def filesystem(uri: str):
    """The pyarrow file system of a Hadoop-style URI, and the path in it."""
    from pyarrow import fs

    if re.match(r"file:/(?!//)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes bundles under ``folder`` (a shared store) as the result is computed; the result is the index.

    Each partition is sorted, so a task that runs again writes the same bundles under the same names;
    a bundle appears under its name by a rename, whole or not at all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        store, root = filesystem(folder)
        writer, rows = BundleWriter(), []

        def flush() -> pd.DataFrame:
            nonlocal writer, rows, n
            name = f"part-{part:06d}-{n:04d}.warc.zst"
            store.create_dir(root, recursive=True)
            temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary, compression=None) as f:
                f.write(writer.finish())
            store.move(temporary, f"{root}/{name}")
            out = pd.DataFrame([(r[0], name, *r[1:]) for r in rows], columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"})
            writer, rows, n = BundleWriter(), [], n + 1
            return out

        for batch in batches:
            refs = batch["refers_to"].astype("Int64")
            for page, url, payload, digest, kind, ref in zip(batch["page_id"].astype("Int64"), batch["url"], batch["payload"], batch["payload_digest"], batch["record_type"], refs):
                page = None if page is pd.NA else int(page)
                data = record(page, url, bytes(payload), digest, kind, None if ref is pd.NA else int(ref), date)
                frame, offset = writer.add(data)
                rows.append((page, frame, offset, len(data)))
                if writer.packed_size >= BUNDLE:
                    yield flush()
        if rows:
            yield flush()

    return records.sortWithinPartitions("page_id", "payload_digest").mapInPandas(run, INDEX)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (all of it, or the rows wanted) points to, sought in the bundles; stored payloads are digested again and checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        bundle, file, table, frame, data = None, None, None, None, b""
        for batch in batches:
            rows = []
            for page, name, k, offset, length in zip(batch["page_id"].astype("Int64"), batch["bundle"], batch["frame"], batch["offset"], batch["length"]):
                if name != bundle:
                    if file is not None:
                        file.close()
                    file = store.open_input_file(f"{root}/{name}")
                    bundle, table, frame = name, seek_table(file), None
                if k != frame:
                    frame, data = k, read_frame(file, table, k)
                head, block = next(parse(data[offset : offset + length]))
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                http, _, payload = block.partition(b"\r\n\r\n")
                size, own = int(re.search(rb"Content-Length: (\d+)", http)[1]), page_of(head["WARC-Record-ID"])
                if own != (None if page is pd.NA else page):
                    raise ValueError(f"the index has page {page} where {bundle} has {own}")
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"damaged payload in record {head['WARC-Record-ID']}")
                rows.append((own, size, digest, kind, page_of(head["WARC-Refers-To"]) if kind == "revisit" else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if file is not None:
            file.close()

    return index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").select("page_id", "bundle", "frame", "offset", "length").mapInPandas(run, ROWS)


def archive(pages: DataFrame, min_bytes: int = 1000) -> tuple[DataFrame, DataFrame, str]:
    """Writes all pages, and returns the index, the records as read back, and the folder of the bundles."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)
    index, _ = materialize_with_path(write_archives(roles(pages, min_bytes), folder), "warc-index")
    return index, read_records(index, folder), folder
