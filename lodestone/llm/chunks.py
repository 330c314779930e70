"""Chunks of documents, and the exchange of packed key sets between them.

Finding what repeats in a corpus means comparing every window with every other.  A row a window would make
the shuffle several times the corpus, so the tasks work on chunks of a few megabytes of text: a chunk
turns its windows into a sorted set of keys, cut by key range into buckets, difference-coded and compressed
(about two to five bytes a key); a bucket's task sees the sets of all chunks, finds what repeats, and
answers each chunk with a bit a key.  A key that is everywhere is in each chunk's set once, so no
bucket is larger than its share of distinct keys a chunk.  Numbers of buckets and bits follow the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
#: Keys that a bucket gets, about.
BUCKET_KEYS = 1 << 20
CHUNKS = "chunk long, n_docs long, n_bytes long, sizes binary, blob binary, rest binary"
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # odd, and far from 1 modulo powers of two
_powers: list[np.ndarray] = []


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def swell(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` as a table of chunks in the shared folder: texts together in UTF-8, other columns as they were."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal n, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            text = pa.chunked_array(rows.column("text")).cast(pa.large_binary()).combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            blob = memoryview(text.buffers()[2] or b"")[offsets[0] : offsets[-1]]
            sizes = np.diff(offsets).astype(np.int64)
            sink = pa.BufferOutputStream()
            rest = rows.drop_columns(["text"])
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            row = {"chunk": [(part << 32) + n], "n_docs": [len(rows)], "n_bytes": [len(blob)], "sizes": [sizes.tobytes()], "blob": [squeeze(bytes(blob), 3)], "rest": [squeeze(sink.getvalue().to_pybytes())]}
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("chunk", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), *((c, pa.binary()) for c in ("sizes", "blob", "rest"))]))

        for batch in batches:
            k = batch.schema.get_field_index("text")
            text = batch.column(k).fill_null("")
            batch = batch.set_column(k, "text", text)
            length = np.asarray(text.cast(pa.large_binary()).buffers()[1] and pa.compute.binary_length(text), np.int64) if len(text) else np.zeros(0, np.int64)
            at = 0
            while at < len(batch):
                total = np.cumsum(length[at:])
                take = max(1, int(np.searchsorted(total, chunk_bytes - size, "right")))
                held.append(batch.slice(at, take))
                size += int(total[take - 1])
                at += take
                if size >= chunk_bytes or at < len(batch):
                    yield out()
        if held:
            yield out()

    kept = docs.select(*(docs[c].cast("string").alias(c) if c == "text" else docs[c] for c in names))
    return materialize(kept.mapInArrow(run, CHUNKS), "chunks")


class Chunk:
    """A chunk's documents as bytes; ``blocks`` gives runs of whole documents of about a megabyte."""

    def __init__(self, sizes: bytes, blob: bytes, rest: bytes):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.data = np.frombuffer(swell(blob), np.uint8) if self.sizes.sum() else np.zeros(0, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self._rest = rest

    def rest(self) -> pa.Table:
        return pa.ipc.open_stream(swell(self._rest)).read_all()

    def doc_ids(self) -> np.ndarray:
        """A null doc_id as the largest number."""
        return np.asarray(self.rest().column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).max), np.int64)

    def blocks(self, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First document, bytes, and sizes of the documents of each block."""
        at, k = 0, 0
        while k < len(self.sizes):
            to = max(k + 1, int(np.searchsorted(self.ends, at + size, "right")))
            end = int(self.ends[to - 1])
            yield k, self.data[at:end], self.sizes[k:to]
            at, k = end, to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(1, U)
            while len(p) < size:
                p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
            _powers.append(p)
    return _powers[0], _powers[1]


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """sums[i]: of data[k] * base**k for k < i; with ``span_hash`` the hash of any span in constant time."""
    forward, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * forward[: len(data)], out=sums[1:])  # modulo 2**64
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def substituted(data: np.ndarray) -> np.ndarray:
    """Each byte by another number: a second hash of the same bytes, independent of the first."""
    return mixed(np.arange(1, 257, dtype=U))[data]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte plane by byte plane, compressed."""
    return squeeze(np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()) if len(keys) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    planes = np.frombuffer(swell(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def pack_numbers(x: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()) if len(x) else b""


def unpack_numbers(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(swell(data), np.uint8).reshape(8, -1).T).view(kind).ravel() if data else np.zeros(0, kind)


def pack_bits(mask: np.ndarray) -> bytes:
    return squeeze(len(mask).to_bytes(8, "little") + np.packbits(mask).tobytes())


def unpack_bits(data: bytes) -> np.ndarray:
    raw = swell(data)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(np.bool_)


def key_bits(n: int, extra: int) -> int:
    return min(62, max(24, math.ceil(math.log2(max(n, 2))) + extra))


def bucket_count(n: int) -> int:
    return max(8, math.ceil(n / BUCKET_KEYS))


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """floor(((key + 1) * buckets - 1) / 2**bits) of 64-bit keys: ranges of equal width, in order; a product of two halves."""
    low = (keys & U(0xFFFFFFFF)) * U(buckets) + U(buckets - 1)
    high = (keys >> U(32)) * U(buckets) + (low >> U(32))
    if bits >= 32:
        return (high >> U(bits - 32)).astype(np.int64)
    return ((high << U(32 - bits)) | ((low & U(0xFFFFFFFF)) >> U(bits))).astype(np.int64)


class Spans:
    """Where the keys of each bucket lie in sorted keys of so many bits; the cost follows the keys, not the buckets."""

    def __init__(self, keys: np.ndarray, bits: int, buckets: int):
        owner = bucket_of(keys, bits, buckets)
        starts = np.flatnonzero(np.r_[np.ones(min(len(keys), 1), np.bool_), owner[1:] != owner[:-1]])
        self.full, self.edges = owner[starts], np.append(starts, len(keys))

    def __iter__(self) -> Iterator[tuple[int, slice]]:
        """The buckets that have keys."""
        return ((b, slice(x, y)) for b, x, y in zip(self.full.tolist(), self.edges[:-1].tolist(), self.edges[1:].tolist()))

    def __getitem__(self, bucket: int) -> slice:
        k = int(np.searchsorted(self.full, bucket))
        return slice(self.edges[k], self.edges[k + 1]) if k < len(self.full) and self.full[k] == bucket else slice(0, 0)


SETS = "bucket int, chunk long, keys binary, side binary"
ANSWERS = "bucket int, chunk long, bits binary, side binary"
_SETS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("side", pa.binary())])
_ANSWERS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("bits", pa.binary()), ("side", pa.binary())])


def key_rows(chunk: int, keys: np.ndarray, bits: int, buckets: int, side: np.ndarray | None = None) -> pa.Table:
    """A row for each bucket that the chunk has keys for; ``side``: a number, or a row of them, that goes with each key."""
    spans = Spans(keys, bits, buckets)
    full = spans.full
    packed = [pack_sorted(keys[s]) for _, s in spans]
    sides = [pack_numbers(side[s]) for _, s in spans] if side is not None else [None] * len(full)
    return pa.table([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array(packed, pa.binary()), pa.array(sides, pa.binary())], schema=_SETS)


def answers(sets: DataFrame, repeated: Callable) -> DataFrame:
    """Runs ``repeated`` on each bucket: [(keys, side)] by chunk to [(mask, side of the marked) or None] by chunk."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        given = [(unpack_sorted(k), unpack_numbers(s) if s is not None else None) for k, s in zip(rows.column("keys").to_pylist(), rows.column("side").to_pylist())]
        found = repeated(given)
        out = [(b, c, pack_bits(m[0]), None if m[1] is None else pack_numbers(m[1])) for b, c, m in zip(rows.column("bucket").to_pylist(), rows.column("chunk").to_pylist(), found) if m is not None and m[0].any()]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _ANSWERS)] if out else [pa.array([], f.type) for f in _ANSWERS], schema=_ANSWERS)

    return sets.groupBy("bucket").applyInArrow(run, ANSWERS)


def marked(keys: np.ndarray, bits: int, buckets: int, found: list[tuple[int, bytes, bytes | None]]) -> tuple[np.ndarray, np.ndarray | None]:
    """The mask over a chunk's sorted keys, from the answers of its buckets, and what came with the marked keys."""
    mask, spans, sides = np.zeros(len(keys), np.bool_), Spans(keys, bits, buckets), []
    for bucket, packed, side in sorted(found, key=lambda x: x[0]):
        mask[spans[bucket]] = unpack_bits(packed)
        if side is not None:
            sides.append(unpack_numbers(side))
    return mask, np.concatenate(sides) if sides else None


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``of``: a table of low bits first, a search for those that pass."""
    if not len(of) or not len(x):
        return np.zeros(len(x), np.bool_)
    low = U((1 << max(16, min(24, len(of).bit_length() + 3))) - 1)
    table = np.zeros(int(low) + 1, np.bool_)
    table[(of & low).astype(np.int64)] = True
    out = table[(x & low).astype(np.int64)]
    at = np.flatnonzero(out)
    y = x[at]
    out[at] = of[np.minimum(np.searchsorted(of, y), len(of) - 1)] == y
    return out


def total(chunks: DataFrame, column: str = "n_bytes") -> int:
    return int(chunks.agg(F.sum(column)).first()[0] or 0)
