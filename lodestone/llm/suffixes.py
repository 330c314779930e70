"""Suffix-array dedup with a logarithmic index family.

A byte goes if a string of ``LENGTH`` bytes over it also starts somewhere else.

1. Anchors.  Each string of ``length`` bytes selects the span of ``gram`` bytes in it with the smallest hash, the
   same one wherever the string stands.  About one place in 150 is selected; these are the suffixes that are indexed.
2. Family.  A level is a sorted array of the anchors' keys, cut by key range into buckets, a row each, in a table in the
   shared folder.  A new batch's array is merge-scanned against every level; keys that come again are told to the
   chunks that hold them, of this batch or of an earlier one.  Levels that are not more than twice as large as
   what is put on top of them merge with it in the same pass, so there are logarithmically many.
3. Suffix arrays.  Anchors whose key comes twice or more send the bytes about them (``length`` to the right, the rest of the
   longest string to the left) to the bucket of their key.  There the suffixes are sorted as bytes, to the right and
   to the left, with the lengths of the matches between neighbours; a string that starts d bytes before two anchors is
   one string if they match for d bytes to the left and ``length`` - d to the right.  Bytes decide, not hashes.
4. A key that comes more than ``crowd`` times would be a bucket of its own.  The strings about such anchors are exchanged
   by 128-bit hashes instead, each once a chunk, over buckets by hash: exact but for a chance of 1e-12 at 1e13 strings.

``SuffixFamily`` keeps texts, anchors and levels under a folder: batches are added one after the other, and ``results`` gives
what goes from all documents added so far.

Defined cases: a null text is empty; texts shorter than ``length`` keep all; matches never cross documents,
but may lie in one document and may overlap; repeated rows are documents of their own, and so repeat each
other; other columns pass through, but one with the name of a result column gives way to it; an empty table gives
no rows.  What stays need not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lodestone.llm import chunks as ch
from lodestone.llm.common import Scratch

LENGTH = 400
GRAM = 100
#: Batches that a table is added to the family in.
BATCHES = 4
#: A key with more anchors than this is exchanged string by string.
CROWD = 4096
#: Anchors that a bucket of suffixes gets, about, if every anchor comes again.
BUCKET_ANCHORS = 1 << 16
RESULTS = ("kept", "n_bytes", "n_removed", "n_spans")
ANCHORS = "chunk long, batch int, n long, at binary, keys binary"
SCAN = "bucket int, chunk long, keys binary, owners binary"
U = np.uint64
_NONE = np.uint32(0xFFFFFFFF)
_SCAN = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary())])


def sliding(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over x[i : i + width] for each i with a whole range: two running passes over blocks of ``width``."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that some string of ``length`` bytes in a document selects, and the keys of the spans there."""
    n, width = len(data), length - gram + 1
    ends = np.cumsum(sizes)
    starts = np.zeros(max(0, n - length + 1), np.bool_)  # of strings
    for a, b in zip(ends - sizes, ends):
        starts[a : max(a, b - length + 1)] = True
    if not starts.any():
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n - gram + 1)
    span = ch.span_hash(ch.prefix_hashes(data), at, at + gram)
    return selected((span >> U(33)).astype(np.uint32), starts, width, span)


def selected(low: np.ndarray, starts: np.ndarray, width: int, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low: numbers below 2**31 that selection goes by; raised by one, so that 0 and the fill are no one's."""
    low = low + np.uint32(1)
    least = sliding(low, width, np.minimum, int(_NONE))
    wanted = np.zeros(len(low) + width - 1, np.uint32)
    wanted[width - 1 : width - 1 + len(least)] = np.where(starts, least, 0)
    places = np.flatnonzero(sliding(wanted, width, np.maximum, 0) == low)
    return places, ch.mixed(span[places])  # hashed anew: the least hashes are chosen, so their top bits are nearly all zero


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def merge_scan(batch: list[tuple[int, np.ndarray, np.ndarray]], levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """A bucket of a new batch (chunk, sorted keys, how often) against its levels (sorted keys, owners).

    An owner is the one chunk that holds a key, or -1 where all that hold it have been told that it comes again.
    Gives what chunks are told, and the batch as an array of keys and owners.
    """
    key = np.concatenate([np.zeros(0, U), *(k for _, k, _ in batch)])
    chunk = np.concatenate([np.zeros(0, np.int64), *(np.full(len(k), c, np.int64) for c, k, _ in batch)])
    many = np.concatenate([np.zeros(0, np.bool_), *(n > 1 for _, _, n in batch)])
    order = np.argsort(key, kind="stable")
    key, chunk, many = key[order], chunk[order], many[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    distinct, group = key[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    hot = (np.diff(np.r_[first, len(key)]) > 1) | (np.bitwise_or.reduceat(many, first) if len(first) else many)
    told = []
    for keys, owners in levels:
        at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        found = keys[at] == distinct if len(keys) else np.zeros(len(distinct), np.bool_)
        hot |= found
        mine = at[found & (owners[at] >= 0) if len(keys) else found]
        mine = mine[np.argsort(owners[mine], kind="stable")]
        edge = np.flatnonzero(np.diff(owners[mine], prepend=-1))
        told += [(int(owners[m[0]]), keys[m]) for m in np.split(mine, edge[1:]) if len(m)]
    again = hot[group]
    told += [(c, k[ch.member(k, distinct[hot])]) for c, k, _ in batch] if again.any() else []
    return [(c, k) for c, k in told if len(k)], distinct, np.where(hot, -1, chunk[first])


def merged_levels(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One array from several; a key in more than one has been told of."""
    keys, owners = np.concatenate([k for k, _ in parts]), np.concatenate([o for _, o in parts])
    order = np.argsort(keys, kind="stable")  # ascending runs: a merge
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.minimum.reduceat(owners, first) if len(first) else owners


# bytes about anchors


def record_size(length: int, gram: int) -> int:
    return length + 2 + (length - gram) + 2


def records(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A row an anchor: ``length`` bytes to the right, how many are there, bytes to the left backwards, how many are there."""
    reach = length - gram
    padded = np.zeros(reach + len(data) + length, np.uint8)
    padded[reach : reach + len(data)] = data
    window = np.lib.stride_tricks.sliding_window_view(padded, reach + length)
    out = np.zeros((len(at), record_size(length, gram)), np.uint8)
    for k in range(0, len(at), 8192):
        a, b, e = at[k : k + 8192], begin[k : k + 8192], end[k : k + 8192]
        rows, cell = window[a], out[k : k + 8192]
        right, left = np.minimum(e - a, length), np.minimum(a - b, reach)
        cell[:, :length] = np.where(np.arange(length) < right[:, None], rows[:, reach:], 0)
        cell[:, length + 2 : -2] = np.where(np.arange(reach) < left[:, None], rows[:, reach - 1 :: -1], 0)
        for place, size in ((length, right), (record_size(length, gram) - 2, left)):
            cell[:, place], cell[:, place + 1] = size >> 8, size & 255
    return out


def sort_order(rows: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(rows)
    return np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")


def neighbour_matches(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How long each sorted row and the one before it match; none before the first."""
    out = np.zeros(len(rows), np.int64)
    for k in range(1, len(rows), 8192):
        differ = rows[k : k + 8192] != rows[k - 1 : k + 8191][: len(rows) - k]
        out[k : k + 8192] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def repeated_strings(rows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each record and d in 0 .. length - gram: whether the string that starts d bytes before its anchor comes again."""
    reach = length - gram
    order = sort_order(rows)
    rows = rows[order]
    new = np.ones(len(rows), np.bool_)
    for k in range(1, len(rows), 8192):
        new[k : k + 8192] = (rows[k : k + 8192] != rows[k - 1 : k + 8191][: len(rows) - k]).any(1)
    first = np.flatnonzero(new)
    kind, rows = np.cumsum(new) - 1, rows[first]  # equal records are one kind
    n = len(rows)
    right = rows[:, length].astype(np.int64) * 256 + rows[:, length + 1]
    left = rows[:, -2].astype(np.int64) * 256 + rows[:, -1]
    match_r = neighbour_matches(rows[:, :length], right)
    by_left = sort_order(rows[:, length + 2 :])
    match_l = neighbour_matches(rows[by_left][:, length + 2 : -2], left[by_left])
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    most_r = np.maximum(match_r, np.r_[match_r[1:], 0])
    most_l = np.maximum(match_l, np.r_[match_l[1:], 0])[rank]
    mask = np.zeros((n, reach + 1), np.bool_)
    for d in range(reach + 1):
        open_ = np.flatnonzero((most_r >= length - d) & (most_l >= d))
        if len(open_) > 1:
            group = np.cumsum(match_r < length - d)[open_] * (n + 1) + np.cumsum(match_l < d)[rank[open_]]
            by = np.argsort(group, kind="stable")
            same = group[by[1:]] == group[by[:-1]]
            mask[open_[by[1:][same]], d] = mask[open_[by[:-1][same]], d] = True
    twice = np.diff(np.r_[first, len(kind)]) > 1
    d = np.arange(reach + 1)
    mask[twice] |= (d <= left[twice, None]) & (length - d <= right[twice, None])
    out = np.empty((len(kind), reach + 1), np.bool_)
    out[order] = mask[kind]
    return out


class Part:
    """A chunk with its anchors, and which of them have keys that come again."""

    def __init__(self, cell: dict, told: list[bytes], crowded: list[bytes]):
        self.chunk = ch.Chunk(cell["sizes"], cell["blob"], cell["rest"])
        at, keys = np.frombuffer(ch.swell(cell["at"]), np.int64), np.frombuffer(ch.swell(cell["keys"]), U)
        hot = np.sort(np.concatenate([np.zeros(0, U), *map(ch.unpack_sorted, told)]))
        many = np.sort(np.concatenate([np.zeros(0, U), *map(ch.unpack_sorted, crowded)]))
        pick = ch.member(keys, hot)
        at, keys = at[pick], keys[pick]
        far = ch.member(keys, many)
        order = np.argsort(keys[~far], kind="stable")
        self.at, self.keys, self.crowded = at[~far][order], keys[~far][order], at[far]

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(self.chunk.ends, at, "right")
        return self.chunk.ends[doc] - self.chunk.sizes[doc], self.chunk.ends[doc]

    def strings(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128-bit keys, in two parts, and starts of the strings over crowded anchors."""
        begin, end = self.bounds(self.crowded)
        step = np.zeros(len(self.chunk.data) + 2, np.int32)
        low, high = np.maximum(begin, self.crowded - (length - gram)), np.minimum(self.crowded, end - length)
        fine = low <= high
        np.add.at(step, low[fine], 1)
        np.add.at(step, high[fine] + 1, -1)
        at = np.flatnonzero(np.cumsum(step) > 0)
        one, two = [np.zeros(0, U)], [np.zeros(0, U)]
        base = 0
        for _, data, _ in self.chunk.blocks():
            own = at[(at >= base) & (at < base + len(data))] - base
            sums = ch.prefix_hashes(data)
            one.append(ch.span_hash(sums, own, own + length))
            two.append(ch.span_hash(ch.prefix_hashes(ch.substituted(data)), own, own + length))
            base += len(data)
        return np.concatenate(one), np.concatenate(two), at


class SuffixFamily:
    """Texts, anchors and levels of all batches so far, in tables under the shared folder."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD):
        self.length, self.gram, self.crowd = length, gram, crowd
        self.texts: list[DataFrame] = []
        self.anchors: list[DataFrame] = []
        self.told: list[DataFrame] = []
        self.levels: list[tuple[int, DataFrame]] = []  # larger ones first
        self.buckets = 0
        self.held = Scratch()

    def add(self, docs: DataFrame, batches: int = 1) -> SuffixFamily:
        """Documents in so many batches, one after the other. All must have the same columns."""
        length, gram = self.length, self.gram
        docs = docs.drop(*(c for c in docs.columns if c.lower() in RESULTS))
        texts = ch.chunked(docs)
        self.schema = docs.schema
        known = len(self.texts) << 56  # chunk numbers of a later call differ
        texts = texts.withColumn("chunk", F.col("chunk") + F.lit(known))

        def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows:
                for name, sizes, blob in zip(*(row.column(c).to_pylist() for c in ("chunk", "sizes", "blob"))):
                    places, keys, base = [np.zeros(0, np.int64)], [np.zeros(0, U)], 0
                    for _, data, size in ch.Chunk(sizes, blob, b"").blocks():
                        at, key = anchors(data, size, length, gram)
                        places.append(at + base)
                        keys.append(key)
                        base += len(data)
                    at, key = np.concatenate(places), np.concatenate(keys)
                    batch = int(ch.mixed(np.array([name], U))[0] % U(batches))
                    yield pa.RecordBatch.from_pydict({"chunk": [name], "batch": [batch], "n": [len(at)], "at": [ch.squeeze(at.tobytes())], "keys": [ch.squeeze(key.tobytes())]}, schema=pa.schema([("chunk", pa.int64()), ("batch", pa.int32()), ("n", pa.int64()), ("at", pa.binary()), ("keys", pa.binary())]))

        found = self.held.keep(texts.select("chunk", "sizes", "blob").mapInArrow(find, ANCHORS), "anchors")
        sizes = {r["batch"]: r["n"] for r in found.groupBy("batch").agg(F.sum("n").alias("n")).collect()}  # a row a batch
        self.texts.append(texts)
        self.anchors.append(found)
        if not self.buckets:  # fixed for the family's life, so that levels merge bucket by bucket
            self.buckets = ch.bucket_count(max(1, sum(sizes.values())))
        for batch in sorted(sizes):
            self.scan(found.where(F.col("batch") == batch), sizes[batch])
        return self

    def scan(self, batch: DataFrame, size: int) -> None:
        """Merge-scan of a batch against all levels; it becomes a level, merged with those it has grown up to."""
        buckets, kept, under = self.buckets, list(self.levels), []
        while kept and kept[-1][0] <= 2 * size:
            n, level = kept.pop()
            size += n
            under.append(level)

        def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows:
                for name, keys in zip(row.column("chunk").to_pylist(), row.column("keys").to_pylist()):
                    distinct, n = repeats(np.frombuffer(ch.swell(keys), U))
                    yield from ch.key_rows(name, distinct, 64, buckets, n.astype(np.int64)).to_batches()

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            bucket = (left if len(left) else right).column("bucket")[0].as_py()
            new = [(c, ch.unpack_sorted(k), ch.unpack_numbers(n)) for c, k, n in zip(*(left.column(x).to_pylist() for x in ("chunk", "keys", "side")))]
            levels = [(ch.unpack_sorted(k), ch.unpack_numbers(o), m) for k, o, m in zip(*(right.column(x).to_pylist() for x in ("keys", "owners", "merges")))]
            told, keys, owners = merge_scan(new, [x[:2] for x in levels])
            keys, owners = merged_levels([(keys, owners), *(x[:2] for x in levels if x[2])])
            out = [(bucket, c, ch.pack_sorted(k), None) for c, k in told] + [(bucket, None, ch.pack_sorted(keys), ch.pack_numbers(owners))]
            return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _SCAN)], schema=_SCAN)

        sets = batch.select("chunk", "keys").mapInArrow(cut, ch.SETS)
        old = [x.withColumn("merges", F.lit(False)) for _, x in kept] + [x.withColumn("merges", F.lit(True)) for x in under]
        if old:
            levels = old[0]
            for x in old[1:]:
                levels = levels.unionByName(x)
        else:
            levels = sets.limit(0).select("bucket", "keys", F.col("side").alias("owners"), F.lit(False).alias("merges"))
        out = self.held.keep(sets.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(scan, SCAN), "scan")
        self.told.append(out.where("chunk IS NOT NULL").select("chunk", "keys"))
        self.levels = [*kept, (size, out.where("chunk IS NULL").select("bucket", "keys", "owners"))]

    def results(self) -> DataFrame:
        """The columns of the documents but text, with kept (binary), n_bytes, n_removed, n_spans, of all batches so far."""
        length, gram, crowd = self.length, self.gram, self.crowd

        def union(frames: list[DataFrame]) -> DataFrame:
            out = frames[0]
            for x in frames[1:]:
                out = out.unionByName(x)
            return out

        texts, found = union(self.texts), union(self.anchors)
        told = union(self.told) if self.told else found.limit(0).select("chunk", "keys")
        n_anchors = int(found.agg(F.sum("n")).first()[0] or 0)
        many, wide = max(8, -(-n_anchors // BUCKET_ANCHORS)), ch.bucket_count(64 * n_anchors)

        def counts(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return ch._SETS.empty_table()
            keys = np.frombuffer(ch.swell(left.column("keys")[0].as_py()), U)
            hot = np.sort(np.concatenate([ch.unpack_sorted(k) for k in right.column("keys").to_pylist()]))
            distinct, n = repeats(keys[ch.member(keys, hot)])
            return ch.key_rows(left.column("chunk")[0].as_py(), distinct, 64, buckets, n.astype(np.int64))

        def crowds(given: list) -> list:
            """Keys with more than ``crowd`` anchors in all chunks together."""
            key, n = np.concatenate([k for k, _ in given]), np.concatenate([n for _, n in given])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            hot = key[first][np.add.reduceat(n, first) > crowd] if len(first) else key
            return [(ch.member(k, hot), None) for k, _ in given]

        buckets = self.buckets or 8
        hot = told.groupBy("chunk").agg(F.collect_list("keys").alias("told"))  # a chunk's own keys, bounded by its anchors
        sets = self.held.keep(found.select("chunk", "keys").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(counts, ch.SETS), "hot")
        marked = ch.answers(sets, crowds).select("bucket", "chunk", F.col("bits")).join(sets.select("bucket", "chunk", "keys"), ["bucket", "chunk"])

        def picked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows:
                packed = [ch.pack_sorted(ch.unpack_sorted(k)[ch.unpack_bits(b)]) for k, b in zip(row.column("keys").to_pylist(), row.column("bits").to_pylist())]
                yield pa.RecordBatch.from_arrays([row.column("chunk"), pa.array(packed, pa.binary())], names=["chunk", "keys"])

        crowded = marked.select("chunk", "keys", "bits").mapInArrow(picked, "chunk long, keys binary").groupBy("chunk").agg(F.collect_list("keys").alias("crowded"))
        about = hot.join(crowded, "chunk", "left")
        about = self.held.keep(found.select("chunk", "at", "keys").join(about, "chunk"), "about")
        cells = texts.select("chunk", "sizes", "blob", "rest")

        def part(left: pa.Table, right: pa.Table) -> Part:
            cell = {c: left.column(c)[0].as_py() for c in ("sizes", "blob", "rest")} | {c: right.column(c)[0].as_py() for c in ("at", "keys")}
            return Part(cell, right.column("told")[0].as_py(), right.column("crowded")[0].as_py() or [])

        size = record_size(length, gram)

        def send(left: pa.Table, right: pa.Table) -> pa.Table:
            """Rows of kind 0: bytes about anchors by key range; of kind 1: 128-bit keys of strings over crowded ones."""
            kinds, bucket, name, keys, side, check = ([] for _ in range(6))
            if len(left) and len(right):
                p, chunk = part(left, right), left.column("chunk")[0].as_py()
                begin, end = p.bounds(p.at)
                for b, s in ch.Spans(p.keys, 64, many):
                    blob = records(p.chunk.data, begin[s], end[s], p.at[s], length, gram)
                    for out, x in zip((kinds, bucket, name, keys, side, check), (0, b, chunk, ch.squeeze(blob.tobytes(), 3), None, None)):
                        out.append(x)
                if len(p.crowded):
                    one, two, _ = p.strings(length, gram)
                    order = np.lexsort((two, one))
                    one, two = one[order], two[order]
                    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
                    first = np.flatnonzero(new)
                    n = np.diff(np.r_[first, len(one)])
                    one, two = one[first], two[first]
                    for b, s in ch.Spans(one, 64, wide):
                        for out, x in zip((kinds, bucket, name, keys, side, check), (1, b, chunk, ch.pack_sorted(one[s]), ch.pack_numbers(two[s]), ch.pack_bits(n[s] > 1))):
                            out.append(x)
            return pa.table([pa.array(kinds, pa.int32()), pa.array(bucket, pa.int32()), pa.array(name, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, side, check))], names=["kind", "bucket", "chunk", "keys", "side", "check"])

        def repeated(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("chunk")
            kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
            names, keys = rows.column("chunk").to_pylist(), rows.column("keys").to_pylist()
            if kind == 0:
                cells = [np.frombuffer(ch.swell(k), np.uint8).reshape(-1, size) for k in keys]
                mask = repeated_strings(np.concatenate(cells), length, gram)
                masks = np.split(mask, np.cumsum([len(c) for c in cells])[:-1])
                found = [ch.squeeze(np.packbits(m, axis=1).tobytes()) if m.any() else None for m in masks]
            else:
                found = repeated_pairs([ch.unpack_sorted(k) for k in keys], [ch.unpack_numbers(s, U) for s in rows.column("side").to_pylist()], [ch.unpack_bits(c) for c in rows.column("check").to_pylist()])
                found = [ch.pack_bits(m) if m.any() else None for m in found]
            out = [(kind, bucket, c, m) for c, m in zip(names, found) if m is not None]
            return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["kind", "bucket", "chunk", "masks"])

        sent = cells.groupBy("chunk").cogroup(about.groupBy("chunk")).applyInArrow(send, "kind int, bucket int, chunk long, keys binary, side binary, check binary")
        masks = sent.groupBy("kind", "bucket").applyInArrow(repeated, "kind int, bucket int, chunk long, masks binary")
        masks = masks.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "masks")).alias("found"))  # a chunk's own
        both = about.join(masks, "chunk")
        schema = StructType([f for f in self.schema.fields if f.name != "text"] + [StructField("kept", BinaryType())] + [StructField(c, LongType()) for c in RESULTS[1:]])

        def clear(left: pa.Table, right: pa.Table) -> pa.Table:
            chunk = ch.Chunk(*(left.column(c)[0].as_py() for c in ("sizes", "blob", "rest")))
            starts = np.zeros(0, np.int64)
            if len(right):
                p = part(left, right)
                rows = right.column("found")[0].as_py()
                spans, lost = ch.Spans(p.keys, 64, many), [starts]
                for row in (r for r in rows if r["kind"] == 0):
                    at = p.at[spans[row["bucket"]]]
                    mask = np.unpackbits(np.frombuffer(ch.swell(row["masks"]), np.uint8).reshape(len(at), -1), axis=1, count=length - gram + 1)
                    r, d = np.nonzero(mask)
                    lost.append(at[r] - d)
                far = sorted(((r["bucket"], r["masks"]) for r in rows if r["kind"] == 1), key=lambda x: x[0])
                if far:
                    one, two, at = p.strings(length, gram)
                    order = np.lexsort((two, one))
                    one, two, at = one[order], two[order], at[order]
                    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
                    first = np.flatnonzero(new)
                    mask, spans = np.zeros(len(first), np.bool_), ch.Spans(one[first], 64, wide)
                    for b, bits in far:
                        mask[spans[b]] = ch.unpack_bits(bits)
                    lost.append(at[mask[np.cumsum(new) - 1]])
                starts = np.unique(np.concatenate(lost))
            return without(chunk, starts, length)

        return cells.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(clear, schema)


def repeated_pairs(one: list[np.ndarray], two: list[np.ndarray], many: list[np.ndarray]) -> list[np.ndarray]:
    """Of two-part keys, each once a chunk: which come in several chunks or more than once in their own."""
    a, b, m = (np.concatenate(x) for x in (one, two, many))
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    hot = np.zeros(len(a), np.bool_)
    hot[order[1:][same]] = hot[order[:-1][same]] = True
    return np.split(hot | m, np.cumsum([len(x) for x in one])[:-1])


def without(chunk: ch.Chunk, starts: np.ndarray, length: int) -> pa.Table:
    """The documents of a chunk without the bytes that the strings at ``starts`` cover."""
    step = np.zeros(len(chunk.data) + 1, np.int32)
    step[starts] += 1
    step[starts + length] -= 1
    gone = np.cumsum(step[:-1], dtype=np.int32) > 0
    begins = chunk.ends - chunk.sizes
    fresh = gone.copy()
    fresh[1:] &= ~gone[:-1]
    fresh[begins[chunk.sizes > 0]] |= gone[begins[chunk.sizes > 0]]
    upto = [np.r_[0, np.cumsum(x, dtype=np.int64)] for x in (gone, fresh)]
    removed, spans = (u[chunk.ends] - u[begins] for u in upto)
    offsets = np.r_[0, np.cumsum(chunk.sizes - removed)]
    kept = pa.Array.from_buffers(pa.large_binary(), len(chunk.sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(chunk.data[~gone].tobytes())]).cast(pa.binary())
    rest = chunk.rest()
    return pa.table({c: rest.column(c) for c in rest.column_names} | {"kept": kept, "n_bytes": pa.array(chunk.sizes), "n_removed": pa.array(removed), "n_spans": pa.array(spans)})


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, crowd: int = CROWD) -> DataFrame:
    """The columns of ``docs`` but text, with kept (binary), n_bytes, n_removed, n_spans: a new family, given the table in batches."""
    return SuffixFamily(length, gram, crowd).add(docs, batches).results()
