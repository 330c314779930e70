"""Substring dedup by fixed-block anchors.

A window of ``window`` words that occurs in an earlier document holds one whole block of that document's
non-overlapping blocks of ``(window + 1) // 2`` words.  So

1. every document's blocks are indexed and every rolling span of block length probes the index; spans that
   are a block somewhere and occur at least twice are anchors (short keys: this only has to lose nothing);
2. around its anchors each document extends, a word at a time, over the windows that hold one; these
   windows, under 128-bit keys, are exchanged with the smallest doc_id that has them.  The key is two 64-bit hashes
   from independent hashes of the words: windows are equal if both are, but for a chance of 1e-12 at 1e13 windows;
3. runs of windows that a smaller doc_id has too are maximal exact repeats, and their words go.

Hits are never paired: a passage that a third of all documents share is one key in each chunk's set.

Words are maximal runs of bytes other than space and \\t\\n\\v\\f\\r.  Defined cases: a null or empty text has no
words; a text shorter than a window keeps all; rows with the same doc_id do not remove from each other; a null
doc_id ranks after all others; other columns pass through, but one with the name of a result column gives way
to it; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm import chunks as ch
from lodestone.llm.common import materialize

WINDOW = 13
U = np.uint64


class Words:
    """Word spans and hashes of a chunk; ``doc`` has the row of each word, ``nth`` its place in the document."""

    def __init__(self, chunk: ch.Chunk):
        starts, ends, hashes, docs = [], [], [], []
        base = 0
        for first, data, sizes in chunk.blocks():
            space = (data == 32) | ((data >= 9) & (data <= 13))
            edge = np.zeros(len(data) + 1, np.bool_)  # where a document starts
            at = np.cumsum(sizes) - sizes
            edge[at] = True
            word = ~space
            before = np.r_[True, space] | edge
            after = np.r_[space, True] | edge
            s = np.flatnonzero(word & before[:-1])
            e = np.flatnonzero(word & after[1:]) + 1
            sums = ch.prefix_hashes(data)
            hashes.append(ch.span_hash(sums, s, e))
            docs.append(first + np.searchsorted(np.cumsum(sizes), s, "right"))
            starts.append(s + base)
            ends.append(e + base)
            base += len(data)
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.count = np.bincount(self.doc, minlength=len(chunk.sizes))
        self.nth = np.arange(len(self.doc)) - (np.cumsum(self.count) - self.count)[self.doc]
        self._chunk = chunk

    def second_keys(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the spans of so many words at ``at``, from other hashes of the words than ``spans`` takes."""
        other, base = np.empty(len(self.hash), U), 0
        for _, data, _ in self._chunk.blocks():
            low, high = np.searchsorted(self.start, (base, base + len(data)))
            other[low:high] = ch.span_hash(ch.prefix_hashes(ch.substituted(data)), self.start[low:high] - base, self.end[low:high] - base)
            base += len(data)
        z = other[at]
        for k in range(1, length):
            z = z * U(0xA0761D6478BD642F) + other[at + k]
        return ch.mixed(z)

    def spans(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all spans of so many words that lie in one document, and the words they start at."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        z = self.hash[:n].copy()
        for k in range(1, length):
            z *= U(0xD6E8FEB86659FD93)
            z += self.hash[k : k + n]
        inside = self.doc[:n] == self.doc[length - 1 :]
        at = np.flatnonzero(inside)
        return ch.mixed(z[at]), at


def probe_keys(words: Words, block: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct span keys with two flags below (a block here; more than once here); the spans' keys and starts."""
    z, at = words.spans(block)
    z >>= U(64 - bits)
    order = np.sort((z << U(1)) | (words.nth[at] % block == 0).astype(U))
    key = order >> U(1)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    is_block = np.maximum.reduceat(order & U(1), first) if len(first) else np.zeros(0, U)
    return (key[first] << U(2)) | (is_block << U(1)) | (count > 1).astype(U), z, at


def repeated_blocks(given: list) -> list:
    """Keys that are a block in some chunk and occur twice at least."""
    every = np.sort(np.concatenate([k for k, _ in given]))
    key = every >> U(2)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.diff(np.r_[first, len(key)]) > 1
    flags = np.bitwise_or.reduceat(every & U(3), first)
    hot = key[first][(flags >= U(2)) & (many | (flags == U(3)))]
    return [(ch.member(k >> U(2), hot), None) for k, _ in given]


def candidate_windows(words: Words, found: list, window: int, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both keys and first words of the windows that hold an anchor."""
    block = (window + 1) // 2
    keys, z, at = probe_keys(words, block, bits)
    mask, _ = ch.marked(keys, bits + 2, buckets, found)
    hits = at[ch.member(z, keys[mask] >> U(2))]
    near = np.zeros(len(words.hash) + 1, np.int32)
    np.add.at(near, np.maximum(hits - (window - block), 0), 1)
    np.add.at(near, hits + 1, -1)
    near = np.cumsum(near)
    z, at = words.spans(window)
    pick = near[at] > 0
    return z[pick], words.second_keys(at[pick], window), at[pick]


def window_sets(keys: np.ndarray, second: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (the lowest bit: in several documents here), of each the smallest doc_id and the second key, and where each window's key is."""
    keys = keys & ~U(1)
    order = np.lexsort((docs, second, keys))
    k, c, d = keys[order], second[order], docs[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, np.bool_)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(k)] - 1
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[first] | (d[first] != d[last]).astype(U), np.column_stack([d[first], c[first].view(np.int64)]), place


def earlier_owner(given: list) -> list:
    """Of keys that a smaller doc_id has, as far as some document of the chunk can lose them: that doc_id."""
    if not given:
        return []
    key = np.concatenate([k >> U(1) for k, _ in given])
    doc, second = np.concatenate([side.reshape(-1, 2) for _, side in given]).T
    order = np.lexsort((doc, second, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (second[order][1:] != second[order][:-1])]
    smallest = np.empty(len(key), np.int64)
    smallest[order] = doc[order][new][np.cumsum(new) - 1]
    out = []
    for (k, side), least in zip(given, np.split(smallest, np.cumsum([len(k) for k, _ in given])[:-1])):
        lose = (least < side.reshape(-1, 2)[:, 0]) | ((k & U(1)) > 0)
        out.append((lose, least[lose]))
    return out


def kept_texts(chunk: ch.Chunk, words: Words, gone: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, of each document."""
    stay = ~gone
    at = np.flatnonzero(stay)
    inside = np.zeros(len(chunk.data) + 1, np.int8)
    inside[words.start[at]] += 1
    np.add.at(inside, words.end[at], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(np.bool_)
    data = chunk.data.copy()
    more = np.r_[words.doc[at][1:] == words.doc[at][:-1], False] if len(at) else np.zeros(0, np.bool_)
    gap = words.end[at[more]]
    data[gap] = 32
    inside[gap] = True
    size = np.r_[0, np.cumsum(inside, dtype=np.int64)]
    offsets = size[np.r_[0, chunk.ends]]
    return pa.Array.from_buffers(pa.large_string(), len(chunk.sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes())]).cast(pa.string())


def dedup(docs: DataFrame, window: int = WINDOW, keep_layout: bool = False) -> DataFrame:
    """``docs`` with text replaced by the words that stay, joined by a space, and with n_words and n_removed.

    ``keep_layout``: texts that lose nothing stay as they are, white space included.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_words", "n_removed")))
    parts = ch.chunked(docs)
    block, n = (window + 1) // 2, max(1, ch.total(parts) // 4)
    bits, buckets = ch.key_bits(n, 10), ch.bucket_count(n)
    wide = ch.bucket_count(n // 2)
    cells = parts.select("chunk", "sizes", "blob", "rest")

    def probe(batches):
        for batch in batches:
            for chunk, sizes, blob, rest in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "blob", "rest"))):
                keys, _, _ = probe_keys(Words(ch.Chunk(sizes, blob, rest)), block, bits)
                yield from ch.key_rows(chunk, keys, bits + 2, buckets).to_batches()

    anchors = materialize(ch.answers(cells.mapInArrow(probe, ch.SETS), repeated_blocks), "anchors")

    def opened(left: pa.Table):
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        chunk = ch.Chunk(row["sizes"], row["blob"], row["rest"])
        return row["chunk"], chunk, Words(chunk)

    def listed(right: pa.Table) -> list:
        return list(zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), right.column("side").to_pylist()))

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return ch._SETS.empty_table()
        name, chunk, words = opened(left)
        keys, second, at = candidate_windows(words, listed(right), window, bits, buckets)
        keys, side, _ = window_sets(keys, second, chunk.doc_ids()[words.doc[at]])
        return ch.key_rows(name, keys, 64, wide, side)

    sets = cells.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, ch.SETS)
    owners = ch.answers(sets, earlier_owner)
    both = anchors.withColumn("step", F.lit(0)).unionByName(owners.withColumn("step", F.lit(1)))

    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    names = docs.columns

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        name, chunk, words = opened(left)
        gone = np.zeros(len(words.hash), np.bool_)
        last = right.filter(pc.equal(right.column("step"), 1))
        if len(last):
            keys, second, at = candidate_windows(words, listed(right.filter(pc.equal(right.column("step"), 0))), window, bits, buckets)
            ids = chunk.doc_ids()[words.doc[at]]
            distinct, _, place = window_sets(keys, second, ids)
            mask, least = ch.marked(distinct, 64, wide, listed(last))
            owner = np.full(len(distinct), np.iinfo(np.int64).max)
            owner[mask] = least
            lost = at[owner[place] < ids]
            step = np.zeros(len(gone) + 1, np.int32)
            step[lost] += 1
            step[lost + window] -= 1
            gone = np.cumsum(step[:-1]) > 0
        removed = np.bincount(words.doc[gone], minlength=len(chunk.sizes)).astype(np.int64)
        text = kept_texts(chunk, words, gone)
        if keep_layout:
            raw = pa.Array.from_buffers(pa.large_string(), len(chunk.sizes), [None, pa.py_buffer(np.r_[0, chunk.ends].astype(np.int64).tobytes()), pa.py_buffer(chunk.data.tobytes())]).cast(pa.string())
            text = pc.if_else(pa.array(removed > 0), text, raw)
        columns = {c: chunk.rest().column(c) for c in chunk.rest().column_names} | {"text": text, "n_words": pa.array(words.count.astype(np.int64)), "n_removed": pa.array(removed)}
        return pa.table({c: columns[c] for c in [*names, "n_words", "n_removed"]})

    return cells.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, schema)
