"""Packing: order-preserving dynamic programming over document and sentence boundaries.

The token stream of consecutive documents is cut into windows of at most ``window`` tokens.  Cuts may
fall on document ends (free), on sentence ends (a small truncation penalty) and, inside very long
sentences, between words (a larger one).  A window costs its padding, and a window whose length is a
power of two is not padded.  With positions ``p`` and best costs ``f``

    f(j) = cut(j) + min( min_{p_j - window <= p_i < p_j} f(i) + window - (p_j - p_i),
                         f(i) where p_j - p_i is a power of two )

The first inner minimum is ``window - p_j + min(f(i) + p_i)`` over a sliding range, kept by a monotone
queue in amortised O(1) a boundary.

Every Spark partition packs its own documents in input order, a segment at a time, and carries the last
open window into the next segment: no shuffle, bounded memory, one partly filled window a partition.

Defined cases: a null text is empty; an empty document is its end token alone; a document longer than a
window goes over several; repeated rows are packed as they come; a partition without rows makes nothing;
columns other than doc_id and text are not read, so any may be there.  A null doc_id stays null.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 2048
END_ID = 1
#: Tokens of padding that a cut at a sentence end, and one inside a sentence, are worth.
SENTENCE_PENALTY = 4.0
WORD_PENALTY = 12.0
#: Boundaries inside a document are kept at least so many tokens apart.
GRAIN = 64
#: Tokens that are packed at a time.
SEGMENT = 1 << 19

UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Numbered(dict):
    """Numbers each key when it is first asked for, and lists the keys that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class UnitEncoder:
    """Token ids of texts, by way of a table of white-space-delimited units.

    Byte-level BPE never merges over the border between a non-space and a space character, so the ids
    of a text are those of its units one after the other.  Units repeat, so most are only looked up.
    New ones are encoded many at a time, a line each, by the quicker of two libraries that give the
    same ids for the same vocabulary (a test holds them against each other).  Texts with special-token strings or with
    separators on which Python's and the tokenizer's ideas of white space differ go to the tokenizer whole.
    """

    LIMIT = 600_000

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lines = tiktoken.Encoding("lines", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.line = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.reset()

    def reset(self) -> None:
        self.index = Numbered()
        self.flat = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.closes = np.zeros(0, np.bool_)

    def learn(self) -> None:
        """Encode the units that are new."""
        fresh, self.index.fresh = self.index.fresh, []
        spaced = np.fromiter((u.isspace() for u in fresh), np.bool_, len(fresh))
        size = np.zeros(len(fresh), np.int32)
        lines = [u for u in fresh if not u.isspace()]
        ids = np.zeros(0, np.int32)
        if lines:
            blobs = ["\n".join(lines[i : i + 5000]) + "\n" for i in range(0, len(lines), 5000)]
            ids = np.concatenate([np.array(self.lines.encode_ordinary(b), np.int32) for b in blobs])
            stops = np.flatnonzero(ids == self.line)
            size[~spaced] = np.diff(np.r_[-1, stops]) - 1
            ids = np.delete(ids, stops)
        own = [np.array(self.tok.encode(u, add_special_tokens=False).ids, np.int32) for u in fresh if u.isspace()]
        size[spaced] = [len(x) for x in own]
        start = np.zeros(len(fresh), np.int64)
        base = len(self.flat)
        start[~spaced] = base + np.cumsum(size[~spaced]) - size[~spaced]
        start[spaced] = base + len(ids) + np.cumsum(size[spaced]) - size[spaced]
        self.flat = np.concatenate([self.flat, ids, *own])
        self.size = np.concatenate([self.size, size])
        self.start = np.concatenate([self.start, start])
        self.closes = np.concatenate([self.closes, np.fromiter((u[-1] in ".!?\n" or "\n" in u for u in fresh), np.bool_, len(fresh))])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids, unit ends (as token counts), and whether a unit closes a sentence."""
        if len(self.index) > self.LIMIT:
            self.reset()
        index, at = self.index.__getitem__, []
        for t in texts:
            if ODD_SPACE.search(t) or any(s in t for s in self.special):
                at.append(None)
            else:
                units = UNIT.findall(t)
                at.append(np.fromiter(map(index, units), np.int64, len(units)))
        if self.index.fresh:
            self.learn()
        for text, units in zip(texts, at):
            if units is None:
                ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)
                yield ids, np.arange(1, len(ids) + 1), np.zeros(len(ids), np.bool_)
                continue
            size = self.size[units]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            yield self.flat[np.repeat(self.start[units] - (ends - size), size) + np.arange(total)], ends, self.closes[units]


def boundaries(n: int, ends: np.ndarray, closes: np.ndarray, window: int = WINDOW) -> list[tuple[int, float]]:
    """Cut points inside a document of ``n`` ids (end token included) with their penalties; its end is free."""
    out: list[tuple[int, float]] = []
    if n > GRAIN:
        inner = ends < n
        good, any_ = ends[inner & closes], ends[inner]
        kept = good[np.r_[True, np.diff(good // GRAIN) > 0]] if len(good) else good
        out = [(int(e), SENTENCE_PENALTY) for e in kept]
        gaps = np.r_[0, kept, n]
        for a, b in zip(gaps[:-1][np.diff(gaps) > 2 * GRAIN], gaps[1:][np.diff(gaps) > 2 * GRAIN]):
            words = any_[(any_ > a) & (any_ < b)]
            words = words[np.r_[True, np.diff(words // GRAIN) > 0]] if len(words) else words
            prev = int(a)
            for e in [*map(int, words), int(b)]:
                while e - prev > window:  # one unit longer than a window
                    prev += window
                    out.append((prev, WORD_PENALTY))
                if e < b:
                    out.append((e, WORD_PENALTY))
                    prev = e
        out.sort()
    out.append((n, 0.0))
    return out


def best_cuts(points: list[int], penalties: list[float], window: int = WINDOW) -> list[int]:
    """Indices of the chosen cut points; the last point is always one. ``points`` ascend and start after 0."""
    pos = [0, *points]
    best, back = [0.0] * len(pos), [0] * len(pos)
    where = {0: 0}
    queue = deque([(0.0, 0, 0)])  # (f(i) + p_i, p_i, i), ascending in value from the left
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    for j, penalty in enumerate(penalties, 1):
        p = pos[j]
        while queue[0][1] < p - window:
            queue.popleft()
        value, _, i = queue[0]
        cost = value + window - p
        if cost > 0:  # else no window could be cheaper
            for w in powers:
                if (p - w) in where and best[k := where[p - w]] < cost:
                    cost, i = best[k], k
        best[j], back[j] = cost + penalty, i
        where[p] = j
        value = cost + penalty + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    cuts, j = [], len(pos) - 1
    while j > 0:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


class Segment:
    """Documents, or what is left of them, that wait to be packed."""

    def __init__(self):
        self.docs: list[tuple] = []  # doc_id, doc_tokens, start, ids from there
        self.points: list[int] = []
        self.penalties: list[float] = []
        self.tokens = 0

    def add(self, doc_id, doc_tokens: int, start: int, ids: np.ndarray, cuts: list[tuple[int, float]]) -> None:
        """cuts: in ids of the document, beyond ``start``."""
        self.points += [self.tokens + c - start for c, _ in cuts]
        self.penalties += [p for _, p in cuts]
        self.docs.append((doc_id, doc_tokens, start, ids))
        self.tokens += len(ids)

    def pack(self, window: int, first: int, last: bool) -> tuple[list[tuple], int, Segment]:
        """Pieces, the next sequence number, and what stays open unless this is the ``last`` segment."""
        cuts = [self.points[k] for k in best_cuts(self.points, self.penalties, window)]
        open_from = len(cuts) if last else max(0, len(cuts) - 1)
        begin = cuts[open_from - 1] if open_from else 0
        rows, rest, seq, at = [], Segment(), first, 0
        edges = [0, *cuts[:open_from]]
        k = 0
        for doc_id, doc_tokens, start, ids in self.docs:
            end = at + len(ids)
            while at < min(end, begin):
                while edges[k + 1] <= at:
                    k += 1
                stop = min(end, edges[k + 1])
                part = ids[len(ids) - (end - at) : len(ids) - (end - stop)]
                rows.append((doc_id, start, stop - at, zlib.crc32(part.astype("<u4").tobytes()), doc_tokens, first + k, at - edges[k]))
                start += stop - at
                at = stop
            if at < end:
                rest.docs.append((doc_id, doc_tokens, start, ids[len(ids) - (end - at) :].copy()))
                rest.tokens += end - at
            at = end
        seq = first + open_from
        keep = [(p - begin, q) for p, q in zip(self.points, self.penalties) if p > begin]
        rest.points, rest.penalties = [p for p, _ in keep], [q for _, q in keep]
        return rows, seq, rest


def pack_partition(batches: Iterator[pa.RecordBatch], tokenizer: tuple[str, str, str], window: int, part: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    coder, segment, seq = UnitEncoder(*tokenizer), Segment(), part << 33

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, schema=schema)

    for batch in batches:
        ids_, column = batch.column(0).to_pylist(), batch.column(1)
        at = 0
        while at < len(ids_):
            texts, size, to = [], 0, at
            while to < len(ids_) and to - at < 400 and size < 1_000_000:
                texts.append(column[to].as_py() or "")
                size += len(texts[-1])
                to += 1
            for doc_id, (ids, ends, closes) in zip(ids_[at:to], coder.encode(texts)):
                ids = np.append(ids, np.int32(END_ID))
                segment.add(doc_id, len(ids), 0, ids, boundaries(len(ids), ends, closes, window))
                if segment.tokens >= SEGMENT:
                    rows, seq, segment = segment.pack(window, seq, False)
                    yield out(rows)
            at = to
    if segment.docs:
        yield out(segment.pack(window, seq, True)[0])


def vocabulary() -> tuple[str, str, str]:
    """The public byte-level BPE: its file for ``tokenizers``, the same as ranks, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pack(docs: DataFrame, tokenizer: tuple[str, str, str] | None = None, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` is the partition's number times 2**33 plus a count, so it is the same on every run
    over the same input splits; sequences are not numbered without gaps.
    """
    tokenizer = tokenizer or vocabulary()

    def run(batches):
        from pyspark import TaskContext

        yield from pack_partition(batches, tokenizer, window, TaskContext.get().partitionId())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)
