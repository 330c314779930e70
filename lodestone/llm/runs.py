"""Periodic runs of words, by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that no neighbouring word
extends.  ``Catchers`` takes words as they come.  For each power of two L it keeps a catcher on every completed block of L
words: as words are appended, the last L of them are compared with the one block of that size that started L to 2L - 1 words
before, by hashes that a running sum gives for any stretch.  So each appended word costs one comparison a level.  A
suffix that equals its block, at a distance q, opens a catch; it is a square of period q, and reported, once the 2q words
from the block on and L more have come and repeat too, as they do in every run of four periods.  Squares inside a run that
is known, of this period or a smaller one, belong to it; any other is compared word by word in both directions, which makes
its run, exact whatever the hashes say.  A run that reaches the end grows with the words that follow.

Appends are of any length and give the same runs; within one, the comparisons of a level are one array operation.  Work
is n log n, memory a few numbers a word.  Documents are appended in groups, a word that is unique between them, so that
short ones cost no array operation each; runs never cross such a word.

Defined cases: a null text has no words; a document without runs has an empty list and null in the columns of its greatest
run; null and repeated doc_id are rows like others; of columns only doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD

#: Words that a group of documents has, about; a document with more than ``LONG`` words is a group of its own.
GROUP, LONG = 1 << 17, 1 << 14
#: Fixed odd numbers: the base of the hashes, and the mixer of word numbers.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ROWS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def powers(base: int, start: int, n: int) -> np.ndarray:
    """base^start, base^(start + 1), ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = pow(base, start, 1 << 64)
    return np.cumprod(out, dtype=np.uint64)


class Catchers:
    """Runs of at least four periods in a stream of word numbers; ``longest`` is a bound for their length, if one is known."""

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.n = 0
        self.words = np.zeros(0, np.int64)
        self.sums, self.scale = np.zeros(1, np.uint64), np.ones(0, np.uint64)
        self.next: list[int] = []  # of each level, where the next suffix to compare starts
        self.waiting: list[np.ndarray] = []  # of each level, catches (block, period) whose square is not complete
        self.found: list[dict[int, list[list[int]]]] = []  # of each level, by period: [start, end] of its runs, in order

    def append(self, words: np.ndarray) -> None:
        """Words that follow; numbers are equal where words are."""
        old = self.n
        self.extend(np.asarray(words, np.int64))
        self.grow(old)
        level = 0
        while 4 << level <= min(self.n, self.longest or self.n):
            if level == len(self.next):
                self.next.append(1 << level)
                self.waiting.append(np.zeros((0, 2), np.int64))
                self.found.append({})
            self.compare(level)
            level += 1

    def runs(self, at_least: int = 6) -> np.ndarray:
        """start, length, period of each run with ``at_least`` words and four periods, by start, then period."""
        rows = [(s, e - s, q) for level in self.found for q, runs in level.items() for s, e in runs if e - s >= max(at_least, 4 * q)]
        return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)

    def extend(self, words: np.ndarray) -> None:
        """Hashes of all stretches: sum of mixed words times powers of the base, scaled back by the inverse power."""
        x = words.astype(np.uint64) * np.uint64(STEP)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(BASE)
        x ^= x >> np.uint64(32)
        more = np.cumsum(x * powers(BASE, self.n, len(words)), dtype=np.uint64) + self.sums[-1]
        self.words, self.sums = np.concatenate([self.words, words]), np.concatenate([self.sums, more])
        self.scale = np.concatenate([self.scale, powers(pow(BASE, -1, 1 << 64), self.n, len(words))])
        self.n += len(words)

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.scale[at]

    def grow(self, old: int) -> None:
        """Runs that ended with the words before go on as far as the new ones repeat."""
        for level in self.found:
            for q, runs in level.items():
                if runs[-1][1] == old:
                    runs[-1][1] += self.agree(old - q, old)

    def agree(self, a: int, b: int) -> int:
        """How many words from a on equal those from b on (a < b)."""
        t, step = 0, 64
        while b + t < self.n:
            k = min(step, self.n - b - t)
            off = np.flatnonzero(self.words[a + t : a + t + k] != self.words[b + t : b + t + k])
            if len(off):
                return t + int(off[0])
            t, step = t + k, step * 2
        return t

    def agree_back(self, a: int, b: int) -> int:
        """How many words just before a equal those just before b (a < b)."""
        t, step = 0, 64
        while a - t > 0:
            k = min(step, a - t)
            off = np.flatnonzero(self.words[a - t - k : a - t] != self.words[b - t - k : b - t])
            if len(off):
                return t + k - 1 - int(off[-1])
            t, step = t + k, step * 2
        return t

    def compare(self, level: int) -> None:
        size = 1 << level
        begin, end = self.next[level], self.n - size + 1
        catches = self.waiting[level]
        if begin < end:
            self.next[level] = end
            first = begin // size - 1
            blocks = self.hashes(np.arange(first * size, (end - 1) // size * size, size), size)
            lo, hi = self.sums[begin:end], self.sums[begin + size : end + size]
            at = np.flatnonzero((hi - lo) * self.scale[begin:end] == np.repeat(blocks, size)[begin % size : begin % size + end - begin]) + begin
            block = (at // size - 1) * size
            catches = np.concatenate([catches, np.stack([block, at - block], 1)])
        if not len(catches):
            return
        # what has come of a catch has this period and lies in a run of a smaller one: the square is of that run
        smaller = sorted((s, e) for known in self.found[:level] for runs in known.values() for s, e in runs)
        if smaller:
            starts, reach = np.array([s for s, _ in smaller]), np.maximum.accumulate([e for _, e in smaller])
            k = np.searchsorted(starts, catches[:, 0], side="right") - 1
            catches = catches[(k < 0) | (reach[np.maximum(k, 0)] < catches.sum(1) + size)]
        full = catches[:, 0] + 2 * catches[:, 1] + size <= self.n
        self.waiting[level], catches = catches[~full], catches[full]
        block, period = catches[:, 0], catches[:, 1]
        repeats = self.hashes(block, size + period) == self.hashes(block + period, size + period)
        self.report(level, block[repeats], period[repeats])

    def report(self, level: int, block: np.ndarray, period: np.ndarray) -> None:
        """Squares become runs; those of one period are taken in order, past all that lie in the run just made."""
        size, order = 1 << level, np.lexsort((block, period))
        block, period, k = block[order], period[order], 0
        while k < len(block):
            b, q = int(block[k]), int(period[k])
            runs = self.found[level].setdefault(q, [])
            if not runs or b + q + size > runs[-1][1]:
                e = b + q + self.agree(b, b + q)
                if e < b + 2 * q + size:  # two stretches with one hash
                    k += 1
                    if not runs:
                        del self.found[level][q]
                    continue
                runs.append([b - self.agree_back(b, b + q), e])
            last = int(np.searchsorted(period, q, side="right"))
            k += max(1, int(np.searchsorted(block[k:last], runs[-1][1] - q - size, side="right")))


def document_runs(documents: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each document, which is a list of words; all go through one ``Catchers``."""
    sizes = np.array([len(d) + 1 for d in documents])
    codes, _ = pd.factorize(np.array([w for d in documents for w in d], dtype=object)) if sizes.sum() > len(documents) else (np.zeros(0, np.int64), None)
    ends = np.cumsum(sizes)
    stream = np.empty(ends[-1], np.int64)
    marks = ends - 1
    inside = np.ones(len(stream), bool)
    inside[marks] = False
    stream[inside], stream[marks] = codes, -1 - np.arange(len(documents))
    catchers = Catchers(int(sizes.max()))
    catchers.append(stream)
    found = catchers.runs()
    owner = np.searchsorted(ends, found[:, 0], side="right")
    found[:, 0] -= (ends - sizes)[owner]
    edges = np.searchsorted(owner, np.arange(len(documents) + 1))
    return [found[a:b] for a, b in zip(edges, edges[1:])]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: each document's runs, and its text without their repeats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, group, held = [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal ids, group, held
            rows = []
            for i, words, runs in zip(ids, group, document_runs(group)):
                collapsed = b" ".join(kept_words(words, runs)).decode("utf-8", "surrogatepass")
                rows.append((i, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], collapsed))
            ids, group, held = [], [], 0
            return pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"]).astype({"doc_id": "Int64"})

        for batch in batches:
            for i, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                words = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes are split at the six ASCII white spaces
                if len(words) > LONG and group:
                    yield flush()
                ids.append(None if i is pd.NA else int(i))
                group.append(words)
                held += len(words) + 1
                if held > GROUP or len(words) > LONG:
                    yield flush()
        if group:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, ROWS)


def with_planted_repeats(text: Column, doc_id: Column) -> Column:
    """The contract's edit: in a document with crc32(doc_id) % 10 = 0 the words from a on repeat those from a on with a period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = F.lit(1) + F.floor((n - a) / (g % 8 + 3))
    head, cycle = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.array_join(F.concat(head, tail), " ")).otherwise(text)


def greatest(runs: Column) -> Column:
    """The run with the greatest length; of several the one with the smallest start, then period; null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(ranked)


def summary(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find``'s rows."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("top", greatest(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.minus")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-F.col("top.minus") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
