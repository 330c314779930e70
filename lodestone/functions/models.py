"""Model-like functions in Arrow batches: where built-in expressions cannot say it."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType


def split_words(text: str, cost: dict[str, float], longest: int, unknown: float) -> str:
    """The cheapest split of a run of letters; unknown letters are words of their own."""
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = [(best[start] + cost.get(text[start:end], unknown * (end - start)), start) for start in range(max(0, end - longest), end)]
        value, start = min(options)
        best.append(value)
        back.append(start)
    out, end = [], len(text)
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return " ".join(reversed(out))


def segmented(vocabulary: Sequence[str], longest: int = 20) -> Callable[[Column], Column]:
    """A word costs the logarithm of its rank (Zipf); ``vocabulary`` is in order of frequency, so the result does not vary."""
    cost = {w: math.log((k + 1) * math.log(max(len(vocabulary), 3))) for k, w in enumerate(vocabulary)}

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else split_words(t, cost, longest, 25.0))

    return run


def substrings(letters: Column | str, longest: int = 20) -> Column:
    """The distinct words that a split of ``letters`` could have."""
    c = F.col(letters) if isinstance(letters, str) else letters
    n = F.length(c)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: c.substr(i, k)))))


def segmented_by(longest: int = 20) -> Callable[[Column, Column, Column, Column], Column]:
    """X5 as in ``segmented``, where each text comes with those of its substrings that are words, their ranks, and the number of all words."""

    @F.pandas_udf(StringType())
    def run(text: pd.Series, words: pd.Series, ranks: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for t, w, r, n in zip(text, words, ranks, size):
            cost = {} if w is None else {x: math.log(k * math.log(max(n, 3))) for x, k in zip(w, r)}
            out.append(None if t is None else split_words(t, cost, longest, 25.0))
        return pd.Series(out, dtype=object)

    return run


def hashed_embedding(size: int) -> Callable[[Column], Column]:
    """A unit vector of hashed words: a stand-in for a model with the same batch interface."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            x = np.zeros(size)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                x[h % size] += 1 if h & (1 << 31) else -1
            n = float(np.sqrt(x @ x))
            out.append((x / n if n else x).tolist())
        return pd.Series(out)

    return run
