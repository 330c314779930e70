"""Plain answers, by brute force, that the operators are held against."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(rows, size=2, percent=80):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def substrings(rows, size=13):
    words, first = {i: WORD.findall(t or "") for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for p in range(k, k + size)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def suffixes(rows, size=400):
    data = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(x[k : k + size] for x in data.values() for k in range(len(x) - size + 1))
    out = {}
    for i, x in data.items():
        gone = bytearray(len(x))
        for k in range(len(x) - size + 1):
            if seen[x[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(x), sum(gone), spans, hashlib.sha256(bytes(y for y, g in zip(x, gone) if not g)).hexdigest())
    return out
