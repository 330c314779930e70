import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chunks, setsketch, substrings, suffixes
from tests.llm import reference

SCHEMA = "doc_id long, text string, lang string, n_words long, score double"


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def edited(rng, base, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in base]


def corpus(seed):
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 40)
    texts = [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1, 0.15]))) for _ in range(90)]
    texts += [" ".join(words(rng, rng.randrange(5, 300)) + passage[: rng.randrange(41)] + words(rng, 20)) for _ in range(60)]
    texts += ["", None, " \n\t ", "one", "One", "two words", "ä " * 700, "x" * 900, "y" * 401, "Tail " + "é" * 500, ("long text " * 9000).strip(), "a b c"]
    texts += [texts[0], texts[5], texts[100]] * 3
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", 1, 2.0) for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = corpus(size)
    found = setsketch.near_duplicates(frame(spark, rows), size).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == reference.near(rows, size)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e F"), (4, None), (4, "")]
    found = sorted(map(tuple, setsketch.near_duplicates(frame(spark, rows), 2).collect()), key=str)
    assert found == sorted([(1, 5, 1, True), (1, 5, 1, True), (None, 5, None, True), (3, 5, 1, False), (4, 0, 4, True), (4, 0, 4, True)], key=str)
    assert setsketch.near_duplicates(frame(spark, rows).limit(0), 2).count() == 0


def test_joint_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    shared, mine, yours = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = np.sort(np.concatenate([shared, mine])), np.sort(np.concatenate([shared, yours]))
    k = setsketch.sketches(np.concatenate([a, b]), np.array([0, 900, 1800]))
    j, fine = setsketch.likely(k[:1], k[1:], np.array([900.0]), np.array([900.0]), 0.8)
    assert abs(j[0] - 0.8) < 0.12 and fine[0]
    union = setsketch.sketches(np.unique(np.concatenate([a, b])), np.array([0, 1000]))
    assert (union[0] == np.maximum(k[0], k[1])).all()  # sketches merge


def test_substrings(spark):
    rows = corpus(3)
    found = substrings.dedup(frame(spark, rows).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == reference.substrings(rows)


def test_substrings_keeps_columns_and_layout(spark):
    text = "  two   spaces \n kept"
    out = substrings.dedup(spark.createDataFrame([(1, text, "x"), (None, text, None)], "doc_id long, text string, lang string"), keep_layout=True).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["lang"] or "", r["n_words"], r["n_removed"]) for r in out) == [(0, text, "", 3, 0), (1, text, "x", 3, 0)]
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substrings_same_id_and_null_id(spark):
    text = " ".join(f"w{k}" for k in range(20))
    out = substrings.dedup(spark.createDataFrame([(2, text), (2, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 20), (2, 0), (2, 0)]


def test_windows_with_one_key_and_other_second_keys_are_apart():
    import numpy as np

    keys, second, docs = np.array([8, 8, 8, 20], np.uint64), np.array([1, 2, 1, 3], np.uint64), np.array([5, 4, 6, 7])
    distinct, side, place = substrings.window_sets(keys, second, docs)
    assert distinct.tolist() == [9, 8, 20] and side.tolist() == [[5, 1], [4, 2], [7, 3]] and place.tolist() == [0, 1, 0, 2]
    other = (np.array([8, 20], np.uint64), np.array([[3, 2], [9, 3]]))
    (lose, least), (none, _) = substrings.earlier_owner([(distinct, side), other])
    assert lose.tolist() == [True, True, False] and least.tolist() == [5, 3] and none.tolist() == [False, True]


def test_clashing_columns_give_way(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(1, text, "x", 2.5, 3), (2, text, "y", 3.5, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept double, n_removed int")
    assert sorted((r["doc_id"], r["kept"], r["n_words"], r["n_removed"]) for r in substrings.dedup(frame).collect()) == [(1, 2.5, 400, 0), (2, 3.5, 400, 400)]
    out = suffixes.dedup(frame).collect()
    assert sorted((r["doc_id"], r["n_words"], bytes(r["kept"]), r["n_removed"]) for r in out) == [(1, "x", b"", len(text)), (2, "y", b"", len(text))]


def test_suffixes(spark):
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdé ") for _ in range(3000))
    rows = [(k, letters[a : a + rng.randrange(300, 900)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(300)))) for k, a in enumerate(rng.randrange(2500) for _ in range(25))]
    rows += [(100, letters[:500] * 2), (101, "z" * 1200), (102, None), (103, ""), (104, "q" * 399), (105, letters[:400])]
    out = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == reference.suffixes(rows)
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffixes_in_batches(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcd\0\n") for _ in range(4000))
    rows = []
    for k in range(40):
        a = rng.randrange(3200)
        t = list(base[a : a + rng.randrange(380, 1400)])
        for _ in range(rng.choice([0, 0, 1, 3])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((k, "".join(t), "clash", k))
    rows += [(50, None, "x", 1), (50, "dup" * 300, None, 2), (None, "dup" * 300, "y", 3)]
    kinds = "doc_id long, text string, kept string, n_bytes int"

    def plain(frame):
        out = frame.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        return sorted(map(tuple, out), key=str)

    def want(given):
        got = reference.suffixes(enumerate(t for _, t, *_ in given))
        return sorted(((i, *got[k]) for k, (i, *_) in enumerate(given)), key=str)

    for crowd in (suffixes.CROWD, 2):  # with 2 nearly all strings go the way of crowded keys
        assert plain(suffixes.dedup(spark.createDataFrame(rows, kinds).repartition(3), crowd=crowd)) == want(rows)
    family = suffixes.SuffixFamily()
    for k in (10, 15, 20, 43):  # each batch against the levels of those before
        family.add(spark.createDataFrame(rows[family.__dict__.get("upto", 0) : k], kinds).repartition(2))
        family.upto = k
        assert plain(family.results()) == want(rows[:k])
        sizes = [n for n, _ in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
        assert [level.select("bucket").distinct().count() > 0 for _, level in family.levels] == [True] * len(sizes)


def test_no_hash_is_reserved():
    import numpy as np

    low = np.array([5, 7, 0, 9, 2**31 - 1, 2**31 - 1, 2**31 - 1, 2**31 - 1], np.uint32)
    span = np.arange(8).astype(np.uint64)
    for width in (2, 3):
        starts = np.ones(8 - width + 1, np.bool_)
        places, keys = suffixes.selected(low, starts, width, span)
        least = [low[k : k + width].min() for k in range(len(starts))]
        assert places.tolist() == [p for p in range(8) if any(low[p] == least[s] for s in range(max(0, p - width + 1), min(p + 1, len(starts))))]
        assert len(set(keys.tolist())) == len(places)
    none, _ = suffixes.selected(low, np.zeros(7, np.bool_), 2, span)
    assert len(none) == 0


def test_repeated_strings_are_compared_as_bytes():
    import numpy as np

    rng, length, gram = np.random.default_rng(6), 12, 4
    data = rng.integers(0, 2, 3000).astype(np.uint8)  # with zero bytes, many partial matches
    ends = np.sort(rng.choice(np.arange(20, 2990), 40, replace=False))
    begin, end = np.r_[0, ends], np.r_[ends, 3000]
    at = np.sort(rng.choice(2900, 300, replace=False))
    doc = np.searchsorted(end, at, "right")
    at, doc = at[at + gram <= end[doc]], doc[at + gram <= end[doc]]
    rows = suffixes.records(data, begin[doc], end[doc], at, length, gram)
    mask = suffixes.repeated_strings(rows, length, gram)
    for d in range(length - gram + 1):
        fits = (at - d >= begin[doc]) & (at - d + length <= end[doc])
        strings = [bytes(data[a - d : a - d + length]) if f else None for a, f in zip(at, fits)]
        assert mask[:, d].tolist() == [s is not None and strings.count(s) > 1 for s in strings]


def test_anchor_keys_fill_buckets_evenly():
    import numpy as np

    from lodestone.llm import chunks as ch

    data = np.random.default_rng(1).integers(97, 123, 1 << 20).astype(np.uint8)
    at, keys = suffixes.anchors(data, np.array([len(data)]), suffixes.LENGTH, suffixes.GRAM)
    sizes = np.diff(ch.Spans(np.sort(keys), 64, 8).edges)
    assert len(keys) == len(at) > 5000 and sizes.sum() == len(keys)
    assert sizes.max() < 1.3 * len(keys) / 8 and sizes.min() > 0.7 * len(keys) / 8


@pytest.mark.parametrize("bits, buckets", [(24, 8), (31, 77), (32, 1000), (40, 12345), (62, 1 << 30), (64, 3), (64, (1 << 31) - 1)])
def test_spans_are_ranges_of_keys_whatever_the_number_of_buckets(bits, buckets):
    rng = random.Random(bits)
    edges = [((b << bits) // buckets) for b in (rng.randrange(buckets) for _ in range(40))]
    some = {0, (1 << bits) - 1, *(rng.randrange(1 << bits) for _ in range(300)), *edges, *(max(e - 1, 0) for e in edges)}
    keys = np.array(sorted(some), np.uint64)
    spans = chunks.Spans(keys, bits, buckets)
    assert [b for b, _ in spans] == sorted({max(b for b in (int(k) * buckets >> bits, (int(k) * buckets >> bits) + 1) if b < buckets and (b << bits) // buckets <= int(k)) for k in keys})
    for b, s in spans:
        assert all((b << bits) // buckets <= int(k) < ((b + 1) << bits) // buckets or b == buckets - 1 for k in keys[s]) and spans[b] == s
    assert sum(s.stop - s.start for _, s in spans) == len(keys)
    assert not len(list(chunks.Spans(keys[:0], bits, buckets))) and len(keys[spans[buckets + 5]]) == 0


def test_merge_scan():
    import collections

    import numpy as np

    rng, levels, seen, told, every = np.random.default_rng(0), [], collections.defaultdict(list), collections.defaultdict(set), {}
    for step in range(30):
        batch = []
        for chunk in range(step * 3, step * 3 + 3):
            keys, n = suffixes.repeats(rng.integers(0, 400 if step % 2 else 4000, rng.integers(1, 60)).astype(np.uint64))
            batch.append((chunk, keys, n))
            every[chunk] = set(keys.tolist())
            for k, m in zip(keys.tolist(), n.tolist()):
                seen[k] += [chunk] * m
        out, keys, owners = suffixes.merge_scan(batch, levels)
        for chunk, k in out:
            told[chunk] |= set(k.tolist())
        parts = [(keys, owners)]
        while levels and len(levels[-1][0]) <= 2 * sum(len(k) for k, _ in parts):
            parts.append(levels.pop())
        levels.append(suffixes.merged_levels(parts))
        for chunk, own in every.items():
            assert told[chunk] == {k for k in own if len(seen[k]) > 1}
