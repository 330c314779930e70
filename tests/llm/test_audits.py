"""Periodic runs, filter audit and url filters against plain code and SQL."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from lodestone.llm import audit, queries, runs, urls
from tests.llm.reference import WORD

DOCS = "doc_id long, text string, source string, start string, part string, runs int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, "clash", "clash", 7) for i, t, s in rows], DOCS).repartition(parts)


# runs


def plain_runs(words):
    """Every period, every start: stretches that repeat, and no smaller period does."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            e = k
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > k and e + q - k >= 4 * q and (k, e + q) not in out:
                out[k, e + q] = q
            k = max(e, k) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= 6)


def periodic(rng, n, letters):
    """Stretches with a period among other words, some of them within others."""
    out = []
    while len(out) < n:
        root = [rng.randrange(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
        if rng.random() < 0.4:
            root = root * rng.randint(2, 6) + [rng.randrange(letters)]
        out += (root * rng.randint(1, 7))[: rng.randint(1, 5 * len(root))]
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_catchers_find_every_run_however_words_come(seed):
    rng = random.Random(seed)
    words = periodic(rng, rng.choice([0, 1, 5, 6, 40, 150, 400]), rng.choice([1, 2, 3, 50]))
    want = plain_runs(words)
    for longest in (1, 7, 64, 1000):
        catchers, at = runs.Catchers(), 0
        while at < len(words):
            k = rng.randint(1, longest)
            catchers.append(np.array(words[at : at + k]))
            at += k
        assert [tuple(r) for r in catchers.runs().tolist()] == want


def test_catchers_take_time_in_proportion():
    import time

    texts = {"one word": [0] * 600_000, "two": [0, 1] * 300_000, "nested": ([0] * 9 + [1]) * 60_000, "Thue-Morse": [bin(i).count("1") & 1 for i in range(1 << 19)]}
    for name, words in texts.items():
        began = time.time()
        catchers = runs.Catchers()
        catchers.append(np.array(words))
        found = catchers.runs()
        assert time.time() - began < 20, name
        if name == "nested":
            assert (found[:, 2] == 10).sum() == 1 and (found[:, 2] == 1).sum() == 60_000
        elif name != "Thue-Morse":
            assert found.tolist() == [[0, 600_000, 1 if name == "one word" else 2]]


def plain_op11(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = min(((-r[1], r[0], r[2]) for r in found), default=None)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    numbers = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *numbers, digest(lines), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs(spark, monkeypatch):
    rng = random.Random(4)
    names = ["a", "b", "ça", "x1", "."]
    planted = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    texts = [" ".join(names[w] for w in periodic(rng, rng.choice([0, 3, 50, 200]), 5)) for _ in range(40)]
    rows = [(i, t, "s") for i, t in zip(planted, texts)] + [(100_000 + i, t.replace(" ", rng.choice(["\n", "\t\v ", "  "])), "s") for i, t in enumerate(texts)]
    rows += [(None, "la " * 9, "s"), (None, None, "s"), (-5, "", "s"), (-5, " \n", "s"), (7, "nb sp " * 5, "s"), (7, "nb sp " * 5, None), (8, "x" * 70_000, "s")]
    rows += [(9, " ".join(f"w{k % 700}" for k in range(17_000)), "s")]
    monkeypatch.setattr(runs, "GROUP", 500)
    docs = frame(spark, rows)
    planted_docs = docs.withColumn("text", runs.with_planted_repeats(docs.text, docs.doc_id))
    got = [tuple(r)[:8] for r in runs.summary(runs.find(planted_docs)).collect()]
    text = lambda r: tuple(str(x) for x in r)
    want = [plain_op11(i, t) for i, t, _ in rows if i != 9]
    assert sorted(map(text, (r for r in got if r[0] != 9))) == sorted(map(text, want))
    assert next(r for r in got if r[0] == 9)[1:6] == (1, 0, 17_000, 700, 24285)
    assert sum(r[1] > 0 for r in want[:40]) > 10
    assert runs.summary(runs.find(docs.limit(0))).collect() == []


# filters


def plain_op12(rows, labels):
    masks, first = {}, {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    for k, (i, t, s) in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and first[t] < i]
        masks.setdefault(s or "", []).append((dict(zip("ABCDE", fails)), i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, docs in masks.items():
        sums = dict.fromkeys("ABCDE", 0)
        rows_of = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                sums[f] += len(gone)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                rows_of.append((part, "".join(order), step, len(left), len(gone), sum(d[0][f] for d in docs) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], sums[r[-1]]) for r in rows_of]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        n = rng.choice([0, 5, 199, 200, 260])
        words = [rng.choice(["Aa", "b", "c$", "é", "D"]) if rng.random() < 0.5 else f"w{k}" for k in range(n)]
        rows.append((i, " ".join(words).replace("$", rng.choice(["$", ""])), rng.choice(["x", "y", "z", None, ""])))
    rows += [(rng.choice([i, i + 200, 5, None]), t, s) for i, t, s in rows[:60]] + [(None, None, "x"), (400, None, "x"), (401, "", "y")] + [(None, "copy " * 300, "hot")] * 40
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(120)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    frame_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit(frame(spark, rows), frame_labels).collect())
    assert got == plain_op12(rows, labels)
    assert audit.audit(frame(spark, rows).limit(0), frame_labels).collect() == []
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", frame_labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    assert sorted(con.sql(queries.OP12_SQL).fetchall()) == got


@pytest.mark.parametrize("n", range(1, 7))
def test_exchanges_meet_every_order(n):
    order = list(range(n))
    met = [tuple(order)]
    for k in audit.exchanges(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        met.append(tuple(order))
    assert len(met) == len(set(met)) == len(list(itertools.permutations(range(n))))


def test_diagram_shares_equal_nodes():
    counts = {m: (1, 0, 0) for m in range(32)}
    diagram = audit.Diagram(counts)
    assert len(diagram.ways) == 6  # an end and a node of each level
    diagram.exchange(2)
    assert diagram.order == list("ABDCE") and len(diagram.ways) == 6


# urls


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    tail = rest[k:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM", "http://www.example.com/en/", "http://x.www.EXAMPLE.com/en/a?b#c", "http://notexample.com/en/", "http://example.com?x=/en/",
       "ftp://net/es/1", "http://a.net/fr/x#y", "http://a.net/fr", "http://com/", "http://xcom/", "http://a.com:80/", "http://É.COM/ß", "a://b://c.com/d", "http://a.net//es/", "http://.com/", "http://" + "a." * 200 + "com/" + "b/" * 200 + "?" + "c&" * 99]


def pages_and_labels(seed):
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(600):
        host = rng.choice(["spam.org", "www.fine.org", "blog.mixed.org", "x.example.net"])
        url = f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'ads', 'de'])}/{rng.randrange(99)}{rng.choice(['', '?utm=1', '?ref=2&utm=3', '#t'])}"
        bad = host == "spam.org" or (host == "blog.mixed.org" and "/ads/" in url) or rng.random() < 0.02
        pages.append((i, url))
        if rng.random() < 0.6:
            labels.append((i, int(not bad and rng.random() < 0.99), int(bad and rng.random() < 0.3)))
    pages += [(1000 + k, u) for k, u in enumerate(ODD)] + [(None, "http://spam.org/en/1"), (3, pages[3][1]), (3, "http://www.fine.org/en/")]
    labels += [(3, 0, 0), (3, 1, 0), (None, 0, 1), (4, None, None), (1000, 0, 1), (1004, 0, 1)]
    return pages, labels


def test_url_filters(spark):
    pages, labels = pages_and_labels(1)
    frame_pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in pages], "page_id long, url string, verdict string, tokens string").repartition(3)
    frame_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.filter_urls(frame_pages, frame_labels).collect()
    want = [(i, *plain_host_path(u)) for i, u in pages]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        rule, verdict = plain_rule(r["host"], r["path"])
        assert r["rule"] == rule and (rule is None or r["verdict"] == verdict)
        if rule is None:
            spam = r["host"] == "spam.org" or (r["host"] == "blog.mixed.org" and "/ads/" in r["path"])
            assert r["verdict"] == ("block" if spam else "allow") and (r["because"] is not None) == spam
    con = duckdb.connect()
    con.register("pages", frame_pages.toPandas().astype({"page_id": "Int64"}))
    con.register("labels", frame_labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    assert sorted(con.sql(queries.OP13_SQL).fetchall(), key=key) == sorted(map(tuple, got), key=key)
    assert urls.filter_urls(frame_pages.limit(0), frame_labels).collect() == []
    none = urls.filter_urls(frame_pages, frame_labels.limit(0)).collect()
    assert {r["verdict"] for r in none if r["rule"] is None} == {"allow"} and len(none) == len(pages)


def test_rules_are_pruned_and_found_by_one_token():
    f = frozenset
    rows = urls.pruned([(f("a"), 10, 8), (f("ab"), 8, 8), (f("abc"), 7, 7), (f("d"), 9, 5), (f("e"), 3, 3)], 5, (8, 10))
    assert {r[0] for r in rows} == {f("a"), f("ab")}  # abc is no better than ab, d is not sure, e is rare
    rules = urls.Rules(rows)
    assert [rules.name(k) for k in rules.fitting("abz")] == ["a b", "a"] and rules.fitting("bz") == []


def test_rules_of_tokens_beyond_the_first_are_mined(spark):
    common = "/".join(f"d{k}" for k in "abcdefghij")
    paths = [f"{common}/p/q"] * 20 + [common] * 8 + ["p/x"] * 25 + ["q/y"] * 25
    pages = spark.createDataFrame([(k, f"http://one.org/{path}") for k, path in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 20), 0) for k in range(len(paths))], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(pages, labels).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] < 20 else "allow") for r in got)
    assert all(set(r["because"].split()) & {"dir=p", "dir=q"} for r in got if r["page_id"] < 20)


@pytest.mark.parametrize("seed", range(3))
def test_grown_rules_are_those_of_all_combinations(spark, seed):
    rng = random.Random(seed)
    rows = [([t for t in "abcdefghij" if rng.random() < 0.6], rng.random() < 0.3) for _ in range(150)]
    rows = [([*t, "k"] if "a" in t else t, b or {"b", "e", "g"} <= set(t) or "c" in t and "d" not in t) for t, b in rows]
    all_of = [frozenset(c) for size in range(1, 12) for c in itertools.combinations("abcdefghijk", size)]
    counts = [(c, sum(c <= set(t) for t, _ in rows), sum(b and c <= set(t) for t, b in rows)) for c in all_of]
    want = urls.pruned(counts, 5, (8, 10))
    often = collections.Counter(x for t, _ in rows for x in t)
    single = spark.createDataFrame([(k, b, x, often[x]) for k, (t, b) in enumerate(rows) for x in t], "row long, blocked boolean, token string, often long")
    got = urls.pruned([(frozenset(r["items"]), r["n"], r["hits"]) for r in urls.grown(single, 5, (8, 10)).collect()], 5, (8, 10))
    assert sorted(map(str, ((sorted(i), n, b) for i, n, b in got))) == sorted(map(str, ((sorted(i), n, b) for i, n, b in want))) and len(want) > 2
