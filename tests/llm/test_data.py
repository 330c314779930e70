"""Packing, archives, extraction, mixing, fingerprints, search, quality, on small fixtures with odd rows."""

import collections
import hashlib
import itertools
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from lodestone.llm import ann, fingerprints, html, mixing, packing, quality, warc
from tests.llm import reference

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score double"


def docs_frame(spark, rows, parts=2):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", 0.5) for i, t, s in rows], DOCS).repartition(parts, "doc_id")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta's", "Ünïcode", "x1", "end.", "why?\n"]) for _ in range(n))


# packing


def tokens(text):
    from tokenizers import Tokenizer

    tok = tokens.__dict__.setdefault("tok", Tokenizer.from_file(packing.vocabulary()[0]))
    return np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")


def test_pack(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([0, 1, 5, 60, 400, 3000])) for _ in range(60)] + [None, "", "a  b\n\n c\t\td   e\x1cf", "word" * 4000, "<|endoftext|> inside", "日本語 テキスト 🙂🙂"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    out = packing.pack(docs_frame(spark, rows)).collect()
    want = {i: tokens(t or "") for i, t, _ in rows}
    for i, ids in want.items():
        pieces = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [0, *itertools.accumulate(r["length"] for r in pieces)][:-1]
        assert sum(r["length"] for r in pieces) == len(ids) and all(r["doc_tokens"] == len(ids) for r in pieces)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    waste = 0
    for s in map(sorted, sequences.values()):
        assert [o for o, _ in s] == [0, *itertools.accumulate(n for _, n in s)][:-1]
        n = sum(n for _, n in s)
        assert n <= 2048
        waste += 0 if n & (n - 1) == 0 else 2048 - n
    assert waste / sum(map(len, want.values())) < 0.1  # two partitions, each with one open window at its end
    assert packing.pack(docs_frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_cuts(seed):
    rng = random.Random(seed)
    points, window = sorted(rng.sample(range(1, 60), 14)), 16
    points = sorted({*points, *range(0, max(points), 13)} - {0})
    penalties = [rng.choice([0.0, 2.0, 5.0]) for _ in points]

    def cost(cuts):
        edges, total = [0, *(points[k] for k in cuts)], sum(penalties[k] for k in cuts)
        for a, b in zip(edges, edges[1:]):
            if b - a > window:
                return None
            total += 0 if (b - a) & (b - a - 1) == 0 else window - (b - a)
        return total

    best = {0: 0.0}
    for p, q in zip(points, penalties):
        best[p] = q + min(v + (0 if (p - a) & (p - a - 1) == 0 else window - (p - a)) for a, v in best.items() if 0 < p - a <= window)
    assert cost(packing.best_cuts(points, penalties, window)) == best[points[-1]]


# archives


def test_archive(spark):
    big, other = "<p>" + "ä" * 800, "b" * 1000
    rows = [(1, "http://a/ b", big), (5, "http://c", big), (3, None, big), (7, "u", other), (8, "u", None), (9, "u", ""), (10, "u", "small"), (11, "u", "small"), (None, "n", other), (12, "x", "z" * 999), (13, "x", "z" * 999), (14, "y", "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, d long").repartition(3)
    index, records, folder = warc.archive(pages)
    got = {r["page_id"]: tuple(r) for r in records.collect()}
    for i, _, h in rows:
        data = (h or "").encode()
        keeper = max((j for j, _, x in rows if x == h and j is not None), default=i) if len(data) >= 1000 else i
        kind = "response" if keeper == i else "revisit"
        assert got[i] == (i, len(data), hashlib.sha1(data).hexdigest(), kind, keeper if kind == "revisit" else None)
    store, root = warc.filesystem(folder)

    class Counted:
        """A file that tells how much of it was read."""

        def __init__(self, file):
            self.file, self.size, self.read = file, file.size, 0

        def read_at(self, n, at):
            self.read += n
            return self.file.read_at(n, at)

    for r in index.collect():  # every record is found alone, by its frame
        with store.open_input_file(f"{root}/{r['bundle']}") as f:
            counted = Counted(f)
            table = warc.seek_table(counted)
            part = warc.read_frame(counted, table, r["frame"])[r["offset"] : r["offset"] + r["length"]]
            assert counted.read == 9 + 8 * len(table) + table[r["frame"]][1] <= f.size()
        head, _ = next(warc.parse(part))
        assert warc.page_of(head["WARC-Record-ID"]) == r["page_id"]
    some = index.where("page_id IN (3, 14)")
    assert {tuple(r) for r in warc.read_records(some, folder).collect()} == {got[3], got[14]}
    old, warc.FEW = warc.FEW, 5  # with so few, payloads of two pages are broadcast
    try:
        again = sorted(map(tuple, warc.roles(pages.drop("payload")).drop("payload", "url").collect()), key=str)
    finally:
        warc.FEW = old
    assert again == sorted(got.values(), key=str)
    assert warc.archive(pages.limit(0))[1].count() == 0


# extraction


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><th>Name<th>Q<tr><td>long name<td>1</table>", "Name      | Q\nlong name | 1"),
        ("<div hidden>no</div><div style='display: none'>no</div><input type=hidden value=v>yes<script>if (a<b) x='</p>'</script>", "yes"),
        ("<head><title>t</title></head><body>b &amp; &lt;c&gt; &eacute;", "b & <c> é"), ("<pre> a\n  b</pre>", " a\n  b"), ("one <b>two</b>three", "one twothree"),
        ("x </zz> <!-- open", "x"), ("<p>a</div>b</p>", "ab"), ("<table><tr><td>a<table><tr><td>n</table><td>b</table>", "a | b\nn |"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>wide", "a | b\nwide"), ("<a title=it's>hello</a> world it's <b>x</b> end", "hello world it's x end"), ("<p title=it's>hello</p>", "hello"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A | b\n  | c\nd | e"), ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d</table>", "A | b\n  | c\nd"),
        ("<style>.x,#z{color:red;display:none} /* } */ @media print{p{display:none}} #i{visibility:hidden} p.y{display:block!important}</style><p class='a x'>no</p><p>yes<p class='x y'>y<p id=z>no</p><p id=i>no <b style='visibility:visible'>seen</b> no</p>", "yes\n\ny\n\nseen"),
        ("<p class=x>no</p>b<style>p.x { DISPLAY : none }</style>", "b"), ("<div style='visibility:hidden'>a<div style='visibility:visible'>b</div></div>c", "b\nc"), ("<div hidden><p style='visibility:visible;display:block'>no</div>c", "c"),
        ("<table><tr><td><ul><li>a<li>b</ul><td>c<tr><td>d<td>e</table>", "- a | c\n- b |\nd   | e"), ("<pre>x\n<table><tr><td>a<td>b</table>y</pre>", "x\n\n\na | b\n\ny"), ("<object>seen</object><video>not</video>", "seen"),
        ("a<!-->b<!--->c<!-- x -->d<? y >e<!doctype html>f</3>g", "abcdefg"), ("1 < 2 <3 <a", "1 < 2 <3"), ("<a href=x/y title = 'q > r' checked>t</a >u", "tu"), ("<p/>a<br/>b", "a\nb"), ("<b>a<table><tr><td></b>c</table>", "a\n\nc"), ("<select><option>o<option>p</select>", "o\np"),
    ],
)
def test_html(page, text):
    assert html.extract_text(page) == text


def test_html_deep_and_long():
    assert html.extract_text("<div>" * 20_000 + "x").strip() == "x"
    assert html.extract_text("<table><tr><td>" * 300 + "x").endswith("x")
    assert len(html.extract_text("<p>word " * 100_000).split("\n\n")) == 100_000


@pytest.mark.parametrize("page", ["<a ", "<a '", '<a "', "<a =", "<", "<!-- ", "&", "<ul><li>", "<dl><dd>x", "<table><tr><td>a<td>b", "<option>", "<style>@{", "<style>a{", "<style>/*", "<tr><td rowspan=65534 colspan=1000>a", "<a b c d=1 e='2' ", "</p>", "<h1>", "<title>"])
def test_html_takes_time_in_proportion(page):
    began = time.process_time()
    n = 1_000_000 // len(page)
    out = html.extract_text("<table>" * page.startswith("<tr>") + page * n)
    assert time.process_time() - began < 20
    assert out.count("a") >= (n if "td>a" in page or "=1000>a" in page else 0)


def test_html_comments_end_at_the_first_of_both_ends():
    assert html.extract_text("<p>one<!-- a --!>two</p><p>three</p>").split() == ["onetwo", "three"]
    assert html.extract_text("<p>a<!-- x --!> y --> b<!-- > --><!-->c<!--->d<!-- -- ! > --!>e").split() == ["a", "y", "-->", "bcde"]


@pytest.mark.parametrize("rule, tag", [(".x{display:block}", '<p class="x">w</p>'), (".x{display:none}.x{display:block}", '<p id=i{} class="x y">w</p>'), (".x.y{}{{color:red;display:block}}", '<p class="x y{}">w</p>')])
def test_style_rules_that_many_elements_match_take_time_in_proportion(rule, tag):
    n = 1_000_000 // (len(rule) + len(tag))
    page = "<style>" + "".join(rule.replace("{}", str(k)).replace("{{", "{").replace("}}", "}") for k in range(n)) + "</style>" + "".join(tag.replace("{}", str(k)) for k in range(n))
    began = time.process_time()
    out = html.extract_text(page)
    assert time.process_time() - began < 4 and out.split() == ["w"] * n


def test_style_cascade():
    sheet = "<style>.a{display:none}p.a{display:block}#i{visibility:hidden}.b.c{display:none!important}.c{display:block}.d{display:none;display:block}</style>"
    body = '<p class=a>1</p><div class=a>2</div><p id=i>3</p><p class="b c" style="display:block">4</p><p class=c>5</p><p class=d>6</p><p class=d style="display:none">7</p><p class="c b" style="display:block!important">8</p>'
    assert html.extract_text(sheet + body).split() == ["1", "5", "6", "8"]


@pytest.mark.parametrize("start", ["<b><table><td>", "<ul><li><ul>", ""])
def test_html_stray_ends_below_deep_stacks(start):
    began = time.process_time()
    for end in ("</b>", "</p>", "<li></li>", "</ul>", "</zz>"):
        html.extract_text(start + "<div>" * 20_000 + end * 20_000)
    assert time.process_time() - began < 10


class Plain(HTMLParser):
    """Visible words in order, the slow and simple way: by the parser of the standard library, without layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden, self.stack = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag not in html.VOID:
            gone = tag in html.UNSEEN or "hidden" in dict(attrs) or "display:none" in (dict(attrs).get("style") or "").replace(" ", "")
            self.stack.append((tag, gone))
            self.hidden += gone

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.stack]:
            while True:
                t, gone = self.stack.pop()
                self.hidden -= gone
                if t == tag:
                    return

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def page_of(rng, depth=0):
    """A well-formed page at random."""
    def words():
        return " ".join(rng.choice(["one", "two", "3 &lt; 4", "&amp;", "fünf", "it's", "x"]) for _ in range(rng.randrange(1, 6)))

    def inner():
        return "".join(page_of(rng, depth + 1) for _ in range(rng.randrange(1, 4)))

    kind = rng.randrange(9) if depth < 4 else 0
    if kind < 2:
        return f" {words()} "
    if kind == 2:
        return f"<ul class=\"a\">{''.join(f'<li>{inner()}</li>' for _ in range(rng.randrange(1, 4)))}</ul>"
    if kind == 3:
        return f"<table border=1>{''.join('<tr>' + ''.join(f'<td>{words()}</td>' for _ in range(rng.randrange(1, 4))) + '</tr>' for _ in range(3))}</table>"
    if kind == 4:
        return f"<div {rng.choice(['hidden', 'style=\"display: none\"', 'title=no', ''])}>{inner()}</div>"
    if kind == 5:
        return rng.choice(["<script>var a = '<p>no</p>';</script>", "<!-- no <p> -->", "<style>b{color:red}</style>", "<br>", "<hr/>", "<img alt='no'>"])
    if kind == 6:
        return f" <b>{words()}</b> <a href='x?a=1&b=2'>{words()}</a> "
    return f"<{(t := rng.choice(['section', 'blockquote', 'dl', 'article']))}>{inner()}</{t}>"


@pytest.mark.parametrize("seed", range(40))
def test_html_has_the_words_of_a_plain_renderer(seed):
    page = page_of(random.Random(seed)) + page_of(random.Random(seed + 1000))
    plain = Plain()
    plain.feed(page)
    plain.close()
    out = html.extract_text(page)
    assert [w for w in out.split() if w not in ("-", "|")] == plain.words


def test_html_frame(spark):
    out = html.extract(spark.createDataFrame([(1, "u", "<p>a<p>b", "t"), (2, None, None, None)], "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, "a\n\nb", 4, 3), (2, "", 0, 0)]


# mixing


def filled(size):
    """Targets as the words say: stop at twice the size, and share the excess again."""
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, stopped = 1.5 * sum(size.values()), set()
    while True:
        left = want - sum(2 * size[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            return {s: 2.0 * size[s] if s in stopped else share[s] for s in names}
        stopped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 10, "d": 100}, {"a": 5, "b": 5, "c": 5, "d": 5, "e": 5, "f": 5, None: 5}, {"a": 0, "b": 0}, {"x": 9}, dict.fromkeys([f"s{k:03}" for k in range(300)] + ["é", "Z", ""], 7)])
def test_targets_of_equal_sources(spark, sizes):
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(3)
    found = mixing.source_targets(sized).collect()
    want = filled(sizes)
    assert {r.source: r.source_size for r in found} == sizes and all(abs(r.target - want[r.source]) < 1e-6 for r in found)
    assert [r.source for r in sorted(found, key=lambda r: r.sid)] == list(want) and sorted(r.sid for r in found) == list(range(1, len(sizes) + 1))


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "é", None, "Z"])) for i in range(400)] + [(1000, None, "empty"), (1001, "", None), (7, "again same id", "a")]
    plan = mixing.plan(docs_frame(spark, rows), block_words=200).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(reference.WORD.findall(t or ""))
    target, names = filled(size), list(filled(size))
    assert sorted((r["doc_id"], r["size"]) for r in plan) == sorted((i, len(reference.WORD.findall(t or ""))) for i, t, _ in rows)
    for s in names:
        own = [r for r in plan if r["source"] == s]
        assert all(r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.5 + 1e-9
    assert sorted(map(tuple, mixing.plan(docs_frame(spark, rows, 5), block_words=200).collect()), key=str) == sorted(map(tuple, plan), key=str)
    mixed = mixing.mixed_documents(docs_frame(spark, rows)).collect()
    assert sum(len(reference.WORD.findall(r["text"] or "")) for r in mixed) == sum(round(t) if t == int(t) else int(t + 0.5) for t in target.values())
    assert mixing.plan(docs_frame(spark, rows).limit(0)).count() == 0


def test_splitting_tree(spark):
    quotas = {1: 1000, 2: 10, 3: 1, 4: 377}
    blocks = spark.createDataFrame([(s, b, 0) for s, n in quotas.items() for b in range(n)], "sid int, block long, pass long")
    old, mixing.CELL_ROWS = mixing.CELL_ROWS, 50  # ranks over many cells
    try:
        out = mixing.deal(blocks, 1388, 3).collect()
    finally:
        mixing.CELL_ROWS = old
    assert len(out) == len({(r["sid"], r["block"], r["pass"]) for r in out}) == 1388
    for depth in (1, 2, 3):  # at every level halves differ by a block at most
        sizes = collections.Counter(r["shard"] >> (3 - depth) for r in out)
        assert len(sizes) == 1 << depth and max(sizes.values()) - min(sizes.values()) <= 1


def test_draws_are_hypergeometric(spark):
    """512 shards of 64 blocks, of 32768 of which 3277 are of source 1: what a shard gets has the law's mean and variance."""
    blocks = spark.range(32768).selectExpr("CASE WHEN id < 3277 THEN 1 ELSE 2 + id % 5 END AS sid", "id AS block", "0L AS pass")
    counts = [r["n"] for r in mixing.deal(blocks, 32768, 9).groupBy("shard").agg(mixing.F.sum((mixing.F.col("sid") == 1).cast("int")).alias("n")).collect()]
    share = 3277 / 32768
    variance = 64 * share * (1 - share) * (32768 - 64) / 32767
    assert len(counts) == 512 and sum(counts) == 3277
    assert abs(np.var(counts) / variance - 1) < 0.25  # four standard errors
    assert 0 < min(counts) + 1 and max(counts) < 64 * share + 6 * variance**0.5


def test_mixing_keeps_clashing_columns(spark):
    names = ["doc_id", "source", "text", "size", "extra", "passes", "shards", "carried", "key", "n_chars"]
    rows = [(i, "ab"[i % 2], "one two three", i, "x", 1.5, None, True, "k", 13) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, extra string, passes double, shards string, carried boolean, key string, n_chars long")
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == names
    out = mixed.collect()
    assert len(out) > 40 and all(r["size"] == r["doc_id"] and r["extra"] == "x" and r["carried"] for r in out)


# fingerprints


def test_mixing_keeps_sources_of_null_ids_apart(spark):
    """A third of the rows has no doc_id, texts of one size, and three sources: each source gives what its plan says, and no block holds them all."""
    rows = [(None if k % 2 else k, f"w{k} one two three", "abc"[k % 3]) for k in range(1500)] + [(7, "same words twice over", s) for s in "abcabc"] + [(None, None, None), (None, "a b", None)]
    docs = docs_frame(spark, rows)
    planned = {r["source"]: r["n"] for r in mixing.plan(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len((r["text"] or "").split())
    assert {s: n for s, n in planned.items() if n} == {s: n for s, n in got.items() if n}


def test_fingerprints(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([1, 3, 40, 200])), "s") for i in range(0, 120, 3)] + [(500, None, "s"), (501, "", "s"), (502, " \n", "s"), (503, "same text here", "s"), (504, "same text here", "s"), (505, "🙂 é" * 50, "s")]
    fingerprints_of = fingerprints.RANGE_ROWS
    fingerprints.RANGE_ROWS = 7
    try:
        out = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(docs_frame(spark, rows)).collect()}
    finally:
        fingerprints.RANGE_ROWS = fingerprints_of
    order, errors = sorted(rows, key=lambda r: -r[0]), []
    for k, (i, t, _) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 2
        edited = t[: len(t) - m] + follow[:m]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (collections.Counter(reference.WORD.findall(x)) for x in (t, edited, follow))
        for name, x in (("near_edited", b), ("near_next", c)):
            true = sum((a & x).values()) / sum((a | x).values()) if a or x else 1.0
            assert abs(r[name] - true) <= 4 * (true * (1 - true) / fingerprints.SAMPLES) ** 0.5 + 1e-9  # none without doubt is off
            errors.append(r[name] - true)
    assert np.mean(np.abs(errors)) < 0.07 and abs(np.mean(errors)) < 0.03
    assert out[503]["fingerprint"] == out[504]["fingerprint"] != "" and out[504]["near_next"] == 1.0 and out[500]["fingerprint"] == ""
    assert fingerprints.fingerprint_pairs(docs_frame(spark, rows[:1])).count() == 1
    assert fingerprints.fingerprint_pairs(docs_frame(spark, rows).limit(0)).count() == 0


def test_fingerprints_of_an_id_that_a_third_of_the_rows_have(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    ids = [None] * 200 + [7] * 100 + [10 + k for k in range(260)] + [-(1 << 63), (1 << 63) - 1]
    rows = [(i, f"word{k} " * (k % 9 + 1) + f"tail{k % 13}") for k, i in enumerate(ids)] + [(None, "same text"), (None, "same text"), (8, None)]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt, firsts, _ = fingerprints.with_ranges(docs.select("doc_id", fingerprints.F.coalesce("text", fingerprints.F.lit("")).alias("text")))
    sizes = [r["count"] for r in dealt.groupBy("range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 60
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    chain = sorted(rows, key=lambda r: (-(-(1 << 63) if r[0] is None else r[0]), hashes[r[1]]))
    want = []
    for k, (i, text) in enumerate(chain):
        text, following = text or "", chain[(k + 1) % len(chain)][1] or ""
        cut = len(text) // 2
        want.append((i, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.fingerprint_pairs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ranges(spark):
    bounds = sorted(random.Random(1).sample(range(-(10**12), 10**12), 977))
    asked = [b + d for b in bounds[::50] for d in (-1, 0, 1)] + [-(1 << 63), (1 << 63) - 1]
    for some in (bounds, bounds[:1], bounds[:5], []):
        got = spark.createDataFrame([(x,) for x in asked], "x long").select("x", fingerprints.range_of(fingerprints.F.col("x"), some).alias("n")).collect()
        assert all(r["n"] == sum(b < r["x"] for b in some) for r in got)


# nearest neighbours


def brute(x, ids, i, k=10):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    at = np.flatnonzero(ids != ids[i])
    return [int(ids[j]) for j in at[np.lexsort((ids[at], d[at]))][:k]]


def test_search_exact_when_small(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:120] = x[49]  # ties
    rows = [(int(i), [float(v) for v in r], 1, 0.1) for i, r in enumerate(x)] + [(400, None, 1, 0.1), (500, [0.0] * 8, 1, 0.1), (600, [1.0] * 7 + [None], 1, 0.1), (700, [float("nan")] * 8, 1, 0.1), (None, [1.0] * 8, 1, 0.1), (800, [1.0, 2.0], 1, 0.1), (801, [4.0, 6.0], 1, 0.1), (900, [1.0], 1, 0.1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int, score double").repartition(3)
    old, ann.LEAST = ann.LEAST, 1000  # one partition: all are ranked
    try:
        out = ann.search(frame).collect()
    finally:
        ann.LEAST = old
    for q in (0, 100, 200):
        assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == brute(x.astype(float), np.arange(300), q)
    assert {r["query_id"] for r in out} == {0, 100, 200, 800}  # 900 has no other of its dimension
    assert [tuple(r) for r in out if r["query_id"] == 800] == [(800, 1, 801, 5.0)]
    assert ann.search(frame.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ann.search(frame.where("vec_id in (100, 150)")).collect()] == [(100, 1, 150)]


@pytest.mark.parametrize(("kind", "n", "most"), [("clusters", 9000, 0.5), ("isotropic", 6000, 1.0), ("few", 600, 1.0)])
def test_search_recall(spark, kind, n, most):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 16))
    if kind != "isotropic":
        x += (rng.normal(size=(40, 16)) * 2)[rng.integers(0, 40, n)]
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    every = 100 if n > 1000 else 10
    old, (ann.BLOCK_ROWS, ann.BLOCK_QUERIES) = (ann.BLOCK_ROWS, ann.BLOCK_QUERIES), (50, 7)  # several blocks of both sides
    try:
        found, parts, probes = ann.with_share(frame, every)
        rows = found.collect()
    finally:
        ann.BLOCK_ROWS, ann.BLOCK_QUERIES = old
    out = collections.defaultdict(set)
    for r in rows:
        out[r["query_id"]].add(r["vec_id"])
    hits = [len(out[q] & set(brute(x, np.arange(n), q))) for q in range(0, n, every)]
    print(kind, "recall", sum(hits) / (10 * len(hits)), "partitions", parts, "probed", probes)
    assert sum(hits) / (10 * len(hits)) >= 0.9 and all(len(v) == 10 for v in out.values())
    assert parts > 10 and probes <= most * parts


def test_balanced_partition():
    x = np.random.default_rng(0).normal(size=(600, 6))
    label = ann.balanced_partition(x, ann.neighbour_graph(x), 6)
    assert np.bincount(label, minlength=6).max() <= 111


# quality


def test_quality(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        t = prose(rng, rng.randrange(10, 80)) if good else " ".join(w + rng.choice(["***", "$$$", "!!"]) for w in prose(rng, rng.randrange(10, 80)).split())
        rows.append((i, t, rng.choice(["a", "b"])))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(1000, None, None), (1001, "", "a"), (0, rows[0][1], "a")]
    labels += [(None, 1, 0), (3, None, 0), (5, labels[2][1], 1)]
    frame, given = docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(frame, given).collect()}
    truth = {i: "***" not in t and "$$$" not in t and "!!" not in t for i, t, _ in rows[:600]}
    held = [i for i in range(0, 600, 2)]
    assert np.mean([out[i]["keep"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == 602
    none = quality.classify(frame, given.where("quality = 1")).collect()
    assert all(r["keep"] and r["score"] == 0.5 for r in none) and len(none) == 603
    assert quality.classify(frame.limit(0), given.limit(0)).count() == 0
    clash = frame.withColumns({"quality": quality.F.lit("q"), "carried": quality.F.lit(1), "id": quality.F.lit(2), "score": quality.F.lit(0.25)})
    kept = quality.accepted(clash, given)
    assert kept.columns == clash.columns and {(r["quality"], r["carried"], r["id"], r["score"]) for r in kept.collect()} == {("q", 1, 2, 0.25)}


def test_quality_takes_one_row_an_id(spark):
    texts = [f"text {k} of one id" for k in range(60)]
    rows = [(1, t, "s") for t in texts] + [(2, "other", "s"), (None, "x", "s")]
    ids = spark.createDataFrame([(1, 1), (2, 0)], "id long, label long")
    found = [quality.vectors(quality.columns_of(docs_frame(spark, rows[::step], parts)), ids) for step, parts in ((1, 1), (-1, 5))]
    for ids_, label, place, views in found:
        assert sorted(ids_) == [1, 2] and len(views["text"]) == 2
    for v in quality.VIEWS:
        assert np.array_equal(found[0][3][v], found[1][3][v])


def test_router_samples_below_a_bound(spark):
    rng = np.random.default_rng(0)
    rows = [(7, [1.0, 2.0])] * 3000 + [(k, rng.normal(size=2).tolist()) for k in range(6000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    router, parts, probes = ann.router_for(frame, len(rows), 10, 512)
    assert router is not None and 2 <= parts <= 512 // ann.SAMPLE_ROWS


def test_views_share_no_input():
    assert len(quality.content_features("some text\nhere")) == quality.TEXT and len(quality.metadata_features("en", "a", 5)) == quality.META
    assert (quality.metadata_features(None, None, None) == quality.metadata_features(None, None, float("nan"))).all()
