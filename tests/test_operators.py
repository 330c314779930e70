"""Literal cases for the operators."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import markdown as md
from lodestone.functions import models
from lodestone.functions import scoring as sc
from lodestone.functions import text as fn
from lodestone.operators import relational as rel
from lodestone.operators import scans
from lodestone.operators import windows as win
from lodestone.plans import chunking, retrieval, understanding


def value(spark, column, **row):
    names = list(row) or ["x"]
    return spark.createDataFrame([tuple(row.values()) or (1,)], names).select(column.alias("v")).first()["v"]


def test_where(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    assert [r.n for r in df.where(rel.where({"$or": [{"n": {"$gte": 3}}, {"s": "a"}]})).collect()] == [1, 3]
    assert df.where(rel.where(None)).count() == 3 and df.where(rel.in_list("s", " , ")).count() == 3


def test_upsert_keeps_first(spark):
    old = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, v string, opened int")
    new = spark.createDataFrame([(2, "z", 9), (3, "w", 7)], "k int, v string, opened int")
    assert sorted(map(tuple, rel.upsert(old, new, ["k"], ["opened"]).collect())) == [(1, "x", 5), (2, "z", 6), (3, "w", 7)]
    assert rel.upsert(old.limit(0), new, ["k"]).count() == 2


def test_replace_is_idempotent(spark):
    old = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1)], "d string, n int")
    new = spark.createDataFrame([("d1", 9)], "d string, n int")
    once = rel.replace_by_key(old, new, "d")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, rel.replace_by_key(once, new, "d").collect())) == [("d1", 9), ("d2", 1)]


def test_keep_best_takes_first_of_equals(spark):
    rows = spark.createDataFrame([("k", 1, None, 0.5), ("k", 2, 2.4, 0.1), ("k", 3, 2.4, 0.1), ("j", 4, None, None)], "key string, arrival int, lex double, vec double")
    got = win.keep_best(rows, ["key"], ["lex", "vec"], "arrival").select("key", "arrival", "position").collect()
    assert sorted(map(tuple, got)) == [("j", 4, 4), ("k", 2, 1)]


def test_budget(spark):
    rows = spark.createDataFrame([("q", 1, "a" * 400), ("q", 2, "b" * 40), ("p", 1, "c" * 40), ("p", 2, "d" * 40), ("p", 3, "e" * 400)], "q string, n int, t string")
    got = {(r.q, r.n): len(r.t) for r in win.budget_prefix(rows, ["q"], ["n"], "t", 20).collect()}
    assert got == {("q", 1): 80 + len(" [truncated]"), ("p", 1): 40, ("p", 2): 40}


def test_list_stack_breadcrumbs(spark):
    text = "pre\n# A\n### B\nx\n### C\n## D"
    assert value(spark, md.breadcrumbs(md.lines("t")), t=text) == ["", "A", "A > B", "A > B", "A > B > C", "A > D"]


def test_level_paths_clear_deeper(spark):
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(["# A", "### B", "## C", "x", "# D"])], "d int, n int, line string")
    assert [r.section_path for r in md.level_paths(rows, "d", "n", "line").orderBy("n").collect()] == ["A", "A > B", "A > C", "A > C", "D"]


def test_pack_oversize_item_is_its_own(spark):
    assert value(spark, md.packed(F.col("t"), 10), t=["aaaa", "bbbb", "c" * 20, "dd", "ee"]) == ["aaaa\nbbbb", "c" * 20, "dd\nee"]
    assert value(spark, md.packed(F.col("t").cast("array<string>"), 10), t=["x"]) == ["x"]


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a\n| h | k |\n|---|---|\n| 1 | 2 |\n\n| lone |\n| x | y |\n| z | |")], "d int, t string")
    got = [(r.table_index, r.row_index, r.cells) for r in md.table_rows(docs, "d", "t").orderBy("table_index", "row_index").collect()]
    assert got == [(1, 1, ["h", "k"]), (1, 2, ["1", "2"]), (2, 1, ["lone"]), (2, 2, ["x", "y"]), (2, 3, ["z", ""])]
    assert value(spark, md.linear_row(F.array(F.lit("h"), F.lit("k")), F.array(F.lit("1"), F.lit("2")))) == "- h: 1; k: 2"


def test_diagnosis(spark):
    x = value(spark, md.diagnosis("t"), t="| Name | Col2 |\n| a | a |\n| b | b |\n| c | d |")
    assert (x.tables, x.table_rows) == (1, 4) and "table_structure_suspect" in x.warnings and x.fallback
    assert "numbered_row_gaps" in value(spark, md.diagnosis("t"), t="\n".join(f"{n}. row" for n in (1, 2, 3, 5, 6, 8))).warnings


def test_questions_and_answers(spark):
    docs = spark.createDataFrame([(1, "Q1: What?\nA: This\nmore\n\n**Question 2: Why?**\n- A: Because\nQ3: none")], "d int, t string")
    assert [(r.question, r.answer) for r in md.qa_pairs(docs, "d", "t").orderBy("pair_index").collect()] == [("What?", "This\nmore"), ("Why?", "Because")]


def test_cleaning(spark):
    assert value(spark, md.cleaned("t"), t="one hyphen-\nated\n 12 \nIntro ........ 4\nend  \n\n\n\nlast") == "one hyphenated\nend\n\nlast"
    assert value(spark, md.header_depths("t"), t="## 1.1 Eligibility Criteria\nGENERAL PENSION RULES\ntext") == "### 1.1 Eligibility Criteria\n## GENERAL PENSION RULES\ntext"
    assert value(spark, md.merged(F.col("a"), F.col("b")), a="one two three", b="three four") == "one two three four"
    assert value(spark, md.merged(F.col("a"), F.col("b")), a="one", b="two") == "one\ntwo"


def test_scores(spark):
    assert value(spark, sc.lexical(F.lit("What about Casual Leave?"), F.lit("Casual Leave"), F.lit("days"))) >= 1.5
    assert value(spark, sc.lexical(F.lit("What about Casual Leave?"), F.lit("Paternity"), F.lit("leave of days"))) < 1.2
    assert value(spark, sc.lexical(F.lit("eligibility"), F.lit("who is eligible"), F.lit(""))) >= 1.5
    assert value(spark, sc.fuzzy(F.lit("ab"), F.lit("AB"))) == 10000.0 and value(spark, sc.fuzzy(F.lit("zz"), F.lit("abc"))) is None
    assert value(spark, sc.fuzzy(F.lit("ac"), F.lit("abc"))) == 80 + 35 + 45 + 80 - 1.0 - 0.3
    assert value(spark, sc.route(F.lit(0.85))) == "rag" and value(spark, sc.route(F.lit(0.86))) == "chat"
    assert [value(spark, sc.effective_top_k(F.lit(q), F.lit(h))) for q, h in (("plain", False), ("in detail please", False), ("plain", True))] == [5, 8, 10]


def test_titles_and_labels(spark):
    assert value(spark, fn.session_title("t"), t="Hello there") == "New Chat"
    assert value(spark, fn.session_title("t"), t="what is the casual leave policy for staff") == "Casual Leave Policy Staff"
    assert value(spark, fn.relabelled(F.col("t"), F.lit("Lora Paper.md")), t="[Doc: approved.md | Section: x]\nbody") == "[Doc: Lora Paper.md | Section: x]\nbody"


def test_knn(spark):
    v = spark.createDataFrame([("apples", [0.1, 0.2, 0.3]), ("oranges", [0.9, 0.8, 0.3]), ("none", [0.0, 0.0, 0.0])], "vec_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [0.1, 0.2, 0.35])], "qid int, q_vector array<double>")
    assert [r.vec_id for r in retrieval.knn(q, v, 1).collect()] == ["apples"]


def test_knn_by_a_grid_is_that_by_broadcast(spark, monkeypatch):
    """10,000 questions in one plan without a branch a block; ties, zero, null and short vectors, targets."""
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.normal(size=(150, 6)).round(1).tolist()
    rows = [(k, data[k % 120], "ab"[k % 2]) for k in range(150)] + [(150, [0.0] * 6, "a"), (151, None, "b"), (152, [1.0, None, 0.0, 0.0, 0.0, 0.0], "a"), (153, [1.0] * 4, "b")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, filename string")
    asked = spark.createDataFrame([(k, data[k % 120] if k % 50 else [0.0] * 6, [None, "a", "b"][k % 3], k * 2) for k in range(300)], "qid long, q_vector array<double>, target string, extra long")
    monkeypatch.setattr(retrieval.grid, "__defaults__", (40, 70))
    few, many = (sorted((*map(str, (r.qid, r.vec_id, r.rank, r.extra, r.filename)), round(r.vector_score, 9)) for r in retrieval.knn(asked, vectors, 7, few=n).collect()) for n in (1000, 0))
    assert few == many and len(few) == 7 * 300
    monkeypatch.undo()
    lots = spark.range(10_000).select(F.col("id").alias("qid"), F.array(*(F.cos(F.col("id") * k) for k in range(6))).alias("q_vector"))
    found = retrieval.knn(lots, vectors.drop("filename"), 2)
    assert found.count() == 20_000 and found._jdf.queryExecution().logical().toString().count("Union") == 0


@pytest.mark.parametrize("cells", [1, 9, 50])
def test_scans_of_a_hot_key_are_windows(spark, cells):
    """A third of the rows has one key; sums, last values and links are those of a window, and no cell has more than its share."""
    import random

    rng = random.Random(cells)
    rows = [("hot" if k % 3 == 0 else rng.choice([None, *"abcdefgh"]), k // 2, k, rng.choice([None, 1, 2, 3]), rng.choice([None, None, "x", "y"])) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, a long, b long, v long, s string").repartition(4)
    w = Window.partitionBy("k").orderBy("a", "b")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"total": F.count("*").over(Window.partitionBy("k")), "position": F.row_number().over(w).cast("long"), "sum": F.coalesce(F.sum("v").over(upto), F.lit(0)), "seen": F.last("s", ignorenulls=True).over(upto)})
    got = scans.scanned(df, ["k"], ["a", "b"], {"sum": F.col("v")}, {"seen": F.col("s")}, cells)
    names = ["k", "a", "b", "v", "s", "total", "position", "sum", "seen"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    linked = (x.link_indices(df, ["k"], ["a", "b"]).select("k", "b", "chunk_index", "prev_index", "next_index").collect() for x in (scans, win))
    assert len({tuple(sorted(map(str, x))) for x in linked}) == 1
    assert scans.link_indices(df.limit(0), ["k"], ["a", "b"]).count() == 0


def test_hundred_thousand_names(spark):
    """Rows come out for hits only, from one automaton or several shards of names, with the character before each place."""
    names = spark.range(100_000).select(F.concat(F.lit("file"), F.col("id").cast("string"), F.lit(".md")).alias("name"), F.col("id").alias("n"))
    said = [(k, f"see @file{k}.md, file{k + 1}.md and xfile{k}.mdx, file.md") for k in range(0, 2000, 20)] + [(-1, ""), (-2, None), (-3, "file5.md")]
    texts = spark.createDataFrame(said, "k long, t string")
    want = sorted([(k, "@", k) for k in range(0, 2000, 20)] + [(k, " ", k + 1) for k in range(0, 2000, 20)] + [(k, "x", k) for k in range(0, 2000, 20)] + [(-3, None, 5)], key=str)
    for shard in (200_000, 30_000):
        found = understanding.contained(texts, "t", names, "name", shard, 40)
        assert found.columns == ["k", "before", "n"] and sorted(map(tuple, found.collect()), key=str) == want


def test_stitch(spark):
    rows = spark.createDataFrame([(1, "A", 1, "Part 1"), (1, "A", 2, "Part 2"), (1, "A", 4, "Part 4"), (1, "B", 1, "b")], "qid int, filename string, chunk_index int, text string")
    assert sorted((r.filename, r.chunk_index, r.stitched_from, r.text) for r in retrieval.stitch(rows).collect()) == [("A", 1, 2, "Part 1\nPart 2"), ("A", 4, 1, "Part 4"), ("B", 1, 1, "b")]


def smart(a, b, most=500):
    """The rule of the merge, a step at a time."""
    if "|" in a and "|" in b and len(a.split("\n")) >= 2 and len(b.split("\n")) >= 2 and a.split("\n")[:2] == b.split("\n")[:2]:
        b = "\n".join(b.split("\n")[2:]).lstrip()
    tail = a[-most:]
    at = b.find(tail[:100].strip()) if tail[:100].strip() else -1
    overlap = b[at : len(tail)] if at >= 0 else None
    return a + b[len(overlap) :] if overlap is not None and a.endswith(overlap) else a + "\n" + b


def test_stitch_takes_headers_and_overlaps_once(spark):
    import random

    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(900))
    cases = [("| h | k |\n|---|---|\n| 1 | 2 |", "| h | k |\n|---|---|\n| 3 | 4 |"), ("one two three", "one two three"), (long[:3000], long[2600:4000]), (long[:3000], long[2000:4000]), ("", "b"), ("a", ""), ("x y", "z x y"), ("| a", "b |")]
    for a, b in cases:
        assert value(spark, md.joined_smartly(F.col("a"), F.col("b")), a=a, b=b) == smart(a, b)
    assert "| h | k |" not in smart(*cases[0])[5:] and smart(*cases[2]) == long[:3000] + "\n" + long[2600:4000] and smart(long[:3000], long[2500:4000]) == long[:4000]

    rows, want = [], []
    for name in "abc":
        at = run = 0
        for k in range(40):
            at += 1 if rng.random() < 0.8 else 2
            rows.append((1, name, at, " ".join(long.split()[k * 7 : k * 7 + rng.choice([3, 30, 250])])))
    for name in "abc":
        group, i = [r for r in rows if r[1] == name], 0
        while i < len(group):
            text, j = group[i][3], i + 1
            while j < len(group) and group[j][2] == group[j - 1][2] + 1:
                text, j = smart(text, group[j][3]), j + 1
                if len(text) > 4000:
                    break
            want.append((name, group[i][2], j - i, text))
            i = j
    frame = spark.createDataFrame(rows, "qid int, filename string, chunk_index int, text string").repartition(3)
    assert sorted((r.filename, r.chunk_index, r.stitched_from, r.text) for r in retrieval.stitch(frame, most=4000).collect()) == sorted(want)
    kinds = spark.createDataFrame([(1, "A", 1, "x", "section"), (1, "A", 2, "y", "table_row"), (2, "A", 1, "x", None), (2, "A", 2, "y", "section")], "qid int, filename string, chunk_index int, text string, chunk_kind string")
    assert sorted((r.qid, r.text) for r in retrieval.stitch(kinds).collect()) == [(1, "x"), (1, "y"), (2, "x\ny")]


def test_chunk_routes_and_rows(spark):
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    for text, kind in ((table, "table_rows"), (table + "\nw" * 4, "body"), ("#h\n" * 9 + table * 9, "body"), ("| a |\ntext\n| b |", "body"), ("", "body"), ("Q1: a\nA: b\nQ2: a\nA: b\nQ3: a\nA: b", "qna"), (None, None)):
        assert spark.createDataFrame([(text,)], "t string").select(chunking.route("t").alias("v")).first()["v"] == kind
    docs = spark.createDataFrame([(1, "| " + " | ".join("c" * 90 for _ in range(6)) + " |\n|---|\n| x |", "f.md")], "d int, t string, n string")
    rows = sorted(map(tuple, chunking.row_chunks(docs, "d", "t", "n", 450).collect()))
    long, short = [r for r in rows if r[2] == 1], [r for r in rows if r[2] == 2]
    head = "[Doc: f.md | Section: Table 1 > " + "c" * 80 + " | Table Row: 1]\n# " + "c" * 80 + "\n"
    assert len(long) == long[0][4] == 3 and all(r[5].startswith(head) and r[5].endswith(f"\n\n[Table row fragment {r[3] + 1}/3]") for r in long)
    assert "".join(r[5] for r in long).count("Column ") == 6 and short[0][5] == "[Doc: f.md | Section: Table 1 > x | Table Row: 2]\n# x\nx"


def test_long_answers_keep_their_question(spark):
    answer = "\n".join(f"line {k} " + "x" * 60 for k in range(20))
    docs = spark.createDataFrame([(1, f"# H\nQ1: why\nA: {answer}", "f.md"), (2, "Q1: a\nA: b", "g.md"), (3, None, "h")], "d int, t string, n string")
    rows = chunking.qna_chunks(docs, "d", "t", "n", 500).orderBy("d", "fragment_index").collect()
    own = [r for r in rows if r.d == 1]
    assert len(own) == own[0].total_fragments > 2 and all(len(r.text) < 600 for r in own)
    assert [r.text.split("\n\n")[1].split(":")[0] for r in own] == ["A"] + ["A continued"] * (len(own) - 1)
    assert "\n".join(r.text.split(": ", 3)[-1].split("\n\n")[-1].split(": ", 1)[1] for r in own) == answer
    assert rows[-1].text == "[Doc: g.md | Section: Root | Q&A: q1 | Part 1/1]\nQ: a\n\nA: b"


def test_coverage(spark):
    rows = spark.createDataFrame([(1, "a", k, 1.0 - k / 100) for k in range(6)] + [(1, "b", 10 + k, 0.1 - k / 100) for k in range(3)], "qid int, t string, id int, s double")
    got = win.target_coverage(rows, "qid", "t", "s", "id", 4).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 10, 11]


def test_resolution_passes_unknown_through(spark):
    files = spark.createDataFrame([("Leave Policy.pdf",), ("b.pdf",)], "filename string")
    out = understanding.resolve_target(spark.createDataFrame([("leave-policy",), ("zzz",)], "target string"), files).collect()
    assert sorted(map(tuple, out)) == [("leave-policy", "Leave Policy.pdf"), ("zzz", "zzz")]


def test_many_names_are_found_as_few_are(spark):
    import random

    rng = random.Random(9)
    names = ["".join(rng.choice("ab_. ") for _ in range(rng.randrange(1, 6))) + rng.choice(["", ".md", ".PDF"]) for _ in range(60)] + ["", None, "...", "--", "ab.md", "AB.md"]
    said = ["".join(rng.choice(["a", "b", "_", ".", " ", "@", ".md", "@ab.md", "ba.pdf", "!"]) for _ in range(rng.randrange(0, 12))) for _ in range(150)] + [None, "", "@AB.MD and ab"]
    known = spark.createDataFrame([(n,) for n in names + names[:9]], "filename string")
    asked = spark.createDataFrame(list(enumerate(said)), "qid int, question string")
    few, many = (sorted(map(tuple, understanding.mentions(asked, known, n).collect())) for n in (1000, 0))
    assert few == many and {r[2] for r in few} == {1, 2, 3}

    def tier(q, n):
        import re

        q, low = q.lower(), n.lower()
        stem = re.sub("[^a-z0-9]+", " ", re.sub(r"\.[a-z0-9]+$", "", low)).strip()
        return 1 if "@" + low in q else 2 if low in q else 3 if stem and f" {stem} " in " " + re.sub("[^a-z0-9]+", " ", q) + " " else None

    assert {r[:3] for r in few} == {(k, n, tier(q, n)) for k, q in enumerate(said) if q is not None for n in set(names) if n and tier(q, n)}
    targets = spark.createDataFrame([(x,) for x in said + names], "target string")
    few, many = ({r.target: r.resolved for r in understanding.resolve_target(targets, known, n).collect()} for n in (1000, 0))
    assert few == many and sum(k != v for k, v in few.items()) > 20
    none = spark.createDataFrame([], "filename string")
    assert understanding.mentions(asked, none, 0).count() == understanding.mentions(asked, none, -1).count() == 0


def test_segmentation_does_not_vary():
    import math

    words = ["the", "cat", "sat"]
    cost = {w: math.log((k + 1) * math.log(3)) for k, w in enumerate(words)}
    assert models.split_words("thecatsat", cost, 20, 25.0) == "the cat sat"


def blocks_by_hand(text):
    """Blocks of a text, a line at a time."""
    import re

    def kind(t):
        if re.match(r"#{1,6}\s+.", t):
            return "heading"
        return "table" if t[:1] == "|" else "figure" if re.match(r"(?i)\[(figure|visual|image description)\b", t) else "paragraph"

    out, fenced, at = [], False, None  # at: the block that the next line may join
    for no, line in enumerate(text.split("\n"), 1):
        t = line.strip()
        edge = t.startswith("```")
        if fenced or edge:
            if at is None:
                at = ["code", no, no, []]
                out.append(at)
            at[2] = no
            at[3].append(line)
            fenced = fenced != edge
            at = at if fenced else None
        elif not t:
            at = None
        else:
            if at is None or at[0] != kind(t) or kind(t) == "heading":
                at = [kind(t), no, no, []]
                out.append(at)
            at[2] = no
            at[3].append(line)
            at = None if kind(t) == "heading" else at
    return [(k, a, b, "\n".join(x).strip()) for k, a, b, x in out]


def test_blocks(spark):
    import random

    rng = random.Random(5)
    parts = ["```", "```py", "  ``` ", "", " ", "# h", "####### no", "#no", "| a |", " | b", "text", "more", "[Figure 2] f", "[visual: v]", "[Visuals]", "````"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) + "\nend" for _ in range(300)] + ["", None, "```", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, t string").repartition(3)
    got = sorted((r.d, r.start_line, r.end_line, r.kind, r.text) for r in md.blocks(docs, "d", "t").collect())
    assert got == sorted((k, a, b, kind, x) for k, t in enumerate(texts) if t for kind, a, b, x in blocks_by_hand(t))
