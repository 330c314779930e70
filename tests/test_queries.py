"""Every query that has SQL gives the rows that DuckDB gives for it; the others run and have rows."""

import os

import duckdb
import pytest

from lodestone import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    assert columns == sorted(con.sql(sql).columns)
    assert rows == sorted(str([plain(v) for v in r]) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_tables_of_the_texts_own(spark, tmp_path):
    import re

    texts = ["| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | |\nwords\n| lone |\nmore\n  | c |\n| 5 |", "plain", "| x | y |\n| 7 | 8 |\n\n| z |\n|---|\n| 9 |"]
    docs = spark.createDataFrame([(k, t, "en", f"s{k}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    islands, linear, diagnosed = set(), [], {}
    for k, t in enumerate(texts):
        lines = f"# en\nintro {k}\n### s{k}\n| k | v |\n|---|---|\n| s{k} | {len(t)} |\n### deep\n{t}\n## end\nQ1: what is en\nA: it is\ns{k}\nQ2: none\n1. a\n2. b".split("\n")
        runs, at = [], 0
        while at < len(lines):
            to = at
            while to < len(lines) and lines[to].lstrip(" ").startswith("|"):
                to += 1
            runs += [range(at, to)] if to > at else []
            at = max(to, at + 1)
        diagnosed[k] = (len(runs), sum(map(len, runs)))
        for table, run in enumerate([r for r in runs if len(r) > 1], 1):
            rows = [(no, [c.strip() for c in lines[no].strip().strip("|").split("|")]) for no in run if not re.fullmatch(r"[\s:|-]*-[\s:|-]*", lines[no])]
            islands |= {(k, no, table, n) for n, (no, _) in enumerate(rows, 1)}
            head = rows[0][1]
            for _, row in rows[1:]:
                pairs = [(h, v) for h, v in zip(head, row) if v]
                linear.append((k, "- " + ("; ".join(f"{h}: {v}" for h, v in pairs) if len(row) == len(head) > 1 else "; ".join(v for v in row if v))))
    run = {name: registry.queries()[name](spark, str(tmp_path)).collect() for name in ("table_islands", "linear_tables", "diagnose_markdown")}
    assert {tuple(r) for r in run["table_islands"]} == islands and max(x[2] for x in islands) == 3
    assert sorted(map(tuple, run["linear_tables"])) == sorted(linear)
    assert {r.doc_id: (r.tables, r.table_rows) for r in run["diagnose_markdown"]} == diagnosed


def test_segments_whole_texts_by_all_words(spark, tmp_path):
    import math
    import random
    from collections import Counter

    from lodestone.functions import models

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(7000)})
    texts = [" ".join(w for w in words for _ in range(1 + (len(w) < 4))), "zebra quagga", None]
    items = [(1, "Zebra, quagga! " + " ".join(rng.choice(words) for _ in range(40))), (2, ""), (3, None), (4, "qqq")]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    counts = Counter(w for t in texts if t for w in t.split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    cost = {w: math.log((k + 1) * math.log(len(order))) for k, w in enumerate(order)}
    expected = {k: None if t is None else models.split_words("".join(c for c in t.lower() if c.isalpha()), cost, 20, 25.0) for k, t in items}
    found = {r.item_id: r.text for r in registry.queries()["viterbi_segment"](spark, str(tmp_path)).collect()}
    assert len(order) > 5000 and found == expected and found[1].startswith("zebra quagga ")
    variants = {(r.item_id, r.variant): r.question for r in registry.queries()["query_variants"](spark, str(tmp_path)).collect()}
    assert variants[1, 0] == items[0][1] and len(variants[1, 0]) > 60


def lines_of(text):
    import re

    parts = re.split("\r\n?|\n", text)
    return parts[:-1] if parts[-1] == "" else parts


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_greedy_packing_by_brute_force(spark, con):
    want = set()
    for i, text in con.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        sizes, n, held = [], 0, 0
        for line in lines_of(text):
            if held and n + len(line) > 2200:  # a chunk closes when the next line would not fit
                sizes.append(n + held - 1)
                n = held = 0
            n, held = n + len(line), held + 1
        sizes += [n + held - 1] if held else []
        want |= {(i, k, k - 1, k + 1 if k + 1 < len(sizes) else -1, size) for k, size in enumerate(sizes)}
    got = {tuple(r) for r in registry.queries()["pack_greedy"](spark, DATA).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_subsequence_scores_by_brute_force(spark, con):
    import re

    def score(letters, text):
        total, last = 0.0, -1
        for c in letters:
            at = text.find(c, last + 1)
            if at < 0:
                return None
            total += 80 + (35 if at == 0 or re.match(r"[\s._/-]", text[at - 1]) else 0) + (45 if at == last + 1 else 0) - 0.5 * at
            last = at
        return total - 0.1 * len(text)

    want = {}
    for i, url in con.sql("SELECT page_id, url FROM pages WHERE url IS NOT NULL").fetchall():
        s = score("exmcom", url.lower())
        if s is not None and s >= 0:
            want[i] = round(s, 6)
    got = {r.page_id: round(r.score, 6) for r in registry.queries()["fuzzy_subsequence"](spark, DATA).collect()}
    assert got == want and want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_normaliser_warnings_by_brute_force(spark, con):
    import re

    def words(t):
        return len(re.findall(r"\w+", t))

    want = {}
    for i, text in con.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        half = "\n".join(x for x in lines_of(text) if len(x) % 2 == 0)
        kept = words(half) / words(text) if words(text) else 1.0
        want[i] = [w for w, on in (("words_lost", kept < 0.55), ("very_short", words(half) < 50), ("open_fence", half.count("```") % 2 == 1)) if on]
    got = {r.doc_id: [w for w in r.warnings if w != "questions_lost"] for r in registry.queries()["normaliser_checks"](spark, DATA).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_layout_pages_are_whole_documents(spark):
    """A row a user with all of the user's blocks, pages in order."""
    from collections import Counter

    rows = registry.queries()["layout_pages"](spark, DATA).collect()
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", "event_type").collect()
    want = Counter((e.user_id, f"{e.event_type}{e.event_id}") for e in events if e.event_id % 13 and e.event_type is not None)
    assert Counter((r.user_id, part) for r in rows for part in r.markdown.split("\n\n") if not part.startswith(("<!-- page:", "## Page "))) == want
    assert len({r.user_id for r in rows}) == len(rows)
    for r in rows:
        pages = [line for line in r.markdown.split("\n") if line.startswith("## Page ")]
        assert pages == sorted(set(pages))
