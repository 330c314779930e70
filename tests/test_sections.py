"""Fragments, batches and packed blocks, by hand and against plain rules; table functions in SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions import markdown as md
from lodestone.plans import sections

DATA = "/root/testdata/sf0.001"


def test_fragments_by_hand():
    text = "# Leave\n\nOne is short. Two ends here.\n| a | b |\n|---|---|\n| 1 | 2 |\nafter the table\n\n\nlast words. And more."
    assert sections.paragraphs(text) == ["# Leave", "One is short. Two ends here.", "| a | b |\n|---|---|\n| 1 | 2 |", "after the table", "last words. And more."]
    assert sections.fragments(text, 1000, 50) == [("\n\n".join(sections.paragraphs(text)), True)]
    got = sections.fragments(text, 60, 18)
    assert got == [("# Leave\n\nOne is short. Two ends here.", False), ("| a | b |\n|---|---|\n| 1 | 2 |\n\nafter the table", True), ("after the table\n\nlast words. And more.", False)]
    assert sections.tail("First one. Second one! Third", 15) == "Third" and sections.tail("short", 10) == "" and sections.tail("no ends at all here", 10) == ""
    assert sections.fragments("", 10, 2) == [] and sections.fragments(" \n\n ", 10, 2) == []


def test_a_long_paragraph_is_cut_at_sentences():
    text = "Alpha beta gamma. Delta is here! Is it? Yes. " + "x" * 80 + ". End."
    parts = sections.sentence_parts(text, 40, 20)
    assert parts[0] == "Alpha beta gamma. Delta is here! Is it?" and any("x" * 80 in p for p in parts) and parts[-1].endswith("End.")
    assert all(len(p) <= 40 + 20 or "x" * 80 in p for p in parts)


@pytest.mark.parametrize("seed", range(25))
def test_fragments_keep_words_and_tables(seed):
    rng = random.Random(seed)
    blocks = []
    for _ in range(rng.randrange(1, 12)):
        if rng.random() < 0.3:
            blocks.append("\n".join("| " + " | ".join(str(rng.randrange(99)) for _ in range(3)) + " |" for _ in range(rng.randrange(1, 6))))
        else:
            blocks.append(" ".join(rng.choice(["one", "two.", "three!", "four", "five?"]) + str(rng.randrange(10**6)) * (rng.random() < 0.3) for _ in range(rng.randrange(1, 60))))
    text, size, overlap = "\n\n".join(blocks), rng.choice([80, 200, 500]), rng.choice([0, 30, 90])
    got = sections.fragments(text, size, overlap)
    at = 0
    for part, table in got:  # what is new of each fragment goes on where the one before ended
        words = part.split()
        fresh = next(k for k in range(len(words) + 1) if text.split()[at : at + len(words) - k] == words[k:])
        at += len(words) - fresh
        assert overlap or not fresh
        holds = any(line.startswith("|") for line in part.split("\n"))
        assert table == holds or fresh and not table  # what is only carried over does not count
        assert len(part) <= size + overlap or len(re.split(r"(?<=[.!?])\s+", part)) <= 2 + 30 * bool(overlap)
    assert at == len(text.split())
    for block in blocks:
        if block.startswith("|") and len(block) + 2 <= size:
            assert any(block in part for part, _ in got)


def plain_batches(text, size, overlap):
    """Heading by heading, character by character."""
    text = text.strip(" \t\n\v\f\r")
    if len(text) <= size:
        return [text]
    starts = [0] + [m.start() for m in re.finditer(r"^#{1,6}[ \t]+\S", text, re.M) if m.start()]
    parts = [p for p in (text[a:b].strip(" \t\n\v\f\r") for a, b in zip(starts, [*starts[1:], None])) if p]
    out = [parts[0]]
    for part in parts[1:]:
        if len(out[-1]) + len(part) > size:
            out.append((out[-1][-overlap:] if overlap else "") + "\n\n" + part)
        else:
            out[-1] += "\n\n" + part
    return [o.strip(" \t\n\v\f\r") for o in out]


@pytest.mark.parametrize("seed", range(15))
def test_batches_and_back(seed):
    rng = random.Random(seed)
    text = "\n".join(("#" * rng.randrange(1, 4) + f" head {k}\n" if rng.random() < 0.25 else "") + f"line {k} " + "w" * rng.randrange(30) for k in range(120))
    size, overlap = rng.choice([200, 600, 10_000]), rng.choice([0, 40, 100])
    got = sections.batches(text, size, overlap)
    assert got == plain_batches(text, size, overlap)
    back = sections.put_together(got, overlap)
    assert back.endswith("\n") and len(back) <= len(text) + 4 * 120 + len(got) * overlap
    words = iter(back.split())
    assert all(w in words for w in text.split())  # all of it, in order; after a blank line in what batches share it is there again
    if not overlap or len(got) == 1:
        assert back.split() == text.split()


def test_repeated_first_lines_go():
    assert sections.put_together(["a\nthe end of one\n## Next", "the end of one\n## Next\nbody"], 40) == "a\nthe end of one\n## Next\n\nbody\n"
    assert sections.put_together(["x\n## Next", "## Next\nbody"], 0) == "x\n## Next\n\nbody\n"
    assert sections.put_together([], 5) == "" and sections.put_together(["one"], 5) == "one\n"


def test_blocks_are_packed_whole(spark):
    text = "# Guide\nintro\n## Table of Contents\n- skipped\n## Rules\nfirst paragraph\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n\ny = 2\n```\n### Deep\n[Figure 1] chart\n## Last\n" + "long " * 30
    docs = spark.createDataFrame([(1, text, "handbook"), (2, "plain only", "notes"), (3, None, "none"), (4, "", "none")], "k long, t string, f string")
    got = {(r.k, r.chunk_index): (r.section_path, r.kind, r.start_line, r.end_line, r.text) for r in sections.kind_chunks(docs, "k", "t", "f", 60).collect()}
    assert got[1, 0] == ("Guide", "section", 2, 2, "Guide\n\n## Guide\n\nintro")
    assert [got[1, k][:2] for k in range(6)] == [("Guide", "section"), ("Guide > Rules", "section"), ("Guide > Rules", "table"), ("Guide > Rules", "code"), ("Guide > Rules > Deep", "figure"), ("Guide > Last", "section_fragment")]
    assert got[1, 2][4] == "Guide > Rules\n\n## Rules\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert got[1, 3][4].endswith("```py\nx = 1\n\ny = 2\n```") and got[2, 0] == ("notes", "section", 1, 1, "notes\n\n## notes\n\nplain only")
    assert {k for k, _ in got} == {1, 2} and not any("skipped" in v[4] for v in got.values())


def test_table_functions_in_sql_are_the_frames(spark):
    from lodestone.catalog import chunking

    sections.register(spark)
    docs = chunking.of_kinds(spark, DATA).select("doc_id", "md").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Q: a\nA: b\nQ: c\nQ1. d\n- A: e\nf")], "doc_id long, md string"))
    docs.createOrReplaceTempView("kinds")
    pairs = spark.sql("SELECT doc_id, p.* FROM kinds, LATERAL extract_qa_pairs(md) p")
    want = md.qa_pairs(docs, "doc_id", "md").select("doc_id", F.col("pair_index").cast("int"), "question", "answer")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect())) and pairs.count() > 40
    chunks = spark.sql("SELECT doc_id, c.section_path, c.fragment_index, c.total_fragments, c.has_table, c.text FROM kinds, LATERAL chunk_markdown(md, 300, 60) c")
    frame = sections.fragment_rows(md.section_rows(docs.where("md IS NOT NULL"), "doc_id", "md").select("doc_id", "section_path", "text"), "text", 300, 60)
    assert sorted(map(tuple, chunks.collect())) == sorted(tuple(r) for r in frame.select("doc_id", "section_path", "fragment_index", "total_fragments", "has_table", "text").collect())
    with pytest.raises(Exception, match="argument 1 of chunk_markdown"):
        spark.sql("SELECT * FROM chunk_markdown(1)").collect()


def test_batches_query_by_plain_code(spark):
    from lodestone.catalog import chunking

    got = {r.doc_id: r for r in registry.queries()["heading_batches"](spark, DATA).collect()}
    rows = chunking.marked(spark, DATA).where("md IS NOT NULL").select("doc_id", "md").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = plain_batches(r.md, 4000, 300)
        assert got[r.doc_id].n == len(want) and got[r.doc_id].batches_md5 == hashlib.md5("\f".join(want).encode()).hexdigest()
