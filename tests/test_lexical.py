"""Lexical search by block maxima gives what scoring all passages gives."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.operators import windows as op
from lodestone.plans import lexical


def fixture():
    rng = random.Random(5)
    words = [f"term{k}" for k in range(60)] + ["eligible", "policies", "a/b", "x.y.z", "SAP", "R&D", "café", "IT"]
    texts = [" ".join(rng.choice(words[: rng.choice([10, 40, 68])]) for _ in range(rng.randrange(1, 90))) for _ in range(700)]
    docs = [(k, rng.choice(["term1 handbook", "R&D policies", "notes", "", None]), t) for k, t in enumerate(texts)] + [(900, None, None), (901, "term3", None), (902, "only", ""), (None, "notes", "term7 term8 eligible")]
    docs += [(1000 + k, "notes", "term7 term8 eligible") for k in range(30)]  # more ties than are asked for
    asked = ["term7 term8 eligibility", "policy a/b x.y.z R&D term12 term13", "the of and", "", None, "term1 handbook SAP", "unheard words only", "x.y.z", "Term7. term8! eligible.", " ".join(f"term{k}" for k in range(60)), "term3 term3 term3"]
    return docs, list(enumerate(asked))


@pytest.mark.parametrize("k, first", [(10, 1), (3, 16), (1000, 2)])
def test_top_is_that_of_scoring_everything(spark, k, first):
    docs, asked = fixture()
    chunks = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, at int").repartition(5)
    questions = spark.createDataFrame(asked, "qid long, question string")
    search = lexical.Search(lexical.build(chunks, "doc_id", "source", "text"), questions, k, first)
    score = F.round(sc.lexical(F.col("question"), F.col("source"), F.col("text")), 6).alias("score")
    plain = op.top_per_group(chunks.crossJoin(questions).select("qid", F.col("doc_id").alias("id"), score).where("score > 0"), ["qid"], [F.desc("score"), F.asc("id")], k)
    got = sorted(map(str, search.top().select("qid", "id", "rank", "score").collect()))
    assert got == sorted(map(str, plain.select("qid", "id", "rank", "score").collect())) and len(got) > 15
    if k == 3:
        assert search.share_read() < 1 and search.scored().count() < len(docs) * 2


def test_no_passages_and_no_questions(spark):
    docs, asked = fixture()
    chunks = spark.createDataFrame(docs, "doc_id long, source string, text string")
    questions = spark.createDataFrame(asked, "qid long, question string")
    assert lexical.Search(lexical.build(chunks.limit(0), "doc_id", "source", "text"), questions).top().count() == 0
    assert lexical.Search(lexical.build(chunks, "doc_id", "source", "text"), questions.limit(0)).top().count() == 0


def test_bounds_meet_where_phrases_are_short():
    wanted = [{"head": 1.3, "body": 0.7, "forms": [["a b"]]}, {"head": 1.0, "body": 1.0, "forms": [["c"], ["d"]]}, {"head": 0.6, "body": 0.6, "forms": [["e f", "f g"]]}]
    masks = [{"term": "a b", "bits": 0b011, "title_bits": 0b001}, {"term": "d", "bits": -(1 << 63), "title_bits": 0}, {"term": "e f", "bits": 0b110, "title_bits": 0}, {"term": "f g", "bits": 0b100, "title_bits": 0}]
    most, least = lexical.score_bounds(wanted, masks)
    assert [round(x, 6) for x in most[:4]] == [1.3, 0.7, 0.6, 0] and most[63] == 1.0
    assert [round(x, 6) for x in least[:4]] == [1.3, 0.7, 0, 0] and least[63] == 1.0


@pytest.mark.parametrize("k, slice_", [(10, 512), (3, 7), (1000, 50)])
def test_scan_gives_what_scoring_everything_gives(spark, k, slice_):
    docs, asked = fixture()
    asked += [(100, "AB-CD term1 term2 A/B/C"), (101, "eligible eligibility policies policy")]
    chunks = spark.createDataFrame([*docs, (2000, "AB CD", "a b c term1 term2"), (2001, None, "ab cd a b term1")], "id long, title string, text string").repartition(3)
    questions = spark.createDataFrame(asked, "qid long, question string")
    score = F.round(sc.lexical(F.col("question"), F.col("title"), F.col("text")), 6).alias("score")
    plain = op.top_per_group(chunks.crossJoin(questions).select("qid", "id", score).where("score > 0"), ["qid"], [F.desc("score"), F.asc("id")], k)
    found = op.top_per_group(lexical.scan(chunks, questions, k, slice_), ["qid"], [F.desc("score"), F.asc("id")], k)
    assert sorted(map(str, found.select("qid", "id", "rank", "score").collect())) == sorted(map(str, plain.select("qid", "id", "rank", "score").collect()))


def test_few_questions_need_no_index_and_many_use_it(spark, monkeypatch):
    docs, asked = fixture()
    chunks, questions = spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(asked, "qid long, question string")
    many = lexical.top(chunks, "doc_id", "source", "text", questions, few=3).collect()
    monkeypatch.setattr(lexical, "build", None)
    assert sorted(map(str, lexical.top(chunks, "doc_id", "source", "text", questions).collect())) == sorted(map(str, many))
    assert lexical.top(chunks.limit(0), "doc_id", "source", "text", questions).count() == 0 and lexical.top(chunks, "doc_id", "source", "text", questions.limit(0)).count() == 0
