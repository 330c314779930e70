"""Scores of passages against questions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as fn


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def share_contained(words: Column, hay: Column) -> Column:
    """The share of words that the text contains."""
    return fn.bound(lambda s: F.size(F.filter(s["words"], lambda t: F.contains(s["hay"], t))) / F.greatest(F.size(s["words"]), F.lit(1)), words=words, hay=hay)


def hits(words: Column, hay: Column) -> Column:
    return fn.bound(lambda s: F.size(F.filter(s["words"], lambda t: F.contains(s["hay"], t))), words=words, hay=hay)


def hybrid(question: Column, vector: Column, text: Column, title: Column, doc_type: Column, kind: Column, chunk_index: Column, has_table: Column, lexical: Column) -> Column:
    """The vector score with the boosts that words, titles, acronyms and structure give."""

    def score(s: Column) -> Column:
        words, title, hay, matched = s["words"], s["title"], s["hay"], s["matched"]
        acronyms = F.size(F.filter(s["acronyms"], lambda a: F.contains(s["padded"], F.concat(F.lit(" "), a, F.lit(" ")))))
        technical = F.arrays_overlap(words, F.array(*(F.lit(x) for x in ("technology", "technologies", "stack", "component", "framework", "tool"))))
        score = (
            vector + 0.45 * matched / F.greatest(F.size(words), F.lit(1)) + 0.06 * hits(words, title) + 0.22 * acronyms
            + F.when((doc_type == "qna") & (matched > 0), 0.08).otherwise(0.0)
            + F.when(kind.startswith("table_row") & (matched > 0), 0.18).otherwise(0.0)
            - F.when(has_table & (matched == 0), 0.04).otherwise(0.0)
            + F.when(technical & (F.contains(title, F.lit("component breakdown")) | hay.rlike(r"\bcomponent:\s+")), 0.42).otherwise(0.0)
            + F.when(F.lower(question).rlike(fn.OVERVIEW) & ((kind == "doc_summary") | (chunk_index < 2)), 0.55).otherwise(0.0)
            + F.least(0.45 * F.coalesce(lexical, F.lit(0.0)), F.lit(0.95))
        )
        return F.when(F.size(words) == 0, vector).otherwise(score)

    names = {"words": F.array_distinct(fn.tokens(question, 2, fn.STOP)), "title": F.lower(title), "hay": F.concat_ws(" ", F.lower(text), F.lower(title)), "acronyms": fn.acronyms(question), "padded": normal(title)}
    # once for the texts, once more for the words that match
    return fn.bound(lambda s: fn.bound(score, matched=hits(s["words"], s["hay"]), **{n: s[n] for n in names}), **names)


def forms(word: Column) -> Column:
    """S3: a word with its plain variants."""
    other = (
        F.when(word == "eligibility", "eligible").when(word == "eligible", "eligibility")
        .when(word.endswith("ies") & (F.length(word) > 4), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(word.endswith("s") & (F.length(word) > 4), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    )
    return F.array(word, other)


def normal(text: Column) -> Column:
    """Letters and digits with single spaces about them, so that whole words are substrings; a word with a full stop is the word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def padded_forms(word: Column) -> Column:
    """S3: a word and its variants, padded as in ``normal``."""
    return F.transform(forms(word), lambda f: F.concat(F.lit(" "), F.trim(F.regexp_replace(f, "[^a-z0-9]+", " ")), F.lit(" ")))


def lexical(question: Column, title: Column, body: Column) -> Column:
    """S3: words (repeats count), adjacent pairs, long words and acronyms of the question in title and body.

    Title and body are normalised once; each word's forms are looked for once.
    """

    def words_of(s: Column) -> Column:
        return F.transform(s["words"], lambda t: F.struct((F.length(t) >= 5).alias("long"), F.exists(padded_forms(t), lambda f: F.contains(s["hay"], f)).alias("found")))

    def points(s: Column, given: Column, in_title: float, in_body: float) -> Column:
        return F.aggregate(F.transform(given, normal), F.lit(0.0), lambda sum_, p: sum_ + F.when(F.contains(s["head"], p), in_title).when(F.contains(s["hay"], p), in_body).otherwise(0.0))

    def score(s: Column) -> Column:
        words = s["words"]
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        found, long_words = F.size(F.filter(s["seen"], lambda x: x["found"])), F.size(F.filter(s["seen"], lambda x: x["found"] & x["long"]))
        total = found / F.greatest(F.size(words), F.lit(1)) + points(s, F.filter(pairs, lambda p: F.contains(p, F.lit(" "))), 1.3, 0.7) + 0.55 * long_words + points(s, s["acronyms"], 1.0, 0.5)
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(total)

    names = {"words": fn.tokens(question, 2, fn.STOP), "acronyms": fn.acronyms(question), "head": normal(title), "hay": normal(F.concat_ws("\n", title, body))}
    return fn.bound(lambda s: fn.bound(score, seen=words_of(s), **{n: s[n] for n in names}), **names)


def rerank(model: Column, question: Column, text: Column) -> Column:
    """The model's score with the share and density of the question's words."""
    words = F.filter(F.split(F.lower(question), r"\s+"), lambda w: F.length(w) > 2)
    length = F.greatest(F.size(F.split(fn.strip(text), r"\s+")), F.lit(1))
    return fn.bound(lambda s: model + 0.15 * s["n"] / F.greatest(s["words"], F.lit(1)) + 5.0 * s["n"] / s["length"], n=hits(words, F.lower(text)), words=F.size(words), length=length)


def route(distance: Column, boundary: float = 0.85) -> Column:
    """chat beyond the boundary, else knowledge; the boundary itself is knowledge."""
    return F.when(distance.isNull() | (distance > boundary), "chat").otherwise("rag")


def effective_top_k(question: Column, hybrid_mode: Column, base: int = 5, detail: int = 8, deep: int = 10) -> Column:
    """L7."""
    return F.when(hybrid_mode | F.lower(question).rlike(r"\b(hybrid|deep dive)\b"), max(base, deep)).when(F.lower(question).rlike(fn.DETAIL), max(base, detail)).otherwise(max(1, base))


def fuzzy(question: Column, text: Column) -> Column:
    """Exact, prefix, substring, else a subsequence whose letters score by where they stand; null without a match."""
    q, t = F.lower(fn.strip(question)), F.lower(text)
    at = F.instr(t, q) - 1
    letters = F.split(F.regexp_replace(q, r"\s+", ""), "")
    start = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("last"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        place = F.call_function("locate", c, t, s["last"] + 2) - 1
        edge = (place == 0) | F.substring(t, place, F.lit(1)).rlike(r"[\s._/-]")
        gain = 80 + F.when(edge, 35).otherwise(0) + F.when(place == s["last"] + 1, 45).otherwise(0) - 0.5 * place
        return F.struct((s["score"] + F.when(place >= 0, gain).otherwise(0.0)).alias("score"), F.when(place >= 0, place).otherwise(s["last"]).alias("last"), (s["ok"] & (place >= 0)).alias("ok"))

    walk = F.aggregate(F.filter(letters, lambda c: c != ""), start, step)
    loose = F.when(walk["ok"], walk["score"] - 0.1 * F.length(t))
    score = F.when(q == "", F.lit(0.0)).when(t == q, F.lit(10000.0)).when(at == 0, 8000.0 - F.length(t)).when(at > 0, 6500.0 - 8 * at - F.length(t)).otherwise(loose)
    return F.when(score >= 0, score)


def grounding(terms: Column, text: Column) -> Column:
    """How many of the terms the text contains."""
    return hits(terms, F.lower(text))


def turn_checks(response: Column, intent: Column, sources: Column, error: Column, spec: Column) -> Column:
    """An array of (name, about, passed) for an answer.

    spec: a struct of arrays expected_intents, expected_sources, forbidden_sources, required_terms, forbidden_terms, of which a null one asks for nothing.  Terms
    are looked for in lower case; an answer is too short below 40 characters, in chat below 10.  A null response is empty, nulls in sources are none.
    """

    def check(name: str, about: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), about.cast("string").alias("about"), F.coalesce(passed, F.lit(False)).alias("passed"))

    def checks(s: Column) -> Column:
        def each(name: str, field: str, passed) -> Column:
            return F.transform(F.coalesce(s["spec"][field], F.array().cast("array<string>")), lambda x: check(name, x, passed(x)))

        wanted = F.array_compact(F.coalesce(s["spec"]["expected_intents"], F.array().cast("array<string>")))
        intent_check = F.array(check("expected_intent", s["intent"], F.array_contains(wanted, F.coalesce(s["intent"], F.lit("?")))))
        least = F.when(s["intent"] == "chat", 10).otherwise(40)
        return F.concat(
            F.array(check("no_stream_error", s["error"], F.coalesce(s["error"], F.lit("")) == ""), check("non_empty_answer", s["length"], s["length"] >= least)),
            F.when(F.size(wanted) > 0, intent_check).otherwise(F.slice(intent_check, 1, 0)),
            each("expected_source", "expected_sources", lambda x: F.array_contains(s["files"], x)), each("forbidden_source_absent", "forbidden_sources", lambda x: ~F.array_contains(s["files"], x)),
            each("required_term", "required_terms", lambda x: F.contains(s["low"], F.lower(x))), each("forbidden_term_absent", "forbidden_terms", lambda x: ~F.contains(s["low"], F.lower(x))),
        )

    said = F.coalesce(response, F.lit(""))
    return fn.bound(checks, low=F.lower(said), length=F.length(F.regexp_replace(said, r"^\s+|\s+$", "")), intent=intent, files=F.array_compact(F.coalesce(sources, F.array().cast("array<string>"))), error=error, spec=spec)
