"""Text scalars as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9][a-z0-9&./-]*"
ACRONYM = r"\b[A-Z][A-Z0-9&/-]{1,7}\b"
#: Words that say nothing about a topic; a parameter of the functions below.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "which", "who", "with")

GREETING = r"^\s*(hi|hello|hey|good (morning|afternoon|evening)|thanks|thank you)\b"
DETAIL = r"\b(in detail|detailed|comprehensive|in depth|elaborate|step by step)\b"
OVERVIEW = r"\b(about|overview|summary|summari[sz]e|purpose|scope)\b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """All white space off both ends; Spark's trim takes spaces only unless told."""
    return F.btrim(col(c), F.lit(" \t\n\u000b\f\r"))


def bound(f: Callable[[Column], Column], **columns: Column) -> Column:
    """``f`` of a struct of ``columns`` that is evaluated once; an expression used in a lambda is evaluated at each call of it."""
    return F.transform(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))), f)[0]


def collapse(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"\s+", " "))


def tokens(c: Column | str, longer_than: int = 0, stop: Sequence[str] = ()) -> Column:
    """Lower-case tokens in order, repeats kept."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))
    if longer_than:
        found = F.filter(found, lambda x: F.length(x) > longer_than)
    return F.filter(found, lambda x: ~x.isin(*stop)) if stop else found


def keyword_query(c: Column | str, stop: Sequence[str] = STOP, most: int = 12) -> Column:
    """The first distinct tokens that are not stop words, as a query."""
    return F.array_join(F.slice(F.array_distinct(tokens(c, 2, stop)), 1, most), " ")


def estimated_tokens(c: Column | str) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(col(c)) / 4).cast("long")


def word_count(c: Column | str) -> Column:
    """Unicode words."""
    return F.regexp_count(col(c), F.lit(r"(?U)\w+"))


def slug(c: Column | str, gap: str = "_") -> Column:
    """Lower case, runs of other characters as one gap, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", gap), f"^{gap}+|{gap}+$", "")


def base_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"([^/\\]*)$", 1)


def safe_name(c: Column | str) -> Column:
    """Characters that file systems dislike as underscores."""
    return F.regexp_replace(base_name(c), r"[^A-Za-z0-9._ -]+", "_")


def anchor_slug(c: Column | str) -> Column:
    """A heading's anchor."""
    return F.regexp_replace(strip(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s-]", "")), r"\s+", "-")


def plain(c: Column | str) -> Column:
    """Tags and emphasis off, breaks and white space as single spaces, common entities decoded."""
    text = F.regexp_replace(col(c), r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\*\*|~~", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def shortened(c: Column | str, most: int) -> Column:
    """At most ``most`` characters, cut at the last space."""
    c = col(c)
    cut = F.regexp_extract(F.substring(c, 1, most + 1), r"(?s)^(.*)\s", 1)
    return F.when(F.length(c) <= most, c).otherwise(F.when(cut != "", cut).otherwise(F.substring(c, 1, most)))


def replaced(c: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, in order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def envelope(doc: Column, section: Column, text: Column) -> Column:
    """A passage with its origin."""
    return F.concat(F.lit("[Source: "), doc, F.lit(" | Section: "), F.coalesce(section, F.lit("Root")), F.lit("]\n"), text)


def relabelled(c: Column | str, name: Column) -> Column:
    """A leading [Doc: old | ...] label with another name."""
    c = col(c)
    rest = F.regexp_extract(c, r"(?s)^\[Doc: [^|\]]*(.*)$", 1)
    spaced = F.when(F.startswith(rest, F.lit("|")), F.concat(F.lit(" "), rest)).otherwise(rest)
    return F.when(c.rlike(r"^\[Doc: "), F.concat(F.lit("[Doc: "), name, spaced)).otherwise(c)


def source_name(c: Column | str) -> Column:
    """The file that a passage's envelope names."""
    return strip(F.regexp_extract(col(c), r"(?:Source|Q&A):\s*([^|\]\n]+)", 1))


def session_title(c: Column | str, stop: Sequence[str] = STOP) -> Column:
    """The first five distinct words that are not stop words, capitalised, at most 60 characters; else New Chat."""
    words = F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: ~x.isin(*stop) & (F.length(x) > 1))), 1, 5)
    title = F.substring(F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100))), " "), 1, 60)
    return F.when(col(c).rlike(f"(?i){GREETING}") | (title == ""), "New Chat").otherwise(title)


def intent(c: Column | str, chat_words: Sequence[str], source_words: Sequence[str]) -> Column:
    """Chat for greetings and chat words, rag for source words, else open; first rule that holds."""

    def any_word(words: Sequence[str]) -> Column:
        return col(c).rlike(r"(?i)\b(" + "|".join(words) + r")\b")

    return F.when(col(c).rlike(f"(?i){GREETING}"), "greeting").when(any_word(source_words), "rag").when(any_word(chat_words), "chat").otherwise("open")


def acronyms(c: Column | str, stop: Sequence[str] = ()) -> Column:
    """Distinct acronyms in lower case."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(ACRONYM), F.lit(0)), F.lower))
    return F.filter(found, lambda x: ~x.isin(*stop)) if stop else found


def has_word(text: Column, word: Column) -> Column:
    """F: ``word`` in ``text`` with no letter or digit beside it; the text is padded, so no expression is compiled a row."""
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))


def compact_status(c: Column | str) -> Column:
    """PARSE_FAILED as Parse Failed."""
    return F.initcap(F.replace(F.lower(col(c)), F.lit("_"), F.lit(" ")))


def status_tone(c: Column | str) -> Column:
    """First rule that holds."""
    s = F.upper(col(c))
    return (
        F.when(s.rlike("FAILED|REJECTED|CANCELLED|ERROR"), "danger").when(s.rlike("COMPLETE|INDEXED|APPROVED"), "success")
        .when(s.rlike("RUNNING|PARSING|CHUNKING|NORMALIZING"), "active").when(s.rlike("PENDING|REVIEW|QUEUED"), "warning").otherwise("neutral")
    )


def human_bytes(c: Column | str) -> Column:
    """A size in B, KB, MB or GB with one decimal beyond bytes."""
    c = col(c).cast("double")
    out = F.concat(c.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        scaled = F.concat(F.format_string("%.1f", F.floor(c / (1024.0**power) * 10 + 0.5) / 10), F.lit(f" {unit}"))
        out = F.when(c >= 1024.0**power, scaled).otherwise(out)
    return out


def model_matches(a: Column, b: Column) -> Column:
    """equal, or equal before the first colon."""
    return (a == b) | (F.split_part(a, F.lit(":"), F.lit(1)) == F.split_part(b, F.lit(":"), F.lit(1)))


def as_bool(c: Column | str) -> Column:
    """F17."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "on"), F.lit(False))


def mapped(c: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """a lookup in a fixed table."""
    return F.coalesce(reduce(lambda x, kv: x.when(c == kv[0], kv[1]), list(table.items())[1:], F.when(c == next(iter(table)), table[next(iter(table))])), F.lit(default))
