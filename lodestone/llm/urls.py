"""URL filters: fixed rules of host and path, and rules mined from labels with FP-growth.

A url is a set of tokens: its host, domain and top domain, the parts of its path and the keys of its query, digits as one
zero.  Labelled pages (``page_id`` is the ``doc_id`` of a label) with quality 0 or toxic 1 are blocked, and are the transactions
of Spark's FP-growth, which finds the token combinations that many of them have.  Each is counted again over the
whole token sets of all labelled pages, and is a rule if its support and its confidence (the share that is blocked) reach the
bounds and no part of it is as confident.  A combination fits a url that has all its tokens.  Rules are looked up by an inverted index: each is filed
under that of its tokens that the fewest rules have, and the tokens of a url fetch those that may fit.  A url is blocked if one fits.

Fixed rules come first: one fits its host and all subdomains of it if the path starts with the rule's; of several the longest.

FP-growth's cost is exponential in a transaction's tokens, so Spark's is given the ``WIDTH`` of a page that are blocked most often.  If a page has
more that are frequent, the combinations beyond those are grown as well: of each token, which is the rarest of its combinations, the commoner tokens
beside it are a conditional table, a group of a shuffle, with equal rows counted once.  A combination that holds on the same pages as a part of it, or has
a part that is blocked on all its pages, is no rule and nor is what contains it, so those are not grown further; all others are, over all rows.
What comes to the driver and goes to each task are the rules.

Defined cases: a null url, or one without ``://``, has an empty host and path and no tokens, fits no rule and is allowed; a null page_id has no label; of
labels that repeat a doc_id one that blocks is enough; repeated pages each count; without blocked labels nothing is mined and
all but the fixed rules' urls are allowed; of other columns none is read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: Share of the labelled pages, and number of them, that a combination needs among the blocked; share of those with it that are blocked.
SUPPORT, LEAST, CONFIDENCE = 0.005, 5, (8, 10)
WIDTH = 8
#: The contract's rules: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
VERDICT = "rule string, verdict string, because string"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; all empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a url; one of more than 64 characters is its digest."""
    host, path, query = parts(url)
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    whole = F.array(
        F.when(host != "", F.concat(F.lit("host="), host)),
        F.when(host.contains("."), F.concat(F.lit("domain="), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1))),
        F.when(host != "", F.concat(F.lit("top="), F.regexp_extract(host, r"([^.]*)$", 1))),
    )
    dirs = F.transform(F.array_remove(F.split(path, "/"), ""), lambda x: F.concat(F.lit("dir="), plain(x)))
    keys = F.transform(F.array_remove(F.split(query, "&"), ""), lambda x: F.concat(F.lit("key="), plain(F.regexp_extract(x, "^([^=]*)", 1))))
    found = F.array_distinct(F.concat(F.array_compact(whole), dirs, keys))
    return F.transform(found, lambda t: F.when(F.length(t) > 64, F.concat(F.lit("md5="), F.md5(t.cast("binary")))).otherwise(t))


Row = tuple[frozenset[str], int, int]


def pruned(counts: Iterable[Row], least: int, confidence: tuple[int, int]) -> list[Row]:
    """Of combinations with their pages and blocked pages those that are frequent and confident, without those that a part of does as well."""
    fit = {items: (n, blocked) for items, n, blocked in counts if blocked >= least and blocked * confidence[1] >= n * confidence[0]}

    index = Rules((items, *v) for items, v in fit.items())

    def idle(items: frozenset[str]) -> bool:
        n, blocked = fit[items]
        less = (index.rows[k] for k in index.fitting(items))
        return any(len(part) < len(items) and b * n >= blocked * m for part, m, b in less)

    return [(items, *v) for items, v in fit.items() if not idle(items)]


class Rules:
    """Mined rules: tokens, how many labelled pages have them all, and how many of those are blocked; an inverted index over them."""

    def __init__(self, rows: Iterable[Row] = ()):
        self.rows = sorted(rows, key=lambda r: (-r[2] / r[1], -r[2], " ".join(sorted(r[0]))))  # the best first
        shared = Counter(t for items, _, _ in self.rows for t in items)
        self.filed: dict[str, list[int]] = {}
        for k, (items, _, _) in enumerate(self.rows):
            self.filed.setdefault(min(items, key=lambda t: (shared[t], t)), []).append(k)

    def fitting(self, found: Iterable[str]) -> list[int]:
        """The numbers of all rules that fit a set of tokens."""
        found = set(found)
        return sorted(k for t in found for k in self.filed.get(t, ()) if self.rows[k][0] <= found)

    def name(self, k: int) -> str:
        return " ".join(sorted(self.rows[k][0]))


class HostRules:
    """Fixed rules, by host."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        self.lengths = sorted({len(h) for h in self.by_host})

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """Name and verdict of the longest rule that fits."""
        best = None
        for size in self.lengths:
            if size < len(host) and host[-size - 1] != "." or size > len(host):
                continue
            tail = host[len(host) - size :]
            for start, verdict in self.by_host.get(tail, ()):
                if path.startswith(start) and (best is None or len(tail + start) > len(best[0])):
                    best = tail + start, verdict
        return best


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: tuple[int, int] = CONFIDENCE) -> Rules:
    """Rules from the urls of labelled pages."""
    scratch = Scratch()
    blocks = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1, F.lit(False))
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(blocks).alias("blocked"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), tokens(F.col("url").cast("string")).alias("tokens"))
    rows = urls.join(judged, F.col("page_id") == F.col("labelled")).select("tokens", "blocked", F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows, "url-labelled")
    try:
        n, blocked = rows.agg(F.count("*"), F.count_if("blocked")).first()
        enough = max(least, math.ceil(n * support))
        if blocked < enough:
            return Rules()
        single = rows.select("row", "blocked", F.explode("tokens").alias("token"))
        shares = single.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits")).where(F.col("hits") >= enough)
        shares = scratch.keep(shares, "url-tokens")
        telling = Window.partitionBy("row").orderBy((F.col("hits") / F.col("n")).desc(), F.col("n").desc(), "token")
        # Spark looks at the size of the written table of tokens before it broadcasts it, and deals out common tokens anew otherwise
        ranked = single.where("blocked").join(shares, "token").withColumn("place", F.row_number().over(telling)).where(F.col("place") <= WIDTH + 1)
        ranked = scratch.keep(ranked.select("row", "token", "place"), "url-places")
        best = ranked.where(F.col("place") <= WIDTH)
        baskets = scratch.keep(best.groupBy("row").agg(F.collect_list("token").alias("items")).select("items"), "url-baskets")
        size = baskets.count()
        if not size:
            return Rules()
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (enough - 0.5) / size), minConfidence=1.0).fit(baskets)
        found = Rules((frozenset(r["items"]), 1, 1) for r in model.freqItemsets.select("items").collect())
        few = counted(rows, found, enough, confidence)
        if ranked.where(F.col("place") == WIDTH + 1).isEmpty():
            return few
        rest = grown(single.join(shares.select("token", F.col("n").alias("often")), "token"), enough, confidence)
        return Rules(pruned([*few.rows, *((frozenset(r["items"]), r["n"], r["hits"]) for r in rest.collect())], enough, confidence))
    finally:
        scratch.drop()


def grow(table: pd.DataFrame, least: int, confidence: tuple[int, int]) -> list[tuple[list[str], int, int]]:
    """The confident combinations of a conditional table (token, items, n, hits) that have its token, with their pages and blocked pages."""
    n, hits = table["n"].to_numpy(), table["hits"].to_numpy()
    rows: dict[str, list[int]] = {}
    for k, items in enumerate(table["items"]):
        for t in items:
            rows.setdefault(t, []).append(k)
    every, out = np.arange(len(table)), []
    # what is chosen, its rows, and the items that may be added, each with the rows that then are left
    todo = [([table["token"].iloc[0]], every, [(t, np.array(at)) for t, at in sorted(rows.items())])]
    while todo:
        chosen, at, more = todo.pop()
        total, blocked = int(n[at].sum()), int(hits[at].sum())
        if blocked * confidence[1] >= total * confidence[0]:
            out.append((chosen, total, blocked))
        if blocked == total:
            continue
        more = [(t, left) for t, left in more if hits[left].sum() >= least and n[left].sum() < total]
        for k, (t, left) in enumerate(more):
            both = [(u, np.intersect1d(left, other, assume_unique=True)) for u, other in more[k + 1 :]]
            todo.append(([*chosen, t], left, [(u, x) for (u, x), (_, other) in zip(both, more[k + 1 :]) if len(x) < len(other)]))
    return out


def grown(single: DataFrame, least: int, confidence: tuple[int, int]) -> DataFrame:
    """items, n, hits of all confident combinations; single: row, blocked, token and how often the token is there, frequent tokens only."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("often")).alias("o"), "token")))  # the commonest first
    pages = single.groupBy("row").agg(order.alias("o"), F.first("blocked").alias("blocked")).select(F.col("o.token").alias("tokens"), "blocked")
    each = pages.select("tokens", "blocked", F.posexplode("tokens").alias("at", "token"))
    tables = each.groupBy("token", F.slice("tokens", F.lit(1), F.col("at")).alias("items")).agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits"))

    def confident(table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(grow(table, least, confidence), columns=["items", "n", "hits"])

    return tables.groupBy("token").applyInPandas(confident, "items array<string>, n long, hits long")


def counted(rows: DataFrame, found: Rules, least: int, confidence: tuple[int, int]) -> Rules:
    """``found`` with the numbers of all labelled pages, pruned by them."""

    @F.pandas_udf("array<int>")
    def fits(column: pd.Series) -> pd.Series:
        return pd.Series([found.fitting(x) for x in column], dtype=object)

    sums = rows.select("blocked", F.explode(fits("tokens")).alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits"))
    return Rules(pruned(((found.rows[r["k"]][0], r["n"], r["hits"]) for r in sums.collect()), least, confidence))


def judge(pages: DataFrame, mined: Rules, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, because (the tokens of the best mined rule that fits, where no fixed one does)."""
    fixed = HostRules(rules)

    @F.pandas_udf(VERDICT)
    def verdicts(host: pd.Series, path: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for h, p, t in zip(host, path, found):
            own = fixed.longest(h, p)
            fit = mined.fitting(t) if own is None else ()
            out.append((*own, None) if own else (None, "block", mined.name(fit[0])) if fit else (None, "allow", None))
        return pd.DataFrame(out, columns=["rule", "verdict", "because"])

    url = F.col("url").cast("string")
    host, path, _ = parts(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), tokens(url).alias("tokens"))
    return rows.withColumn("v", verdicts("host", "path", "tokens")).select("page_id", "host", "path", "v.rule", "v.verdict", "v.because")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return judge(pages, mine(pages, labels), rules)
