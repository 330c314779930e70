"""Filters, joins and keyed mutations of the warehouse tables, as lazy DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$in": lambda c, v: c.isin(list(v)),
}


def where(clause: Mapping | None) -> Column:
    """F8: a metadata predicate such as {"$and": [{"label": 3}, {"n": {"$lt": 2}}]} as a column; none is true."""
    parts = []
    for key, value in (clause or {}).items():
        if key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, [where(x) for x in value]))
        elif isinstance(value, Mapping):
            parts += [_COMPARE[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_list(column: str, wanted: str) -> Column:
    """membership in a comma-separated list; blanks are dropped, an empty list does not filter."""
    items = [x.strip() for x in wanted.split(",") if x.strip()]
    return F.col(column).isin(items) if items else F.lit(True)


def like_any(columns: Sequence[str], term: str) -> Column:
    """case-insensitive LIKE over several columns; % and _ in the term are wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).ilike(f"%{term}%") for c in columns])


def contains_any(columns: Sequence[str], term: str) -> Column:
    """literal substring search in lower case over several columns."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.lower())) for c in columns])


def first_present(*columns: str) -> Column:
    """the first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """L1: one page of an ordered list; ``order`` must end in a unique key."""
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)


def page_with_total(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """L1, L4: a page whose rows carry the true number of matches."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return page(df, order, number, size).crossJoin(F.broadcast(total))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """SK5: insert or update by key; columns in ``keep_first`` keep what is there (the earliest opening time)."""
    a, b = current.alias("a"), changes.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    out = []
    for c in current.columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}") if c in changes.columns else F.lit(None)
        out.append((F.coalesce(old, new) if c in keep_first else F.coalesce(new, old)).alias(c))
    return a.join(b, on, "full_outer").select(*out)


def insert_or_ignore(current: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SK6: only rows whose key is new."""
    return current.unionByName(rows.join(current, list(keys), "left_anti").select(*current.columns))


def replace_by_key(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """SK4: all rows of the keys in ``rows`` are replaced by ``rows``."""
    return current.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def delete_where(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SK2: rows without the keys of a delete set."""
    return current.join(gone.select(key).distinct(), key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """SK10: the children whose parent survives."""
    return children.join(parents.select(key), key, "left_semi")


def cancel_jobs(jobs: DataFrame, chosen: Column) -> DataFrame:
    """SK7: open jobs of the chosen become CANCELLED; all of them carry the request."""
    return jobs.withColumns({
        "status": F.when(chosen & F.col("status").isin("QUEUED", "RUNNING"), "CANCELLED").otherwise(F.col("status")),
        "cancel_requested": F.when(chosen, 1).otherwise(F.col("cancel_requested")),
    })


def transitions(rows: DataFrame, commands: DataFrame, rules: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """SK16, SK17: commands (key, action) applied by rules (action, from_status, to_status); and the rejected ones."""
    asked = commands.join(rows.select(key, "status"), key, "left")
    rule = F.broadcast(rules)  # a fixed table of a few rows
    done = asked.join(rule, (asked["action"] == rule["action"]) & (asked["status"] == rule["from_status"])).select(asked[key], asked["action"], "status", "to_status")
    refused = asked.join(rule, (asked["action"] == rule["action"]) & (asked["status"] == rule["from_status"]), "left_anti")
    return done, refused


def overlay(defaults: Mapping[str, object], overrides: Mapping[str, str]) -> list[Column]:
    """each default, overlaid by the column that overrides it where that is not null."""
    return [F.coalesce(F.col(overrides[k]), F.lit(v)).alias(k) if k in overrides else F.lit(v).alias(k) for k, v in defaults.items()]


def exact_else_newest(rows: DataFrame, runs: DataFrame, name: str, path: str, age: str, value: str) -> DataFrame:
    """A lookup by (name, path), else the name's newest entry."""
    exact = runs.groupBy(F.col(name).alias("_n"), F.col(path).alias("_p")).agg(F.max_by(value, age).alias("_exact"))
    newest = runs.groupBy(F.col(name).alias("_m")).agg(F.max_by(value, F.struct(age, path)).alias("_newest"))
    joined = rows.join(exact, (rows[name] == exact["_n"]) & (rows[path] == exact["_p"]), "left").join(newest, rows[name] == newest["_m"], "left")
    return joined.withColumn(value, F.coalesce("_exact", "_newest")).drop("_n", "_p", "_m", "_exact", "_newest")


def nested(parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children."""
    kids = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    return parents.join(kids, key, "left")


def resolve_by_rank(rows: DataFrame, keys: Sequence[str], rank: Column, *tie: Column) -> DataFrame:
    """Of each key the row of the lowest rank (ranks above zero only)."""
    best = Window.partitionBy(*keys).orderBy("_rank", *tie)
    return rows.withColumn("_rank", rank).where("_rank > 0").withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth", "_rank")


def capped(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """L2: the first rows of a list, with the number of rows returned as the total."""
    rows = df.orderBy(*order).limit(most)
    return rows.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1))))  # at most ``most`` rows


def partial_update(rows: DataFrame, changes: DataFrame, key: str, given: Mapping[str, Column]) -> DataFrame:
    """SK8: of rows that ``changes`` names, the columns in ``given`` take its value; others stay, as do rows not named.

    The expressions see the row as ``old`` and the change as ``new``; a change that says nothing of a column returns ``old``'s value.
    """
    new = changes.select(F.col(key).alias("_key"), F.struct(*changes.columns).alias("new"))
    joined = rows.select(F.col(key).alias("_own"), F.struct(*rows.columns).alias("old")).join(new, F.col("_own") == F.col("_key"), "left")
    return joined.select(*(F.when(F.col("_key").isNotNull(), given[c]).otherwise(F.col("old")[c]).alias(c) if c in given else F.col("old")[c].alias(c) for c in rows.columns))


def set_status(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """SK8: status with its rules: an error stays only where the new status ends in _FAILED, counts only change where they are given."""
    error = F.when(F.col("new.error_summary").isNotNull(), F.col("new.error_summary")).when(F.col("new.status").endswith("_FAILED"), F.col("old.error_summary"))
    return partial_update(rows, changes, key, {"status": F.col("new.status"), "error_summary": error, "chunk_count": F.coalesce("new.chunk_count", "old.chunk_count")})


def sessions(messages: DataFrame, user: str) -> DataFrame:
    """SC13: sessions of each user, the one that was said something in last first."""
    found = messages.groupBy(user, "session_id").agg(F.count("*").alias("messages"), F.max("id").alias("last_id"))
    return found.withColumn("position", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("last_id"), "session_id")))


def history(messages: DataFrame, json: str, schema: str) -> DataFrame:
    """SC13: messages of each session in order; JSON that does not parse is an empty value, not an error."""
    order = Window.partitionBy("session_id").orderBy("id")
    return messages.withColumns({"position": F.row_number().over(order), json: F.coalesce(F.from_json(F.col(json), schema), F.from_json(F.lit("{}"), schema))})


def including(df: DataFrame, key: str, include: Sequence[str]) -> DataFrame:
    """SC8: the key and what is asked for; other columns are not read."""
    return df.select(key, *(c for c in include if c in df.columns))


def overlaid(base: Column, over: Column, without: Sequence[str] = ()) -> Column:
    """Two maps, the second's values first; keys in ``without`` are left out."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return F.map_filter(F.map_concat(kept, over), lambda k, v: ~k.isin(*without) if without else F.lit(True))
