"""SC10: pages of placed blocks as markdown, with the tables that their places show.

Blocks whose vertical extents overlap by half are a line.  Ruled tables: rules that touch are one table, the places of its vertical and horizontal
rules, those that are close taken as one, are the edges of columns and rows, and a block is in the cell that has its middle.  Unruled tables: lines in
a row whose blocks, laid over each other, leave the same gaps and share an edge or the middle of their column, at least two columns in each; a line that does not ends the table.  What is
in no table is a paragraph a block, from top to bottom, then left to right.  A page's blocks come together in one row; pages of a document do not.

Defined cases: blank and null texts are left out, and pages without any other; blocks without a place come first, as paragraphs in their order; a table of one
row or one column is no table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.sources.office import pipe_table

#: Gap that parts two columns, and what edges of one rule may be apart, in the units of the page.
GAP, CLOSE = 6.0, 3.0
Box = tuple[float, float, float, float, str]  # left, top, right, bottom, text


def clusters(values: list[float], close: float) -> list[float]:
    """Middles of values that follow each other at ``close`` at most."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][-1] <= close:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(c) / len(c) for c in out]


def text_lines(boxes: list[Box]) -> list[list[Box]]:
    """Blocks by line, each from left to right."""
    out: list[list[Box]] = []
    top = bottom = 0.0
    for b in sorted(boxes, key=lambda b: (b[1] + b[3], b[0])):
        if out and b[1] == top < bottom == b[3]:
            out[-1].append(b)
            continue
        overlap = min(bottom, b[3]) - max(top, b[1])
        if out and overlap > 0 and overlap >= 0.5 * min(bottom - top, b[3] - b[1]):
            out[-1].append(b)
            top, bottom = min(top, b[1]), max(bottom, b[3])
        else:
            out.append([b])
            top, bottom = b[1], b[3]
    return [sorted(line) for line in out]


def spread(spans: list[tuple[float, float]], gap: float) -> list[tuple[float, float]]:
    """Stretches that are covered, those less than ``gap`` apart as one."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] < gap:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def matrix(lines: list[list[Box]], columns: list[tuple[float, float]]) -> list[list[str]]:
    """Texts by line and column; several in one cell follow each other."""
    rows = []
    for line in lines:
        row, k = [""] * len(columns), 0
        for b in line:  # from left to right, as the columns are
            while not (columns[k][0] <= b[0] and b[2] <= columns[k][1]):
                k += 1
            row[k] = f"{row[k]} {b[4]}".strip() if row[k] else b[4].strip()
        rows.append(row)
    return rows


def aligned(line: list[Box], columns: list[tuple[float, float]], close: float) -> bool:
    """Whether each block that stands over a column shares its left, right or middle."""
    over = ((b, c) for b in line for c in columns if b[0] < c[1] and c[0] < b[2])
    return all(min(abs(b[0] - c[0]), abs(b[2] - c[1]), abs((b[0] + b[2]) - (c[0] + c[1])) / 2) <= close for b, c in over)


def unruled(boxes: list[Box], gap: float, close: float) -> tuple[list[tuple[float, str]], list[Box]]:
    """Tables (top, markdown) that lines of blocks show, and the blocks in none."""
    tables, rest, run, columns, known = [], [], [], [], set()

    def end() -> None:
        nonlocal run, columns, known
        if len(run) > 1:
            tables.append((min(b[1] for line in run for b in line), pipe_table(matrix(run, columns))))
        else:
            rest.extend(b for line in run for b in line)
        run, columns, known = [], [], set()

    for line in text_lines(boxes):
        own = [(b[0], b[2]) for b in line]
        if len(own) > 1 and known.issuperset(own) and len(set(own)) == len(own):  # each block as wide as its column
            run.append(line)
            continue
        own = spread(own, gap)
        both = spread([*columns, *own], gap)
        fits = bool(run) and len(own) > 1 and min(len(columns), len(own)) <= len(both) <= max(len(columns), len(own)) and aligned(line, columns, close)
        if not fits:
            end()
            both = own
        if len(own) > 1:
            run.append(line)
            columns, known = both, set(both)
        else:
            rest.extend(line)
    end()
    return tables, rest


def ruled(boxes: list[Box], rules: list[tuple[float, float, float, float]], close: float) -> tuple[list[tuple[float, str]], list[Box]]:
    """Tables (top, markdown) between rules, and the blocks in none."""
    groups: list[list[tuple[float, float, float, float]]] = []
    for r in rules:
        touching = [g for g in groups if any(r[0] <= o[2] + close and o[0] <= r[2] + close and r[1] <= o[3] + close and o[1] <= r[3] + close for o in g)]
        groups = [g for g in groups if g not in touching] + [[r, *(o for g in touching for o in g)]]
    tables, rest = [], list(boxes)
    for group in groups:
        xs = clusters([x for r in group if r[3] - r[1] > r[2] - r[0] for x in [(r[0] + r[2]) / 2]], close)
        ys = clusters([y for r in group if r[2] - r[0] >= r[3] - r[1] for y in [(r[1] + r[3]) / 2]], close)
        if len(xs) < 3 or len(ys) < 3:
            continue
        cells: dict[tuple[int, int], list[Box]] = {}
        for b in rest:
            x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
            if xs[0] <= x <= xs[-1] and ys[0] <= y <= ys[-1]:
                cells.setdefault((sum(e < y for e in ys[1:-1]), sum(e < x for e in xs[1:-1])), []).append(b)
        inside = {id(b) for c in cells.values() for b in c}
        rest = [b for b in rest if id(b) not in inside]
        said = {at: " ".join(b[4] for line in text_lines(c) for b in line) for at, c in cells.items()}
        if said:
            tables.append((ys[0], pipe_table([[said.get((r, c), "") for c in range(len(xs) - 1)] for r in range(len(ys) - 1)])))
    return tables, rest


def page_markdown(boxes: list[Box], rules: list[tuple[float, float, float, float]], gap: float = GAP, close: float = CLOSE) -> list[str]:
    """Tables and paragraphs of a page, in reading order."""
    lined, rest = ruled(boxes, rules, close)
    plain, rest = unruled(rest, gap, close)
    items = [(y, 0.0, t) for y, t in [*lined, *plain]] + [(b[1], b[0], b[4]) for b in rest]
    return [t for _, _, t in sorted(items, key=lambda i: (round(i[0], 1), round(i[1], 1)))]


def layout_tables(blocks: DataFrame, key: str, page: str, order: str, text: str, rules: DataFrame | None = None, gap: float = GAP, close: float = CLOSE) -> DataFrame:
    """key, page, markdown: a row a page, under its anchor and heading.

    blocks: ``key``, ``page``, ``order``, ``text`` and left, top, right, bottom; rules: ``key``, ``page`` and the same four.
    """

    def lists(column: pa.Array) -> Iterator[list[tuple]]:
        """The structs of each row as tuples of their fields."""
        inner = column.flatten()
        flat = list(zip(*(f.to_pylist() if f.null_count else f.to_numpy(zero_copy_only=False).tolist() for f in inner.flatten()))) if len(inner) else []
        ends = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).cumsum().tolist()
        return (flat[start:end] for start, end in zip([0, *ends], ends))

    @F.arrow_udf(StringType())
    def drawn(found: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for some, drawn_ in zip(lists(found), lists(lines)):
            some.sort(key=itemgetter(0))
            placed = [b[2:] + b[1:2] for b in some if None not in b[2:]]
            loose = [b[1] for b in some if None in b[2:]]
            out.append("\n\n".join([*loose, *page_markdown(placed, drawn_, gap, close)]))
        return pa.array(out, pa.string())

    sides = [F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")]
    pages = blocks.where(F.trim(text) != "").groupBy(key, page).agg(F.collect_list(F.struct(F.col(order).alias("order"), F.trim(text).alias("text"), *sides)).alias("_b"))
    kind = "array<struct<left: double, top: double, right: double, bottom: double>>"
    if rules is None:
        pages = pages.withColumn("_r", F.lit(None).cast(kind))
    else:
        drawn_rules = rules.groupBy(F.col(key).alias("_key"), F.col(page).alias("_page")).agg(F.collect_list(F.struct(*sides)).alias("_r"))
        pages = pages.join(drawn_rules, pages[key].eqNullSafe(F.col("_key")) & pages[page].eqNullSafe(F.col("_page")), "left")
    number = F.col(page).cast("string")
    head = F.concat(F.lit("<!-- page:"), number, F.lit(" -->\n\n## Page "), number, F.lit("\n\n"))
    return pages.select(key, page, F.concat(head, drawn("_b", "_r")).alias("markdown"))
