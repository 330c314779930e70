"""SC9: Word, PowerPoint, Excel and HTML files as markdown: headings, lists, tables with merged cells.

``Office`` is a Python data source (format ``office``): files below a path, a partition a group of them by size.  ``office_markdown`` takes
contents that Spark has read itself (format ``binaryFile``), for stores that only Spark reaches.  XML is read as a stream and dropped as it is used; of a file only
its shared strings and the sheet, slide or table at hand are held.

Rules: blocks are apart by a blank line; a heading has as many # as its level; list items are indented by two spaces a level, with their
number where the list counts; a merged cell's text stands in each place that it covers; a cell's white space is single; empty rows are dropped and
rows padded to the widest.  A sheet begins with its name as a heading, a slide with its title.  A file that cannot be read gives an ``error`` and no text.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any
from xml.etree.ElementTree import Element, iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, markdown string, error string"
EXTENSIONS = (".docx", ".pptx", ".xlsx", ".html", ".htm")
#: Bytes of files in a partition, about.
GROUP = 32 << 20
COUNTING = {"decimal", "decimalZero", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "ordinal"}


def local(tag: str) -> str:
    """A tag or attribute without its name space."""
    return tag.rsplit("}", 1)[-1]


def attribute(x: Element | None, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    return default if x is None else next((v for k, v in x.attrib.items() if local(k) == name), default)


def child(x: Element | None, *names: str) -> Element | None:
    """The first descendant along a way of local names."""
    for name in names:
        x = None if x is None else next((c for c in x if local(c.tag) == name), None)
    return x


def flat(text: str) -> str:
    return " ".join(text.split())


def pipe_table(rows: list[list[str]]) -> str:
    """SC11's pipe table of a matrix."""
    rows = [r for r in ([flat(c) for c in row] for row in rows) if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class Grid:
    """Cells that may cover several columns and rows, put in their places."""

    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.covered: dict[int, tuple[int, str]] = {}  # columns of this row that a cell above covers: for how many rows, and its text
        self.coming: dict[int, tuple[int, str]] = {}  # those of the next row

    def start(self) -> None:
        self.end()
        self.rows.append([])
        self.covered, self.coming = self.coming, {}

    def take(self, column: int) -> None:
        left, text = self.covered.pop(column)
        if left > 1:
            self.coming[column] = left - 1, text
        row = self.rows[-1]
        row.extend([""] * (column - len(row)) + [text])

    def cell(self, text: str, across: int = 1, down: int = 1) -> None:
        if not self.rows:
            self.start()
        row = self.rows[-1]
        for _ in range(max(1, min(across, 1000))):
            while len(row) in self.covered:
                self.take(len(row))
            if down > 1:
                self.coming[len(row)] = down - 1, text
            row.append(text)

    def end(self) -> None:
        """The row is complete; cells above may cover columns beyond its last one."""
        for column in sorted(self.covered):
            self.take(column)


class Package:
    """An office file: a zip of XML parts that refer to each other."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def stream(self, name: str, *tags: str) -> Iterator[Element]:
        """The elements with these local names, complete, and dropped once used; those within another of them come with it only."""
        if name not in self.names:
            return
        with self.zip.open(name) as file:
            depth, parents = 0, []
            for event, x in iterparse(file, ("start", "end")):
                wanted = local(x.tag) in tags
                if event == "start":
                    depth += wanted
                    parents.append(x)
                    continue
                parents.pop()
                depth -= wanted
                if wanted and not depth:
                    yield x
                if not depth and parents:
                    parents[-1].remove(x)

    def links(self, name: str) -> dict[str, str]:
        """What a part refers to by id: other parts, or addresses."""
        folder, file = posixpath.split(name)
        out = {}
        for x in self.stream(f"{folder}/_rels/{file}.rels", "Relationship"):
            target = x.get("Target", "")
            if x.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join(folder, target)) if not target.startswith("/") else target[1:]
            out[x.get("Id", "")] = target
        return out


class Lists:
    """Numbers of list items, by list and level."""

    def __init__(self) -> None:
        self.counts: dict[Any, dict[int, int]] = defaultdict(dict)

    def item(self, list_: Any, level: int, counts: bool, text: str, start: int = 1) -> str:
        seen = self.counts[list_]
        for deeper in [k for k in seen if k > level]:
            del seen[deeper]
        seen[level] = seen.get(level, start - 1) + 1
        return "  " * level + (f"{seen[level]}. " if counts else "- ") + text


def joined(blocks: list[tuple[bool, str]]) -> str:
    """Blocks apart by a blank line; items of lists (first of the pair) in lines that follow."""
    out, before = "", False
    for item, text in blocks:
        if text.strip():
            out += ("\n" if item and before else "\n\n") * bool(out) + text
            before = item
    return out


# Word


def docx_markdown(content: bytes) -> str:
    package = Package(content)
    main = "word/document.xml"
    links = package.links(main)
    levels: dict[str, int] = {}
    for style in package.stream("word/styles.xml", "style"):
        name, id_ = attribute(child(style, "name"), "val", "").lower(), attribute(style, "styleId", "")
        outline, based = attribute(child(style, "pPr", "outlineLvl"), "val"), attribute(child(style, "basedOn"), "val")
        number = re.fullmatch(r"heading (\d)", name)
        if number or outline is not None and int(outline) < 9:
            levels[id_] = int(number[1]) if number else int(outline) + 1
        elif name == "title":
            levels[id_] = 1
        elif based in levels:
            levels[id_] = levels[based]
    abstract, numbering = {}, {}
    for x in package.stream("word/numbering.xml", "abstractNum"):
        abstract[attribute(x, "abstractNumId")] = {int(attribute(v, "ilvl", "0")): (attribute(child(v, "numFmt"), "val"), int(attribute(child(v, "start"), "val", "1"))) for v in x if local(v.tag) == "lvl"}
    for x in package.stream("word/numbering.xml", "num"):
        numbering[attribute(x, "numId")] = abstract.get(attribute(child(x, "abstractNumId"), "val"), {})

    def text_of(x: Element, bold: bool = False) -> str:
        out = []
        for c in x:
            tag = local(c.tag)
            if tag == "t":
                out.append(c.text or "")
            elif tag in ("tab", "ptab"):
                out.append(" ")
            elif tag in ("br", "cr"):
                out.append("\n")
            elif tag == "hyperlink":
                inner, to = text_of(c), links.get(attribute(c, "id", ""))
                out.append(f"[{inner}]({to})" if to and inner else inner)
            elif tag == "r":
                inner, weight = text_of(c), child(c, "rPr", "b")
                strong = weight is not None and attribute(weight, "val", "1") not in ("0", "false") and inner.strip()
                out.append(re.sub(r"^(\s*)(.*?)(\s*)$", r"\1**\2**\3", inner, flags=re.S) if strong and not bold else inner)
            elif tag not in ("pPr", "rPr", "del", "moveFrom", "tbl", "p", "instrText"):
                out.append(text_of(c))
            elif tag == "p":
                out.append(text_of(c) + "\n")
        return "".join(out).replace("****", "")

    def paragraph(p: Element) -> tuple[bool, str]:
        about = child(p, "pPr")
        style, number = attribute(child(about, "pStyle"), "val", ""), child(about, "numPr")
        level = levels.get(style)
        text = text_of(p, level is not None).strip()
        if level is not None and text:
            return False, "#" * min(level, 6) + " " + flat(text)
        list_ = attribute(child(number, "numId"), "val")
        if list_ is not None and list_ != "0" and text:
            depth = int(attribute(child(number, "ilvl"), "val", "0"))
            form, start = numbering.get(list_, {}).get(depth, ("bullet", 1))
            return True, lists.item(list_, depth, form in COUNTING, flat(text), start)
        return False, text

    def table(x: Element) -> str:
        grid, above = [], {}
        for row in (r for r in x.iter() if local(r.tag) == "tr"):
            cells: list[str] = []
            for cell in (c for c in row if local(c.tag) == "tc"):
                about = child(cell, "tcPr")
                across, merge = int(attribute(child(about, "gridSpan"), "val", "1")), child(about, "vMerge")
                at = len(cells)
                text = text_of(cell) if merge is None or attribute(merge, "val", "continue") == "restart" else above.get(at, "")
                above[at] = text
                cells += [text] * across
            grid.append(cells)
        return pipe_table(grid)

    lists, blocks = Lists(), []
    for x in package.stream(main, "p", "tbl"):
        blocks.append((False, table(x)) if local(x.tag) == "tbl" else paragraph(x))
    return joined(blocks)


# PowerPoint


def pptx_markdown(content: bytes) -> str:
    package = Package(content)
    links, out = package.links("ppt/presentation.xml"), []
    order = [links.get(attribute_of(x)) for x in package.stream("ppt/presentation.xml", "sldId")]

    def paragraphs(shape: Element, listed: bool) -> list[tuple[bool, str]]:
        blocks, lists = [], Lists()
        for p in (x for x in shape.iter() if local(x.tag) == "p" and "drawingml" in x.tag):
            text = "".join("\n" if local(t.tag) == "br" else t.text or "" for t in p.iter() if local(t.tag) in ("t", "br")).strip()
            about = child(p, "pPr")
            level = int(attribute(about, "lvl", "0"))
            counts = child(about, "buAutoNum") is not None
            if text and (counts or child(about, "buChar") is not None or listed and child(about, "buNone") is None):
                blocks.append((True, lists.item(counts, level, counts, flat(text), int(attribute(child(about, "buAutoNum"), "startAt", "1")))))
            else:
                blocks.append((False, text))
                lists = Lists()  # numbers begin anew after a paragraph of its own
        return blocks

    for number, name in enumerate(order, 1):
        title, blocks = "", []
        for shape in package.stream(name or "", "sp", "tbl"):
            if local(shape.tag) == "tbl":
                rows: list[list[str]] = []
                for tr in (r for r in shape if local(r.tag) == "tr"):
                    row: list[str] = []
                    for tc in (c for c in tr if local(c.tag) == "tc"):
                        text = "".join(t.text or "" for t in tc.iter() if local(t.tag) == "t")
                        if tc.get("hMerge") in ("1", "true") and row:
                            text = row[-1]
                        elif tc.get("vMerge") in ("1", "true") and rows and len(row) < len(rows[-1]):
                            text = rows[-1][len(row)]
                        row.append(text)
                    rows.append(row)
                blocks.append((False, pipe_table(rows)))
                continue
            place = next((x for x in shape.iter() if local(x.tag) == "ph"), None)
            if place is not None and place.get("type") in ("title", "ctrTitle") and not title:
                title = flat(" ".join(text for _, text in paragraphs(shape, False)))
            elif place is None or place.get("type") not in ("sldNum", "dt", "ftr"):
                blocks += paragraphs(shape, place is not None and place.get("type", "body") in ("body", "obj"))
        out.append((False, joined([(False, f"<!-- slide:{number} -->\n## {title or f'Slide {number}'}"), *blocks])))
    return joined(out)


def attribute_of(x: Element) -> str:
    """A slide's link: its id in the name space of relationships, not its own number."""
    return next((v for k, v in x.attrib.items() if local(k) == "id" and "relationships" in k), "")


# Excel


def column_of(reference: str) -> int:
    """Column number, from 0, of a reference like AB12."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_markdown(content: bytes) -> str:
    package = Package(content)
    main = "xl/workbook.xml"
    links = package.links(main)
    base = dt.datetime(1904, 1, 1) if any(attribute(x, "date1904") in ("1", "true") for x in package.stream(main, "workbookPr")) else dt.datetime(1899, 12, 30)
    shared = ["".join(t.text or "" for r in x for t in ([r] if local(r.tag) == "t" else r if local(r.tag) == "r" else []) if local(t.tag) == "t") for x in package.stream("xl/sharedStrings.xml", "si")]
    custom = {x.get("numFmtId"): x.get("formatCode", "") for x in package.stream("xl/styles.xml", "numFmt")}
    forms = [f.get("numFmtId", "0") for x in package.stream("xl/styles.xml", "cellXfs") for f in x]
    dated = [14 <= int(f) <= 22 or 45 <= int(f) <= 47 or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(f, "").lower()))) for f in forms]

    def shown(c: Element) -> str:
        kind, raw = c.get("t", "n"), child(c, "v")
        value = "" if raw is None else raw.text or ""
        if kind == "s":
            return shared[int(value)] if value else ""
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
        if kind == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(value, value)
        if kind != "n" or not value:
            return value
        style = int(c.get("s", "0"))
        if style < len(dated) and dated[style]:
            when = base + dt.timedelta(seconds=round(float(value) * 86400))
            return when.date().isoformat() if float(value) == int(float(value)) else when.isoformat(sep=" ")
        return str(int(float(value))) if re.fullmatch(r"-?\d+\.0+", value) else value

    out = []
    for sheet in package.stream(main, "sheet"):
        rows: dict[int, dict[int, str]] = {}
        name, merges = links.get(attribute_of(sheet), ""), []
        for x in package.stream(name, "row", "mergeCell"):
            if local(x.tag) == "mergeCell":
                merges.append(x.get("ref", ""))
                continue
            number, at = int(x.get("r", len(rows) + 1)), -1
            for c in x:
                at = column_of(c.get("r")) if c.get("r") else at + 1
                text = shown(c)
                if text:
                    rows.setdefault(number, {})[at] = text
        for ref in (m for m in merges if ":" in m):
            a, b = ref.split(":")
            top, bottom, left, right = int(re.sub(r"\D", "", a)), int(re.sub(r"\D", "", b)), column_of(a), column_of(b)
            text = rows.get(top, {}).get(left)
            if text:
                for r in range(top, min(bottom, max(rows)) + 1):
                    for c in range(left, right + 1):
                        rows.setdefault(r, {})[c] = text
        if rows:
            first = min(min(r) for r in rows.values())
            matrix = [[r.get(c, "") for c in range(first, max(r) + 1)] for _, r in sorted(rows.items())]
            out.append((False, f"## {flat(sheet.get('name', ''))}\n\n{pipe_table(matrix)}"))
    return joined(out)


# HTML


class Markdown(HTMLParser):
    """Headings, paragraphs, lists, tables and preformatted text of a page."""

    BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "blockquote", "figure", "figcaption", "form", "fieldset", "address", "dl", "dt", "dd", "body", "html"}
    HIDDEN = {"script", "style", "template", "noscript", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []
        self.text: list[str] = []
        self.heading = self.hidden = self.verbatim = 0
        self.lists: list[list[int | None]] = []  # of each open list the next number, None without numbers
        self.item = False
        self.tables: list[Grid] = []
        self.cell: tuple[int, int] | None = None
        self.outer: list[tuple[list[str], tuple[int, int] | None]] = []

    def flush(self) -> None:
        """What has been said so far is a block."""
        raw, self.text = "".join(self.text), []
        said = raw.strip("\n") if self.verbatim else flat(raw)
        if self.tables:
            self.text = [raw]
            return
        if not said.strip():
            return
        if self.verbatim:
            said = f"```\n{said}\n```"
        elif self.heading:
            said = "#" * self.heading + " " + said
        elif self.lists:
            number = self.lists[-1][0]
            mark = ("- " if number is None else f"{number}. ") if self.item else "  "
            if self.item and number is not None:
                self.lists[-1][0] = number + 1
            said, self.item = "  " * (len(self.lists) - 1) + mark + said, False
        self.blocks.append((bool(self.lists) and not self.heading, said))

    def end_cell(self) -> None:
        if self.cell is not None and self.tables:
            self.tables[-1].cell("".join(self.text), *self.cell)
            self.text, self.cell = [], None

    def end_row(self) -> None:
        self.end_cell()
        if self.tables:
            self.tables[-1].end()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        about = dict(attrs)
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "br":
            self.text.append("\n" if self.verbatim else " ")
        elif tag == "table":
            if not self.tables:
                self.flush()
            self.outer.append((self.text, self.cell))
            self.text, self.cell = [], None
            self.tables.append(Grid())
        elif tag == "tr" and self.tables:
            self.end_row()
            self.tables[-1].start()
        elif tag in ("td", "th") and self.tables:
            self.end_cell()
            spans = [int(v) if (v := about.get(n) or "1").strip().isdigit() else 1 for n in ("colspan", "rowspan")]
            self.text, self.cell = [], (spans[0], max(1, min(spans[1], 65534)))
        elif self.tables and (tag in self.BLOCKS or tag in ("li", "ul", "ol", "pre") or re.fullmatch("h[1-6]", tag)):
            self.text.append(" ")
        elif tag in ("ul", "ol"):
            self.flush()
            start = (about.get("start") or "1").strip()
            self.lists.append([None if tag == "ul" else int(start) if start.isdigit() else 1])
        elif tag == "li":
            self.flush()
            self.item = bool(self.lists)
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.heading = int(tag[1])
        elif tag == "pre":
            self.flush()
            self.verbatim = 1
        elif tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag == "table" and self.tables:
            self.end_row()
            grid = self.tables.pop()
            self.text, self.cell = self.outer.pop()
            if self.tables:  # within a cell: its words
                self.text.append(" " + " ".join(c for r in grid.rows for c in r) + " ")
            else:
                self.blocks.append((False, pipe_table(grid.rows)))
        elif tag in ("ul", "ol") and self.lists and not self.tables:
            self.flush()
            self.lists.pop()
        elif re.fullmatch("h[1-6]", tag) and not self.tables:
            self.flush()
            self.heading = 0
        elif tag == "pre" and not self.tables:
            self.flush()
            self.verbatim = 0
        elif (tag in self.BLOCKS or tag == "li") and not self.tables:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def html_markdown(content: bytes | str) -> str:
    parser = Markdown()
    parser.feed(content if isinstance(content, str) else content.decode("utf-8", "replace"))
    parser.close()
    while parser.tables:
        parser.handle_endtag("table")
    parser.flush()
    return joined(parser.blocks)


# files

PARSERS = {".docx": docx_markdown, ".pptx": pptx_markdown, ".xlsx": xlsx_markdown, ".html": html_markdown, ".htm": html_markdown}


def parsed(path: str, content: bytes) -> tuple[str, str | None, str | None]:
    """Path, markdown, error."""
    try:
        return path, PARSERS[posixpath.splitext(path.lower())[1]](content), None
    except Exception as fault:  # noqa: BLE001  files come from anywhere; what is wrong with one is said in its row
        return path, None, f"{type(fault).__name__}: {fault}"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(len(paths))
        self.paths = paths


class Office(DataSource):
    """``spark.dataSource.register(Office)``, then ``spark.read.format("office").load(path)``; option ``groupBytes``."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return OfficeReader(self.options["path"], int(self.options.get("groupBytes", GROUP)))


class OfficeReader(DataSourceReader):
    def __init__(self, path: str, group: int):
        self.path, self.group = path, group

    def store(self) -> tuple[Any, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        """Files by name, so many a partition that their bytes come to about ``group``."""
        from pyarrow import fs

        store, root = self.store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        groups: list[list[str]] = [[]]
        held = 0
        for f in sorted((f for f in found if f.is_file and wanted(f.path)), key=lambda f: f.path):
            if groups[-1] and held + f.size > self.group:
                groups.append([])
                held = 0
            groups[-1].append(f.path)
            held += f.size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self.store()
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as file:
                yield parsed(path, file.read())


def wanted(path: str) -> bool:
    name = posixpath.basename(path)
    return name.lower().endswith(EXTENSIONS) and not name.startswith((".", "~$"))


def office_markdown(files: DataFrame) -> DataFrame:
    """path, markdown, error of files with ``path`` and ``content``; of other columns none is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parsed(p, bytes(c)) for p, c in zip(batch["path"], batch["content"])], columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """The office files below a path of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return office_markdown(files.where(F.lower(name).rlike(r"\.(docx|pptx|xlsx|html?)$") & ~name.startswith(".") & ~name.startswith("~$")))
