"""HTML extraction: a tree builder with implied tags, visibility rules, and layout-aware rendering.

The scanner takes tags with possessive patterns, so each character is looked at a bounded number of times whatever the page
holds; a quote opens a value only after ``=``.  The builder closes what a new tag implies (a paragraph before a block,
a list item before the next, cells and rows before others), ignores end tags that match nothing in their scope, and keeps
script-like elements out; counts of what is open since the last boundary spare it any search that would find nothing.
The renderer walks the tree with a stack of its own: blocks stand on lines of their own with blank lines where the
browser has margins, list items get markers and indents, preformatted text keeps its lines, and tables are laid out
with their cells, of several lines if need be, padded to common column widths; a cell that spans rows keeps its columns.

Visibility: ``hidden``, ``display:none`` and ``visibility:hidden``, inline or from a ``style`` element (rules whose selectors are
a tag, classes and ids; rules in @-blocks are left out), by specificity; ``display:none`` hides all below it, while a
``visibility:visible`` child of a hidden element is seen.  Head, script, style, template, noscript, iframe, and the fallbacks
of audio, video, canvas and svg give nothing; the fallback of an object is seen.

Defined cases: null html gives empty text; text without tags is itself with white space collapsed; unclosed elements, stray
ends and broken comments never fail; a tag, comment or quote that the page ends in is dropped, as browsers do; lists
deeper than ``DEEPEST`` indent no further, tables deeper than that are plain blocks, and no more cells than that span rows at
once; columns are padded to ``WIDEST`` characters at most.  Padding could otherwise be the square of the text; no text is
lost by it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>))"
_ATTRIBUTE = rf"=?[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+"
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE}|=)*+)>")
ATTRIBUTE = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|[\s/=]++")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe title noembed noframes audio video canvas svg datalist".split())
#: Blocks, with the blank lines that a browser's margins leave about them.
BLOCKS = dict.fromkeys("address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav option optgroup search section summary table tbody thead tfoot tr td th caption".split(), 0)
BLOCKS |= dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote figure hr xmp".split(), 1)
LISTS = frozenset("ul ol menu dir".split())
CLOSES_P = frozenset(t for t in BLOCKS if t not in {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "figcaption"})
SCOPE = frozenset("table td th caption html button object".split())
#: A start tag closes the nearest open element of the first set, unless one of the second stands between.
IMPLIED = {
    "p": ({"p"}, SCOPE), "head": ({"head"}, set()),
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup", "tr"}, {"table"}),
}
CLOSED_BY = {"dd": "dt", "th": "td", "thead": "tbody", "tfoot": "tbody", "body": "head"} | {k: k for k in IMPLIED if k not in ("p", "head")}
COUNTED, ENTERED = defaultdict(list), defaultdict(list)
for _group, (_tags, _until) in IMPLIED.items():
    for _t in _tags:
        COUNTED[_t].append(_group)
    for _t in _until:
        ENTERED[_t].append(_group)
#: End tags that look beyond the scope they stand in.
FAR_ENDS = SCOPE | {"tr", "tbody", "thead", "tfoot"}
SPACE = re.compile(r"[ \t\n\r\f]+")
DEEPEST = 32
#: A column is padded to this width at most; longer cells run over it.
WIDEST = 240
#: The most that browsers let a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Element:
    __slots__ = ("attrs", "children", "found", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.found = tag, attrs, [], None

    def attributes(self) -> dict[str, str]:
        if self.found is None:
            pairs = [(k.lower(), v) for k, v in ATTRIBUTE.findall(self.attrs) if k] if self.attrs and not self.attrs.isspace() else []
            self.found = {k: unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in reversed(pairs)}
        return self.found


class OpenElements:
    """The stack of open elements, with counts that tell whether a search would find anything."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.in_scope: list[Counter] = [Counter()]
        self.everywhere: Counter = Counter()
        self.near = {group: [0] for group in IMPLIED}

    def push(self, x: Element) -> None:
        self.stack.append(x)
        self.everywhere[x.tag] += 1
        self.in_scope[-1][x.tag] += 1
        for group in COUNTED.get(x.tag, ()):
            self.near[group][-1] += 1
        for group in ENTERED.get(x.tag, ()):
            self.near[group].append(0)
        if x.tag in SCOPE:
            self.in_scope.append(Counter())

    def pop(self) -> str:
        tag = self.stack.pop().tag
        if tag in SCOPE:
            self.in_scope.pop()
        for group in ENTERED.get(tag, ()):
            self.near[group].pop()
        for group in COUNTED.get(tag, ()):
            self.near[group][-1] -= 1
        self.everywhere[tag] -= 1
        self.in_scope[-1][tag] -= 1
        return tag

    def close(self, group: str) -> None:
        while self.near[group][-1]:  # a section ends the row and the section before it
            tags = IMPLIED[group][0]
            while self.pop() not in tags:
                pass
            if group != "tbody":
                return

    def end(self, tag: str) -> bool:
        """Closes the nearest element ``tag``, if it is in reach."""
        if not (self.everywhere if tag in FAR_ENDS else self.in_scope[-1])[tag]:
            return False
        while self.pop() != tag:
            pass
        return True


COMMENT_END = re.compile("--!?>")


def build(html: str) -> tuple[Element, list[str]]:
    """The tree of a page, and its style sheets; every element the page leaves open is closed at its end."""
    root, sheets = Element("html"), []
    open_ = OpenElements(root)
    stack, at, look, end = open_.stack, 0, 0, len(html)

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].children.append(unescape(html[at:upto]))

    while (lt := html.find("<", look)) >= 0:
        mark = html[lt + 1 : lt + 3]
        if mark[:1] in ("!", "?") or mark[:1] == "/" and not (mark[1:].isascii() and mark[1:].isalpha()):
            text(lt)
            if html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    at = html.index(">", lt + 4) + 1
                else:
                    close = COMMENT_END.search(html, lt + 4)
                    at = close.end() if close else end
            else:
                close = html.find(">", lt + 2)
                at = close + 1 if close >= 0 else end
            look = at
            continue
        if not (mark[:1] == "/" or mark[:1].isascii() and mark[:1].isalpha()):
            look = lt + 1  # a plain character
            continue
        found = TAG.match(html, lt)
        text(lt)
        if not found:  # the page ends in this tag
            at = end
            break
        at = look = found.end()
        tag = found[2].lower()
        if found[1]:
            if not open_.end(tag) and tag == "p":
                open_.close("p")
                stack[-1].children.append(Element("p"))
            continue
        if tag == "html":
            root.attrs = root.attrs or found[3]
            continue
        if tag in CLOSES_P:
            open_.close("p")
        if tag in CLOSED_BY:
            open_.close(CLOSED_BY[tag])
        if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
            open_.pop()
        element = Element(tag, found[3])
        stack[-1].children.append(element)
        if tag in RAW_END:
            last = RAW_END[tag].search(html, at)
            inner = html[at : last.start() if last else end]
            if tag == "textarea" or tag == "xmp":
                element.children.append(unescape(inner) if tag == "textarea" else inner)
            elif tag == "style":
                sheets.append(inner)
            ended = TAG.match(html, last.start()) if last else None
            at = look = ended.end() if ended else end
        elif tag not in VOID:
            open_.push(element)
    text(end)
    return root, sheets


# visibility

DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-zA-Z-]+)\s*(!\s*important)?", re.I)
SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")


def without_at_rules(sheet: str) -> str:
    """The sheet without comments and @-blocks."""
    out, depth, skip, at = [], 0, 0, 0
    for token in re.finditer(r"/\*.*?(?:\*/|\Z)|@[^{};]*+[{;]?|[{}]", sheet, re.S):
        if not skip:
            out.append(sheet[at : token.start()])
        at = token.end()
        mark = token[0]
        if mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
        if mark[0] == "@" and not skip and mark[-1] == "{":
            skip = 1
        elif skip and mark[-1] == "{":
            skip += 1
        elif skip and mark == "}":
            skip -= 1
        elif not skip and mark in "{}":
            out.append(mark)
    return "".join(out) + ("" if skip else sheet[at:])


def rules(sheet: str) -> list[tuple[str, str]]:
    """Selectors and body of each rule."""
    parts = re.split(r"([{}])", without_at_rules(sheet))
    return [(parts[k - 1], parts[k + 1]) for k in range(1, len(parts) - 2, 2) if parts[k] == "{" and parts[k + 2] == "}"]


class Styles:
    """What style elements and attributes say of display and visibility.

    Rules with one selector are merged into what wins for each property, a selector is filed under that of its parts which
    the fewest have, and elements of one tag with the same of the names that selectors know share one answer.
    """

    def __init__(self, sheets: list[str]):
        merged: dict[tuple[str, frozenset[str]], dict[str, tuple]] = {}
        n = 0
        for selectors, body in (r for sheet in sheets for r in rules(sheet)):
            said = [(p.lower(), v.lower(), bool(i)) for p, v, i in DECLARATION.findall(body)]
            for selector in selectors.split(",") if said else ():
                simple = SIMPLE.match(selector.strip())
                if simple and simple[0]:
                    parts = re.findall(r"[.#][\w-]+", simple[2])
                    weight = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), bool(simple[1]), n)
                    wins = merged.setdefault(((simple[1] or "").lower(), frozenset(parts)), {})
                    for p, v, important in said:
                        key = (important, 0, *weight)
                        if p not in wins or key >= wins[p][0]:
                            wins[p] = key, v
                    n += 1
        self.names = {p for _, parts in merged for p in parts}
        often = Counter(p for _, parts in merged for p in parts)
        self.rules: dict[str, list] = defaultdict(list)
        for (tag, parts), wins in merged.items():
            self.rules[min(parts, key=lambda p: (often[p], p)) if parts else tag].append((tag, parts, wins))
        self.answers: dict[tuple[str, frozenset[str]], dict[str, tuple]] = {}

    def sheets_say(self, tag: str, names: frozenset[str]) -> dict[str, tuple]:
        """What wins for each property, with its rank, for elements of a tag with these names of selectors."""
        if (tag, names) not in self.answers:
            value: dict[str, tuple] = {}
            for name in (*names, tag):
                for own, parts, wins in self.rules.get(name, ()):
                    if own in ("", tag) and parts <= names:
                        for p, (key, v) in wins.items():
                            if p not in value or key >= value[p][0]:
                                value[p] = key, v
            self.answers[tag, names] = value
        return self.answers[tag, names]

    def of(self, x: Element) -> tuple[bool, bool | None]:
        """Whether the element is displayed, and whether it is visible (None: as what it stands in)."""
        if x.tag in UNSEEN:
            return False, None
        bare = not x.attrs or x.attrs.isspace()
        if bare and not self.rules:
            return True, None
        own = {} if bare else x.attributes()
        value: dict[str, tuple] = {}
        if self.rules:
            names = {f"#{own['id']}"} if "id" in own else set()
            names |= {f".{c}" for c in own.get("class", "").split()}
            value |= self.sheets_say(x.tag, frozenset(names & self.names))
        for p, v, important in DECLARATION.findall(own.get("style", "")):
            key, p = (bool(important), 1), p.lower()
            if p not in value or key >= value[p][0]:
                value[p] = key, v.lower()
        display = value["display"][1] != "none" if "display" in value else "hidden" not in own
        visible = value["visibility"][1] if "visibility" in value else "inherit"
        return display, None if visible == "inherit" else visible == "visible"


# layout


class Lines:
    """Text as it is laid out: a line being filled, finished lines, and the gap that the next line wants."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def inline(self, text: str) -> None:
        words = SPACE.sub(" ", text)
        if words.strip(" ") == "":
            self.space = self.space or bool(words)
            return
        if self.line and (self.space or words[0] == " "):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def plain(self, text: str) -> None:
        """Preformatted: white space and line ends stay."""
        first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for part in more:
            self.put("".join(self.line))
            self.line = [part]

    def flush(self) -> None:
        if self.line:
            self.put("".join(self.line))
        self.line, self.space = [], False

    def put(self, line: str) -> None:
        if self.done and self.gap:
            self.done += [""] * self.gap
        lead = "".join(self.indent[:DEEPEST])
        if self.marker:
            lead = lead[: len(lead) - len(self.marker)] + self.marker
            self.marker = ""
        self.done.append((lead + line).rstrip(" "))
        self.gap = 0

    def edge(self, blank: int) -> None:
        self.flush()
        self.gap = max(self.gap, blank)

    def text(self) -> str:
        self.flush()
        return "\n".join(self.done)


def render(node: Element, styles: Styles, nesting: int = 0, shown: bool = True) -> str:
    out = Lines()
    lists: list[list] = []
    stack: list[tuple] = [("open", node, shown, False)]
    while stack:
        step, x, shown, pre = stack.pop()
        if step == "close":
            if x.tag in ("li", "dd", "blockquote"):
                out.flush()
                out.indent.pop()
                out.marker = ""
            if x.tag in LISTS:
                lists.pop()
            if pre and out.line == [""]:
                out.line = []  # the line end before the end tag
            out.edge(BLOCKS.get(x.tag, 0) if not (x.tag in LISTS and lists) else 0)
            continue
        if isinstance(x, str):
            if shown:
                (out.plain if pre else out.inline)(x)
            continue
        display, visible = styles.of(x)
        if not display:
            continue
        shown = shown if visible is None else visible
        tag = x.tag
        if tag == "br":
            if shown and pre:
                out.plain("\n")
            elif shown and out.line:
                out.flush()
            elif shown:
                out.gap = max(out.gap, 1)
            continue
        if tag == "table" and nesting < DEEPEST:
            out.edge(1)
            for line in table_lines(x, styles, nesting + 1, shown):
                out.put(line)
            out.edge(1)
            continue
        children = x.children
        if tag in BLOCKS:
            nested = tag in LISTS and lists
            out.edge(0 if nested else BLOCKS[tag])
            if tag in LISTS:
                start = x.attributes().get("start", "1") if tag == "ol" else "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                if lists and lists[-1][0] == "ol":
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    marker = "- "
                out.indent.append(" " * len(marker))
                out.marker = marker if shown and len(out.indent) <= DEEPEST else ""
            elif tag in ("dd", "blockquote"):
                out.indent.append("  ")
            elif tag in ("pre", "xmp"):
                pre = True
                if children and isinstance(children[0], str):  # a line end right after the tag does not count
                    children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]
            stack.append(("close", x, shown, pre))
        stack.extend(("open", c, shown, pre) for c in reversed(children))
    return out.text()


def span(cell: Element, name: str, most: int) -> int:
    value = cell.attributes().get(name, "1") if cell.attrs else "1"
    return min(int(value[:6]), most) if re.fullmatch("[0-9]+", value) else 1


def table_lines(table: Element, styles: Styles, nesting: int, shown: bool) -> list[str]:
    """Caption, loose text, then rows with cells padded to the widths of their columns."""
    rows: list[list[tuple[int, list[str], int]]] = []  # of each row: column, lines, end of the columns spanned
    caption: list[str] = []
    loose = Element("div")
    covered: list[tuple[int, int, int]] = []  # columns that a cell above takes, and for how many more rows

    def lines_of(x: Element, seen: bool) -> list[str]:
        return [line for line in render(x, styles, nesting, seen).split("\n") if line]

    def add(cells: list, seen: bool) -> None:
        nonlocal covered
        out, at, new = [], 0, []
        above = iter([*covered, (1 << 60, 0, 0)])
        low, high, _ = next(above)
        for c in cells:
            display, visible = (True, None) if isinstance(c, str) else styles.of(c)
            if not display or isinstance(c, str) and not c.strip():
                continue
            while low <= at:
                at = max(at, high)
                low, high, _ = next(above)
            if isinstance(c, str):
                out.append((at, [SPACE.sub(" ", c).strip(" ")] if seen else [], at + 1))
                at += 1
                continue
            wide, tall = max(1, span(c, "colspan", MOST_COLUMNS)), span(c, "rowspan", MOST_ROWS) or MOST_ROWS
            out.append((at, lines_of(c, seen), at + wide))
            if tall > 1:
                new.append((at, at + wide, tall - 1))
            at += wide
        covered = [(a, b, n - 1) for a, b, n in covered if n > 1]
        covered = sorted(covered + new[: max(0, DEEPEST - len(covered))])
        if out:
            rows.append(out)

    stack = [(c, shown) for c in reversed(table.children)]
    while stack:
        x, seen = stack.pop()
        if isinstance(x, str):
            if x.strip():
                loose.children.append(x)
            continue
        display, visible = styles.of(x)
        if not display:
            continue
        own = seen if visible is None else visible
        if x.tag in ("tbody", "thead", "tfoot"):
            covered.clear()
            stack.append((None, seen))
            stack.extend((c, own) for c in reversed(x.children))
        elif x.tag == "tr":
            add(x.children, own)
        elif x.tag in ("td", "th"):
            add([x], seen)
        elif x.tag == "caption":
            caption += lines_of(x, seen)
        elif x.tag not in ("colgroup", "col"):
            loose.children.append(x)
        while stack and stack[-1][0] is None:  # cells do not span beyond their section
            stack.pop()
            covered.clear()
    # only columns that a cell begins in have a width
    begins = sorted({at for row in rows for at, _, _ in row})
    place = {at: k for k, at in enumerate(begins)}
    rows = [[(place[at], lines, bisect_left(begins, end)) for at, lines, end in row] for row in rows]
    widths = [0] * len(begins)
    for row in rows:
        for at, lines, end in row:
            if end == at + 1:
                widths[at] = min(WIDEST, max(widths[at], max(map(len, lines), default=0)))
    upto = [0, *accumulate(widths)]

    def room(a: int, b: int) -> int:
        return upto[b] - upto[a] + 3 * (b - a - 1)

    out = [*caption, *(lines_of(loose, shown) if loose.children else [])]
    for row in rows:
        for k in range(max(len(lines) for _, lines, _ in row)):
            parts, column = [], 0
            for at, lines, end in row:
                if column < at:  # under cells that span rows
                    parts += ["".ljust(widths[c]) for c in range(column, at)]
                parts.append((lines[k] if k < len(lines) else "").ljust(room(at, end)))
                column = end
            out.append(" | ".join(parts).rstrip(" "))
    return out


def extract_text(html: str | None) -> str:
    if not html:
        return ""
    root, sheets = build(html)
    return render(root, Styles(sheets))


@F.pandas_udf(StringType())
def _extract(pages: pd.Series) -> pd.Series:
    return pages.map(extract_text, na_action=None)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _extract(F.col("html").cast("string")).alias("text"))
    return rows.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": F.when(F.length("text") == 0, F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")})
