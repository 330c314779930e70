"""Office files that the test writes come back as the markdown expected."""

import re
import zipfile

import pytest

from lodestone.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def packed(path, parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


def docx(path):
    def p(text, about=""):
        return f"<w:p>{f'<w:pPr>{about}</w:pPr>' if about else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"

    def item(text, list_, level):
        return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{list_}"/></w:numPr>')

    def cell(text, about=""):
        return f"<w:tc><w:tcPr>{about}</w:tcPr>{p(text)}</w:tc>"

    body = p("Handbook", '<w:pStyle w:val="Title"/>') + p("Scope &amp; aims", '<w:pStyle w:val="H2"/>') + p("Own", '<w:pStyle w:val="Own"/>')
    body += '<w:p><w:r><w:t xml:space="preserve">Plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t xml:space="preserve"> in</w:t></w:r></w:ins> <w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p><w:p/>'
    body += item("one", 1, 0) + item("under", 1, 1) + item("under too", 1, 1) + item("two", 1, 0) + item("again", 1, 1) + item("dot", 2, 0) + p("after")
    merged = '<w:vMerge w:val="restart"/>'
    rows = [cell("A|B", '<w:gridSpan w:val="2"/>') + cell("C"), cell("x", merged) + cell("y") + cell("z"), cell("", "<w:vMerge/>") + cell("p") + cell("q"), cell("") * 3]
    body += "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>" + p("end")
    level = '<w:lvl w:ilvl="{}"><w:start w:val="{}"/><w:numFmt w:val="{}"/></w:lvl>'
    packed(path, {
        "word/document.xml": f"<w:document {W}><w:body>{body}<w:sectPr/></w:body></w:document>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Title"><w:name w:val="Title"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Own"><w:name w:val="mine"/><w:basedOn w:val="H2"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7">{level.format(0, 3, "decimal")}{level.format(1, 1, "lowerLetter")}</w:abstractNum><w:abstractNum w:abstractNumId="8">{level.format(0, 1, "bullet")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>',
        "word/_rels/document.xml.rels": RELS.format('<Relationship Id="r1" Target="https://a.b/c" TargetMode="External"/>'),
    })


DOCX = """# Handbook

## Scope & aims

## Own

Plain **bold** in[site](https://a.b/c)

3. one
  1. under
  2. under too
4. two
  1. again
- dot

after

| A\\|B | A\\|B | C |
| --- | --- | --- |
| x | y | z |
| x | p | q |

end"""


def pptx(path):
    def para(text, about=""):
        return f"<a:p>{about}<a:r><a:t>{text}</a:t></a:r></a:p>"

    def shape(place, *paras):
        return f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody>{''.join(paras)}</p:txBody></p:sp>"

    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl>" + "".join(f"<a:tr>{r}</a:tr>" for r in (
        '<a:tc gridSpan="2"><a:txBody><a:p><a:r><a:t>wide</a:t></a:r></a:p></a:txBody></a:tc><a:tc hMerge="1"/>', "<a:tc><a:txBody><a:p><a:r><a:t>l</a:t></a:r></a:p></a:txBody></a:tc>" * 2, '<a:tc vMerge="1"/><a:tc><a:txBody><a:p><a:r><a:t>m</a:t></a:r></a:p></a:txBody></a:tc>')) + "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    one = shape('<p:ph type="title"/>', para("First")) + shape('<p:ph idx="1"/>', para("point"), para("deeper", '<a:pPr lvl="1"/>'), para("free", "<a:pPr><a:buNone/></a:pPr>"), para("step", "<a:pPr><a:buAutoNum type='arabicPeriod'/></a:pPr>"), para("step", "<a:pPr><a:buAutoNum type='arabicPeriod'/></a:pPr>")) + table
    two = shape('<p:ph type="sldNum"/>', para("9")) + shape("", para("box"))
    slide = f"<p:sld {A}><p:cSld><p:spTree>{{}}</p:spTree></p:cSld></p:sld>"
    packed(path, {
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="r1" Target="slides/s2.xml"/><Relationship Id="r2" Target="/ppt/slides/s1.xml"/>'),
        "ppt/slides/s1.xml": slide.format(one), "ppt/slides/s2.xml": slide.format(two),
    })


PPTX = """<!-- slide:1 -->
## First

- point
  - deeper

free

1. step
2. step

| wide | wide |
| --- | --- |
| l | l |
| l | m |

<!-- slide:2 -->
## Slide 2

box"""


def xlsx(path):
    rows = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>in</t></is></c></row><row r="3"><c r="B3"><v>3.0</v></c><c r="C3" s="1"><v>45292</v></c><c r="D3" t="b"><v>1</v></c></row>'
    rows += '<row r="5"><c r="B5" s="2"><v>45292.5</v></c><c r="C5" t="str"><v>f|g</v></c></row><row r="6"><c r="D6"><v>1.25</v></c></row>'
    packed(path, {
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="Empty" r:id="r1"/><sheet name="Data 1" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {X}><si><t>Name</t></si><si><r><t>Ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {X}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/a.xml": f"<worksheet {X}><sheetData/></worksheet>",
        "xl/worksheets/b.xml": f'<worksheet {X}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="C5:D6"/><mergeCell ref="A9:A9"/></mergeCells></worksheet>',
    })


XLSX = """## Data 1

| Name | Rich | in |
| --- | --- | --- |
| 3 | 2024-01-01 | TRUE |
| 2024-01-01 12:00:00 | f\\|g | f\\|g |
|  | f\\|g | f\\|g |"""

HTML = """<html><head><title>t</title><style>x</style></head><body><h1>Big  <b>one</b></h1><p>text<br>more &amp; more<ul><li>a<ol start=4><li>x<li>y</ol></li><li><p>b</p><p>b2</p></ul>
<table><tr><th rowspan=2>h</th><th colspan=2>wide</th></tr><tr><td>1<td>2<table><tr><td>in</td></tr></table></tr><tr><td colspan=2 rowspan=9>z</td></tr><tr><td>a|b</table>tail<pre>
 code
  more</pre><script>no</script><h3>last"""

HTML_MD = """# Big one

text more & more

- a
  4. x
  5. y
- b
  b2

| h | wide | wide |
| --- | --- | --- |
| h | 1 | 2 in |
| z | z |  |
| z | z | a\\|b |

tail

```
 code
  more
```

### last"""


def write_all(folder):
    (folder / "sub").mkdir()
    docx(folder / "a.docx")
    pptx(folder / "sub" / "b.PPTX")
    xlsx(folder / "sub" / "c.xlsx")
    (folder / "d.html").write_text(HTML)
    (folder / "bad.docx").write_bytes(b"not a zip")
    (folder / "~$a.docx").write_bytes(b"lock")
    (folder / "e.txt").write_text("other")


WANT = {"a.docx": DOCX, "b.PPTX": PPTX, "c.xlsx": XLSX, "d.html": HTML_MD, "bad.docx": None}


@pytest.mark.parametrize("how", ["source", "binary"])
def test_office_files(spark, tmp_path, how):
    write_all(tmp_path)
    if how == "source":
        spark.dataSource.register(office.Office)
        found = spark.read.format("office").option("groupBytes", 2000).load(str(tmp_path))
        assert found.rdd.getNumPartitions() > 1
    else:
        found = office.office_files(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert {n: r.markdown for n, r in rows.items()} == WANT
    assert [n for n, r in rows.items() if r.error] == ["bad.docx"]


def test_no_files(spark, tmp_path):
    spark.dataSource.register(office.Office)
    assert spark.read.format("office").load(str(tmp_path)).count() == 0


def test_pages_keep_their_words(spark):
    """Every page's markdown has the words of the page's text, in order, but for marks; tables and lists are there."""
    from lodestone import registry

    d = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in registry.queries()["html_markdown"](spark, d).collect()}
    lists = 0
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        assert got[r.page_id].error is None
        md = got[r.page_id].markdown
        lists += bool(re.search(r"^\s*(-|\d+\.) ", md, re.M))
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title|template|noscript)\b.*?</\1>", "", r.html or "")
        plain = set(re.findall(r"\w{4,}", re.sub(r"<[^>]*>", " ", body)))
        said = set(re.findall(r"\w{4,}", md))
        assert len(plain - said) <= 0.1 * len(plain) + 3, r.page_id
    assert lists
