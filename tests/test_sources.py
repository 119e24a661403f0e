"""Converters on small inputs: structure, options, limits and damage."""

import pytest

from folio import samples as s
from folio.sources import charset, markup, numfmt, plain
from folio.sources.base import Budget, Corrupt, Document, Encrypted, Limits, Registry, Section, Source, TooLarge, Unsupported, format_name, format_of
from folio.sources.formats import all_formats
from folio.sources.package import COMPOUND, ENCRYPTION

ALL = all_formats()


def run(fmt, data, registry=ALL, **source):
    return registry.convert(fmt, Source(data.encode() if isinstance(data, str) else data, **source))


# Registry and limits


def test_formats_and_names():
    assert ALL.formats() == ["csv", "docx", "html", "json", "md", "pdf", "pptx", "txt", "xlsx"]
    assert [format_name(x) for x in (" .HTM ", "text", "Markdown", "yml", "docx", "..x")] == ["html", "txt", "md", "yaml", "docx", ".x"]
    assert [format_of(x) for x in ("a/b.TXT", "b\\c.tar.yml", "x.d/e", ".hidden", "end.", "p/.htm", "a.b/c.md")] == ["txt", "yaml", None, None, None, None, "md"]


def test_later_registrations_win_and_errors_name_the_source():
    r = Registry().register(lambda src, limits: Document("one"), "x", "Y").register(lambda src, limits: Document("two"), ".x")
    assert (run("X", "", r).markdown, run("y", "", r).markdown, r.formats()) == ("two", "one", ["x", "y"])
    with pytest.raises(Unsupported):
        run("z", "", r)
    with pytest.raises(TypeError):
        r.register(None, "q")
    with pytest.raises(Corrupt, match="^book.xlsx: "):
        run("xlsx", "no zip", name="book.xlsx")


def test_limits():
    assert vars(Limits().effective()) == {"source": 32 << 20, "expanded": 128 << 20, "output": 64 << 20}
    assert vars(Limits(-5, 7, 0).effective()) == {"source": -1, "expanded": 7, "output": 64 << 20}
    assert Limits(1, 0, 0).filled(Limits(2, 3, 0)) == Limits(1, 3, 0)
    small = all_formats(Limits(source=4), json={"limits": Limits(source=-1, output=12)})
    with pytest.raises(TooLarge) as e:
        run("txt", "fives", small)
    assert (e.value.limit, e.value.most) == ("source", 4)
    with pytest.raises(TooLarge):
        run("json", "[1]", small)
    assert run("txt", "four", small).markdown == "four"
    Budget("x", -1).charge(1 << 60)


def test_sections_in():
    d = Document("", (Section("page", 1, "", 0, 5), Section("page", 2, "", 5, 5), Section("page", 3, "", 7, 9)))
    assert [[x.number for x in d.sections_in(*r)] for r in ((0, 9), (4, 7), (5, 7), (3, 3), (8, 20))] == [[1, 3], [1], [], [], [3]]


# Decoding

CHINESE = "汉字"


@pytest.mark.parametrize(
    "data, declared, fallback, want",
    [
        (CHINESE.encode(), None, None, CHINESE),
        (b"\xef\xbb\xbfx", "gbk", None, "x"),
        (b"\xff\xfe" + CHINESE.encode("utf-16-le"), None, None, CHINESE),
        (b"\xfe\xff" + CHINESE.encode("utf-16-be"), "utf-8", None, CHINESE),
        (b"\xff\xfe\0\0" + "😀".encode("utf-32-le"), None, None, "😀"),
        (b"\0\0\xfe\xff" + "😀".encode("utf-32-be"), None, None, "😀"),
        (CHINESE.encode("gb18030"), " 'GB2312' ", None, CHINESE),
        (CHINESE.encode("gb18030"), "hz-gb-2312", "gbk", CHINESE),
        (CHINESE.encode("gb18030"), "", "gbk", CHINESE),
        (CHINESE.encode(), None, "gbk", CHINESE),
        ("テスト".encode("cp932"), "x-sjis", None, "テスト"),
        ("é€".encode("cp1252"), "iso-8859-1", None, "é€"),
        ("Привет".encode("koi8-r"), "KOI8-R", None, "Привет"),
        ("Ş".encode("cp1254"), "windows-1254", None, "Ş"),
        ("ő".encode("iso8859-2"), "iso-8859-2", None, "ő"),
        (b"a\xff\xfe\xfdb\xff\xef\xbf\xbd", None, None, "a\ufffdb\ufffd\ufffd"),
        (b"x\xff", "utf-8", "gbk", "x\ufffd"),
        (b"x", "iso-2022-kr", None, "x"),
    ],
)
def test_decoding(data, declared, fallback, want):
    assert charset.decode(data, declared, fallback) == want


def test_text_and_json():
    assert run("text", b"\xef\xbb\xbfa\r\nb\rc\0 \n").markdown == "a\nb\nc \n"
    assert run("json", '{"x": "```"}\r\n').markdown == '````json\n{"x": "```"}\n````'
    assert run("md", "  # T\n\n").markdown == "  # T\n\n"


# Markdown


def test_markup():
    assert markup.cell(" a\u3000\n|b\\ \0") == "a \\|b\\\\ "
    assert markup.paragraph("  # x\r\n12. y\r1234567890. z\n\t- a\n_b") == "\\# x\n12\\. y\n1234567890. z\n\\- a\n\\_b"
    assert markup.table([["", ""], []]) == "" and markup.table([], header=["a"]) == "| a |\n| --- |"
    assert markup.link("[a]\n b", "x<y>\nz") == "[\\[a\\] b](<x%3Cy%3E%0Az>)"
    rows = [["a", "b|"], ["é"], ["", "", "c"]]
    for promote in (True, False):
        whole = markup.table(rows, promote=promote)
        assert markup.table(rows, len(whole.encode()), promote=promote) == whole
        with pytest.raises(TooLarge):
            markup.table(rows, len(whole.encode()) - 1, promote=promote)


# CSV


@pytest.mark.parametrize(
    "text, options, want",
    [
        ('k;v\n"a;b";"c ""d"""\n', {"comma": ";"}, "| k | v |\n| --- | --- |\n| a;b | c \"d\" |"),
        ("k\r\n\r\na,b\r\n", {}, "| k |  |\n| --- | --- |\n| a | b |"),
        ('"two\nlines",x', {}, "| two lines | x |\n| --- | --- |"),
        ("1,2", {"header": False}, "|  |  |\n| --- | --- |\n| 1 | 2 |"),
        ('a"b,"c"d",e', {"lazy": True}, '| a"b | c"d | e |\n| --- | --- | --- |'),
        ('x,"open', {"lazy": True}, "| x | open |\n| --- | --- |"),
        (",\n,,", {}, ""),
        ("", {}, ""),
    ],
)
def test_csv(text, options, want):
    assert run("csv", text, all_formats(csv=options)).markdown == want


@pytest.mark.parametrize("text", ['a"b', '"a"b', '"a', 'x\n"y" z'])
def test_strict_quotes(text):
    with pytest.raises(Corrupt):
        run("csv", text)


@pytest.mark.parametrize("comma", ['"', "\n", "", "ab", "\0"])
def test_bad_separators_are_no_damage(comma):
    with pytest.raises(Exception) as e:
        run("csv", "a", all_formats(csv={"comma": comma}))
    assert e.value.kind == "config"


# HTML


def html(text, **k):
    return run("html", text, **k).markdown


def test_page_structure():
    text = "<title>t</title><style>x</style><h2>Head <em>two</em></h2><p>One<br>line &amp; <a href='../q?a=1 b' title='T'>li nk</a><p>Two <img src=i.png alt='a b'><ol start=3><li>x<ul><li>y</ul><li>z</ol><blockquote>q<p>r</blockquote><hr><pre><code class='language-py'>if a:\n  b</code></pre><script>no</script>"
    want = '## Head *two*\n\nOne  \nline & [li nk](<http://e/q?a=1 b> "T")\n\nTwo ![a b](http://e/d/i.png)\n\n3. x\n   - y\n4. z\n\n> q\n>\n> r\n\n* * *\n\n```py\nif a:\n  b\n```'
    assert html(text, base_url="http://e/d/p.html") == want


def test_open_formatting_goes_on():
    assert html("<p>a <b>b<p>c</b> d<p>e") == "a **b**\n\n**c** d\n\ne"
    assert html("<p><i>x<table><tr><td>y</table>z") == "*x*\n\n| y |\n|---|\n\n*z*"


def test_html_escapes():
    assert html("<p>a*b_c d_ [x] `t` &lt;u&gt; 1 < 2") == "a\\*b_c d\\_ \\[x\\] \\`t\\` \\<u> 1 < 2"
    assert html("<p># no<p>1. no<p>- no<p>+1") == "\\# no\n\n1\\. no\n\n\\- no\n\n+1"


@pytest.mark.parametrize(
    "rows, want",
    [
        ("<tr><th>a<th>b<tr><td colspan=2>c", "| a | b |\n|---|---|\n| c | c |"),
        ("<tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d", "| a | b |\n|---|---|\n| a | c |\n| d |  |"),
        ("<tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d", "| a | b |\n|---|---|\n| a | c |\n| d |  |"),
        ("<tr><td colspan=' +2x'>a<tr><td>b", "| a | a |\n|---|---|\n| b |  |"),
        ("<tr><td rowspan=9>a<td><code>x|y</code> z|w<p>v", "| a | `x\\|y` z\\|w<br />v |\n|---|---|"),
        ("<caption>cap</caption><tr><td>a", "| a |\n|---|\n\ncap"),
    ],
)
def test_html_tables(rows, want):
    assert html(f"<table>{rows}</table>") == want


def test_tables_in_tables_and_clamps():
    assert html("<table><tr><td>o<td><table><tr><td>i</table></table>") == "o\n\n| i |\n|---|"
    assert html("<table><tr><td colspan=5000>x</table>").count("| x") == 1000


def test_copies_are_charged_before_they_are_made():
    text = "<table><tr><td>a<td>b<tr><td colspan=2>xy</table>"
    cost = 2 * 64 + 16 * len("colspan" + "2" + "td" + "xy")
    run("html", text, all_formats(Limits(expanded=cost)))
    with pytest.raises(TooLarge) as e:
        run("html", text, all_formats(Limits(expanded=cost - 1)))
    assert e.value.limit == "expanded"
    with pytest.raises(TooLarge):
        run("html", "<table><tr><td colspan=1000><a href=x>l</a></table>", all_formats(Limits(expanded=1 << 20)), base_url="http://e/" + "b" * 9000)


@pytest.mark.parametrize("tag", ["blockquote", "ul", "ol", "div", "span"])
def test_deep_nesting(tag):
    got = html(f"<{tag}>" * 5000 + "<p>x" * 200)
    assert got.count("x") == 200 and max(line.find("x") for line in got.split("\n")) <= 24


@pytest.mark.parametrize(
    "data, charset_, fallback, want",
    [
        (b"<meta charset=gbk>" + CHINESE.encode("gbk"), None, None, CHINESE),
        (b'<meta content="text/html; charset=big5" http-equiv=Content-Type>' + "漢字".encode("big5"), None, None, "漢字"),
        (b"<meta charset=utf-16>" + CHINESE.encode(), None, "gbk", CHINESE),
        (b"<body><meta charset=gbk>" + CHINESE.encode(), None, None, CHINESE),
        (b"<meta charset=utf-8>" + CHINESE.encode("gbk"), "gbk", None, CHINESE),
        (b"<meta charset=gbk>" + CHINESE.encode("gbk"), "bogus", None, CHINESE),
        (CHINESE.encode("gbk"), None, "gbk", CHINESE),
        (b" \n", None, None, ""),
    ],
)
def test_html_charsets(data, charset_, fallback, want):
    assert run("html", data, all_formats(fallback=fallback), charset=charset_).markdown == want


# Word


def para(text, properties=""):
    return s.word_paragraph(text, properties)


def test_word_document():
    styles = '<w:style w:styleId="A"><w:name w:val="Heading 3"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:pPr><w:outlineLvl w:val="9"/></w:pPr></w:style><w:style w:styleId="C"><w:basedOn w:val="A"/></w:style>'
    styles += '<w:style w:styleId="L"><w:pPr><w:numPr><w:numId w:val="7"/></w:numPr></w:pPr></w:style><w:style w:styleId="M"><w:basedOn w:val="L"/></w:style>'
    numbering = '<w:abstractNum w:abstractNumId="2"><w:lvl w:ilvl="0"><w:numFmt w:val="upperRoman"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/><w:pStyle w:val="M"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="2"/></w:num>'
    numbering += '<w:num w:numId="8"><w:abstractNumId w:val="2"/><w:lvlOverride w:ilvl="0"><w:lvl><w:numFmt w:val="none"/></w:lvl></w:lvlOverride></w:num>'
    body = para("three", '<w:pStyle w:val="A"/>') + para("body", '<w:pStyle w:val="B"/>') + para("also  three", '<w:pStyle w:val="C"/>') + para("six", '<w:outlineLvl w:val="7"/>')
    body += para("one", '<w:pStyle w:val="L"/>') + para("linked", '<w:pStyle w:val="M"/>') + para("plain", '<w:numPr><w:numId w:val="8"/></w:numPr>') + para("none", '<w:pStyle w:val="L"/><w:numPr><w:numId w:val="0"/></w:numPr>')
    body += '<w:sdt><w:sdtContent><w:p><w:r><w:t>- a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t># c</w:t><w:drawing><w:t>no</w:t></w:drawing></w:r></w:p></w:sdtContent></w:sdt><w:sectPr/>'
    got = run("docx", s.word_file(body, styles, numbering)).markdown
    assert got == "### three\n\nbody\n\n### also three\n\n###### six\n\n1. one\n\n   - linked\n\n- plain\n\nnone\n\n\\- a b\n\\# c"


def test_word_links_and_tables():
    link = '<w:p><w:hyperlink r:id="r1"><w:r><w:t>a</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>b</w:t></w:r></w:hyperlink></w:hyperlink><w:hyperlink r:id="r9"><w:r><w:t>c</w:t></w:r></w:hyperlink></w:p>'
    cell = lambda text, p="": f"<w:tc><w:tcPr>{p}</w:tcPr>{para(text)}{para('2') if text == 'x' else ''}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("a")}{cell("b", "<w:gridSpan w:val=%s3%s/>" % (chr(34), chr(34)))}</w:tr><w:tr>{cell("x", "<w:vMerge w:val=%srestart%s/>" % (chr(34), chr(34)))}{cell("y")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("| z")}</w:tr></w:tbl>'
    got = run("docx", s.word_file(link + table, links=(("r1", "hyperlink", "http://e/"),))).markdown
    assert got == "[ab](<http://e/>)c\n\n| a | b | b | b |\n| --- | --- | --- | --- |\n| x 2 | y |  |  |\n| x 2 | \\| z |  |  |"


def test_output_limit_is_exact_across_blocks():
    data = s.word_file(para("one") + "<w:tbl><w:tr><w:tc>" + para("é") + "</w:tc></w:tr></w:tbl>" + para("two"))
    whole = run("docx", data).markdown
    assert run("docx", data, all_formats(Limits(output=len(whole.encode())))).markdown == whole
    for most in (len(whole.encode()) - 1, 10, 4):
        with pytest.raises(TooLarge) as e:
            run("docx", data, all_formats(Limits(output=most)))
        assert e.value.most == most


@pytest.mark.parametrize("fmt", ["docx", "pptx", "xlsx"])
def test_packages_that_are_none(fmt):
    for data, error in ((b"", Corrupt), (b"text", Corrupt), (COMPOUND + ENCRYPTION, Encrypted), (COMPOUND, Unsupported), (s.zipped({"a": "", "A": ""}), Corrupt), (s.zipped({"a": ""}), Corrupt), (s.word_file("")[:-30], Corrupt)):
        with pytest.raises(error):
            run(fmt, data)


def test_xml_rules():
    body = para("x")
    twice = s.zipped({"word/document.xml": f'<w:document {s.WORD}><w:body><w:p w:a="1" w:a="2"><w:r><w:t w:b="x" w:b="y">kept</w:t></w:r></w:p></w:body></w:document>'})
    assert run("docx", twice).markdown == "kept"
    deep = "<w:x>" * 300 + body + "</w:x>" * 300
    with pytest.raises(Corrupt):
        run("docx", s.word_file(deep))
    with pytest.raises(Corrupt):
        run("docx", s.zipped({"word/document.xml": f'<!DOCTYPE x [<!ENTITY e "v">]><w:document {s.WORD}><w:body>&e;</w:body></w:document>'}))
    with pytest.raises(TooLarge) as e:
        run("docx", s.word_file(body * 2000), all_formats(Limits(expanded=50_000)))
    assert e.value.limit == "expanded"


# PowerPoint


def test_slides():
    data = s.deck_file([s.shape("ctrTitle", "A", "b") + s.shape("body", "1. x", " ", "y"), "", f'<p:grpSp>{s.shape("", "g")}</p:grpSp><mc:AlternateContent xmlns:mc="m"><mc:Choice>{s.shape("", "c")}</mc:Choice><mc:Fallback>{s.shape("", "f")}</mc:Fallback></mc:AlternateContent>', s.shape("title", "H")], notes={3: "said"}, hidden={4})
    d = run("pptx", data)
    assert d.markdown == "# A b\n\n1\\. x\ny\n\ng\n\nc\n\nsaid"
    assert [(x.number, x.name, d.markdown.encode()[x.start : x.end].decode()) for x in d.sections] == [(1, "A b", "# A b\n\n1\\. x\ny"), (2, "", ""), (3, "", "g\n\nc\n\nsaid"), (4, "", "")]
    assert run("pptx", data, all_formats(pptx={"notes": False, "hidden": True})).markdown == "# A b\n\n1\\. x\ny\n\ng\n\nc\n\n# H"


def test_charts_with_gaps():
    cat = s.chart_cache("cat", {0: "p", 3: "q"}, "str")
    series = f'<c:ser><c:tx><c:v>S</c:v></c:tx>{cat}{s.chart_cache("val", {0: "1", 65535: "9", 65536: "no"})}</c:ser><c:ser>{s.chart_cache("val", {3: "2"})}</c:ser>'
    points = f'<c:ser><c:tx><c:v>P</c:v></c:tx>{s.chart_cache("xVal", {0: "1", 5: "2"})}{s.chart_cache("yVal", {5: "3"})}</c:ser>'
    got = run("pptx", s.deck_file([s.CHART_FRAME], f"<c:plotArea><c:lineChart>{series}</c:lineChart><c:scatterChart>{points}</c:scatterChart></c:plotArea>")).markdown
    assert got == "|  | S |  |\n| --- | --- | --- |\n| p | 1 |  |\n| q |  | 2 |\n|  | 9 |  |\n\n|  | x | y |\n| --- | --- | --- |\n| P | 1 |  |\n| P | 2 | 3 |"
    assert run("pptx", s.deck_file([s.CHART_FRAME], "<c:plotArea/>")).markdown == ""


# Excel


def test_sheets():
    data = s.book_file([("One|", "visible", [["k", "", "v"], [], ["=1.5", "=0.125@1", "x|y"]]), ("No", "visible", []), ("Hid", "hidden", [["h"]])], [0, 10])
    d = run("xlsx", data)
    assert d.markdown == "## One\\|\n\n| k |  | v |\n| --- | --- | --- |\n| 1.5 | 12.50% | x\\|y |"
    assert [(x.number, x.name, x.start, x.end) for x in d.sections] == [(1, "One|", 0, len(d.markdown)), (2, "No", len(d.markdown), len(d.markdown)), (3, "Hid", len(d.markdown), len(d.markdown))]
    assert run("xlsx", data, all_formats(xlsx={"hidden": True, "raw": True})).markdown.endswith("| 1.5 | 0.125 | x\\|y |\n\n## Hid\n\n| h |\n| --- |")


@pytest.mark.parametrize("part, content", [("xl/worksheets/sheet1.xml", "<worksheet><sheetData>"), ("xl/worksheets/sheet1.xml", ""), ("xl/styles.xml", "<a/><b/>"), ("xl/workbook.xml", "garbage"), ("xl/_rels/workbook.xml.rels", s.relationships(("rId1", "worksheet", "worksheets/gone.xml")))])
def test_damaged_books(part, content):
    with pytest.raises(Corrupt):
        run("xlsx", s.book_file([("A", "visible", [["x"]])], changed={part: content}))


def test_declared_sizes_are_checked_first():
    with pytest.raises(TooLarge) as e:
        run("xlsx", s.book_file([("A", "visible", [["x" * 5000]])]), all_formats(Limits(expanded=4000)))
    assert e.value.limit == "expanded"


@pytest.mark.parametrize(
    "raw, code, want",
    [
        ("1234567.891", "#,##0.00", "1,234,567.89"), ("-0.5", "0%", "-50%"), ("0.005", "0.00", "0.01"), ("7", "000", "007"), ("1.50", "0.##", "1.5"), ("1", "0.##", "1."),
        ("1500", '0.0,"k"', "1.5k"), ("-2", "0;(0)", "(2)"), ("0", "0;-0;zero", "zero"), ("12345", "0.0E+00", "1.2E+04"), ("2.5", "# ?/?", "2 1/2"), ("60", "yyyy-mm-dd", "1900-02-28"),
        ("45292.25", "d mmm yyyy h:mm AM/PM", "1 Jan 2024 6:00 AM"), ("45292.999", "hh:mm:ss", "23:58:34"), ("0.75", "mm:ss.0", "00:00.0"), ("1.0417", "[h]:mm", "25:00"), ("100", "General", "100"), ("1E-10", "General", "1E-10"), ("x", "0", "x"),
    ],
)
def test_number_formats(raw, code, want):
    assert numfmt.shown(raw, code) == want


# PDF

BODY = (12, 72, 500, "Enough text of the usual size to be the body of the page, as all may see.")


@pytest.mark.parametrize(
    "lines, want",
    [
        ([(20, 72, 700, "Big"), (20, 72, 678, "title"), (15, 72, 650, "Less"), BODY], f"# Big title\n\n## Less\n\n{BODY[3]}"),
        ([(12, 72, 700, "one"), (12, 72, 686, "two"), (12, 72, 640, "* three")], "one\ntwo\n\n\\* three"),
        ([(12, 72, 700, "left"), (12, 300, 700, "right")], "left right"),
        ([(12, 72, 700, "a (b) \\ c")], "a (b) \\ c"),
        ([(30, 72, 700, "123"), BODY], f"123\n\n{BODY[3]}"),
    ],
)
def test_pdf_layout(lines, want):
    assert run("pdf", s.pdf_file([lines])).markdown == want


def test_pdf_pages_and_options():
    data = s.pdf_file([[], [(24, 72, 700, "T"), BODY], [], []])
    d = run("pdf", data)
    assert [(x.number, x.start, x.end) for x in d.sections] == [(1, 0, 0), (2, 0, len(d.markdown)), (3, len(d.markdown), len(d.markdown)), (4, len(d.markdown), len(d.markdown))]
    assert run("pdf", data, all_formats(pdf={"headings": False})).markdown == f"T\n\n{BODY[3]}"
    for options, limit in (({"most_pages": 3}, "pages"), ({"most_chars": 20}, "page_chars")):
        with pytest.raises(TooLarge) as e:
            run("pdf", data, all_formats(pdf=options))
        assert e.value.limit == limit
    with pytest.raises(TooLarge) as e:
        run("pdf", data, all_formats(Limits(output=30)))
    assert e.value.limit == "output"


def test_pdf_streams_and_fonts():
    import zlib

    content = zlib.compress(b"q 2 0 0 2 0 0 cm BT /F 6 Tf 1 0 0 1 36 350 Tm [(W) 40 (ord) -400 <0102>] TJ T* ET Q BT /F 12 Tf 72 600 Td (x\\051\\(y) ' ET")
    cmap = b"begincmap 1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfrange <01> <02> <0041> endbfrange endcmap"
    parts = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[4 0 R]/Count 1/Resources<</Font<</F 3 0 R>>>>>>",
        b"<</Type/Font/Subtype/Type1/ToUnicode 6 0 R/Encoding<</Differences[120/eacute]>>/FirstChar 0/Widths[%s]>>" % b" ".join([b"500"] * 256),
        b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>", b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(content), content), b"<</Length %d>>stream\n%s\nendstream" % (len(cmap), cmap),
    ]
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, p) for k, p in enumerate(parts, 1)) + b"trailer<</Root 1 0 R>>"
    assert run("pdf", data).markdown == "Word AB\n\né)(y"


def test_pdf_damage_and_passwords():
    for data in (b"", b"%PDF-1.4", b"%PDF-1.4 1 0 obj <</Type/Catalog>> endobj"):
        with pytest.raises(Corrupt):
            run("pdf", data)
    with pytest.raises(Encrypted):
        run("pdf", s.pdf_file([[BODY]], key=bytes(32)))


def test_pdf_that_an_empty_password_opens():
    import hashlib

    from folio.sources.pdffile import PAD, rc4

    owner = bytes(range(32))
    key = hashlib.md5(PAD + owner + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + b"id").digest()[:5]
    content = b"BT /F 12 Tf 72 700 Td (opened) Tj ET"
    lock = lambda n, raw: rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:10], raw)
    parts = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Resources<</Font<</F<</Type/Font>>>>>>>>", b"<</Type/Page/Contents 4 0 R>>", b"<</Length %d>>stream\n%s\nendstream" % (len(content), lock(4, content))]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, p) for k, p in enumerate(parts, 1))
    data += b"trailer<</Root 1 0 R/ID[<6964><6964>]/Encrypt<</Filter/Standard/V 1/R 2/P -4/O<%s>/U<%s>>>>>" % (owner.hex().encode(), rc4(key, PAD).hex().encode())
    assert run("pdf", data).markdown == "opened"


def test_plain_records_are_lazy():
    rows = plain.records("a,b\n" * 3)
    assert next(rows) == ["a", "b"]


def test_damaged_sources_raise_nothing_else():
    import random

    from folio import conversions as c

    rng, nations = random.Random(7), [{"key": k, "name": f"N{k}", "region": "R"} for k in range(1, 5)]
    seeds = {"docx": c.word_of(nations), "pptx": c.deck_of(nations), "xlsx": c.book_of(nations), "pdf": c.pdf_of(nations), "csv": b'a,"b""c"\n\n"x\ny",z'}
    seeds["html"] = b"<table><tr><td rowspan=2>a<u><table><td>b</u><ul><li>x<p>y<b>z<tr><td colspan=3>q</table><pre>k</pre><blockquote>t<a href=x>l</a>"
    for fmt, data in seeds.items():
        for _ in range(150):
            b = bytearray(data)
            for _ in range(rng.randrange(1, 6)):
                k = rng.randrange(len(b))
                b[k : k + rng.randrange(12)] = rng.choice([b"", b"<", b">", b"<table>", b"</td>", b"<<", b"[", b"(", b"-1", b"99999999999", bytes([rng.randrange(256)])])
            try:
                run(fmt, bytes(b))
            except (Corrupt, Encrypted, Unsupported, TooLarge):
                pass
