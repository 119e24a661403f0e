"""Office packages and PDF files made of rows, as Arrow columns: inputs for queries and tests of the converters."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of the formats.
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DECK = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def relationships(*items: tuple[str, str, str]) -> str:
    """Relationships (id, type, target); targets that are addresses are external."""
    body = "".join(
        f'<Relationship Id="{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{escape(target)}"' + (' TargetMode="External"/>' if "://" in target else "/>")
        for i, kind, target in items
    )
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def word_paragraph(text: str, properties: str = "") -> str:
    return f'<w:p><w:pPr>{properties}</w:pPr><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def word_file(body: str, styles: str = "", numbering: str = "", links: tuple = ()) -> bytes:
    parts = {"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": relationships(*links)}
    if styles:
        parts["word/styles.xml"] = f"<w:styles {WORD}>{styles}</w:styles>"
    if numbering:
        parts["word/numbering.xml"] = f"<w:numbering {WORD}>{numbering}</w:numbering>"
    return zipped(parts)


def shape(kind: str, *paragraphs: str) -> str:
    place = f'<p:ph type="{kind}"/>' if kind else ""
    body = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in paragraphs)
    return f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"


def deck_file(slides: list[str], chart: str = "", notes: dict[int, str] | None = None, hidden: set[int] = frozenset()) -> bytes:
    """Slides by their shapes, numbered from 1."""
    parts, ids, links = {}, "", []
    for n, shapes in enumerate(slides, 1):
        ids += f'<p:sldId id="{255 + n}" r:id="rId{n}"/>'
        links.append((f"rId{n}", "slide", f"slides/slide{n}.xml"))
        show = ' show="0"' if n in hidden else ""
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {DECK}{show}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        own = [("rIdChart", "chart", "../charts/chart1.xml")] if chart else []
        if notes and n in notes:
            own.append(("rIdNotes", "notesSlide", f"../notesSlides/notesSlide{n}.xml"))
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f'<p:notes {DECK}><p:cSld><p:spTree>{shape("sldNum", "7")}{shape("body", notes[n])}</p:spTree></p:cSld></p:notes>'
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = relationships(*own)
    parts["ppt/presentation.xml"] = f"<p:presentation {DECK}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = relationships(*links)
    if chart:
        parts["ppt/charts/chart1.xml"] = f"<c:chartSpace {DECK}><c:chart>{chart}</c:chart></c:chartSpace>"
    return zipped(parts)


CHART_FRAME = '<p:graphicFrame><a:graphic><a:graphicData><c:chart r:id="rIdChart"/></a:graphicData></a:graphic></p:graphicFrame>'


def chart_cache(tag: str, values: dict[int, str], kind: str = "num") -> str:
    points = "".join(f'<c:pt idx="{k}"><c:v>{escape(v)}</c:v></c:pt>' for k, v in values.items())
    return f"<c:{tag}><c:{kind}Ref><c:{kind}Cache>{points}</c:{kind}Cache></c:{kind}Ref></c:{tag}>"


def book_file(sheets: list[tuple[str, str, list[list[str]]]], formats: list[int] = (0,), changed: dict[str, str] | None = None) -> bytes:
    """Sheets (name, state, rows of cell contents); a cell is text, or =number or =number@style."""
    parts = {"[Content_Types].xml": TYPES, "_rels/.rels": relationships(("rId1", "officeDocument", "xl/workbook.xml"))}
    links, tabs = [("rIdStyles", "styles", "styles.xml")], ""
    for n, (name, state, rows) in enumerate(sheets, 1):
        links.append((f"rId{n}", "worksheet", f"worksheets/sheet{n}.xml"))
        tabs += f'<sheet name="{escape(name)}" sheetId="{n}" state="{state}" r:id="rId{n}"/>'
        body = ""
        for r, cells in enumerate(rows, 1):
            inner = ""
            for k, c in enumerate(cells):
                at = f"{chr(65 + k)}{r}"
                if c.startswith("="):
                    value, _, style = c[1:].partition("@")
                    inner += f'<c r="{at}" s="{style or 0}"><v>{value}</v></c>'
                elif c:
                    inner += f'<c r="{at}" t="inlineStr"><is><t>{escape(c)}</t></is></c>'
            body += f'<row r="{r}">{inner}</row>' if inner else ""
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {SHEET}><sheetData>{body}</sheetData></worksheet>"
    parts["xl/styles.xml"] = f'<styleSheet {SHEET}><cellXfs>{"".join(f"<xf numFmtId=%s/>" % f"{chr(34)}{f}{chr(34)}" for f in formats)}</cellXfs></styleSheet>'
    parts["xl/workbook.xml"] = f"<workbook {SHEET}><sheets>{tabs}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = relationships(*links)
    return zipped(parts | (changed or {}))


def pdf_file(pages: list[list[tuple[int, int, int, str]]], key: bytes | None = None) -> bytes:
    """Pages of lines (size, x, y, text) in Helvetica; an encrypting key makes the file one with a user password."""
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for lines in pages:
        content = b"".join(f"BT /F1 {size} Tf {x} {y} Td (".encode() + "".join("\\" + c if c in "()\\" else c for c in text).encode("cp1252") + b") Tj ET\n" for size, x, y, text in lines)
        bodies.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % len(bodies))
        kids.append(len(bodies))
    bodies[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in enumerate(bodies, 1))
    lock = b"" if key is None else b" /Encrypt << /Filter /Standard /V 1 /R 2 /P -4 /O <%s> /U <%s> >> /ID [<00> <00>]" % (key.hex().encode(), key.hex().encode())
    return out + b"trailer << /Root 1 0 R /Size %d%s >>\n%%%%EOF\n" % (len(bodies) + 1, lock)


def made(make: Callable[[list], bytes], rows: Column) -> Column:
    """The file that a function makes of a row's array."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([make(x or []) for x in batch.to_pylist()], pa.binary())

    return run(rows)
