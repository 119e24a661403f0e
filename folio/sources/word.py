"""Word documents: styles, numbering, paragraphs, links and merged tables."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass, field

from folio.sources import markup
from folio.sources.base import Blocks, Converter, Corrupt, Document, Limits, Source
from folio.sources.package import NOTHING, Element, Package

# Styles followed upwards, heading and list levels shown, columns of a cell, and the outline level of body text.
CHAIN, HEADING, LIST, SPAN, BODY = 16, 6, 8, 64, 9
#: Elements without text of the paragraph, and what stands for others.
SILENT = set("pPr rPr drawing pict object Fallback".split())
SPOKEN = {"tab": " ", "br": "\n", "cr": "\n"}


def _number(raw: str) -> int | None:
    try:
        return int(raw)
    except ValueError:
        return None


@dataclass
class Style:
    """level: 0 for body text, None for unsaid."""

    parent: str
    level: int | None
    number: str
    depth: str


def _outline(properties: Element) -> int | None:
    n = _number(properties.at("outlineLvl").get("val"))
    return None if n is None else 0 if n >= BODY else n + 1


def _style(element: Element) -> Style:
    name = element.at("name").get("val").lower()
    named = 1 if name == "title" else _number(name[8:]) if name.startswith("heading ") else None
    own, numbering = _outline(element.at("pPr")), element.at("pPr", "numPr")
    return Style(element.at("basedOn").get("val"), (named or None) if own is None else own, numbering.at("numId").get("val"), numbering.at("ilvl").get("val"))


@dataclass
class Styles:
    """Paragraph styles, and numbering: by instance, which levels count and which styles a level is linked to."""

    styles: dict[str, Style] = field(default_factory=dict)
    counted: dict[str, ChainMap] = field(default_factory=dict)
    linked: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, package: Package) -> Styles:
        out = cls()
        root = package.read("word/styles.xml") or NOTHING
        out.styles = {s.get("styleId"): _style(s) for s in root.at("styles").all("style") if s.get("styleId")}
        numbering = (package.read("word/numbering.xml") or NOTHING).at("numbering")
        shapes = {}
        for a in numbering.all("abstractNum"):
            levels = list(a.all("lvl"))
            links = {x.at("pStyle").get("val"): x.get("ilvl") for x in levels if x.at("pStyle").get("val")}
            shapes[a.get("abstractNumId")] = {x.get("ilvl"): _counts(x) for x in levels}, links
        for n in numbering.all("num"):
            levels, links = shapes.get(n.at("abstractNumId").get("val"), ({}, {}))
            own = {o.get("ilvl"): _counts(o.at("lvl")) for o in n.all("lvlOverride") if o.at("lvl", "numFmt")}
            out.counted[n.get("numId")] = ChainMap(own, levels)
            out.linked[n.get("numId")] = links
        return out

    def chain(self, name: str) -> Iterator[tuple[str, Style]]:
        """A style and those it is based on, as far as they are known."""
        for _ in range(CHAIN):
            if name not in self.styles:
                return
            yield name, self.styles[name]
            name = self.styles[name].parent

    def level(self, name: str) -> int:
        return next((s.level for _, s in self.chain(name) if s.level is not None), 0)

    def numbering(self, name: str) -> tuple[str, str]:
        """(instance, level) that a style applies; a level that the numbering links to a style counts before the style's own."""
        chain = list(self.chain(name))
        number = next((s.number for _, s in chain if s.number), "")
        links = self.linked.get(number, {})
        return number, next((d for n, s in chain if (d := links.get(n) or s.depth)), "") if number else ""


def _counts(level: Element) -> bool:
    return level.at("numFmt").get("val") not in ("bullet", "none", "")


class Reader:
    def __init__(self, package: Package, out: Blocks):
        self.styles, self.out = Styles.of(package), out
        self.links = {k: target for k, (_, target, outside) in package.relations("word/document.xml").items() if outside}

    def text(self, node: Element, linked: bool = False) -> str:
        """A paragraph's text; hyperlinks to the outside become links, but not within one."""
        out = []
        for c in node.children:
            if c.name == "t":
                out.append(c.text)
            elif c.name in SPOKEN:
                out.append(SPOKEN[c.name])
            elif c.name == "hyperlink" and not linked and (target := self.links.get(c.get("r:id"))):
                out.append(markup.link(self.text(c, True), target))
            elif c.name not in SILENT:
                out.append(self.text(c, linked))
        return "".join(out)

    def paragraph(self, node: Element, in_cell: bool) -> str:
        text = self.text(node).strip(markup.SPACES)
        if not text:
            return ""
        properties = node.at("pPr")
        style, own = properties.at("pStyle").get("val"), _outline(properties)
        if level := self.styles.level(style) if own is None else own:
            return f"{'#' * min(level, HEADING)} {markup.collapsed(text)}"
        if in_cell:
            return text
        number, depth = self.styles.numbering(style)
        number = properties.at("numPr", "numId").get("val") or number
        depth = properties.at("numPr", "ilvl").get("val") or depth or "0"
        block = markup.paragraph(text)
        if number in ("", "0"):
            return block
        marker = "1. " if self.styles.counted.get(number, {}).get(depth) else "- "
        indent = "   " * min(max(_number(depth) or 0, 0), LIST)
        return f"{indent}{marker}" + block.replace("\n", f"\n{indent}   ")

    def blocks(self, node: Element, in_cell: bool) -> Iterator[str]:
        """Markdown of paragraphs and tables; other elements are opened."""
        for c in node.children:
            if c.name == "p":
                yield self.paragraph(c, in_cell)
            elif c.name == "tbl":
                yield self.table(c)
            elif c.name != "sectPr":
                yield from self.blocks(c, in_cell)

    def row(self, node: Element, above: list[str]) -> list[str]:
        cells: list[str] = []
        for c in node.all("tc"):
            properties = c.at("tcPr")
            merge = properties.at("vMerge")
            goes_on = merge and merge.get("val") != "restart" and len(cells) < len(above)
            text = above[len(cells)] if goes_on else " ".join(b for b in self.blocks(c, True) if b)
            cells += [text] * min(max(_number(properties.at("gridSpan").get("val")) or 1, 1), SPAN)
        return cells

    def rows(self, node: Element) -> Iterator[list[str]]:
        above: list[str] = []
        for r in node.all("tr"):
            above = self.row(r, above)
            yield above

    def table(self, node: Element) -> str:
        return self.out.fit(lambda most: markup.table(self.rows(node), most))


def docx() -> Converter:
    def convert(source: Source, limits: Limits) -> Document:
        package = Package(source.data, limits.expanded)
        body = package.need("word/document.xml").at("document", "body")
        if not body:
            raise Corrupt("the document has no body")
        out = Blocks(limits.output)
        for block in Reader(package, out).blocks(body, False):
            out.add(block)
        return out.document()

    return convert
