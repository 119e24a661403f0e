"""PowerPoint decks: slides in order with their shapes, tables, charts and notes."""

from __future__ import annotations

from collections.abc import Iterator

from folio.sources import markup
from folio.sources.base import Blocks, Converter, Document, Limits, Source
from folio.sources.base import Corrupt as Damage
from folio.sources.package import Element, Package

#: Point indices of a chart that are read.
POINTS = 1 << 16
TITLES = ("title", "ctrTitle")
SILENT = set("pPr rPr endParaRPr".split())


def text_of(node: Element) -> str:
    """Runs and fields; a line break is a line feed, a paragraph ends in a space."""
    out = []
    for c in node.children:
        if c.name == "t":
            out.append(c.text)
        elif c.name == "br":
            out.append("\n")
        elif c.name not in SILENT:
            out.append(text_of(c) + " " * (c.name == "p"))
    return "".join(out)


def shape_text(shape: Element) -> str:
    lines = (text_of(p).strip(markup.SPACES) for p in shape.at("txBody").all("p"))
    return "\n".join(x for x in lines if x)


def placeholder(shape: Element) -> str:
    return shape.at("nvSpPr", "nvPr", "ph").get("type")


def points(node: Element) -> dict[int, str]:
    """Values of a chart's cache by point index; those of a further cache follow on."""
    out: dict[int, str] = {}
    end = 0

    def read(n: Element) -> None:
        nonlocal end
        origin = end
        for c in n.children:
            if c.name != "pt":
                read(c)
            elif (raw := c.get("idx")).lstrip("+").isdecimal() and int(raw) < POINTS:
                at = origin + int(raw)
                out[at] = c.at("v").text
                end = max(end, at + 1)

    read(node)
    return out


def series_name(series: Element) -> str:
    names = points(series.at("tx"))
    return names.get(0, "") if names else series.at("tx", "v").text


def category_rows(series: list[Element]) -> tuple[list[str], list[list[str]]]:
    """(header, rows): a full outer join of the labels and each series' values on the point index."""
    columns = [points(s.at("val")) for s in series]
    labels = next((p for s in series if (p := points(s.at("cat")))), {})
    sides = [labels, *columns]
    return ["", *map(series_name, series)], [[s.get(k, "") for s in sides] for k in sorted(set().union(*sides))]


def point_rows(series: list[Element]) -> tuple[list[str], list[list[str]]]:
    """(header, rows): a row for each point index that a series has an x, y or size for."""
    names = ["xVal", "yVal"] + ["bubbleSize"] * any(s.at("bubbleSize") for s in series)
    rows = []
    for s in series:
        sides = [points(s.at(n)) for n in names]
        every = set().union(*sides)
        rows += [[series_name(s), *(x.get(k, "") for x in sides)] for k in sorted(every)]
    return ["", "x", "y", "size"][: 1 + len(names)], rows


class Slide:
    def __init__(self, package: Package, part: str, out: Blocks):
        self.package, self.out, self.title = package, out, ""
        self.root = package.need(part).at("sld")
        if not self.root:
            raise Damage(f"{part} is no slide")
        self.relations = package.relations(part)

    @property
    def hidden(self) -> bool:
        return self.root.get("show") in ("0", "false")

    def table(self, rows: list[list[str]], header: list[str] | None = None) -> str:
        return self.out.fit(lambda most: markup.table(rows, most, header))

    def chart(self, target: str) -> Iterator[str]:
        chart = self.package.need(target).at("chartSpace", "chart")
        series = [s for plot in chart.at("plotArea").children for s in plot.all("ser")]
        by_category = [s for s in series if s.at("val")]
        by_point = [s for s in series if not s.at("val") and s.at("yVal")]
        if not by_category and not by_point:
            return
        title = chart.at("title")
        cached = points(title.at("tx"))
        yield markup.paragraph(markup.collapsed(text_of(title)) or " ".join(cached[k] for k in sorted(cached)))
        for group, rows_of in ((by_category, category_rows), (by_point, point_rows)):
            if group:
                header, rows = rows_of(group)
                yield self.table(rows, header)

    def shapes(self, tree: Element) -> Iterator[str]:
        for s in tree.children:
            if s.name == "sp" and (text := shape_text(s)):
                if placeholder(s) in TITLES:
                    line = markup.collapsed(text)
                    self.title = self.title or line
                    yield f"# {line}"
                else:
                    yield markup.paragraph(text)
            elif s.name == "graphicFrame":
                data = s.at("graphic", "graphicData")
                if data.at("chart"):
                    yield from self.chart(self.relations.get(data.at("chart").get("r:id"), ("", "", False))[1])
                else:
                    yield self.table([[text_of(c.at("txBody")) for c in r.all("tc")] for r in data.at("tbl").all("tr")])
            elif s.name == "grpSp":
                yield from self.shapes(s)
            elif s.name == "AlternateContent":
                yield from self.shapes(s.at("Choice"))

    def notes(self) -> Iterator[str]:
        """Speaker notes, by relationship ids of which rId2 comes before rId10."""
        for key in sorted(self.relations, key=lambda k: (len(k), k)):
            kind, target, _ = self.relations[key]
            if kind == "notesSlide":
                for s in self.package.need(target).at("notes", "cSld", "spTree").all("sp"):
                    if placeholder(s) == "body":
                        yield markup.paragraph(shape_text(s))


def pptx(notes: bool = True, hidden: bool = False) -> Converter:
    """A section for each slide; hidden ones are empty unless asked for."""

    def convert(source: Source, limits: Limits) -> Document:
        package, out = Package(source.data, limits.expanded), Blocks(limits.output)
        deck = package.need("ppt/presentation.xml").at("presentation")
        if not deck:
            raise Damage("no presentation")
        relations = package.relations("ppt/presentation.xml")
        for number, item in enumerate(deck.at("sldIdLst").all("sldId"), 1):
            slide = Slide(package, relations.get(item.get("r:id"), ("", "", False))[1], out)
            with out.in_section("slide", number) as section:
                if hidden or not slide.hidden:
                    for block in slide.shapes(slide.root.at("cSld", "spTree")):
                        out.add(block)
                    for block in slide.notes() if notes else ():
                        out.add(block)
                section.name = slide.title
        return out.document()

    return convert
