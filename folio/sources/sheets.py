"""Excel workbooks: a heading and a table for each sheet."""

from __future__ import annotations

import re
from collections.abc import Iterator

from folio.sources import markup
from folio.sources.base import EXPANDED, Blocks, Converter, Corrupt, Document, Limits, Source, TooLarge
from folio.sources.numfmt import BUILT_IN, shown
from folio.sources.package import NOTHING, Element, Package

#: Columns of a sheet.
COLUMNS = 16384
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def column(reference: str) -> int | None:
    """Column of a cell reference, from 0."""
    found = re.match(r"\$?([A-Za-z]{1,3})", reference)
    if not found:
        return None
    n = 0
    for c in found[1].upper():
        n = 26 * n + ord(c) - 64
    return n - 1 if n <= COLUMNS else None


def string(item: Element) -> str:
    """A shared or inline string: its text, or that of its runs; phonetic readings are left out."""
    parts = [c.text if c.name == "t" else c.at("t").text for c in item.children if c.name in ("t", "r")]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


class Book:
    def __init__(self, package: Package, raw: bool):
        self.package, self.raw = package, raw
        root = package.relations("")
        self.part = next((t for kind, t, _ in root.values() if kind == "officeDocument"), "xl/workbook.xml")
        self.workbook = package.need(self.part).at("workbook")
        if not self.workbook:
            raise Corrupt("no workbook")
        self.relations = package.relations(self.part)
        self.epoch_1904 = self.workbook.at("workbookPr").get("date1904") in ("1", "true")
        self.strings = [string(s) for s in self._related("sharedStrings", "xl/sharedStrings.xml").at("sst").all("si")]
        styles = self._related("styles", "xl/styles.xml").at("styleSheet")
        own = {f.get("numFmtId"): f.get("formatCode") for f in styles.at("numFmts").all("numFmt")}
        self.formats = [own.get(x.get("numFmtId")) or BUILT_IN.get(int(x.get("numFmtId") or 0), "General") for x in styles.at("cellXfs").all("xf")]

    def _related(self, kind: str, usual: str) -> Element:
        part = next((t for k, t, _ in self.relations.values() if k == kind), usual)
        part = part if part in self.package.parts else self.package.folded.get(part.lower(), part)
        return self.package.read(part) or NOTHING

    def sheets(self) -> Iterator[tuple[str, bool, str]]:
        """(name, hidden, part) in the order of the tabs."""
        for s in self.workbook.at("sheets").all("sheet"):
            yield s.get("name"), s.get("state") in ("hidden", "veryHidden"), self.relations.get(s.get("r:id"), ("", "", False))[1]

    def value(self, cell: Element) -> str:
        kind, v = cell.get("t"), cell.at("v").text
        if kind == "s":
            return self.strings[int(v)] if v.strip().isdecimal() and int(v) < len(self.strings) else v
        if kind == "inlineStr":
            return string(cell.at("is"))
        if kind == "b":
            return v if self.raw else {"1": "TRUE", "0": "FALSE"}.get(v, v)
        if kind in ("str", "e", "d") or not v:
            return v
        style = cell.get("s")
        code = self.formats[int(style)] if style.isdecimal() and int(style) < len(self.formats) else "General"
        return v if self.raw else shown(v, code, self.epoch_1904)

    def rows(self, part: str) -> Iterator[list[str]]:
        sheet = self.package.need(part).at("worksheet")
        for r in sheet.at("sheetData").all("row"):
            cells: list[str] = []
            for c in r.all("c"):
                at = column(c.get("r"))
                at = len(cells) if at is None else at
                cells += [""] * (at + 1 - len(cells))
                cells[at] = self.value(c)
            yield cells


def xlsx(hidden: bool = False, raw: bool = False) -> Converter:
    """A section for each sheet; empty ones, and hidden ones unless asked for, are empty. raw: values as stored."""

    def convert(source: Source, limits: Limits) -> Document:
        package = Package(source.data, limits.expanded)
        if 0 <= limits.expanded < package.declared_size():
            raise TooLarge(EXPANDED, limits.expanded)
        for part in package.xml_parts():
            package.check(part)
        package.budget.spent = 0
        out = Blocks(limits.output)
        try:
            book = Book(package, raw)
            for number, (name, is_hidden, part) in enumerate(book.sheets(), 1):
                with out.in_section("sheet", number) as section:
                    section.name = name
                    if is_hidden and not hidden:
                        continue
                    head = f"## {markup.cell(name)}\n\n"
                    table = out.fit(lambda most: markup.table(book.rows(part), most if most < 0 else max(most - len(head.encode()), 0)))
                    out.add(head + table if table else "")
        except (ValueError, IndexError, OverflowError) as e:
            raise Corrupt(f"the workbook cannot be read: {e}") from e
        return out.document()

    return convert
