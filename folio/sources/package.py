"""Office Open XML packages: parts, element trees, relationships, and what counts as damage."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

from folio.sources.base import EXPANDED, Budget, Corrupt, Encrypted, TooLarge, Unsupported

# The signature of compound files, and the stream that encrypted packages hold in one.
COMPOUND, ENCRYPTION = bytes.fromhex("d0cf11e0a1b11ae1"), "EncryptionInfo".encode("utf-16-le")
# Nesting of elements that is damage, and what an element is charged besides its bytes.
DEEPEST, ELEMENT_COST = 256, 64
# Namespaces whose attributes are named r:..., in the transitional and the strict form.
REFERENCES = ("http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://purl.oclc.org/ooxml/officeDocument/relationships")
# Parts that readers load by name or by these relationship types, and so are XML whatever they are declared as.
NAMED_PARTS = set("xl/workbook.xml xl/sharedstrings.xml xl/styles.xml xl/theme/theme1.xml word/document.xml word/styles.xml word/numbering.xml ppt/presentation.xml".split())
CORE_TYPES = {"officeDocument", "worksheet", "sharedStrings", "styles", "theme"}
CONTENT_TYPES = "[Content_Types].xml"
_CHUNK = 1 << 16
#: What the zip reader raises over damage.
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError, ValueError, struct.error)


class Element:
    """An XML element by local names; text is its own character data. A missing child is an empty element."""

    __slots__ = ("name", "attrs", "children", "text")

    def __init__(self, name: str = "", attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children, self.text = name, attrs or {}, [], ""

    def __bool__(self) -> bool:
        return bool(self.name)

    def get(self, key: str) -> str:
        return self.attrs.get(key, "")

    def all(self, name: str) -> Iterator[Element]:
        return (c for c in self.children if c.name == name)

    def at(self, *path: str) -> Element:
        """The first child of each name in turn."""
        found = self
        for name in path:
            found = next(found.all(name), NOTHING)
        return found


NOTHING = Element()


def _local(name: str) -> str:
    space, _, local = name.rpartition("\n")
    return f"r:{local}" if space in REFERENCES else local


_TAG = re.compile(rb"<[A-Za-z_:][^\s/>]*(?:\s+[^\s=>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))+\s*/?>")
_ATTRIBUTE = re.compile(rb"\s+([^\s=>]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')")


def _without_repeats(raw: bytes) -> bytes:
    """Of attributes that a tag repeats, the last stays: the parser rejects the others."""

    def tag(m: re.Match) -> bytes:
        found = list(_ATTRIBUTE.finditer(m[0]))
        last = {a[1]: k for k, a in enumerate(found)}
        if len(last) == len(found):
            return m[0]
        drop = [a.span() for k, a in enumerate(found) if last[a[1]] != k]
        out, at = [], 0
        for a, b in drop:
            out.append(m[0][at:a])
            at = b
        return b"".join([*out, m[0][at:]])

    return _TAG.sub(tag, raw)


class _Parser:
    def __init__(self, part: str, budget: Budget, keep: bool):
        self.part, self.budget, self.keep = part, budget, keep
        self.stack = [Element("#document")]
        self.depth = 0
        self.expat = expat.ParserCreate(namespace_separator="\n")
        self.expat.StartElementHandler, self.expat.EndElementHandler = self._start, self._end
        self.expat.CharacterDataHandler = self._text if keep else None
        self.expat.EntityDeclHandler = self._entity

    def _start(self, name: str, attrs: dict[str, str]) -> None:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Corrupt(f"{self.part} is nested too deeply")
        if self.keep:
            self.budget.charge(ELEMENT_COST)
            element = Element(_local(name), {_local(k): v for k, v in attrs.items()})
            self.stack[-1].children.append(element)
            self.stack.append(element)

    def _end(self, name: str) -> None:
        self.depth -= 1
        if self.keep:
            self.stack.pop()

    def _text(self, data: str) -> None:
        self.stack[-1].text += data

    def _entity(self, *_) -> None:
        raise Corrupt(f"{self.part} declares entities")

    def feed(self, data: bytes, last: bool = False) -> None:
        try:
            self.expat.Parse(data, last)
        except expat.ExpatError as e:
            raise Corrupt(f"{self.part}: {e}") from e


class Package:
    """An open package whose reads are charged to the expansion limit."""

    def __init__(self, data: bytes, most: int):
        if data.startswith(COMPOUND):
            raise Encrypted("an encrypted document") if ENCRYPTION in data else Unsupported("a binary Office format")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except _BROKEN as e:
            raise Corrupt(f"no package: {e}") from e
        self.budget, self.most = Budget(EXPANDED, most), most
        self.parts: dict[str, zipfile.ZipInfo] = {}
        folded: set[str] = set()
        for info in self.zip.infolist():
            name = info.filename.replace("\\", "/")
            if name.lower() in folded:
                raise Corrupt(f"two parts are named {name}")
            folded.add(name.lower())
            if not name.endswith("/"):
                self.parts[name] = info
        self.folded = {n.lower(): n for n in self.parts}

    def declared_size(self) -> int:
        return sum(i.file_size for i in self.parts.values())

    def chunks(self, name: str, budget: Budget) -> Iterator[bytes]:
        try:
            with self.zip.open(self.parts[name]) as f:
                while data := f.read(_CHUNK):
                    budget.charge(len(data))
                    yield data
        except _BROKEN as e:
            raise Corrupt(f"{name}: {e}") from e

    def read(self, name: str, budget: Budget | None = None) -> Element | None:
        """The part's tree under a document element; None if there is no such part."""
        if name not in self.parts:
            return None
        budget = budget or self.budget
        raw = b"".join(self.chunks(name, budget))
        parser = _Parser(name, budget, True)
        try:
            parser.feed(raw, True)
        except Corrupt as e:
            if "duplicate attribute" not in str(e):
                raise
            parser = _Parser(name, Budget(EXPANDED, -1), True)
            parser.feed(_without_repeats(raw), True)
        return parser.stack[0]

    def need(self, name: str) -> Element:
        found = self.read(name) if name else None
        if found is None:
            raise Corrupt(f"part {name} is missing" if name else "a relationship has no target")
        return found

    def check(self, name: str) -> None:
        """Whether a part is well-formed: one root, and nothing but that; charged, without keeping a tree."""
        parser, empty = _Parser(name, self.budget, False), True
        for data in self.chunks(name, self.budget):
            parser.feed(data)
            empty = False
        if empty:
            raise Corrupt(f"{name} is empty")
        parser.feed(b"", True)

    def relations(self, part: str, budget: Budget | None = None) -> dict[str, tuple[str, str, bool]]:
        """(type, target, external) by id; targets inside are paths in the package."""
        folder, name = posixpath.split(part)
        root = self.read(posixpath.join(folder, "_rels", f"{name}.rels"), budget) or NOTHING
        out = {}
        for r in root.at("Relationships").children:
            outside = r.get("TargetMode") == "External"
            target = r.get("Target")
            out[r.get("Id")] = posixpath.basename(r.get("Type")), target if outside else resolved(folder, target), outside
        return out

    def _sniffs_as_xml(self, name: str) -> bool:
        try:
            with self.zip.open(self.parts[name]) as f:
                head = f.read(_CHUNK).removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")
                while not head and (more := f.read(_CHUNK)):
                    head = more.lstrip(b" \t\r\n")
        except _BROKEN:
            return False
        return head.startswith(b"<")

    def xml_parts(self) -> list[str]:
        """Parts to check as XML: declared as such, loaded by name, or named by relationships that readers follow.

        A core part that a relationship names must be there, under either way of reading
        backslashes and dots in its target.
        """
        free = Budget(EXPANDED, self.most)
        types, by_extension = {}, {}
        if CONTENT_TYPES in self.parts:
            self.check(CONTENT_TYPES)
            for item in self.read(CONTENT_TYPES, free).at("Types").children:
                is_xml = item.get("ContentType").strip().lower().endswith(("+xml", "/xml"))
                if item.name == "Default":
                    by_extension[item.get("Extension").lower()] = is_xml
                elif item.name == "Override":
                    types[item.get("PartName").removeprefix("/").lower()] = is_xml
        followed: dict[str, bool] = {}
        for rels in [n for n in self.parts if n.endswith(".rels")]:
            folder = posixpath.dirname(posixpath.dirname(rels))
            for r in self.read(rels, Budget(EXPANDED, self.most)).at("Relationships").children:
                if r.get("TargetMode") == "External":
                    continue
                core = posixpath.basename(r.get("Type")) in CORE_TYPES
                ways = {resolved(folder, r.get("Target").replace("\\", "/")), resolved(folder, r.get("Target"), clean_first=True)}
                if core and not any(w in self.parts or (w.lower() == "xl/sharedstrings.xml" and w.lower() in self.folded) for w in ways):
                    raise Corrupt(f"part {min(ways)} is missing")
                for w in ways:
                    followed[w] = followed.get(w, False) or core
        out = []
        for name in self.parts:
            lower, clean = name.lower(), posixpath.normpath(name)
            core = followed.get(name, followed.get(clean))
            declared = types.get(lower, by_extension.get(posixpath.splitext(lower)[1].lstrip("."), False))
            if name != CONTENT_TYPES and (declared or core or lower in NAMED_PARTS or name.endswith(".rels") or (core is False and self._sniffs_as_xml(name))):
                out.append(name)
        return out


def resolved(folder: str, target: str, clean_first: bool = False) -> str:
    """A target's path in the package; clean_first removes dot segments before backslashes become slashes."""
    if clean_first:
        target = (posixpath.normpath(target) if target else ".").replace("\\", "/")
        return target[1:] if target.startswith("/") else f"{folder}/{target}" if folder else target
    if target.startswith("/"):
        return posixpath.normpath(target).lstrip("/")
    return posixpath.normpath(posixpath.join(folder, target))


__all__ = ["Element", "NOTHING", "Package", "TooLarge", "resolved"]
