"""What all formats share: a source, its document and sections, limits, errors and the registry of formats."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

MIB = 1 << 20
# Names of limits and their defaults in bytes.
SOURCE, EXPANDED, OUTPUT, PAGES, PAGE_CHARS = "source", "expanded", "output", "pages", "page_chars"
DEFAULTS = {SOURCE: 32 * MIB, EXPANDED: 128 * MIB, OUTPUT: 64 * MIB}
# Format names and their aliases.
ALIASES = {"markdown": "md", "htm": "html", "yml": "yaml", "text": "txt"}


class ConvertError(Exception):
    """A conversion that failed; kind is unsupported, corrupt, encrypted, too_large or config."""

    kind = "corrupt"


class Unsupported(ConvertError):
    kind = "unsupported"


class Corrupt(ConvertError):
    kind = "corrupt"


class Encrypted(ConvertError):
    kind = "encrypted"


class BadOption(ConvertError):
    kind = "config"


class TooLarge(ConvertError):
    kind = "too_large"

    def __init__(self, limit: str, most: int):
        super().__init__(f"{limit} limit of {most} exceeded")
        self.limit, self.most = limit, most


@dataclass(frozen=True)
class Limits:
    """Bytes that one conversion may read, expand to and write: 0 takes the default, a negative number lifts the limit."""

    source: int = 0
    expanded: int = 0
    output: int = 0

    def effective(self) -> Limits:
        """With defaults in place; -1 is no limit."""
        return Limits(**{k: DEFAULTS[k] if v == 0 else max(v, -1) for k, v in vars(self).items()})

    def filled(self, shared: Limits) -> Limits:
        """Zero fields taken from shared limits."""
        return Limits(**{k: v or getattr(shared, k) for k, v in vars(self).items()})


@dataclass(frozen=True)
class Source:
    """One document to convert. A declared charset counts only if it is known; base_url resolves links in HTML."""

    data: bytes
    name: str | None = None
    charset: str | None = None
    base_url: str | None = None


@dataclass(frozen=True)
class Section:
    """A page, slide or sheet: its number from 1, its name and its bytes in the Markdown."""

    kind: str
    number: int
    name: str
    start: int
    end: int


@dataclass(frozen=True)
class Document:
    markdown: str = ""
    sections: tuple[Section, ...] = ()

    def sections_in(self, start: int, end: int) -> list[Section]:
        """Sections that share a byte with [start, end); empty ones never do."""
        return [s for s in self.sections if max(s.start, start) < min(s.end, end)]


class Budget:
    """Bytes that may still be spent under one limit."""

    def __init__(self, name: str, most: int):
        self.name, self.most, self.spent = name, most, 0

    def charge(self, n: int) -> None:
        self.spent += n
        if 0 <= self.most < self.spent:
            raise TooLarge(self.name, self.most)

    @property
    def left(self) -> int:
        return -1 if self.most < 0 else self.most - self.spent


@dataclass
class _Open:
    kind: str
    number: int
    name: str = ""


class Blocks:
    """Markdown blocks with a blank line between them, under the output limit, and the sections they belong to."""

    def __init__(self, most: int):
        self.budget, self.parts, self.sections, self.at = Budget(OUTPUT, most), [], [], 0
        self.begun: int | None = None

    @property
    def gap(self) -> int:
        return 2 if self.parts else 0

    def room(self) -> int:
        """Bytes that the next block may have; -1 without a limit."""
        return -1 if self.budget.most < 0 else max(self.budget.left - self.gap, 0)

    def fit(self, make: Callable[[int], str]) -> str:
        """What make gives for the room there is; the error names the whole limit."""
        try:
            return make(self.room())
        except TooLarge:
            raise TooLarge(OUTPUT, self.budget.most) from None

    def add(self, block: str) -> None:
        """An empty block adds nothing."""
        if not block:
            return
        size = len(block.encode())
        self.budget.charge(size + self.gap)
        if self.begun is None:
            self.begun = self.at + self.gap
        self.at += size + self.gap
        self.parts.append(block)

    @contextmanager
    def in_section(self, kind: str, number: int) -> Iterator[_Open]:
        """Blocks that are added within make the section; its name may be set until the end."""
        section, self.begun = _Open(kind, number), None
        yield section
        start = self.at if self.begun is None else self.begun
        self.sections.append(Section(kind, number, section.name, start, self.at))

    def document(self) -> Document:
        return Document("\n\n".join(self.parts), tuple(self.sections))


Converter = Callable[[Source, Limits], Document]


def bounded(markdown: str, limits: Limits) -> Document:
    """A document without sections, under the output limit."""
    if markdown:
        Budget(OUTPUT, limits.output).charge(len(markdown.encode()))
    return Document(markdown)


def format_name(name: str) -> str:
    """A format's name without space around it and a leading dot, in lower case, its alias resolved."""
    bare = name.strip().removeprefix(".").lower()
    return ALIASES.get(bare, bare)


def format_of(path: str) -> str | None:
    """The format that a file name's extension says; a dot at either end of the base name is none."""
    found = re.search(r"[^/\\]\.([^./\\]+)$", path)
    return format_name(found[1]) if found else None


@dataclass
class Registry:
    """Converters by format. A later registration replaces an earlier one."""

    limits: Limits = field(default_factory=Limits)
    converters: dict[str, tuple[Converter, Limits]] = field(default_factory=dict)

    def register(self, converter: Converter, *formats: str, limits: Limits = Limits()) -> Registry:
        if not callable(converter):
            raise TypeError("a converter is a function of a source and limits")
        for f in formats:
            self.converters[format_name(f)] = converter, limits
        return self

    def lookup(self, name: str) -> Converter | None:
        found = self.converters.get(format_name(name))
        return found and found[0]

    def formats(self) -> list[str]:
        return sorted(self.converters)

    def convert(self, name: str, source: Source) -> Document:
        """The document; a ConvertError if the format is unknown, a limit is exceeded or the source cannot be read."""
        found = self.converters.get(format_name(name))
        if found is None:
            raise Unsupported(f"no converter for {format_name(name)!r}")
        converter, own = found
        limits = own.filled(self.limits).effective()
        Budget(SOURCE, limits.source).charge(len(source.data))
        try:
            return converter(source, limits)
        except ConvertError as e:
            if source.name and not isinstance(e, TooLarge):
                raise type(e)(f"{source.name}: {e}") from e
            raise

    def with_limits(self, limits: Limits) -> Registry:
        return replace(self, limits=limits, converters=dict(self.converters))
