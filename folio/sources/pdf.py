"""PDF text: characters of pages, lines with a size and a box, headings and paragraphs."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from folio.sources import markup
from folio.sources.base import OUTPUT, PAGE_CHARS, PAGES, Budget, Converter, Corrupt, Document, Limits, Section, Source, TooLarge
from folio.sources.pdffile import File, Lexer, Name, Ref, Stream

# Defaults of the limits, and the rules of layout.
MOST_PAGES, MOST_CHARS = 10_000, 1 << 20
HEADING_RATIO, HEADING_LENGTH, HEADING_LEVELS, PARAGRAPH_GAP = 1.15, 60, 3, 0.8
#: Of the font size: how far a character reaches above and below its line, and from where on a gap is a space.
ASCENT, DESCENT, SPACE = 0.72, 0.21, 0.15
#: Forms within forms.
MOST_FORMS = 12
# Code points of names that the Unicode database spells otherwise, and the Windows code page's own.
GLYPHS = {"quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "quotedbl": '"', "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "hyphen": "-", "minus": "−", "space": " ", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "exclam": "!", "question": "?", "parenleft": "(", "parenright": ")", "bracketleft": "[", "bracketright": "]", "braceleft": "{", "braceright": "}", "slash": "/", "backslash": "\\", "underscore": "_", "ampersand": "&", "percent": "%", "numbersign": "#", "dollar": "$", "at": "@", "plus": "+", "equal": "=", "less": "<", "greater": ">", "asterisk": "*", "bar": "|", "asciitilde": "~", "asciicircum": "^", "grave": "`", "germandbls": "ß", "Euro": "€", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "section": "§", "paragraph": "¶", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "guillemotleft": "«", "guillemotright": "»", "exclamdown": "¡", "questiondown": "¿"}
_DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789"))
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "ring": "̊", "caron": "̌"}
_NARROW, _WIDE = set("iljtfrI.,;:!'|()[]{}/\\` ‘’"), set("mwMW@%—")


@lru_cache(4096)
def glyph(name: str) -> str:
    """The text of a glyph name; empty if it says none."""
    if name in GLYPHS:
        return GLYPHS[name]
    if name in _DIGITS:
        return _DIGITS[name]
    if len(name) == 1:
        return name
    if found := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name.split(".")[0]):
        return "".join(chr(int(found[1][k : k + 4], 16)) for k in range(0, len(found[1]), 4)) if found[1] else chr(min(int(found[2], 16), 0x10FFFF))
    if name[1:] in _ACCENTS and name[0].isalpha():
        return unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
    return glyph(name.split(".")[0]) if "." in name[1:] else ""


def _text(raw: bytes) -> str:
    return raw.decode("utf-16-be", "ignore")


def cmap(data: bytes) -> tuple[dict[int, str], int]:
    """(text by code, bytes of a code) of a ToUnicode map."""
    out: dict[int, str] = {}
    width, lexer, stack = 1, Lexer(data), []
    while (v := lexer.value()) is not None:
        if v == "endcodespacerange" and stack:
            width = max(len(x) for x in stack if isinstance(x, bytes)) if any(isinstance(x, bytes) for x in stack) else width
        elif v == "endbfchar":
            for code, to in zip(stack[::2], stack[1::2]):
                if isinstance(code, bytes) and isinstance(to, bytes):
                    out[int.from_bytes(code, "big")] = _text(to)
        elif v == "endbfrange":
            for low, high, to in zip(stack[::3], stack[1::3], stack[2::3]):
                if not isinstance(low, bytes) or not isinstance(high, bytes):
                    continue
                a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for k in range(min(b - a + 1, 1 << 16)):
                    if isinstance(to, list):
                        if k < len(to) and isinstance(to[k], bytes):
                            out[a + k] = _text(to[k])
                    elif isinstance(to, bytes) and to:
                        first = _text(to)
                        out[a + k] = first[:-1] + chr(min(ord(first[-1]) + k, 0x10FFFF)) if first else ""
        if isinstance(v, str) and not isinstance(v, Name):
            stack = []
        else:
            stack.append(v)
    return out, width


class Font:
    def __init__(self, file: File, info: dict):
        self.texts: dict[int, str] = {}
        self.width, self.widths, self.usual = 1, {}, None
        to_unicode = file.get(info.get("ToUnicode"))
        if isinstance(to_unicode, Stream):
            self.texts, self.width = cmap(file.bytes_of(to_unicode))
        if info.get("Subtype") == "Type0":
            self.width = 2
            below = file.dictionary(file.array(info.get("DescendantFonts"))[0]) if file.array(info.get("DescendantFonts")) else {}
            self.usual = _number(file.get(below.get("DW")), 1000) / 1000
            self._wide(file, file.array(below.get("W")))
            return
        self.width = 1
        descriptor = file.dictionary(info.get("FontDescriptor"))
        if "MissingWidth" in descriptor:
            self.usual = _number(file.get(descriptor["MissingWidth"]), 0) / 1000
        first = _number(file.get(info.get("FirstChar")), 0)
        scale = 1000
        if info.get("Subtype") == "Type3":
            matrix = file.array(info.get("FontMatrix"))
            scale = 1 / abs(_number(matrix[0], 0.001) or 0.001) if matrix else 1000
        self.widths = {int(first) + k: _number(file.get(w), 0) / scale for k, w in enumerate(file.array(info.get("Widths")))}
        self._encode(file, info)

    def _wide(self, file: File, spans: list) -> None:
        k = 0
        while k + 1 < len(spans):
            first, second = file.get(spans[k]), file.get(spans[k + 1])
            if isinstance(second, list):
                self.widths |= {int(_number(first, 0)) + i: _number(file.get(w), 0) / 1000 for i, w in enumerate(second)}
                k += 2
            else:
                w = _number(file.get(spans[k + 2]), 0) / 1000 if k + 2 < len(spans) else 0
                self.widths |= dict.fromkeys(range(int(_number(first, 0)), min(int(_number(second, 0)), 65535) + 1), w)
                k += 3

    def _encode(self, file: File, info: dict) -> None:
        encoding = file.get(info.get("Encoding"))
        rules = encoding if isinstance(encoding, dict) else {}
        base = str(file.get(rules.get("BaseEncoding")) if rules else encoding)
        page = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        known = self.texts
        texts = {c: bytes([c]).decode(page, "ignore") for c in range(256)}
        at = 0
        for item in file.array(rules.get("Differences")):
            item = file.get(item)
            if isinstance(item, Name):
                texts[at] = glyph(str(item)) or texts.get(at, "")
                at += 1
            elif isinstance(item, (int, float)):
                at = int(item)
        self.texts = texts | known

    def characters(self, raw: bytes) -> Iterator[tuple[str, float, bool]]:
        """(text, advance in font sizes, whether it is the one-byte space)"""
        for k in range(0, len(raw) - self.width + 1, self.width):
            code = int.from_bytes(raw[k : k + self.width], "big")
            text = self.texts.get(code, "")
            wide = self.widths.get(code, self.usual)
            if wide is None:
                c = text[:1]
                wide = 0.28 if c in _NARROW else 0.83 if c in _WIDE else 0.67 if c.isupper() else 0.55
            yield text, wide, self.width == 1 and code == 32


def _number(value, otherwise: float) -> float:
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else otherwise


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


@dataclass
class Line:
    page: int
    text: str = ""
    sizes: Counter = field(default_factory=Counter)
    top: float = -math.inf
    bottom: float = math.inf

    @property
    def size(self) -> float:
        """The size of most characters, the smaller on ties."""
        return min(self.sizes, key=lambda s: (-self.sizes[s], s))


class Lines:
    """Characters as they come, grouped into lines: a character that is not on its line's height begins the next."""

    def __init__(self, output: Budget, most_chars: int):
        self.lines: list[Line] = []
        self.output, self.most, self.page = output, most_chars, 0
        self.now: Line | None = None

    def begin(self, page: int) -> None:
        self.page, self.now, self.seen = page, None, 0

    def count(self, n: int) -> None:
        self.seen += n
        if 0 <= self.most < self.seen:
            raise TooLarge(PAGE_CHARS, self.most)

    def add(self, text: str, x: float, y: float, size: float, advance: float, dx: float, dy: float) -> None:
        """A character at (x, y) that moves by advance along the direction (dx, dy)."""
        self.count(len(text))
        along, across = x * dx + y * dy, y * dx - x * dy
        now = self.now
        if now is not None and abs(across - self.across) >= 0.5 * max(size, self.size):
            now = self.now = None
        if now is not None and abs(along - self.end) > SPACE * max(size, self.size):
            self.space = True
        shown = "".join(" " if c.isspace() or unicodedata.category(c) == "Cc" else c for c in text)
        self.end, self.across, self.size = along + advance, across, size
        if not shown.strip():
            self.space = True
            return
        if now is None:
            now = self.now = Line(self.page)
            self.lines.append(now)
            self.space = False
        shown = shown.strip(" ")
        if self.space and now.text:
            now.text += " "
            self.output.charge(1)
        self.space = False
        now.text += shown
        self.output.charge(len(shown.encode("utf-8", "replace")))
        now.sizes[round(size * 2) / 2] += len(shown)
        now.top, now.bottom = max(now.top, y + ASCENT * size), min(now.bottom, y - DESCENT * size)


class Page:
    """Runs a page's content and hands its characters on."""

    def __init__(self, file: File, out: Lines):
        self.file, self.out, self.fonts = file, out, {}

    def font(self, ref) -> Font | None:
        info = self.file.dictionary(ref)
        if not info:
            return None
        key = ref if isinstance(ref, Ref) else id(info)
        if key not in self.fonts:
            self.fonts[key] = Font(self.file, info)
        return self.fonts[key]

    def run(self, content: bytes, resources: dict, base: tuple = (1, 0, 0, 1, 0, 0), depth: int = 0) -> None:
        fonts, forms = self.file.dictionary(resources.get("Font")), self.file.dictionary(resources.get("XObject"))
        state = {"m": base, "font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}
        stack: list[dict] = []
        line = text = (1, 0, 0, 1, 0, 0)

        def show(raw: bytes) -> None:
            nonlocal text
            font, size = state["font"], state["size"]
            if font is None:
                return
            wide = state["Tz"] / 100
            for c, w, is_space in font.characters(raw):
                whole = _times((size * wide, 0, 0, size, 0, state["Ts"]), _times(text, state["m"]))
                height = math.hypot(whole[2], whole[3])
                length = math.hypot(whole[0], whole[1]) or 1.0
                move = (w * size + state["Tc"] + (state["Tw"] if is_space else 0)) * wide
                unit = length / (abs(size * wide) or 1.0)
                if c and height:
                    self.out.add(c, whole[4], whole[5], height, w * size * wide * unit, whole[0] / length, whole[1] / length)
                text = _times((1, 0, 0, 1, move, 0), text)

        def to_next(x: float, y: float) -> None:
            nonlocal line, text
            line = text = _times((1, 0, 0, 1, x, y), line)

        for op, args in Lexer(content).operations():
            numbers = [a for a in args if isinstance(a, (int, float))]
            if op in ("Tj", "'", '"'):
                if op != "Tj":
                    if op == '"' and len(numbers) >= 2:
                        state["Tw"], state["Tc"] = numbers[:2]
                    to_next(0, -state["TL"])
                if args and isinstance(args[-1], bytes):
                    show(args[-1])
            elif op == "TJ" and args and isinstance(args[-1], list):
                for part in args[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, (int, float)):
                        text = _times((1, 0, 0, 1, -part / 1000 * state["size"] * state["Tz"] / 100, 0), text)
            elif op == "BT":
                line = text = (1, 0, 0, 1, 0, 0)
            elif op == "Tf" and len(args) >= 2 and numbers:
                state["font"], state["size"] = self.font(fonts.get(str(args[0]))), numbers[-1]
            elif op in ("Td", "TD") and len(numbers) >= 2:
                if op == "TD":
                    state["TL"] = -numbers[1]
                to_next(*numbers[:2])
            elif op == "T*":
                to_next(0, -state["TL"])
            elif op == "Tm" and len(numbers) >= 6:
                line = text = tuple(numbers[:6])
            elif op in ("Tc", "Tw", "Tz", "TL", "Ts") and numbers:
                state[op] = numbers[0]
            elif op == "cm" and len(numbers) >= 6:
                state["m"] = _times(tuple(numbers[:6]), state["m"])
            elif op == "q":
                stack.append(dict(state))
            elif op == "Q" and stack:
                state = stack.pop()
            elif op == "Do" and args and depth < MOST_FORMS:
                form = self.file.get(forms.get(str(args[0])))
                if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                    matrix = [_number(self.file.get(v), 0) for v in self.file.array(form.info.get("Matrix"))]
                    inner = _times(tuple(matrix), state["m"]) if len(matrix) == 6 else state["m"]
                    own = self.file.dictionary(form.info.get("Resources")) or resources
                    self.run(self.file.bytes_of(form), own, inner, depth + 1)


def pages(file: File, most: int) -> list[tuple[dict, dict]]:
    """(page, resources) in order; resources may come from a node above."""
    out: list[tuple[dict, dict]] = []
    stack, seen = [(file.root.get("Pages"), {})], set()
    while stack:
        ref, above = stack.pop()
        if isinstance(ref, Ref):
            if ref in seen:
                continue
            seen.add(ref)
        node = file.dictionary(ref)
        resources = file.dictionary(node.get("Resources")) or above
        kids = file.get(node.get("Kids"))
        if isinstance(kids, list):
            stack.extend((k, resources) for k in reversed(kids))
        elif node:
            out.append((node, resources))
            if 0 <= most < len(out):
                raise TooLarge(PAGES, most)
    return out


def layout(lines: list[Line], n_pages: int, headings: bool, limits: Limits) -> Document:
    """Markdown of lines: large ones are headings by size, neighbours of one size and kind make a paragraph; a section for each page."""
    weight: Counter = Counter()
    for x in lines:
        for s, n in x.sizes.items():
            weight[s] += n
    body = min(weight, key=lambda s: (-weight[s], s), default=0)
    is_head = [headings and x.size >= HEADING_RATIO * body and len(x.text) <= HEADING_LENGTH and any(c.isalpha() for c in x.text) for x in lines]
    levels = {s: min(k, HEADING_LEVELS) for k, s in enumerate(sorted({x.size for x, h in zip(lines, is_head) if h}, reverse=True), 1)}
    blocks: list[tuple[int, str]] = []
    group: list[str] = []
    before: tuple[Line, bool] | None = None

    def flush() -> None:
        if before is not None:
            line, head = before
            blocks.append((line.page, f"{'#' * levels[line.size]} {' '.join(group)}" if head else markup.paragraph("\n".join(group))))

    for x, head in zip(lines, is_head):
        if before is not None:
            last, was = before
            near = last.bottom - x.top <= PARAGRAPH_GAP * (x.top - x.bottom) and x.top <= last.top
            if (last.page, last.size, was) == (x.page, x.size, head) and near:
                group.append(x.text)
                before = x, head
                continue
        flush()
        group, before = [x.text], (x, head)
    flush()
    budget, at, spans = Budget(OUTPUT, limits.output), 0, {}
    for k, (page, block) in enumerate(blocks):
        size, gap = len(block.encode()), 2 if k else 0
        budget.charge(size + gap)
        spans[page] = spans.get(page, (at + gap,))[0], at + gap + size
        at += gap + size
    sections, after = [], at
    for page in range(n_pages, 0, -1):
        start, end = spans.get(page, (after, after))
        sections.append(Section("page", page, "", start, end))
        after = start
    return Document("\n\n".join(b for _, b in blocks), tuple(reversed(sections)))


def pdf(headings: bool = True, most_pages: int = MOST_PAGES, most_chars: int = MOST_CHARS) -> Converter:
    """A section for each page. Text that is drawn as text is read; images are not."""

    def convert(source: Source, limits: Limits) -> Document:
        try:
            file = File(source.data, limits.expanded)
            found = pages(file, most_pages)
            if not found:
                raise Corrupt("the file has no pages")
            lines = Lines(Budget(OUTPUT, limits.output), most_chars)
            for number, (page, resources) in enumerate(found, 1):
                lines.begin(number)
                streams = [s for s in map(file.get, file.array(page.get("Contents"))) if isinstance(s, Stream)]
                Page(file, lines).run(b"\n".join(map(file.bytes_of, streams)), resources)
        except (RecursionError, ValueError, IndexError, TypeError, KeyError, OverflowError, AttributeError) as e:
            raise Corrupt(f"the file cannot be read: {e}") from e
        return layout([x for x in lines.lines if x.text], len(found), headings, limits)

    return convert
