"""Markdown from worker-side values: cells, tables, paragraphs, fences and links. The column functions say the same in Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable

from folio.sources.base import OUTPUT, Budget

# White space of every trimming rule.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{SPACES}]+")
_LEADING = re.compile(r"^[ \t]*(?:([#>+*=|`~<_-])|([0-9]{1,9})([.)]))?", re.M)


def collapsed(text: str) -> str:
    """White space runs as one space, none at the ends."""
    return _RUN.sub(" ", text).strip(" ")


def cell(text: str) -> str:
    return collapsed(text).replace("\0", "").replace("\\", "\\\\").replace("|", "\\|")


def paragraph(text: str) -> str:
    """Lines that begin no Markdown structure: spaces in front go, markers get a backslash."""

    def marked(m: re.Match) -> str:
        if m[1]:
            return "\\" + m[1]
        return f"{m[2]}\\{m[3]}" if m[2] else ""

    return _LEADING.sub(marked, text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", ""))


def table(rows: Iterable[list[str]], most: int = -1, header: list[str] | None = None, promote: bool = True) -> str:
    """A table as wide as its widest row; rows of empty cells alone go. The header is given, the first row (promote), or empty."""
    budget = Budget(OUTPUT, most)
    body = []
    for row in rows:
        cells = [cell(c) for c in row]
        if any(cells):
            budget.charge(2 + 3 * len(cells) + sum(map(len, cells)))
            body.append(cells)
    if header is not None:
        head = [cell(c) for c in header]
    elif promote and body:
        head = body.pop(0)
    else:
        head = []
    width = max(map(len, [head, *body]))
    if not width:
        return ""
    lines = [head, ["---"] * width, *body]
    size = sum(2 + 3 * width + sum(len(c.encode()) for c in r) for r in (head, *body)) + 2 + 6 * width - 1
    Budget(OUTPUT, most).charge(size)
    return "\n".join("| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in lines)


def fence_for(text: str, char: str = "`") -> str:
    """A fence that no run in the text is as long as."""
    return char * max(3, 1 + max(map(len, re.findall(f"{char}+", text)), default=0))


def fenced(text: str, info: str = "") -> str:
    ticks = fence_for(text)
    return f"{ticks}{info}\n{text}{'' if text.endswith(chr(10)) else chr(10)}{ticks}"


def link(label: str, target: str) -> str:
    """A link whose label is on one line; a target may hold any character."""
    shown = collapsed(label).replace("[", "\\[").replace("]", "\\]")
    for bad, code in (("<", "%3C"), (">", "%3E"), ("\n", "%0A")):
        target = target.replace(bad, code)
    return f"[{shown}](<{target}>)"
