"""Text and Markdown functions as native columns: they stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every trimming rule, as the inside of a regular expression class.
SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Format names and their aliases.
ALIASES = {"markdown": "md", "htm": "html", "yml": "yaml", "text": "txt"}


def format_name(name: Column) -> Column:
    """A format name without white space around it and a leading dot, in lower case, its alias resolved."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(name, f"^[{SPACES}]+|[{SPACES}]+$", ""), r"^\.", ""))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, bare), bare)


def format_of(path: Column) -> Column:
    """Format of a file name: what follows the base name's last dot, which is neither its first nor its last character; else null."""
    found = F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1)
    return F.when(found != "", format_name(found))


def normalized(text: Column) -> Column:
    """Without one leading byte order mark and without NUL, lines ended by LF."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, r"^\x{FEFF}", ""), r"\r\n?", "\n"), F.lit("\0"), F.lit(""))


def measured_length(text: Column) -> Column:
    """Code points, CR LF counting as one."""
    return F.length(F.replace(text, F.lit("\r\n"), F.lit("\n"))).cast("long")


def longest_run(text: Column, char: str = "`") -> Column:
    """Length of the longest run of a character, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({char}+)")), F.length)), F.lit(0))


def fenced(text: Column, info: str = "") -> Column:
    """A code block whose fence is longer than any backtick run in it."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_run(text) + 1))
    end = F.when(F.endswith(text, F.lit("\n")) | (text == ""), "").otherwise("\n")
    return F.concat(fence, F.lit(f"{info}\n"), text, end, fence)


def cell(text: Column) -> Column:
    """A table cell's text: white space collapsed, NUL dropped, backslashes and pipes escaped."""
    flat = F.regexp_replace(F.regexp_replace(text, f"[{SPACES}]+", " "), "^ | $", "")
    return F.replace(F.replace(F.replace(flat, F.lit("\0"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def paragraph(text: Column) -> Column:
    """Text whose lines start no Markdown structure: leading blanks go, a leading marker gets a backslash."""
    plain = F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\0"), F.lit(""))
    flush = F.regexp_replace(plain, r"(?m)^[ \t]+", "")
    marked = F.regexp_replace(flush, r"(?m)^([#>\-+*=|`~<_])", r"\\$1")
    return F.regexp_replace(marked, r"(?m)^([0-9]{1,9})([.)])", r"$1\\$2")


def _filled(rows: Column) -> Column:
    """Rows that have a cell with text, escaped."""
    return F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))


def gfm_table(rows: Column) -> Column:
    """array<array<string>> as a table whose first row is the header; rows are padded to the widest; empty for no rows."""
    full = _filled(rows)
    width = F.array_max(F.transform(full, F.size))
    lines = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    out = F.concat(F.get(lines, F.lit(0)), F.lit("\n"), F.array_join(F.concat(F.array(rule), F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1))), "\n"))
    return F.when(F.size(full) > 0, out).otherwise("")


def gfm_table_size(rows: Column) -> Column:
    """Bytes of that table, without rendering it: rows * (2 + 3 * width) + cells + 2 + 6 * width - 1."""
    full = _filled(rows)
    width = F.array_max(F.transform(full, F.size))
    cells = F.aggregate(F.flatten(full), F.lit(0).cast("long"), lambda n, c: n + F.octet_length(c))
    return F.when(F.size(full) > 0, F.size(full) * (2 + 3 * width) + cells + 2 + 6 * width - 1).otherwise(0).cast("long")


def context(headings: Column, table_header: Column) -> Column:
    """A chunk's heading path and table header; empty parts add nothing."""
    path = F.array_join(F.transform(headings, lambda h: h["text"]), " > ")
    return F.concat_ws("\n", F.nullif(path, F.lit("")), F.nullif(table_header["text"], F.lit("")))


def text_with_context(text: Column, headings: Column, table_header: Column) -> Column:
    head = context(headings, table_header)
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def sections_in(sections: Column, start: Column, end: Column) -> Column:
    """Sections that overlap [start, end), in order; empty ranges overlap nothing."""
    return F.filter(sections, lambda s: (start < end) & (s["start"] < s["end"]) & (s["start"] < end) & (start < s["end"]))


def within_limit(text: Column, most: int) -> Column:
    """Whether a source is of so many bytes at most; a negative limit is none."""
    return F.lit(True) if most < 0 else F.octet_length(text) <= most
