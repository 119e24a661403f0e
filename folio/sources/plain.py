"""Plain text, Markdown, JSON and CSV sources."""

from __future__ import annotations

from collections.abc import Iterator

from folio.sources import markup
from folio.sources.base import BadOption, Converter, Corrupt, Document, Limits, Source, bounded
from folio.sources.charset import decode, normalized


def text(fallback: str | None = None) -> Converter:
    """Decoded and normalised, else unchanged."""
    return lambda source, limits: bounded(normalized(decode(source.data, source.charset, fallback)), limits)


def json_text(fallback: str | None = None) -> Converter:
    """As text, in a fence."""
    return lambda source, limits: bounded(markup.fenced(normalized(decode(source.data, source.charset, fallback)), "json"), limits)


def records(text: str, comma: str = ",", lazy: bool = False) -> Iterator[list[str]]:
    """Records of comma-separated text; empty lines are none.

    A field in quotes may hold commas, line breaks and doubled quotes. A quote elsewhere
    is an error, as is text after a closing quote, unless lazy: then it is text.
    """
    at, n = 0, len(text)
    while at < n:
        if text[at] == "\n":
            at += 1
            continue
        record: list[str] = []
        while True:
            if at < n and text[at] == '"':
                value, at = _quoted(text, at + 1, comma, lazy)
            else:
                stop = min((k for k in (text.find(comma, at), text.find("\n", at)) if k >= 0), default=n)
                value, at = text[at:stop], stop
                if '"' in value and not lazy:
                    raise Corrupt('a bare " in a field without quotes')
            record.append(value)
            if at < n and text[at] == comma:
                at += 1
                continue
            at += 1
            break
        yield record


def _quoted(text: str, at: int, comma: str, lazy: bool) -> tuple[str, int]:
    """(value, where it ends) of a field whose opening quote is before at."""
    parts = []
    while True:
        quote = text.find('"', at)
        if quote < 0:
            if lazy:
                return "".join([*parts, text[at:]]), len(text)
            raise Corrupt("a quoted field has no end")
        parts.append(text[at:quote])
        after = text[quote + 1 : quote + 2]
        if after in ("", comma, "\n"):
            return "".join(parts), quote + 1
        if after != '"' and not lazy:
            raise Corrupt('text after a closing "')
        parts.append('"')
        at = quote + 2 if after == '"' else quote + 1


def csv(comma: str = ",", header: bool = True, lazy: bool = False, fallback: str | None = None) -> Converter:
    """A table of the records; without a header its header row is empty. Short records are filled up."""

    def convert(source: Source, limits: Limits) -> Document:
        if len(comma) != 1 or comma in '"\r\n\ufffd\0':
            raise BadOption(f"{comma!r} cannot separate fields")
        rows = list(records(normalized(decode(source.data, source.charset, fallback)), comma, lazy))
        return bounded(markup.table(rows, limits.output, promote=header), limits)

    return convert
