"""The registry of all formats."""

from __future__ import annotations

from folio.sources import plain
from folio.sources.base import Limits, Registry
from folio.sources.pdf import pdf
from folio.sources.sheets import xlsx
from folio.sources.slides import pptx
from folio.sources.webpage import html
from folio.sources.word import docx


def all_formats(limits: Limits = Limits(), fallback: str | None = None, **own: dict) -> Registry:
    """Text, Markdown, JSON, HTML, CSV, Word, PowerPoint, Excel and PDF.

    own: options by format, as csv={"comma": ";"}; "limits" among them fills that format's
    zero limits before the shared ones do, and fallback is a text format's charset.
    """
    out = Registry(limits)
    shared = {"fallback": fallback}
    for make, names, defaults in (
        (plain.text, ("txt", "md"), shared),
        (plain.json_text, ("json",), shared),
        (html, ("html",), shared),
        (plain.csv, ("csv",), shared),
        (docx, ("docx",), {}),
        (pptx, ("pptx",), {}),
        (xlsx, ("xlsx",), {}),
        (pdf, ("pdf",), {}),
    ):
        options = defaults | {k: v for name in names for k, v in own.get(name, {}).items()}
        limits_of = options.pop("limits", Limits())
        out.register(make(**options), *names, limits=limits_of)
    return out
