"""Conversion as a column and a DataFrame operator: sources of any format to Markdown with sections and errors.

What can be known without a source's bytes is settled in the JVM: the format, the source
limit, unknown formats. Only the rest crosses to Python, as Arrow batches, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import format_name, format_of
from folio.operators.split import CHUNK, chunk_array, exploded
from folio.plans.splitting import Options, split
from folio.sources.base import SOURCE, ConvertError, Registry, Source, TooLarge
from folio.sources.formats import all_formats

SECTION = "struct<kind: string, number: int, name: string, start: int, end: int>"
ERROR = "struct<class: string, limit: string, max: long, message: string>"
DOCUMENT = f"struct<markdown: string, sections: array<{SECTION}>, error: {ERROR}>"
_SECTION = pa.struct([("kind", pa.string()), ("number", pa.int32()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ERROR = pa.struct([("class", pa.string()), ("limit", pa.string()), ("max", pa.int64()), ("message", pa.string())])


def outcome(registry: Registry, fmt: str | None, source: Source) -> tuple[str | None, list[dict] | None, dict | None]:
    """(markdown, sections, error) of one source; of the first two and the last, one side is null."""
    try:
        d = registry.convert(fmt or "", source)
        return d.markdown, [vars(s) for s in d.sections], None
    except TooLarge as e:
        return None, None, {"class": e.kind, "limit": e.limit, "max": e.most, "message": str(e)}
    except ConvertError as e:
        return None, None, {"class": e.kind, "limit": None, "max": None, "message": str(e)}
    except (ArithmeticError, AttributeError, LookupError, RecursionError, TypeError, ValueError) as e:
        # A source that a converter has no word for: one row's error, not the job's.
        return None, None, {"class": "corrupt", "limit": None, "max": None, "message": f"{type(e).__name__}: {e}"}


def _sources(*columns: pa.Array) -> Iterator[tuple[str | None, Source | None]]:
    for fmt, data, name, charset, base in zip(*(c.to_pylist() for c in columns)):
        yield fmt, None if data is None else Source(data, name, charset, base)


def _documents(registry: Registry, *columns: pa.Array) -> list[tuple]:
    return [(None, None, None) if s is None else outcome(registry, fmt, s) for fmt, s in _sources(*columns)]


def _document_array(rows: list[tuple]) -> pa.StructArray:
    markdown, sections, error = zip(*rows) if rows else ((), (), ())
    arrays = [pa.array(markdown, pa.string()), pa.array(sections, pa.list_(_SECTION)), pa.array(error, _ERROR)]
    return pa.StructArray.from_arrays(arrays, names=["markdown", "sections", "error"])


def _text(c: Column | str | None) -> Column:
    return F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c


class Plan:
    """The columns that a conversion reads, with what is settled before Python."""

    def __init__(self, registry: Registry, content: Column | str, fmt: Column | str | None, name: Column | str | None, charset: Column | str | None, base_url: Column | str | None):
        data = (F.col(content) if isinstance(content, str) else content).cast("binary")
        self.format = format_name(_text(fmt)) if fmt is not None else format_of(_text(name))
        limits = {f: own.filled(registry.limits).effective().source for f, (_, own) in registry.converters.items()}
        # Null for a format without a converter.
        limit = F.try_element_at(F.create_map(*[x for f, most in limits.items() for x in (F.lit(f), F.lit(most).cast("long"))]), self.format) if limits else F.lit(None).cast("long")
        known = limit.isNotNull()
        large = (limit >= 0) & (F.octet_length(data) > limit)
        none = F.lit(None).cast("string")
        error = lambda kind, which, most, message: F.struct(F.lit(kind).alias("class"), which.alias("limit"), most.alias("max"), message.alias("message"))
        self.early = F.when(~known, error("unsupported", none, F.lit(None).cast("long"), F.concat(F.lit("no converter for '"), F.coalesce(self.format, F.lit("")), F.lit("'")))).when(
            large, error("too_large", F.lit(SOURCE), limit, F.concat(F.lit(f"{SOURCE} limit of "), limit.cast("string"), F.lit(" exceeded")))
        )
        self.read = [self.format, F.when(F.coalesce(known & ~large, F.lit(False)), data), _text(name), _text(charset), _text(base_url)]


def converted(content: Column | str, fmt: Column | str | None = None, name: Column | str | None = None, charset: Column | str | None = None, base_url: Column | str | None = None, registry: Registry | None = None) -> Column:
    """struct<markdown, sections, error> of sources (binary or string) whose format is given or is that of their name.

    A deterministic scalar: filters on other columns pass below it, and unused it is pruned
    away. Null content of a known format gives null fields. A conversion that fails has an
    error (its class, and the limit if one was exceeded) and no Markdown.
    """
    registry = registry or all_formats()
    plan = Plan(registry, content, fmt, name, charset, base_url)

    @F.arrow_udf(DOCUMENT)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield _document_array(_documents(registry, *columns))

    found = run(*plan.read)
    return F.struct(found["markdown"].alias("markdown"), found["sections"].alias("sections"), F.coalesce(plan.early, found["error"]).alias("error"))


def convert_documents(docs: DataFrame, content: str = "content", fmt: str | None = None, name: str | None = None, charset: str | None = None, base_url: str | None = None, registry: Registry | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the content unless named), markdown, sections and error of each row.

    A kept column of one of those names comes out with doc_ in front.
    """
    keep = [c for c in docs.columns if c != content] if keep is None else keep
    named = [F.col(c).alias(f"doc_{c}" if c in ("markdown", "sections", "error") else c) for c in keep]
    return docs.select(*named, converted(content, fmt, name, charset, base_url, registry).alias("_document")).select(*[c for c in _names(keep)], "_document.*")


def _names(keep: list[str]) -> list[str]:
    return [f"doc_{c}" if c in ("markdown", "sections", "error") else c for c in keep]


def convert_and_split(docs: DataFrame, options: Options, content: str = "content", fmt: str | None = None, name: str | None = None, charset: str | None = None, base_url: str | None = None, registry: Registry | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row for each chunk of each converted source: the kept columns, chunk_no, the chunk's fields and the sections that it meets.

    Bytes cross to Python once, and neither the Markdown nor the sections of whole documents come back.
    Sources that cannot be converted have no chunks; `convert_documents` tells why.
    """
    registry = registry or all_formats()
    plan = Plan(registry, content, fmt, name, charset, base_url)
    keep = [c for c in docs.columns if c != content] if keep is None else keep
    with_sections = CHUNK[:-1] + f", sections: array<{SECTION}>>"

    @F.arrow_udf(f"array<{with_sections}>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = []
            for markdown, sections, _ in _documents(registry, *columns):
                chunks = split(markdown, options) if markdown else []
                for c in chunks:
                    c["sections"] = [s for s in sections if max(s["start"], c["start"]) < min(s["end"], c["end"])]
                rows.append(chunks)
            yield chunk_array(rows, ("sections", pa.list_(_SECTION)))

    return exploded(docs, run(*plan.read), keep, extra=["sections"])


def golden_json(chunks: DataFrame, shown: Column | None = None) -> DataFrame:
    """One JSON object for each chunk, as `value`: Start, End, Length, Context unless empty, Text."""
    from folio.functions.text import context

    shown = shown if shown is not None else context(F.col("headings"), F.col("table_header"))
    fields = F.struct(F.col("start").alias("Start"), F.col("end").alias("End"), F.col("length").alias("Length"), F.nullif(shown, F.lit("")).alias("Context"), F.col("text").alias("Text"))
    return chunks.select(F.to_json(fields, {"ignoreNullFields": "true"}).alias("value"))
