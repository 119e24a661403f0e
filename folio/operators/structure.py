"""What the splitter sees in a text, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.plans import lines as md
from folio.plans import splitting

RANKS = {"enclosed": splitting.ENCLOSED, "space": splitting.SPACE, "clause": splitting.CLAUSE, "sentence": splitting.SENTENCE, "line": splitting.LINE, "block": splitting.BLOCK}


def line_kinds(text: Column) -> Column:
    """array<struct<start, end, kind>> of a text's lines, in code points; a null gives null."""

    @F.arrow_udf("array<struct<start: int, end: int, kind: string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [None if t is None else [{"start": x.start, "end": x.end, "kind": x.kind} for x in md.structure(t).lines] for t in batch.to_pylist()]
            yield pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))

    return run(text)


def boundary_counts(text: Column) -> Column:
    """struct of how many positions within a text's lines have each rank; breaks between lines are left out, as is the end."""

    @F.arrow_udf("struct<" + ", ".join(f"{k}: long" for k in RANKS) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                layout = splitting.Layout(t or "")
                inner = layout.ranks.copy()
                inner[[x.start for x in layout.structure.lines]] = splitting.NONE
                n = np.bincount(np.maximum(inner, splitting.NONE).astype(int), minlength=splitting.BLOCK + 1)
                rows.append({k: int(n[v]) for k, v in RANKS.items()})
            yield pa.array(rows, pa.struct([(k, pa.int64()) for k in RANKS]))

    return run(text)


def soft_wraps(text: Column) -> Column:
    """How many line breaks of a text only wrap a sentence; a null gives null."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                lines = [t[x.start : x.end] for x in md.split_lines(t)] if t is not None else []
                out.append(None if t is None else sum(splitting.soft_wrap(a, b) for a, b in zip(lines, lines[1:])))
            yield pa.array(out, pa.int64())

    return run(text)
