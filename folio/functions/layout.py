"""Lines with sizes and styles with parents as relations: what the PDF and Word converters compute in a worker, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.pdf import HEADING_LENGTH, HEADING_LEVELS, HEADING_RATIO
from folio.sources.word import CHAIN


def headed(lines: DataFrame) -> DataFrame:
    """Lines (doc, page, line, text, size) with body_size, level (null for body text) and same_paragraph as the line before.

    The body size is the weighted mode by characters, the smaller on ties; sizes count in
    halves. Headings are larger, short and hold a letter; their sizes make levels.
    """
    rows = lines.withColumn("size", F.round(F.col("size") * 2) / 2)
    weight = rows.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("n"))
    body = weight.groupBy("doc").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))
    head = (F.col("size") >= HEADING_RATIO * F.col("body_size")) & (F.length("text") <= HEADING_LENGTH) & F.rlike("text", F.lit(r"\p{L}"))
    known = rows.join(body, "doc").withColumn("head", head)
    levels = known.where("head").groupBy("doc").agg(F.sort_array(F.collect_set("size"), False).alias("sizes"))  # a document's distinct sizes
    w = Window.partitionBy("doc", "page").orderBy("line")
    same = (F.lag("size").over(w) == F.col("size")) & (F.lag("head").over(w) == F.col("head"))
    level = F.when(F.col("head"), F.least(F.array_position("sizes", F.col("size")), F.lit(HEADING_LEVELS)))
    return known.join(levels, "doc", "left").select(*lines.columns, "body_size", level.alias("level"), F.coalesce(same, F.lit(False)).alias("same_paragraph"))


def inherited(styles: DataFrame) -> DataFrame:
    """(style, level) of styles (style, parent, level): the nearest level up the chain of parents, of at most CHAIN styles; 0 without one."""
    spark = styles.sparkSession
    styles.createOrReplaceTempView("folio_styles")
    return spark.sql(f"""
        WITH RECURSIVE chain(style, parent, level, n) AS (
          SELECT style, parent, level, 1 FROM folio_styles
          UNION ALL
          SELECT c.style, s.parent, s.level, c.n + 1 FROM chain c JOIN folio_styles s ON s.style = c.parent WHERE c.level IS NULL AND c.n < {CHAIN})
        SELECT style, coalesce(max(level), 0) AS level FROM chain GROUP BY style""")
