"""Layout blocks (source, ord, block_id, type, text, page, box, source_kind): regions, headings, sources, boxes.

One document's blocks are a window partition; nothing leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Which parser output is trusted first.
SOURCE_PRIORITY = {
    "content_list": 130, "content_list_v2": 125, "pdf_info": 110, "layout": 105,
    "block_list": 105, "model": 80, "nested_content": 40, "unknown": 10,
}


def _order() -> Window:
    return Window.partitionBy("source").orderBy("ord")


def title_regions(blocks: DataFrame) -> DataFrame:
    """Add title_region: a run of headings opens a region that lasts until the next run; null before the first."""
    heading = F.col("type") == "heading"
    opens = heading & ~F.coalesce(F.lag(heading).over(_order()), F.lit(False))
    region = F.sum(opens.cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("title_region", F.nullif(region, F.lit(0)).cast("int"))


def heading_context(blocks: DataFrame) -> DataFrame:
    """Add heading_block and heading_text: for a text block that follows headings, the last one with text.

    Any other block between them, text or not, ends the heading's reach.
    """
    heading = F.col("type") == "heading"
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    named = heading & (strip(F.coalesce("text", F.lit(""))) != "")
    latest = F.last(F.when(named, F.struct("ord", "block_id", strip(F.col("text")).alias("text"))), ignorenulls=True).over(before)
    barrier = F.max(F.when(~heading, F.col("ord"))).over(before)
    return (
        blocks.withColumn("__h", latest).withColumn("__b", barrier)
        .withColumn("__reach", (F.col("type") == "text") & F.col("__h").isNotNull() & (F.col("__b").isNull() | (F.col("__h.ord") > F.col("__b"))))
        .withColumn("heading_block", F.when(F.col("__reach"), F.col("__h.block_id")))
        .withColumn("heading_text", F.when(F.col("__reach"), F.col("__h.text")))
        .drop("__h", "__b", "__reach")
    )


def source_priority(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SOURCE_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(kind, F.lit("unknown"))), F.lit(SOURCE_PRIORITY["unknown"]))


def has_text() -> Column:
    """Whether a block is a text, heading or formula with a page and text."""
    return F.col("type").isin("text", "heading", "formula") & F.col("page").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"\S")


def usable_text(blocks: DataFrame) -> DataFrame:
    """Blocks of text, headings and formulas that have a page and text, with their kind of source as ``__kind``."""
    return blocks.where(has_text()).withColumn("__kind", F.coalesce("source_kind", F.lit("unknown")))


def best_kinds(usable: DataFrame) -> DataFrame:
    """(source, __kind): the best kind of source of each document.

    Best is the highest priority, then more boxes, then more blocks, then the kind seen first.
    """
    groups = usable.groupBy("source", "__kind").agg(F.count("box").alias("boxes"), F.count("*").alias("n"), F.min("ord").alias("first"))
    rank = F.struct(source_priority(F.col("__kind")), "boxes", "n", -F.col("first"))
    return groups.groupBy("source").agg(F.max_by("__kind", rank).alias("__kind"))


def best_source_kind(blocks: DataFrame) -> DataFrame:
    """Blocks with a page and text of the best kind of source in each document."""
    usable = usable_text(blocks)
    return usable.join(best_kinds(usable), ["source", "__kind"], "left_semi").drop("__kind")


def consensus_boxes(blocks: DataFrame, *by: str) -> DataFrame:
    """(by, box, n): the box that most blocks of a group have, to three places; then the smallest, then the first."""
    box = F.transform("box", lambda x: F.round(x.cast("double"), 3))
    area = lambda b: F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))
    counted = blocks.where("box is not null").select(*by, "ord", box.alias("box")).groupBy(*by, "box").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = counted.groupBy(*by).agg(F.max_by(F.struct("box", "n"), F.struct(F.col("n").alias("n"), (-area(F.col("box"))).alias("a"), (-F.col("first")).alias("f"))).alias("b"))
    return best.select(*by, "b.box", "b.n")


def diagnostics(blocks: DataFrame) -> DataFrame:
    """(source, page, type, n, with_box, with_text): counts of blocks by page and type."""
    return blocks.groupBy("source", "page", "type").agg(
        F.count("*").alias("n"), F.count("box").alias("with_box"), F.count_if(strip(F.coalesce("text", F.lit(""))) != "").alias("with_text")
    )
