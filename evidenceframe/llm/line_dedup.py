"""Line dedup by site-relative frequency, with DataFrame functions only.

For each site, the number of pages that contain a line is divided by the site's number of pages;
lines above ``ratio`` are boilerplate there and are dropped from every page of the site.

A site of N pages with L lines a page on average has fewer than L / ratio such lines, however large
N is, so one row a site holds them. Counts are summed in the map tasks before they are shuffled,
and pages meet only their site's row: pages are shuffled, if at all, by a join that Spark splits
where a site is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RATIO = 0.1
#: A line that one page alone has is no repeat, whatever share of a small site that page is.
MIN_PAGES = 2

#: What is cut off both ends of a line before lines are compared.
_EDGE = " \t\r\x0b\x0c"


def line_keys(text: Column) -> Column:
    """The distinct lines of a text without the blanks around them; blank lines are left out."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_EDGE)))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def boilerplate_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): for each site with any, the hashes of its boilerplate lines."""
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    lines = docs.where(F.col("text").isNotNull()).select(F.col(host).alias("host"), F.explode(line_keys(F.col("text"))).alias("line"))
    # 96 bits stand for a line in the shuffle
    seen = lines.groupBy("host", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = seen.join(pages, seen.host.eqNullSafe(pages.host)).where(F.col("n") > ratio * F.col("pages")).select(seen.host, "h1", "h2")
    return over.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("h1", "h2"))).alias("lines"))


def _cleaned(docs: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """``docs`` without boilerplate lines in ``text``, with ``__n_lines`` and ``__n_dropped``."""
    drop = written(boilerplate_lines(docs, host, ratio, min_pages), "boilerplate").select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    joined = docs.join(drop, F.col(host).eqNullSafe(F.col("__host")), "left")
    lines = F.split(F.col("text"), "\n")
    key = lambda x: F.trim(x, F.lit(_EDGE))
    known = F.coalesce(F.col("__lines"), F.array().cast("array<struct<h1:bigint,h2:int>>"))
    kept = F.filter(lines, lambda x: ~F.array_contains(known, F.struct(F.xxhash64(key(x)).alias("h1"), F.hash(key(x)).alias("h2"))))
    return (
        joined.withColumn("__kept", kept)
        .withColumn("__n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint"))
        .withColumn("__n_dropped", F.when(F.col("text").isNull(), 0).otherwise(F.col("__n_lines") - F.size("__kept")).cast("bigint"))
        .withColumn("text", F.when(F.col("__n_dropped") > 0, F.array_join("__kept", "\n")).otherwise(F.col("text")))
        .drop("__host", "__lines", "__kept")
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, plus ``n_lines`` and ``n_dropped``.

    A page is one row; a line counts once a page. Lines are compared without the blanks around
    them; blank lines are never counted or dropped. A line must be on more than ``ratio`` of its
    site's pages and on ``min_pages`` at least. Rows with a null host form one site; null texts stay
    null with 0 lines; a text that loses all lines becomes empty. Repeated rows count as pages.
    Columns ``n_lines`` and ``n_dropped`` of ``docs`` are replaced.
    """
    cleaned = _cleaned(docs, host, ratio, min_pages).drop("n_lines", "n_dropped")
    return cleaned.withColumnsRenamed({"__n_lines": "n_lines", "__n_dropped": "n_dropped"})


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the same columns: texts without boilerplate lines, and ``n_chars``, if there, of those that lost any."""
    cleaned = _cleaned(docs, host, ratio, min_pages)
    if "n_chars" in docs.columns:
        now = F.when(F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", now.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(list_distinct(list_filter(
    list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> ''))) AS line
  FROM documents WHERE text IS NOT NULL),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
boiler AS (
  SELECT l.source, line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  GROUP BY l.source, line, pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * pages),
sets AS (SELECT source, list(line) AS lines FROM boiler GROUP BY source),
kept AS (
  SELECT d.*, string_split(text, chr(10)) AS before,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(s.lines, []), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS after
  FROM documents d LEFT JOIN sets s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, coalesce(len(before), 0) AS n_lines, coalesce(len(before) - len(after), 0) AS n_dropped, array_to_string(after, chr(10)) AS text
FROM kept
"""
