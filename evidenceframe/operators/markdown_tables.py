"""Tables inside text: where they are, what they hold, and the text without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import html_table_markdown

# An HTML table, and lines that hold a pipe, one after another. A greedy group that repeats takes Java's
# stack line by line, and overflows on long tables; a possessive one does not, and as nothing after it can fail it finds the same.
HTML = r"(?is)<table\b.*?</table>"
PIPES = r"(?<![^\n])[^\n|]*+\|[^\n]*+(?:\n[^\n|]*+\|[^\n]*+)*+\n?"


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, raw) of the matches, in code points: pieces between them are what a split leaves."""
    raws, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(pieces, raws, lambda p, r: F.struct(F.length(p).alias("before"), F.length(F.coalesce(r, F.lit(""))).alias("n"), r.alias("raw")))
    zero = F.array().cast("array<struct<start:int,end:int,raw:string>>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
    add = lambda acc, x: F.when(x["raw"].isNull(), acc).otherwise(
        F.concat(acc, F.array(F.struct((last(acc) + x["before"]).alias("start"), (last(acc) + x["before"] + x["n"]).alias("end"), x["raw"].alias("raw")))).cast("array<struct<start:int,end:int,raw:string>>")
    )
    return F.aggregate(lengths, zero, add)


def clean_lines(raw: Column) -> Column:
    """Lines without the blanks around them; blank ones are left out."""
    return F.filter(F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def is_table(lines: Column) -> Column:
    """At least two lines, all with a pipe, and a rule among the first three."""
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: x.contains("|")) & F.exists(F.slice(lines, 1, 3), lambda x: x.contains("---"))


def is_table_like(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return text.rlike(r"(?i)<table\b") | is_table(F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+", "") != ""))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def table_blocks(text: Column) -> Column:
    """Array of (start, end, raw, kind, markdown) in order: HTML tables, and markdown ones that overlap none."""
    text = F.coalesce(text, F.lit(""))
    block = lambda x, kind, md: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["raw"].alias("raw"), F.lit(kind).alias("kind"), md.alias("markdown"))
    html = F.filter(F.transform(spans(text, HTML), lambda x: block(x, "html", html_table_markdown(x["raw"]))), lambda x: x["markdown"] != "")
    plain = F.filter(F.transform(spans(text, PIPES), lambda x: block(x, "markdown", F.array_join(clean_lines(x["raw"]), "\n"))), lambda x: is_table(clean_lines(x["raw"])))
    free = F.filter(plain, lambda x: ~F.exists(html, lambda h: overlaps(x, h)))
    return F.array_sort(F.concat(html, free))


def without_tables(text: Column, blocks: Column) -> Column:
    """The text with a line break in place of each block (start, end), which are in order."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, b: F.struct(b["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, b["start"] - acc["at"]), F.lit("\n")).alias("out"))
    return F.aggregate(blocks, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
