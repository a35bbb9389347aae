"""Chunks of texts and tables, nodes and their identity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import point_id, strip
from ..settings import DEFAULTS, Settings


#: Texts that are read at a time in a task.
STEP = 256
#: What the regular expression \s takes for blank.
BLANKS = " \t\n\x0b\f\r"


def sliding_chunks(text: str, s: Settings = DEFAULTS) -> list[tuple[int, int, str]]:
    """(char_start, char_end, text): windows with overlap over the stripped text.

    Short pieces are dropped unless they end the text; the last window is the first to reach the end.
    """
    body = text.strip(BLANKS)
    n, step = len(body), s.chunk_size - s.chunk_overlap
    windows = 1 - (-max(0, n - s.chunk_size) // step)
    cut = [(a, min(a + s.chunk_size, n), body[a : a + s.chunk_size].strip(BLANKS)) for a in range(0, windows * step, step)]
    return [c for c in cut if len(c[2]) >= s.chunk_min or (c[1] == n and c[2])]


def chunk_documents(docs: DataFrame, s: Settings = DEFAULTS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, chunk_index, char_start, char_end, text); the index counts chunks that are kept."""
    kept = docs.select("doc_id", *carried, "text")
    names = ("doc_id", *carried)

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, STEP):
                batch = whole.slice(first, STEP)
                found = [(row, i, *c) for row, text in enumerate(batch.column("text").to_pylist()) if text for i, c in enumerate(sliding_chunks(text, s))]
                if found:
                    rows, *columns = zip(*found, strict=True)
                    own = [batch.column(c).take(pa.array(rows)) for c in names]
                    ints = [pa.array(c, pa.int32()) for c in columns[:3]]
                    yield pa.RecordBatch.from_arrays([*own, *ints, pa.array(columns[3], pa.string())], names=[*names, "chunk_index", "char_start", "char_end", "text"])

    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names)
    return kept.mapInArrow(run, f"{kinds}, chunk_index int, char_start int, char_end int, text string")


def text_nodes(docs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Chunks as nodes with ids; three chunks make a page. ``origin`` is the source of the document, if it has one."""
    origin = (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string")
    source = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    key = F.md5(source)
    return chunk_documents(docs.select("doc_id", "text", origin.alias("origin")), s, ("origin",)).select(
        F.concat_ws(":", key, F.lit("text"), F.col("chunk_index").cast("string")).alias("node_id"),
        "doc_id", source.alias("source"), "chunk_index", F.expr("chunk_index div 3 + 1").cast("int").alias("page"), "text", "origin",
    )


def with_point_ids(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("point_id", point_id(F.col("node_id")))


def table_chunks(markdown: Column, s: Settings = DEFAULTS) -> Column:
    """A markdown table whole if it is small, else its header with groups of rows."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x) != "")

    def groups(head: Column, rows: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(s.table_group_rows))
        return F.transform(starts, lambda a: strip(F.array_join(F.concat(head, F.slice(rows, a, s.table_group_rows)), "\n")))

    def parts(t: Column) -> Column:
        small = F.size(t.rows) <= s.table_small_rows
        return F.when(t.whole == "", F.array().cast("array<string>")).when(small, F.array(t.whole)).otherwise(groups(t.head, t.rows))

    # as lambda variables, the lines are cut once a row and not once a group
    cut = F.transform(F.array(lines), lambda x: F.struct(strip(markdown).alias("whole"), F.slice(x, 1, 2).alias("head"), F.slice(x, 3, F.greatest(F.size(x) - 2, F.lit(0))).alias("rows")))
    return F.get(F.transform(cut, parts), F.lit(0))


def table_fingerprint(markdown: Column) -> Column:
    """Lines without separator rows and without runs of blanks."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^\|?[\s:|-]+\|?$"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")), "\n")


def html_table_rows(html: Column) -> Column:
    """Cells of each table row in the text of an HTML table; empty rows are left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(
        rows,
        lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))),
    )
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


def html_table_markdown(html: Column) -> Column:
    """The table as markdown; ragged rows are padded."""

    def lines(rows: Column, width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return F.array_join(F.flatten(F.transform(rows, lambda r, i: F.when(i == 0, F.array(line(r), rule)).otherwise(F.array(line(r))))), "\n")

    # as lambda variables, rows and width are found once a table and not once a row
    table = F.transform(F.array(html_table_rows(html)), lambda rows: F.struct(rows.alias("rows"), F.array_max(F.transform(rows, F.size)).alias("width")))
    return F.get(F.transform(table, lambda t: F.when(F.size(t.rows) == 0, "").otherwise(lines(t.rows, t.width))), F.lit(0))
