"""Tables that a document has several times, as one: blocks of several parsers, and nodes of equal content.

Blocks meet by fingerprint within their document, where one after another joins the first cluster that
it agrees with, a scan of slim rows in a group of its own. Nodes of equal content need no scan but
the order in which they were merged, a fold over each group's ids.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .chunking import html_table_markdown
from .layout import source_priority

#: Boxes are the same with this overlap, or if no coordinate differs by more than CLOSE.
OVERLAP, CLOSE = 0.8, 2.0


def table_rows(text: Column) -> Column:
    """Array of the cells of each row of a markdown table, without the rows of dashes; other lines count for nothing."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda x: x.contains("|"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1), strip))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]+$")))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once a row, also where the expression repeats it: as a lambda variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def block_fingerprint(text: Column) -> Column:
    """A table's cells without blanks, row by row; of any other text all but its blanks."""
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, bare), "|")), "\n")
    return _once(table_rows(F.coalesce(text, F.lit(""))), lambda rows: F.when(F.size(rows) > 0, joined(rows)).otherwise(bare(F.coalesce(text, F.lit("")))))


def _ordered(box) -> tuple[float, ...]:
    x0, y0, x1, y1 = map(float, box[:4])
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


def same_place(a, b) -> bool:
    """Whether two boxes may be of one table; a missing one may be anywhere."""
    if a is None or b is None:
        return True
    a, b = _ordered(a), _ordered(b)
    common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return (whole > 0 and common / whole >= OVERLAP) or all(abs(x - y) <= CLOSE for x, y in zip(a, b, strict=True))


def joins(a, b, keep_charts: bool) -> bool:
    """Whether block b, of the fingerprint of a, is the same table: nothing speaks against it, and a place or a parser for it."""
    if keep_charts and (a.chart or b.chart):
        return False
    if (a.page is not None and b.page is not None and a.page != b.page) or not same_place(a.box, b.box):
        return False
    if a.box is not None or b.box is not None or (a.page is None) != (b.page is None):
        return True
    kinds = bool(a.raw_type) and bool(b.raw_type) and a.raw_type != b.raw_type and not (a.chart or b.chart)
    return a.source_kind != b.source_kind or kinds or a.n > 1 or b.n > 1


class Cluster:
    """Blocks that are one table: the best of them, and all their ids in order."""

    __slots__ = ("box", "chart", "first", "ids", "key", "n", "page", "raw_type", "source_kind")

    def __init__(self, row: dict):
        self.page, self.box, self.raw_type, self.source_kind, self.chart, self.n = (row[k] for k in ("page", "box", "raw_type", "source_kind", "chart", "n"))
        self.key = (self.page is not None, self.box is not None, row["priority"], row["length"])
        self.first, self.ids = row["ord"], [row["block_id"]]


def coalesced_blocks(blocks: DataFrame, keep_charts: bool = True) -> DataFrame:
    """(source, block_id, duplicates, merged_ids, first_ord) of blocks (source, ord, block_id, text, page, box, source_kind, raw_type): a row a table.

    The best block stands for its table: one with a page, then a box, then of the better parser, then
    the longer text, then the first. ``merged_ids`` are all blocks of it, ``first_ord`` its place. A block
    of no text stays alone. ``structured_duplicate_count``, where there is such a column, counts what a block stands for already.
    """
    raw = F.col("raw_type") if "raw_type" in blocks.columns else F.lit(None).cast("string")
    before = F.coalesce("structured_duplicate_count", F.lit(1)) if "structured_duplicate_count" in blocks.columns else F.lit(1)
    chart = F.lower(F.coalesce(raw, F.lit(""))).contains("chart") | F.lower(F.coalesce("source_kind", F.lit(""))).contains("chart")
    # Blocks without text are each a group; the others meet by a digest of their fingerprint.
    group = _once(block_fingerprint(F.col("text")), lambda mark: F.when(mark == "", F.concat(F.lit("#"), F.col("ord").cast("string"))).otherwise(F.sha2(mark, 256)))
    slim = blocks.select(
        "source", F.col("ord").cast("long").alias("ord"), F.col("block_id").cast("string").alias("block_id"), group.alias("mark"), F.col("page").cast("int").alias("page"), F.col("box").cast("array<double>").alias("box"), "source_kind", raw.alias("raw_type"),
        chart.alias("chart"), before.cast("long").alias("n"), source_priority(F.col("source_kind")).alias("priority"), F.length(F.coalesce("text", F.lit(""))).alias("length"),
    )

    def clusters(rows) -> list[Cluster]:
        kept: list[Cluster] = []
        for row in rows:
            new = Cluster(row)
            old = next((c for c in kept if joins(c, new, keep_charts)), None)
            if old is None:
                kept.append(new)
                continue
            ids, n, first = old.ids + new.ids, old.n + new.n, old.first
            if new.key > old.key:
                kept[kept.index(old)] = old = new
                ids = [ids[-1], *ids[:-1]]
            old.ids, old.n, old.first = ids, n, first
        return kept

    kinds = {"source": pa.string(), "block_id": pa.string(), "duplicates": pa.int64(), "merged_ids": pa.list_(pa.string()), "first_ord": pa.int64()}

    def scanned(batches):
        """The groups of a task one after another, in order; only one group's clusters are held. Blocks alone in their group are not walked."""
        alone, out = [], []

        def rows():
            for batch in batches:
                single = _singles(batch)
                own = batch.filter(pa.array(single))
                ids = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1), pa.int32()), own.column("block_id"))
                alone.append(pa.RecordBatch.from_arrays([*map(own.column, ("source", "block_id", "n")), ids, own.column("ord")], names=list(kinds)))
                yield from batch.filter(pa.array(~single)).to_pylist()

        for (source, _), group in groupby(rows(), key=lambda row: (row["source"], row["mark"])):
            out += [(source, c.ids[0], c.n, c.ids, c.first) for c in clusters(group)]
            while alone:
                yield alone.pop()
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
        yield from alone

    dealt = slim.repartition("source", "mark").sortWithinPartitions("source", "mark", "ord")
    return dealt.mapInArrow(scanned, "source string, block_id string, duplicates long, merged_ids array<string>, first_ord long")


def _singles(batch: pa.RecordBatch) -> np.ndarray:
    """Rows whose group no neighbour shares; the first and last of a batch may go on in another one."""
    new = np.ones(batch.num_rows + 1, bool)
    for at, c in enumerate(("source", "mark")):
        column = batch.column(c)
        same = pc.equal(column[1:], column[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        both_null = pc.and_(column[1:].is_null(), column[:-1].is_null()).to_numpy(zero_copy_only=False)
        new[1:-1] = ~(same | both_null) if not at else new[1:-1] | ~(same | both_null)
    single = new[1:] & new[:-1]
    single[:1] = single[-1:] = False
    return single


def content_key(text: Column) -> Column:
    """The rows of a table, from markdown or HTML, as one value; null without any."""
    bare = strip(F.coalesce(text, F.lit("")))
    html = F.when(F.lower(bare).startswith("<table"), F.nullif(html_table_markdown(bare), F.lit("")))
    rows = table_rows(F.coalesce(html, bare))
    return F.when(F.size(rows) > 0, F.to_json(rows))


def coalesced_nodes(nodes: DataFrame, keep_charts: bool = True) -> DataFrame:
    """Table nodes with one row for each content of a document, and merged_ids, occurrences, duplicates.

    nodes: source, doc_id, node_id, chunk_index, modality, text, page, section, page_source, source_kind, raw_type,
    structured_duplicates. The best node stays: one with a page, then a page from the layout, then of more
    duplicates, then with a section, then the first. What it stands for is listed as it was merged: the
    one that it replaced, with those before it, then the later ones. Other nodes, charts and tables without rows stay as they are.
    """
    charts = F.lower(F.concat_ws(" ", "raw_type", "source_kind")).contains("chart") & F.lit(keep_charts)
    key = F.when((F.col("modality") == "table") & ~charts, content_key(F.col("text")))
    alone = F.concat(F.lit("#"), F.col("node_id"))
    quality = F.struct(F.col("page").isNotNull().cast("int").alias("a"), (F.coalesce("page_source", F.lit("")) == "structured").cast("int").alias("b"), F.coalesce("structured_duplicates", F.lit(0)).alias("c"), (F.coalesce("section", F.lit("")) != "").cast("int").alias("d"), (-F.col("chunk_index")).alias("e"))
    own = F.struct("node_id", "page", "chunk_index", "source_kind", "raw_type", "page_source")
    rows = nodes.select("source", "doc_id", F.coalesce(F.sha2(key, 256), alone).alias("key"), F.struct(F.col("chunk_index").alias("at"), quality.alias("quality"), own.alias("own"), F.col("structured_duplicates").alias("n")).alias("x"))
    groups = rows.groupBy("source", "doc_id", "key").agg(F.array_sort(F.collect_list("x")).alias("all"))
    first = F.get("all", F.lit(0))
    none = F.slice(F.transform("all", lambda x: x["own"]), 1, 0)

    def step(state: Column, x: Column) -> Column:
        better = x["quality"] > state["best"]["quality"]
        merged = F.when(better, F.array_prepend(state["merged"], state["best"]["own"])).otherwise(F.array_append(state["merged"], x["own"]))
        return F.struct(F.when(better, x).otherwise(state["best"]).alias("best"), merged.alias("merged"))

    state = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.struct(first.alias("best"), none.alias("merged")), step)
    most = F.array_max(F.transform("all", lambda x: F.coalesce(x["n"], F.lit(1))))
    kept = groups.select("source", "doc_id", state.alias("s"), most.alias("most"))
    count = F.when((F.col("most") > 1) | F.col("s.best.n").isNotNull(), F.col("most"))
    return kept.select(
        "source", "doc_id", "s.best.own.*", F.transform("s.merged", lambda x: x["node_id"]).alias("merged_ids"), F.col("s.merged").alias("occurrences"),
        (F.size("s.merged") + 1).alias("duplicates"), count.alias("structured_duplicates"),
    )
