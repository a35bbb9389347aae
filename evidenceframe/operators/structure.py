"""Structural split of oversize text nodes, with the edges rewritten to the parts.

The cut of one text runs on from where the last part ended, so it is a small loop in an Arrow function
that only oversize texts reach; all else is joins and arrays. Nodes that are split become a map from
an id to the ids of its parts, which is joined to the edges from both ends.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings

#: Where a part may end: after blank lines, or after the blanks behind a sentence.
BOUNDARY = re.compile(r"\n\n+|(?<=[.!?。！？])\s+")
#: The share of a window that a part fills at least.
FILL = 0.55
#: Relations that hold one node; all others hold lists.
SCALAR = ("prev_id", "next_id", "doc_prev_node_id", "doc_next_node_id", "context_prev_node_id", "context_next_node_id")
#: Relations that parts of one node have among themselves, by the step to the other part.
CHAINED = {"prev_id": -1, "doc_prev_node_id": -1, "next_id": 1, "doc_next_node_id": 1}


def boundary(window: str, least: int) -> int:
    """The length of the part that a window gives: to the last boundary, line break or blank that is far enough, else all."""
    ends = [m.end() for m in BOUNDARY.finditer(window)]
    if ends and ends[-1] >= least:
        return ends[-1]
    for separator in "\n ":
        at = window.rfind(separator)
        if at >= least:
            return at + 1
    return len(window)


def parts_of(text: str, most: int, least: int, overlap: int) -> list[str]:
    """Parts of at most ``most`` code points in order, each beginning ``overlap`` before the end of the one before it."""
    out, at = [], 0
    while at < len(text):
        window = text[at : at + most]
        last = at + most >= len(text)
        end = at + (len(window) if last else max(1, boundary(window, max(least, int(len(window) * FILL)))))
        out.append(text[at:end].strip())
        if last:
            break
        at = max(end - overlap, at + 1)
    return [p for p in out if p]


def split_parts(text: Column, s: Settings = DEFAULTS) -> Column:
    """Array of the parts of a text above the hard limit; null for others, which no Python sees."""

    @F.arrow_udf("array<string>")
    def cut(x: pa.Array) -> pa.Array:
        found = (None if t is None else parts_of(t, s.hard_chars, max(1, s.hard_part_min), max(0, s.hard_overlap)) for t in x.to_pylist())
        return pa.array([p if p and len(p) > 1 else None for p in found], pa.list_(pa.string()))

    return cut(F.when(F.length(text) > s.hard_chars, text))


def split_nodes(nodes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """nodes (node_id, modality, text, more) with a row for each part, and parent_id, part_index, part_count, original_length.

    Only text nodes above the limit are split; those columns are null for the rest. The id of a part
    is the node's with ``:part:`` and its index. A part of a node with several boxes has none
    (``bbox``, ``bbox_items``), as nobody knows which of them it fills; ``parent_bbox`` and ``parent_bbox_items`` keep them.
    """
    parts = split_parts(F.when(F.col("modality") == "text", F.col("text")), s)
    out = nodes.withColumn("__parts", parts).select("*", F.posexplode(F.coalesce("__parts", F.array("text"))).alias("__at", "__text"))
    split = F.col("__parts").isNotNull()
    if "bbox_items" in nodes.columns:
        several = split & (F.size("bbox_items") > 1)
        out = out.withColumns({"parent_bbox": F.when(several, F.col("bbox")), "parent_bbox_items": F.when(several, F.col("bbox_items")), "bbox_merge_policy": F.when(several, "dropped_on_structural_split").otherwise(F.col("bbox_merge_policy") if "bbox_merge_policy" in nodes.columns else F.lit(None))})
        out = out.withColumns({c: F.when(several, None).otherwise(F.col(c)) for c in ("bbox", "bbox_items")})
    out = out.withColumns({
        "parent_id": F.when(split, F.col("node_id")), "part_index": F.when(split, F.col("__at")), "part_count": F.when(split, F.size("__parts")),
        "original_length": F.when(split, F.length("text")), "text": F.col("__text"),
    })
    return out.withColumn("node_id", F.when(split, F.concat_ws(":", "node_id", F.lit("part"), "__at")).otherwise(F.col("node_id"))).drop("__parts", "__at", "__text")


def part_ids(split: DataFrame) -> DataFrame:
    """(node_id, n): the nodes that ``split_nodes`` split, and into how many parts."""
    return split.where("part_index = 0").select(F.col("parent_id").alias("node_id"), F.col("part_count").alias("n"))


def rewritten_edges(edges: DataFrame, split: DataFrame) -> DataFrame:
    """Edges (src_id, relation, pos, dst_id) after ``split_nodes``, with none to a node that is gone.

    Each part has the edges of its node, but those to the next and previous node lead to the next and
    previous part within it. Places are numbered anew. An edge to a split node leads to its first part where the relation
    holds one node, and to all parts, in their place of the list, where it holds several. Only the
    column ``parent_id`` of the parts still names the node.
    """
    n = part_ids(split)
    part = lambda node, at: F.concat_ws(":", node, F.lit("part"), at)
    one = F.col("relation").isin(*SCALAR)
    to = n.select(F.col("node_id").alias("dst_id"), F.col("n").alias("dst_n"))
    out = edges.where("relation <> 'parent_id'").join(to, "dst_id", "left")
    all_ = F.transform(F.sequence(F.lit(0), F.col("dst_n") - 1), lambda i: part(F.col("dst_id"), i))
    targets = F.when(F.col("dst_n").isNull(), F.array("dst_id")).when(one, F.slice(all_, 1, 1)).otherwise(all_)
    out = out.select("src_id", "relation", "pos", F.posexplode(targets).alias("within", "dst_id"))
    place = Window.partitionBy("src_id", "relation").orderBy("pos", "within")
    out = out.withColumn("pos", F.row_number().over(place) - 1)
    out = out.join(n.select(F.col("node_id").alias("src_id"), F.col("n").alias("src_n")), "src_id", "left")
    sources = F.when(F.col("src_n").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("src_n") - 1))
    out = out.withColumn("__at", F.explode(sources))
    inner = F.lit(False)
    for relation, step in CHAINED.items():
        inner = inner | ((F.col("relation") == relation) & (F.col("__at") + step >= 0) & (F.col("__at") + step < F.col("src_n")))
    out = out.where((F.col("__at") < 0) | ~inner).select(F.when(F.col("__at") < 0, F.col("src_id")).otherwise(part(F.col("src_id"), F.col("__at"))).alias("src_id"), "relation", "pos", "dst_id")
    chain = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(step).alias("step")) for r, step in CHAINED.items()])
    own = split.where("part_index is not null").select("node_id", "parent_id", "part_index", "part_count", F.explode(chain).alias("c")).withColumn("to", F.col("part_index") + F.col("c.step"))
    own = own.where((F.col("to") >= 0) & (F.col("to") < F.col("part_count"))).select(F.col("node_id").alias("src_id"), "c.relation", F.lit(0).alias("pos"), part(F.col("parent_id"), F.col("to")).alias("dst_id"))
    return out.unionByName(own)
