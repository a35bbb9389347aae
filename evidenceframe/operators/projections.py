"""What a node or hit gives to an index, a reranker, the gate and the prompt; plain coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import point_id

EMPTY = ""
# Kinds of blocks by their raw type, and scene types by what a describer says.
CAPTIONS = ("image_caption", "figure_caption", "chart_caption", "image_footnote", "chart_footnote")
SCENES = {"网页截图": "screenshot", "截图": "screenshot", "图表": "chart", "照片": "photo", "文档": "document", "chart": "chart", "diagram": "diagram", "screenshot": "screenshot", "photo": "photo", "document": "document"}
BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1")


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(EMPTY))


def index_text(modality: Column, text: Column, table_markdown: Column, formula_latex: Column) -> Column:
    """The text of a hit: a table's markdown or a formula's source, where there is one."""
    special = F.when(modality == "table", table_markdown).when(modality == "formula", formula_latex)
    return F.coalesce(F.nullif(special, F.lit(EMPTY)), text, F.lit(EMPTY))


def embedding_text(modality: Column, text: Column, table_markdown: Column, formula_latex: Column, image_path: Column, source: Column) -> Column:
    """The text to embed; an image without text gives the name of its file."""
    name = F.concat(F.lit("Image file: "), F.element_at(F.split(F.coalesce(F.nullif(image_path, F.lit(EMPTY)), source), "/"), -1))
    said = F.nullif(text, F.lit(EMPTY))
    return F.when(modality == "image", F.coalesce(said, name)).otherwise(index_text(modality, text, table_markdown, formula_latex))


def hits_of_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, doc_id, page, modality, text, table_markdown, formula_latex) as hits without a score."""
    text = index_text(F.col("modality"), F.col("text"), F.col("table_markdown"), F.col("formula_latex"))
    return nodes.select(point_id(F.col("node_id")).alias("point_id"), "node_id", "doc_id", "page", F.lit("bm25").alias("channel"), "modality", text.alias("text"), F.lit(0.0).alias("score"))


def rerank_text(*parts: str) -> Column:
    """The texts of a hit that are there, one a line: text, table, formula, caption, OCR, object."""
    return F.regexp_replace(F.concat_ws("\n", *[F.nullif(F.col(p), F.lit(EMPTY)) for p in parts]), r"^\s+|\s+$", "")


def evidence_text(text: str, *parts: str) -> Column:
    """The text of a hit and what else of it is there, joined by spaces; an empty text keeps its place."""
    return F.concat_ws(" ", _or_empty(text), *[F.nullif(F.col(p).cast("string"), F.lit(EMPTY)) for p in parts])


def sized(vector: Column, dim: int, truncate: bool = True) -> Column:
    """A vector of ``dim`` numbers: longer ones are cut, or an error; shorter ones are an error."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector must have {dim} numbers, not "), F.size(vector).cast("string")))
    long = F.slice(vector, 1, dim) if truncate else wrong
    return F.when(F.size(vector) == dim, vector).when(F.size(vector) > dim, long).otherwise(wrong)


def label_map(value: Column) -> Column:
    """Map of label to number from label:number pairs, which commas part; the last of a label counts, what is no such pair is left out."""
    pairs = F.filter(F.split(F.coalesce(value, F.lit(EMPTY)), ","), lambda p: p.contains(":"))
    named = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).try_cast("double").alias("v")))
    kept = F.filter(named, lambda p: (p["k"] != "") & p["v"].isNotNull())
    labels = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    return F.map_from_entries(F.transform(labels, lambda k: F.struct(k, F.element_at(F.filter(kept, lambda p: p["k"] == k), -1)["v"])))


def block_type(value: Column) -> Column:
    """The kind of a layout block from its raw type; text where nothing else fits."""
    raw = F.lower(F.trim(F.coalesce(F.nullif(value, F.lit(EMPTY)), F.lit("text"))))
    return (
        F.when(raw.isin(*CAPTIONS), "image_caption").when(raw.isin("table_caption", "table_footnote"), "text").when(raw.isin("page_number", "page_footer", "page_header"), "page_marker")
        .when(raw.contains("formula") | raw.contains("equation"), "formula").when(raw.isin("chart", "figure", "graphic"), "image_semantic")
        .when(raw.isin("table", "table_body", "html_table", "latex_table", "chart_table"), "table").when(raw.contains("title") | raw.contains("heading"), "heading")
        .when(raw.contains("image") | raw.contains("figure"), "image").otherwise("text")
    )


def source_kind(name: Column) -> Column:
    """The kind of a layout file from its name; null where it tells nothing."""
    low, out = F.lower(F.replace(name, F.lit("\\"), F.lit("/"))), F.when(F.lit(False), "")
    for part in ("content_list_v2", "content_list", "pdf_info", "layout", "block_list"):
        out = out.when(low.contains(part), part)
    return out.when(low.contains("middle") | low.contains("model"), "model")


def page_of(value: Column, zero_based: bool = False) -> Column:
    """The number that the digits of a text make, one more for pages counted from 0; null without digits."""
    return F.nullif(F.regexp_replace(value, r"[^0-9]", ""), F.lit(EMPTY)).try_cast("int") + (1 if zero_based else 0)


def scene_type(value: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SCENES.items() for x in pair])
    said = F.trim(F.coalesce(value, F.lit(EMPTY)))
    return F.coalesce(F.get(F.array(names[said]), F.lit(0)), names[F.lower(said)], F.lit("unknown"))


def image_mime(content: Column) -> Column:
    """The type of an image by its first bytes; null if they tell none."""
    head = F.hex(F.substring(content, 1, 12))
    at = lambda a, n: F.substring(head, 2 * a + 1, 2 * n)
    whole = F.octet_length(content) >= 12
    text = lambda s: s.encode().hex().upper()
    return (
        F.when(at(0, 3) == "FFD8FF", "image/jpeg").when(at(0, 8) == "89504E470D0A1A0A", "image/png").when(whole & (at(0, 4) == text("RIFF")) & (at(8, 4) == text("WEBP")), "image/webp")
        .when(at(0, 2) == text("BM"), "image/bmp").when(at(0, 4).isin("49492A00", "4D4D002A"), "image/tiff").when(whole & (at(4, 4) == text("ftyp")) & at(8, 4).isin(*map(text, BRANDS)), "image/heic")
    )
