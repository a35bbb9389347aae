"""Image units of a document: an image with its captions and descriptions, gathered from layout blocks.

A document's blocks are read once in order within a task, as what a caption belongs to depends on what
came before. Units that say the same are one, and a caption without an image goes to the
image whose caption is most like it. Nothing leaves the document; a task holds the units of one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import SOURCE_PRIORITY

# How far in the order a caption may be from its image, how alike captions are linked, lengths, labels.
GAP = 5
LIKE = 0.82
HELD, HELD_LIKENESS = 48, 0.95
KEY_CHARS, USUAL_CAPTION = 200, 300
LABEL = re.compile(r"\b(?:fig(?:ure)?\.?)\s*([0-9]+[A-Za-z]?)\b", re.I)
PLAIN_LABEL = re.compile(r"\b(?:supplemental figure|figure|fig)\s*([a-z0-9]+)")
CAPTION = re.compile(r"\b(fig\.?|figure|supplemental figure|图)\b", re.I)
ROLES = {"image_caption": "captions", "image_semantic": "semantics"}
IMAGES = ("image", "image_caption", "image_semantic")

UNITS = "source string, unit int, image_path string, caption_ids array<string>, semantic_ids array<string>, image_ids array<string>, best_caption string"


def figure_label(text: str) -> str | None:
    m = LABEL.search(text)
    return m[1].lower() if m else None


def plain_caption(text: str) -> str:
    """A caption as words of ASCII letters and digits."""
    text = re.sub(r"[$^_{}\\]", " ", re.sub(r"\\[()[\]]", " ", text.lower()))
    return " ".join(re.sub(r"[^a-z0-9]+", " ", text).split())


def likeness(a: str, b: str) -> float:
    """How alike two plain captions are: 0 with different figure numbers, else by what the shorter one shares."""
    if not a or not b:
        return 0.0
    labels = [m[1] for m in map(PLAIN_LABEL.search, (a, b)) if m]
    if len(labels) == 2 and labels[0] != labels[1]:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= HELD and short in long:
        return HELD_LIKENESS
    x, y = set(a.split()), set(b.split())
    return len(x & y) / min(len(x), len(y))


class Block:
    __slots__ = ("boxed", "id", "kind", "order", "page", "path", "priority", "text", "type")

    def __init__(self, row: dict):
        self.id, self.order, self.type, self.page, self.kind = row["block_id"], row["ord"], row["type"], row["page"], row["source_kind"]
        self.text, self.boxed = (row["text"] or "").strip(), row["box"] is not None
        self.path = (row["image_path"] or "").replace("\\", "/").strip() or None
        self.priority = SOURCE_PRIORITY.get(self.kind or "unknown", SOURCE_PRIORITY["unknown"])


class Unit:
    """Blocks of one image by role; ``path`` is null where only words are known."""

    def __init__(self, *blocks: Block, path: str | None = None):
        self.path, self.captions, self.semantics, self.images = path, [], [], []
        for b in blocks:
            self.add(b)

    def add(self, b: Block) -> None:
        getattr(self, ROLES.get(b.type, "images")).append(b)

    def blocks(self) -> list[Block]:
        return self.images + self.captions + self.semantics

    def pages(self) -> set[int]:
        return {b.page for b in self.blocks() if b.page is not None}

    def take(self, other: Unit) -> None:
        """All blocks of the other unit too; each text of an order and kind once, in order."""
        for role in ("captions", "semantics", "images"):
            once = {(b.kind, b.order, "".join(b.text.split())): b for b in reversed(getattr(self, role) + getattr(other, role))}
            setattr(self, role, sorted(once.values(), key=lambda b: b.order))

    def accepts(self, caption: Block, page: int | None = None) -> bool:
        """Whether a caption is this image's: near it, on its page, and of its figure number.

        A second caption needs a number: that of one before, or a better parser than all those without one.
        """
        page = caption.page if caption.page is not None else page
        if page is not None and self.pages() and page not in self.pages():
            return False
        near = [abs(caption.order - b.order) for b in self.images + self.semantics if b.path]
        if not near or min(near) > GAP:
            return False
        label, known = figure_label(caption.text), {figure_label(b.text) for b in self.captions} - {None}
        if not self.captions or not label:
            return not self.captions
        return label in known if known else caption.priority > max(b.priority for b in self.captions)

    def key(self) -> str:
        said = "".join((_joined(self.semantics) + _joined(self.captions)).split())
        first = self.blocks()[0]
        return f"path:{self.path}" if self.path else f"text:{said[:KEY_CHARS]}" if said else f"block:{first.kind}:{first.order}"

    def best_caption(self) -> Block | None:
        """The caption that looks most like one: by its words, box, parser, length, then the first."""
        rank = lambda b: (len(b.text) >= 6 and bool(CAPTION.search(b.text)), b.boxed, b.priority, -abs(len(b.text) - USUAL_CAPTION), -b.order)
        return max(self.captions, key=rank, default=None)


def _joined(blocks: list[Block]) -> str:
    once = {"".join(b.text.split()): b.text for b in sorted(blocks, key=lambda b: -b.order) if b.text}
    return "\n\n".join(reversed(once.values()))


def gathered(blocks: Iterable[Block]) -> Iterator[Unit]:
    """Units of a document's blocks in order.

    A caption goes to the image before it, or waits for the next one, until another caption or other
    content comes, when it stands alone; one whose image does not accept it goes, as in the rules that are
    matched here. Images of one path are one unit; what has no path and is no caption stands alone.
    """
    by_path: dict[str, Unit] = {}
    waiting: Block | None = None
    last: Unit | None = None
    for b in blocks:
        if b.type not in IMAGES and not b.path:
            if b.type != "page_number":
                if waiting:
                    yield Unit(waiting)
                waiting = last = None
        elif b.path:
            unit = by_path.get(b.path)
            if not unit:
                unit = by_path[b.path] = Unit(path=b.path)
                yield unit
            unit.add(b)
            if waiting and unit.accepts(waiting, b.page):
                unit.add(waiting)
            waiting = None
            last = last if b.type == "image_caption" or b.type not in IMAGES else unit
        elif b.type != "image_caption":
            yield Unit(b)
            last = None
        elif last and last.accepts(b):
            last.add(b)
        else:
            if waiting:
                yield Unit(waiting)
            waiting = b
    if waiting:
        yield Unit(waiting)


def merged(units: list[Unit]) -> list[Unit]:
    """Units of equal keys as one, and captions without an image at the image with the most similar caption, of equals the first."""
    keyed: dict[str, Unit] = {}
    for unit in units:
        key = unit.key()
        if key in keyed:
            keyed[key].take(unit)
        else:
            keyed[key] = unit
    out, said = [], {}
    images = [u for u in keyed.values() if u.path]
    plain = lambda u: plain_caption(_joined(u.captions))
    for unit in keyed.values():
        best, at = 0.0, None
        if not unit.path and unit.captions:
            own, pages = plain(unit), unit.pages()
            for image in images:
                there = image.pages()
                if not pages or not there or pages & there:
                    words = said.get(id(image)) or said.setdefault(id(image), plain(image))
                    like = likeness(own, words)
                    if like >= LIKE and like > best:
                        best, at = like, image
        if at:
            at.take(unit)
            said.pop(id(at), None)
        else:
            out.append(unit)
    return out


def image_units(blocks: DataFrame) -> DataFrame:
    """(source, unit, image_path, caption_ids, semantic_ids, image_ids, best_caption) of blocks.

    blocks: source, ord, block_id, type, text, page, box, source_kind, image_path. Units are numbered in
    the order of their first block; ids are in block order. Documents without images give no rows.
    """
    slim = blocks.select(
        "source", F.col("ord").cast("long").alias("ord"), F.col("block_id").cast("string").alias("block_id"), "type", F.when(F.col("type").isin(*IMAGES), F.col("text")).alias("text"), F.col("page").cast("int").alias("page"),
        F.col("box").cast("array<double>").alias("box"), "source_kind", F.col("image_path").cast("string").alias("image_path"),
    )
    names, kinds = UNITS.replace(" string", "").replace(" int", "").replace(" array<string>", "").split(", "), [pa.string(), pa.int32(), pa.string(), *[pa.list_(pa.string())] * 3, pa.string()]

    def scanned(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        for source, group in groupby(rows, key=lambda row: row["source"]):
            out = []
            for i, u in enumerate(merged(list(gathered(map(Block, group))))):
                best = u.best_caption()
                ids = [[b.id for b in sorted(x, key=lambda b: b.order)] for x in (u.captions, u.semantics, u.images)]
                out.append((source, i, u.path, *ids, best.id if best else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return slim.repartition("source").sortWithinPartitions("source", "ord").mapInArrow(scanned, UNITS)
