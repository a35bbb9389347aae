"""Alignment of texts to layout blocks of the same document: which block is a text from?

A text and a block belong together if one holds the other, or if the first 40 characters of one are in
the other, all without blanks. Whole texts and openings are patterns to be found in the other
side's texts. The texts and blocks of a document come together once and are walked there. Of documents for
which that is much work, a pattern is looked up by one key, the rarest of its minimizers, which every text that
holds it has too; what the key finds is compared exactly. So texts that share an opening, as
pages of one form do, do not all meet each other. Patterns are distinct, and of equal blocks the best stands for all.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import source_priority

OPENING = 40
#: A minimizer is the smallest hash of the 8-character grams of a window of 16; shorter patterns have none.
GRAM, WINDOW = 8, 16
#: Characters that the patterns of one document may be compared with in a walk; above it they are looked up by keys.
WALKED = 2_000_000_000


def minimizers(text: Column) -> Column:
    """Array of the distinct minimizers of a text; empty below the window."""

    def of(t: str | None) -> list[int]:
        if t is None or len(t) < WINDOW:
            return []
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code = np.zeros(len(points) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            code = code * np.uint64(1_000_003) + points[i : i + len(code)]
        code ^= code >> np.uint64(29)
        code = (code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
        return np.unique(np.lib.stride_tricks.sliding_window_view(code, WINDOW - GRAM + 1).min(1)).astype(np.int64).tolist()

    @F.arrow_udf("array<long>")
    def found(x: pa.Array) -> pa.Array:
        return pa.array([of(t) for t in x.to_pylist()], pa.list_(pa.int64()))

    return found(text)


def bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def occurrences(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, pattern, text) of distinct patterns that occur in distinct texts of their source."""
    # Minimizers go with a hash of their text; only what a key finds gets the text itself, and texts of one hash are all compared.
    named = texts.withColumn("id", F.xxhash64("text"))
    grams = named.select("source", "id", F.explode(minimizers(F.col("text"))).alias("key"))
    counts = grams.groupBy("source", "key").agg(F.count("*").alias("n"))
    long, short = patterns.where(F.length("pattern") >= WINDOW), patterns.where(F.length("pattern") < WINDOW)
    known = long.withColumn("pattern_id", F.xxhash64("pattern"))
    keys = known.select("source", "pattern_id", F.explode(minimizers(F.col("pattern"))).alias("key")).join(counts, ["source", "key"], "left")
    # A pattern with a minimizer that no text has occurs nowhere.
    rarest = keys.groupBy("source", "pattern_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).where("k.n > 0").select("source", "pattern_id", "k.key")
    near = rarest.join(grams, ["source", "key"]).select("source", "pattern_id", "id")
    near = near.join(known, ["source", "pattern_id"]).join(named, ["source", "id"])
    found = near.where(F.col("text").contains(F.col("pattern"))).select("source", "pattern", "text")
    # Short patterns of a document go to its texts as one list; most documents have few.
    lists = short.groupBy("source").agg(F.collect_set("pattern").alias("patterns"))
    near = texts.join(lists, "source").select("source", F.explode(F.filter("patterns", lambda p: F.col("text").contains(p))).alias("pattern"), "text")
    return found.unionByName(near)


def best_blocks(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, text_id, block_id, score): for each text (source, text_id, text) the block it is from, if any.

    blocks: source, ord, block_id, text, page, section, box, source_kind; those with neither page nor section are left out. The score is
    the length of the shorter one where it is held whole, else 40 for an opening. Of equal scores the
    better kind of source is taken, then a block with a box, then the first.
    """
    located = F.col("page").isNotNull() | (F.col("section").isNotNull() if "section" in blocks.columns else F.lit(False))
    rank = F.struct(source_priority(F.col("source_kind")).alias("priority"), F.col("box").isNotNull().cast("int").alias("boxed"), (-F.col("ord")).alias("first"), "block_id")
    placed = blocks.where(located)
    held = placed.select("source", bare(F.col("text")).alias("text"), rank.alias("rank")).where("text <> ''")
    asked = texts.select("source", "text_id", bare(F.col("text")).alias("needle")).where("needle <> ''")
    much = _crowded(texts, placed)
    if not much:
        return _walked(asked, held)
    much = F.broadcast(texts.sparkSession.createDataFrame(much, texts.select("source").schema))
    few = _walked(*(rows.join(much, "source", "left_anti") for rows in (asked, held)))
    return few.unionByName(_looked_up(*(rows.join(much, "source", "left_semi") for rows in (asked, held))))


def _crowded(texts: DataFrame, blocks: DataFrame) -> list:
    """Sources whose walk would be more than ``WALKED``; each has a few hundred thousand characters or very many blocks."""
    side = lambda rows, n: rows.select("source", *[(v if i == n else F.lit(0)).cast("double").alias(c) for i in (0, 1) for c, v in ((f"n{i}", F.lit(1)), (f"c{i}", F.length("text")))])
    sums = side(texts, 0).unionByName(side(blocks, 1)).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n0", "c0", "n1", "c1")])
    return sums.where(2 * (F.col("n0") * F.col("c1") + F.col("n1") * F.col("c0")) > WALKED).select("source").collect()


def _walked(asked: DataFrame, held: DataFrame) -> DataFrame:
    """The best blocks of the texts, by a walk over each document: its texts and blocks are shuffled once, and nothing made of them is."""
    kind = lambda df, c: df.select(c).schema[0].dataType.simpleString()
    none = lambda df, c, name: F.lit(None).cast(kind(df, c)).alias(name)
    rows = asked.select("source", "text_id", none(held, "rank", "rank"), F.col("needle").alias("text")).withColumn("asked", F.lit(True))
    rows = rows.unionByName(held.select("source", none(asked, "text_id", "text_id"), "rank", "text", F.lit(False).alias("asked"))).where("source is not null")
    rows = rows.select("source", "asked", "text", "text_id", "rank.priority", "rank.boxed", "rank.first", "rank.block_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema = [], None

        def each():
            nonlocal schema
            for batch in batches:
                schema = pa.schema([*map(batch.schema.field, ("source", "text_id", "block_id")), pa.field("score", pa.int32())])
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names=schema.names)

        for source, group in groupby(each(), key=lambda row: row[0]):
            needles, ranks = {}, {}
            for _, wanted, text, text_id, priority, boxed, first, block_id in group:
                if wanted:
                    needles.setdefault(text, []).append(text_id)
                else:  # a null is the smallest of its place
                    rank = (priority, boxed, first is not None, first, block_id is not None, block_id)
                    ranks[text] = max(ranks.get(text, rank), rank)
            for needle, (score, rank) in walk(needles, ranks):
                out += [(source, text_id, rank[-1], score) for text_id in needles[needle]]
            if len(out) >= 10_000:
                yield made()
                out = []
        if out:
            yield made()

    schema = f"source {kind(asked, 'source')}, text_id {kind(asked, 'text_id')}, block_id {kind(held, 'rank.block_id')}, score int"
    return rows.repartition("source").sortWithinPartitions("source").mapInArrow(found, schema)


def walk(needles, ranks: dict[str, tuple]) -> Iterator[tuple[str, tuple[int, tuple]]]:
    """(needle, (score, rank)) of the needles that belong to a block of the same document; ranks: the best of each block text."""
    # Blocks from the best on: the first that holds a pattern is the one to take. No text has a blank.
    blocks = sorted(ranks, key=ranks.get, reverse=True)
    whole, starts = "\n".join(blocks), list(accumulate((len(b) + 1 for b in blocks), initial=0))

    def holder(pattern: str) -> tuple | None:
        at = whole.find(pattern)
        return ranks[blocks[bisect_right(starts, at) - 1]] if at >= 0 else None

    best: dict[str, tuple[int, tuple]] = {}
    for text, rank in ranks.items():
        for pattern, score in ((text, len(text)), (text[:OPENING], OPENING))[: 1 + (len(text) > OPENING)]:
            best[pattern] = max(best.get(pattern, (score, rank)), (score, rank))
    offers = sorted(((*offer, pattern) for pattern, offer in best.items()), reverse=True)
    for needle in needles if blocks else ():
        rank = holder(needle)
        found = (len(needle), rank) if rank else None
        if not rank and len(needle) > OPENING:
            rank = holder(needle[:OPENING])
            found = (OPENING, rank) if rank else None
        for *offer, pattern in offers:
            if found and tuple(offer) <= found:
                break
            if pattern in needle:
                found = tuple(offer)
                break
        if found:
            yield needle, found


def _looked_up(asked: DataFrame, held: DataFrame) -> DataFrame:
    """The same by joins on minimizers, for documents that are too large for a walk."""
    def patterns(rows: DataFrame, *more: str) -> DataFrame:
        """The texts themselves and the openings of longer ones."""
        opening = F.when(F.length("text") > OPENING, F.left("text", F.lit(OPENING)))
        return rows.select("source", F.col("text").alias("whole"), *more, F.explode(F.array_compact(F.array("text", opening))).alias("pattern"))

    block_texts = held.groupBy("source", "text").agg(F.max("rank").alias("rank"))
    needles = asked.select("source", F.col("needle").alias("text")).distinct()
    score = F.when(F.col("whole") == F.col("pattern"), F.length("pattern")).otherwise(OPENING).alias("score")

    # Blocks that hold a text or its opening: the best of them for each distinct pattern.
    of_needles = patterns(needles)
    into = occurrences(of_needles.select("source", "pattern").distinct(), block_texts.select("source", "text")).join(block_texts, ["source", "text"])
    into = into.groupBy("source", "pattern").agg(F.max("rank").alias("rank"))
    down = of_needles.join(into, ["source", "pattern"]).select("source", F.col("whole").alias("needle"), score, "rank")
    # Texts that hold a block or its opening: for each distinct pattern the best block that has it.
    best = patterns(block_texts, "rank").groupBy("source", "pattern").agg(F.max(F.struct(score, "rank")).alias("best"))
    up = occurrences(best.select("source", "pattern"), needles).join(best, ["source", "pattern"]).select("source", F.col("text").alias("needle"), "best.score", "best.rank")
    found = down.unionByName(up).groupBy("source", "needle").agg(F.max(F.struct("score", "rank")).alias("best"))
    return asked.join(found, ["source", "needle"]).select("source", "text_id", "best.rank.block_id", "best.score")
