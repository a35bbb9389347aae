"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every document gets a rate between 0 and ``CAP``. Among the rates that give each source its target
number of words, entropy balancing takes those closest to 1 in (bounded) relative entropy. The dual
has one variable a source, and its solution tilts rates exponentially by document size:
``rate = CAP / (1 + (CAP - 1) * exp(-t * size / mean size))``. Newton's method solves the dual for
all sources at once; each step is one aggregation over the (source, size) histogram, which is all
that the rates depend on. Rates are rounded to whole copies by running totals over the histogram,
then a few copies are moved so that each
source comes close to its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, written

WEIGHTS = (1, 2, 3)
CAP = 3
#: Hashes of one size and source, or rows of one hash, that one window ranks, about.
RANKED = 5_000
#: Cells that a join may broadcast, by count; above it both sides are shuffled.
SMALL = 400_000


def _size():
    """The number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_SQL)), F.lit(0)).cast("bigint")


def _mark():
    """The hash by which documents of one size take turns."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.lit(3))


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _mark().alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): shares by weight, at most ``cap`` times the source.

    Sources take the weights in turn, in the order of their code points, null last. What a source
    cannot take goes to the others by weight, until none is above its cap.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())  # one row a source
    at = (F.row_number().over(order) - 1) % len(weights)
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("double"))
    sources = written(sources.withColumn("capped", F.lit(False)), "mix")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full, weight, count = sources.agg(
            F.coalesce(F.sum(F.when(F.col("capped"), cap * F.col("source_size"))), F.lit(0)), F.sum(F.when(~F.col("capped"), F.col("w"))), F.count_if("capped")
        ).first()
        if count == capped or not weight:
            break
        capped, level = count, (total - full) / weight
        sources = written(sources.withColumn("capped", F.col("capped") | (F.col("w") * level > cap * F.col("source_size"))), "mix")
    return sources.select("source", "source_size", F.when(F.col("capped"), F.col("source_size").cast("double") * cap).otherwise(F.col("w") * level).alias("target"))


def allotted(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source and size of ``sizes`` (source, size, h): s, z, source_size, target,
    rate, each, cut, slots, ties.

    Documents get ``each`` copies, and one more where their hash is below ``cut``, or at it for
    ``slots`` of the ``ties`` rows there.
    """
    goal = written(targets(sizes, weights, cap), "mix")
    cells = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    cells = cells.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    pages = Window.partitionBy("source")
    cells = written(cells.withColumn("z", F.col("size") * F.sum("n").over(pages) / F.greatest(F.col("source_size"), F.lit(1))), "mix")
    # Newton's method, kept inside a bracket. A step that has not halved the gap is followed by one
    # that halves the bracket, so that it ends.
    tilt = written(
        goal.select("source", "source_size", "target", F.lit(0.0).alias("t"), F.lit(-64.0).alias("lo"), F.lit(64.0).alias("hi"), F.lit(float("inf")).alias("was"), F.lit(False).alias("done")), "mix")
    rate = lambda t, z: cap / (1 + (cap - 1) * F.exp(-t * z))
    while tilt.where("not done").limit(1).count():
        now = cells.join(tilt.select(F.col("source").alias("s"), "t"), F.col("source").eqNullSafe(F.col("s"))).withColumn("r", rate(F.col("t"), F.col("z")))
        mass = F.col("n") * F.col("size")
        sums = now.groupBy("s").agg(F.sum(mass * F.col("r")).alias("has"), F.sum(mass * F.col("z") * F.col("r") * (1 - F.col("r") / cap)).alias("slope"))
        step = tilt.join(sums, tilt.source.eqNullSafe(sums.s)).withColumn("gap", F.col("has") - F.col("target"))
        step = step.withColumn("lo", F.when(F.col("gap") < 0, F.col("t")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") >= 0, F.col("t")).otherwise(F.col("hi")))
        jump = F.col("t") - F.col("gap") / F.col("slope")
        inside = (F.abs("gap") <= F.col("was") / 2) & (F.col("slope") > 0) & (jump > F.col("lo")) & (jump < F.col("hi"))
        done = F.col("done") | (F.abs(F.col("gap")) <= 1e-7 * F.col("target")) | (F.col("target") >= cap * F.col("source_size")) | (F.col("hi") - F.col("lo") < 1e-9)
        tilt = written(
            step.select("source", "source_size", "target", F.when(done, F.col("t")).when(inside, jump).otherwise((F.col("lo") + F.col("hi")) / 2).alias("t"), "lo", "hi", F.abs("gap").alias("was"), done.alias("done")), "mix"
        )
    full = F.col("target") >= cap * F.col("source_size")
    final = tilt.select(F.col("source").alias("s"), F.round("t", 7).alias("t"))
    cells = cells.join(final, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = cells.withColumn("rate", F.when(full, F.lit(float(cap))).otherwise(rate(F.col("t"), F.col("z"))))
    # Whole copies for each cell: the growth of the rounded running total, in the order of sizes.
    # A source has at most as many cells as its longest text has words.
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("run", F.sum(F.col("n") * F.col("rate")).over(along))
    before = F.coalesce(F.lag("run").over(Window.partitionBy("source").orderBy("size")), F.lit(0.0))
    cells = cells.withColumn("give", (F.floor(F.col("run") + 0.5) - F.floor(before + 0.5)).cast("bigint"))
    cells = _settled(written(cells.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", "rate", "give"), "mix"), cap)
    # Within a cell, the first documents by hash get the copies that are left over. Rows of one hash
    # are counted first, and large cells are ranked in parts of the hashes' range.
    each = F.floor(F.col("give") / F.col("n")).cast("bigint")
    cells = written(cells.select("s", "z", "n", "source_size", "target", "rate", each.alias("each"), (F.col("give") - each * F.col("n")).alias("extra")), "mix")
    key = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    marks = sizes.groupBy("source", "size", "h").agg(F.count("*").alias("c")).join(cells.where("extra > 0").select("s", "z", "n", "extra"), key)
    wide = F.ceil(F.col("n") / RANKED).cast("double")
    part = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * wide)
    marks = written(marks.select("s", "z", "h", "c", "extra", part.alias("part")), "marks")
    ahead = Window.partitionBy("s", "z").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = marks.groupBy("s", "z", "part", "extra").agg(F.sum("c").alias("c")).withColumn("skip", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    parts = parts.where("skip < extra and extra <= skip + c").select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("part").alias("p2"), "skip")
    last = marks.join(parts, F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")) & (F.col("part") == F.col("p2")))
    within = Window.partitionBy("s", "z").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("slots", F.col("extra") - F.col("skip") - F.coalesce(F.sum("c").over(within), F.lit(0))).where("slots > 0 and slots <= c")
    last = last.select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("h").alias("cut"), "slots", F.col("c").alias("ties"))
    return written(cells.join(last, F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")), "left").drop("s2", "z2", "n", "extra"), "allotted")


def _with_copies(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` (__source, __size, __h and others) with their cell's columns and ``copies``."""
    cells = F.broadcast(cells) if cells.limit(SMALL + 1).count() <= SMALL else cells
    rows = rows.join(cells, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__size") == F.col("z")))
    more = F.when(F.col("__h") < F.col("cut"), 1).when((F.col("__h") == F.col("cut")) & (F.col("slots") == F.col("ties")), 1).otherwise(0)
    out = rows.withColumn("copies", (F.col("each") + more).cast("bigint"))
    if not cells.where("slots < ties").limit(1).count():
        return out
    # Rows that repeat an id and a text share the cut, and only some get the copy: these are
    # written with numbers, and ranked in parts.
    torn = F.coalesce((F.col("__h") == F.col("cut")) & (F.col("slots") < F.col("ties")), F.lit(False))
    some = written(out.where(torn).withColumn("__no", F.monotonically_increasing_id()), "torn")
    some = some.withColumn("__part", F.pmod(F.xxhash64("__no"), F.ceil(F.col("ties") / RANKED)))
    counts = some.groupBy("s", "z", "__part").agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy("s", "z").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("s").alias("__s"), F.col("z").alias("__z"), F.col("__part").alias("__p"), F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__skip"))
    some = some.join(counts, F.col("s").eqNullSafe(F.col("__s")) & (F.col("z") == F.col("__z")) & (F.col("__part") == F.col("__p")))
    rank = F.col("__skip") + F.row_number().over(Window.partitionBy("s", "z", "__part").orderBy("__no"))
    some = some.withColumn("copies", F.col("each") + F.when(rank <= F.col("slots"), 1).otherwise(0))
    return out.where(~torn).unionByName(some.select(out.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row of ``docs``.

    A null source is a source of its own, a null text has size 0. Documents of size 0 are taken
    about once and add nothing. Repeated rows each count and each return a row; the order among
    documents of one size is by a hash of id and text. An empty table gives no rows. Reruns agree.
    """
    sizes = written(with_sizes(docs), "sizes")
    cells = allotted(sizes, weights, cap)
    rows = _with_copies(sizes.select("doc_id", F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("h").alias("__h")), cells)
    return rows.select(
        "doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("source_size").cast("bigint").alias("source_size"), "target", "rate", "copies",
        (F.col("copies") * F.col("__size")).alias("taken"),
    )


def _settled(cells: DataFrame, cap: int) -> DataFrame:
    """Cells whose copies add up closer to the targets.

    Each pass moves every source by as many copies as fit of its largest size that is not above the
    gap left by rounding, until no size fits: the gap is then below the least size that has room.
    """
    while True:
        gaps = cells.groupBy("s").agg(F.sum(F.col("give") * F.col("z")).alias("has")).withColumnRenamed("s", "k")
        now = cells.join(gaps, F.col("s").eqNullSafe(F.col("k"))).drop("k").withColumn("gap", F.col("target") - F.col("has")).drop("has")
        room = F.when(F.col("gap") > 0, cap * F.col("n") - F.col("give")).otherwise(F.col("give"))
        fits = F.when((F.col("z") > 0) & (room > 0) & (F.col("z") <= F.abs("gap")), F.least(room, F.floor(F.abs("gap") / F.greatest("z", F.lit(1)))))
        now = written(now.withColumn("move", F.coalesce(fits, F.lit(0)).cast("bigint")), "mix")
        best = now.where("move > 0").groupBy("s").agg(F.max("z").alias("bz")).withColumnRenamed("s", "k")
        if not best.limit(1).count():
            return cells
        turn = F.when(F.col("bz") == F.col("z"), F.signum("gap").cast("bigint") * F.col("move")).otherwise(0)
        now = now.join(best, F.col("s").eqNullSafe(F.col("k")), "left").withColumn("give", F.col("give") + F.coalesce(turn, F.lit(0)))
        cells = written(now.select("s", "z", "n", "source_size", "target", "rate", "give"), "mix")
    return cells


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, numbered by ``copy`` from 1.

    Each row is judged by itself, so rows with a null or repeated doc_id get what ``mix`` takes of
    them. A column ``copy`` of ``docs`` is replaced, wherever its name stood.
    """
    docs = docs.drop("copy")
    cells = allotted(written(with_sizes(docs), "sizes"), weights, cap)
    kept = [F.col(c).alias(f"__{i}_{c}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*kept, F.col("source").cast("string").alias("__source"), _size().alias("__size"), _mark().alias("__h"))
    out = _with_copies(rows, cells).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"__{i}_{c}").alias(c) for i, c in enumerate(docs.columns)], F.col("__copy").alias("copy"))
