"""Boxes as arrays (x0, y0, x1, y1)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    """The common box, or null where the boxes do not overlap."""
    c = F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    return F.when((c[2] > c[0]) & (c[3] > c[1]), c)


def iou(a: Column, b: Column) -> Column:
    common = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def normalised(b: Column) -> Column:
    """To the 0..1000 range: boxes within 0..1 are scaled, boxes beyond 1000 are null."""
    most = F.array_max(b)
    ok = (F.size(b) == 4) & (b[2] > b[0]) & (b[3] > b[1])
    return F.when(~ok | (most > 1000), None).when(most <= 1, F.transform(b, lambda x: x * 1000)).otherwise(b)


#: Boxes whose cells are counted at once.
FEW = 128


def _cells(b: np.ndarray) -> float:
    """Area of a few boxes' union: cells between neighbouring edges that any box covers."""
    xs, ys = np.unique(b[:, [0, 2]]), np.unique(b[:, [1, 3]])
    marks = np.zeros((len(xs), len(ys)), np.int32)
    x0, y0, x1, y1 = (np.searchsorted(v, b[:, i]) for i, v in enumerate((xs, ys, xs, ys)))
    for x, y, sign in ((x0, y0, 1), (x1, y1, 1), (x0, y1, -1), (x1, y0, -1)):
        np.add.at(marks, (x, y), sign)
    inside = (marks.cumsum(0).cumsum(1) > 0)[:-1, :-1]
    return float(np.diff(xs) @ inside @ np.diff(ys))


def covered_area(b: np.ndarray) -> float:
    """Area that any of the boxes (rows x0, y0, x1, y1) covers.

    The plane is halved at an edge until a box covers a part or few boxes are left in it.
    """
    b = b[np.isfinite(b).all(1) & (b[:, 2] > b[:, 0]) & (b[:, 3] > b[:, 1])]
    parts, todo = [], [(b, [*b[:, :2].min(0), *b[:, 2:].max(0)])] if len(b) else []
    while todo:
        b, (x0, y0, x1, y1) = todo.pop()
        if ((b[:, :2] <= (x0, y0)).all(1) & (b[:, 2:] >= (x1, y1)).all(1)).any():
            parts.append((x1 - x0) * (y1 - y0))
        elif len(b) <= FEW:
            parts.append(_cells(b))
        else:
            edges = [e[(e > lo) & (e < hi)] for e, lo, hi in ((b[:, [0, 2]].ravel(), x0, x1), (b[:, [1, 3]].ravel(), y0, y1))]
            axis = int(len(edges[1]) > len(edges[0]))
            cut = float(np.partition(edges[axis], len(edges[axis]) // 2)[len(edges[axis]) // 2])
            for side in (axis, axis + 2):  # below the cut it is the upper bound, above it the lower
                bounds = [x0, y0, x1, y1]
                bounds[axis + 2 if side == axis else axis] = cut
                near = b[b[:, axis] < cut] if side == axis else b[b[:, axis + 2] > cut]
                if len(near):
                    todo.append((np.clip(near, bounds[:2] * 2, bounds[2:] * 2), bounds))
    return math.fsum(parts)


def union_area(boxes: Column) -> Column:
    """Area that any of the boxes of an array covers; boxes with a number that is missing or not finite cover nothing."""

    @F.arrow_udf("double")
    def covered(x: pa.Array) -> pa.Array:
        each = (x.slice(i, 1).flatten() for i in range(len(x)))
        return pa.array([None if not known else covered_area(b.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 4)) for known, b in zip(x.is_valid().to_pylist(), each, strict=True)], pa.float64())

    return covered(boxes)


#: Boxes of a group in a tile, about, and the most tiles a side.
TILE, SIDES = 1024, 64


def union_areas(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, covered): the area that the boxes (keys, box) of each group cover together.

    The plane is cut into tiles at quantiles of the edges, as fine as the largest group asks. A tile
    that one box of a group covers needs no other; of the rest, boxes go to the tiles they lie in,
    clipped, so that no task holds a whole group. Boxes with a number that is missing or not finite
    cover nothing; their group has a row.
    """
    at = [F.col("box")[i].cast("double") for i in range(4)]
    good = (F.size("box") == 4) & F.forall("box", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (at[2] > at[0]) & (at[3] > at[1])
    most = found.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    sides = min(SIDES, math.ceil(math.sqrt(most / TILE)))
    if sides < 2:
        return found.groupBy(*keys).agg(F.coalesce(union_area(F.collect_list(F.when(good, F.col("box")))), F.lit(0.0)).alias("covered"))
    steps = [i / sides for i in range(sides + 1)]
    edges = found.where(good).select(F.explode(F.array(F.struct(at[0].alias("x"), at[1].alias("y")), F.struct(at[2].alias("x"), at[3].alias("y")))).alias("e"))
    # the outer tiles end beyond every box, as quantiles are approximate
    ends = edges.agg(*[f(f"e.{c}") for c in "xy" for f in (F.min, F.max)], *[F.percentile_approx(f"e.{c}", steps, 1000) for c in "xy"]).first()
    if ends[0] is None:
        return found.select(*keys, F.lit(0.0).alias("covered")).distinct()
    lines = [sorted({*ends[2 * i : 2 * i + 2], *(v for v in ends[4 + i] if ends[2 * i] < v < ends[2 * i + 1])}) for i in (0, 1)]
    cuts = [F.array(*map(F.lit, line)) for line in lines]

    def spans(i: int) -> Column:
        """Places of the tiles that a box meets along an axis."""
        inner = F.array(*map(F.lit, lines[i][1:-1])).cast("array<double>")
        return F.sequence(F.size(F.filter(inner, lambda c: c <= at[i])), F.size(F.filter(inner, lambda c: c < at[i + 2])))

    tiles = F.flatten(F.transform(spans(0), lambda i: F.transform(spans(1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    dealt = found.select(*keys, "box", F.explode_outer(F.when(good, tiles)).alias("t")).select(*keys, "box", "t.i", "t.j")
    low, high = ([F.get(cut, F.col(p) + up) for cut, p in zip(cuts, "ij", strict=True)] for up in (0, 1))
    whole = (at[0] <= low[0]) & (at[1] <= low[1]) & (at[2] >= high[0]) & (at[3] >= high[1])
    full = dealt.where(whole).select(*keys, "i", "j").distinct()
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (*keys, "i", "j")]
    open_ = dealt.where(F.coalesce(~whole, F.lit(True))).alias("d").join(small(full).alias("f"), same, "left_anti")
    clipped = F.when(F.col("i").isNotNull(), F.array(F.greatest(at[0], low[0]), F.greatest(at[1], low[1]), F.least(at[2], high[0]), F.least(at[3], high[1])))
    parts = open_.groupBy(*keys, "i", "j").agg(union_area(F.collect_list(clipped)).alias("part"))
    parts = parts.select(*keys, "part").union(full.select(*keys, ((high[0] - low[0]) * (high[1] - low[1])).alias("part")))
    return parts.groupBy(*keys).agg(F.sum("part").alias("covered"))
