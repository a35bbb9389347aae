import random
import time

import numpy as np
import pytest

from evidenceframe.functions import boxes


def cells(found):
    return len({(x, y) for x0, y0, x1, y1 in found for x in range(x0, x1) for y in range(y0, y1)})


@pytest.mark.parametrize("tile", [1024, 10])
def test_areas_of_groups_equal_the_cells(spark, monkeypatch, tile):
    monkeypatch.setattr(boxes, "TILE", tile)
    monkeypatch.setattr(boxes, "FEW", 6)
    rnd = random.Random(8)
    box = lambda most: (x := rnd.randrange(60), y := rnd.randrange(60), x + rnd.randrange(1, most), y + rnd.randrange(1, most))
    groups = {1: [box(8) for _ in range(400)], 2: [box(40) for _ in range(300)], None: [box(3) for _ in range(50)], 4: [(0, 0, 9, 9)] * 30, 5: []}
    rows = [(k, [float(v) for v in b]) for k, found in groups.items() for b in found]
    rows += [(5, [1.0, 1.0, None, 2.0]), (5, [1.0, 1.0, float("nan"), 2.0]), (5, [3.0, 1.0, 2.0, 2.0]), (5, None), (1, [0.0, 0.0, float("inf"), 2.0])]
    got = boxes.union_areas(spark.createDataFrame(rows, "case_id int, box array<double>"), "case_id").collect()
    assert {r.case_id: r.covered for r in got} == {k: cells(found) for k, found in groups.items()} and len(got) == 5


def test_many_boxes_are_not_compared_with_every_strip():
    """60 000 boxes apart, for which strips that each filter all boxes take 10^10 steps."""
    x, y = (v.ravel().astype(float) for v in np.meshgrid(np.arange(300), np.arange(200)))
    began = time.time()
    assert boxes.covered_area(np.stack([x, y, x + 0.5, y + 0.5], 1)) == 15_000 and time.time() - began < 60
