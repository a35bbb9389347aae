"""Image units by hand-made documents, and by what must hold of any."""

import random

import pytest

from evidenceframe.operators import image_units as u

BLOCKS = "source string, ord int, block_id string, type string, text string, page int, box array<double>, source_kind string, image_path string"
LONG = "Figure 2. The long caption of the second image tells what is seen in it and where it was taken"


def rows(*given):
    return [("d", i, f"b{i}", *(list(g) + [None] * 6)[:6]) for i, g in enumerate(given)]


def units(spark, blocks):
    got = u.image_units(spark.createDataFrame(blocks, BLOCKS)).collect()
    return [(r.image_path, r.caption_ids, r.semantic_ids, r.image_ids) for r in sorted(got, key=lambda r: (r.source, r.unit))]


def image(path, page=1):
    return ("image", None, page, None, "layout", path)


def caption(text, page=1, kind="layout", path=None):
    return ("image_caption", text, page, None, kind, path)


TEXT = ("text", "words", 1)


@pytest.mark.parametrize(("given", "want"), [
    ((image("a"), caption("Figure 1. x")), [("a", ["b1"], [], ["b0"])]),
    ((caption("Figure 1. x"), image("a")), [("a", ["b0"], [], ["b1"])]),
    # the text between them ends the wait, but the captions are not alike to any other
    ((caption("One"), TEXT, image("a")), [(None, ["b0"], [], []), ("a", [], [], ["b2"])]),
    ((image("a"), TEXT, caption("Figure 1. x")), [("a", [], [], ["b0"]), (None, ["b2"], [], [])]),
    ((image("a"), ("page_number", "3", 1), caption("x")), [("a", ["b2"], [], ["b0"])]),
    # another page, and too far in the order
    ((image("a"), caption("x", 2)), [("a", [], [], ["b0"]), (None, ["b1"], [], [])]),
    ((image("a"), *[("page_number", "1", 1)] * 5, caption("x")), [("a", [], [], ["b0"]), (None, ["b6"], [], [])]),
    # a second caption: of the same number, of another, without one, and of a better parser than the unnumbered first
    ((image("a"), caption("Figure 1"), caption("Fig. 1 again")), [("a", ["b1", "b2"], [], ["b0"])]),
    ((image("a"), caption("Figure 1"), caption("Figure 2")), [("a", ["b1"], [], ["b0"]), (None, ["b2"], [], [])]),
    ((image("a"), caption("one"), caption("two")), [("a", ["b1"], [], ["b0"]), (None, ["b2"], [], [])]),
    ((image("a"), caption("one"), caption("Figure 2", kind="content_list")), [("a", ["b1", "b2"], [], ["b0"])]),
    # of two captions the later waits; one path is one unit; semantics without a path stand alone
    ((caption("first"), caption("second"), image("a")), [(None, ["b0"], [], []), ("a", ["b1"], [], ["b2"])]),
    ((image("a"), TEXT, image(" a "), ("image_semantic", "a dog", 1, None, None, "a")), [("a", [], ["b3"], ["b0", "b2"])]),
    ((("image_semantic", "a cat", 1), ("image_semantic", "a  cat", 1)), [(None, [], ["b0", "b1"], [])]),
    # a caption elsewhere in the document is linked by its words, unless the figure numbers differ
    ((image("a"), caption(LONG), TEXT, caption(LONG.upper() + " too")), [("a", ["b1", "b3"], [], ["b0"])]),
    ((image("a"), caption(LONG), TEXT, caption(LONG.replace("2", "3"))), [("a", ["b1"], [], ["b0"]), (None, ["b3"], [], [])]),
    ((image("a"), caption("Red fox at dawn"), image("b"), caption("Red fox at dawn"), TEXT, caption("fox at dawn red")), [("a", ["b1", "b5"], [], ["b0"]), ("b", ["b3"], [], ["b2"])]),
    # a waiting caption that the next image does not accept goes
    ((caption("x", 2), image("a")), [("a", [], [], ["b1"])]),
    ((TEXT, TEXT), []),
])
def test_units(spark, given, want):
    assert units(spark, rows(*given)) == want


def test_likeness():
    assert u.likeness(u.plain_caption("Figure 1: A$_b$"), u.plain_caption("figure 1 a b")) == 1.0
    assert u.likeness("figure 1 a b", "figure 2 a b") == 0.0 and u.likeness("a b c d", "a b c x y") == 0.75 and u.likeness("", "a") == 0.0
    words = "x" * 20 + " " + "y" * 27
    assert u.likeness(words, f"z{words}z w") == u.HELD_LIKENESS and u.likeness("fig a1 q", "q figure a1") == 2 / 3


def test_best_caption():
    block = lambda i, text, box=None, kind=None: u.Block({"block_id": str(i), "ord": i, "type": "image_caption", "page": 1, "text": text, "box": box, "source_kind": kind, "image_path": None})
    assert u.Unit(block(0, "words alone"), block(1, "Figure 1 shows")).best_caption().id == "1"
    assert u.Unit(block(0, "Figure 1 a"), block(1, "Figure 1 b", [1.0])).best_caption().id == "1"
    assert u.Unit(block(0, "Figure 1 a"), block(1, "Figure 1 b", kind="layout")).best_caption().id == "1"
    assert u.Unit(block(0, "Figure 1 a"), block(1, "Figure 1 a"), block(2, "Figure 1")).best_caption().id == "0" and u.Unit().best_caption() is None


def test_every_image_block_is_in_one_unit_of_its_document(spark):
    """Of random documents: a path is one unit, and no block is in two; only captions that no image accepted are in none."""
    rnd, blocks = random.Random(1), []
    for i in range(600):
        kind = rnd.choice(["image", "image_caption", "image_semantic", "text", "page_number"])
        text = rnd.choice([None, "Figure 1 dog", "Figure 2 a cat sits", "a cat sits", f"caption {i}"])
        blocks.append((f"s{i % 9}", i // 9, f"b{i}", kind, text, rnd.choice([None, 1, 2]), rnd.choice([None, [1.0]]), rnd.choice([None, "layout"]), rnd.choice([None, "a.png", "b.png"]) if kind.startswith("image") else None))
    got = u.image_units(spark.createDataFrame(blocks, BLOCKS)).collect()
    ids = [x for r in got for x in (*r.caption_ids, *r.semantic_ids, *r.image_ids)]
    images, refused = {b[2] for b in blocks if b[3].startswith("image")}, {b[2] for b in blocks if b[3] == "image_caption" and b[8] is None}
    assert len(ids) == len(set(ids)) and set(ids) <= images and images - set(ids) <= refused and len(ids) > 0.9 * len(images)
    assert all(len({r.unit for r in got if r.source == s and r.image_path == p}) <= 1 for s in {b[0] for b in blocks} for p in ("a.png", "b.png"))
    by = {b[2]: b for b in blocks}
    assert all(by[x][0] == r.source for r in got for x in r.caption_ids) and all(r.best_caption in r.caption_ids for r in got if r.caption_ids)
