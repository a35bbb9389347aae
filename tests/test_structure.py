"""Structural split with edges, and formulas, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidenceframe.ingestion_queries import GRAMMARS
from evidenceframe.operators import formulas, structure
from evidenceframe.settings import Settings

SMALL = Settings(hard_chars=120, hard_part_min=40, hard_overlap=10)
TINY = Settings(hard_chars=8, hard_part_min=4, hard_overlap=1)
NODES = "node_id string, modality string, text string, bbox array<int>, bbox_items array<array<int>>"
EDGES = "src_id string, relation string, pos int, dst_id string"


def test_split_rewrites_references(spark):
    text = ("Sentence one. Sentence two. Sentence three. " * 8).strip()
    nodes = spark.createDataFrame([("t", "text", text, None, None), ("f", "formula", "x=1" * 100, None, None), ("u", "text", "short", None, None), ("n", "text", None, None, None)], NODES)
    edges = [("f", "context_node_ids", 0, "u"), ("f", "context_node_ids", 1, "t"), ("f", "context_node_ids", 2, "u"), ("f", "context_prev_node_id", 0, "t"), ("t", "next_id", 0, "u"), ("u", "prev_id", 0, "t"), ("t", "child_ids", 0, "f")]
    split = structure.split_nodes(nodes, SMALL)
    rows = {r.node_id: r for r in split.collect()}
    parts = [f"t:part:{i}" for i in range(rows["t:part:0"].part_count)]
    assert set(rows) == {*parts, "f", "u", "n"} and len(parts) > 1
    assert all(len(rows[p].text) <= 120 and rows[p].parent_id == "t" and rows[p].original_length == len(text) for p in parts)
    got = sorted(map(tuple, structure.rewritten_edges(spark.createDataFrame(edges, EDGES), split).collect()))
    want = [("f", "context_node_ids", i, d) for i, d in enumerate(["u", *parts, "u"])] + [("f", "context_prev_node_id", 0, parts[0]), ("u", "prev_id", 0, parts[0])]
    want += [(p, "child_ids", 0, "f") for p in parts] + [(parts[-1], "next_id", 0, "u")]
    for a, b in zip(parts, parts[1:], strict=False):
        want += [(a, "next_id", 0, b), (a, "doc_next_node_id", 0, b), (b, "prev_id", 0, a), (b, "doc_prev_node_id", 0, a)]
    assert got == sorted(want)


def test_parts_drop_the_union_box(spark):
    boxes = [[0, 0, 50, 50], [100, 100, 200, 200]]
    nodes = spark.createDataFrame([("a", "text", "alpha. beta. gamma. delta.", [0, 0, 200, 200], boxes), ("b", "text", "alpha. beta. gamma.", [0, 0, 1, 1], [[0, 0, 1, 1]])], NODES)
    rows = structure.split_nodes(nodes, TINY).collect()
    assert all(r.bbox is None and r.bbox_items is None and r.parent_bbox_items == boxes and r.bbox_merge_policy == "dropped_on_structural_split" for r in rows if r.parent_id == "a")
    assert all(r.bbox == [0, 0, 1, 1] and r.parent_bbox is None for r in rows if r.parent_id == "b") and len(rows) > 5


@pytest.mark.parametrize("seed", range(4))
def test_parts_cover_the_text(seed):
    """Every part is in the text after the one before it, no longer than the limit, and no word is lost."""
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["wort ", "Satz. ", "Ende!\n\n", "".join(rnd.choices("abcdefgh", k=150)), "\n", "。", " "]) for _ in range(300))
    parts = structure.parts_of(text, 120, 40, 10)
    at = 0
    for p in parts:
        found = text.find(p, max(0, at - 12 - len(p)))
        assert found >= 0 and len(p) <= 120 and not text[at:found].strip()
        at = max(at, found + len(p))
    assert not text[at:].strip()


def test_boundaries():
    assert structure.boundary("aaaa. bbbb", 4) == 6 and structure.boundary("aaaa. bbbb", 7) == 10
    assert structure.boundary("aaaa\nbb bbb", 4) == 5 and structure.boundary("aa\n\n  bbbb", 3) == 4 and structure.boundary("aaaa bbbb", 4) == 5


def plain_formulas(text, s, flags, group):
    """The six grammars one after another in plain Python."""
    keep = lambda body, kind: plain_kept(body, kind, s, **flags)
    spans = []
    for kind, expression, body in GRAMMARS:
        for m in re.finditer(expression.replace(r"\3", r"\1"), text, re.DOTALL):
            latex = (m[1] if body else m[0]).strip()
            if keep(latex, kind):
                spans.append((m.start(), m.end(), kind, latex, 1))
    at = [m.start() for m in re.finditer(formulas.DOLLAR, text)]
    i = 0
    while i + 1 < len(at):
        body = text[at[i] + 1 : at[i + 1]]
        if "\n" not in body and keep(body, "inline"):
            spans.append((at[i], at[i + 1] + 1, "inline", body.strip(), 1))
            i += 1
        i += 1
    out = []
    for x in sorted(spans, key=lambda x: (x[0], -x[1])):
        if all(x[0] >= y[1] or x[1] <= y[0] for y in out):
            out.append(x)
    if group:
        joined = []
        for x in out:
            gap = text[joined[-1][1] : x[0]] if joined else "x"
            if joined and x[2] == joined[-1][2] == "display" and not gap.strip() and gap.count("\n") <= s.formula_gap_lines + 1:
                a = joined.pop()
                x = (a[0], x[1], "display", a[3] + "\n\n" + x[3], a[4] + 1)
            joined.append(x)
        out = joined
    return out


def plain_kept(body, kind, s, text_only=False, references=False, notes=False):
    short = " ".join(body.split())
    command = re.search(formulas.COMMAND, short)
    if not short or (kind == "inline" and (text_only or len(short) < s.formula_min)):
        return False
    if (references and re.match(formulas.REFERENCE, short)) or (notes and re.match(formulas.NOTE, short)):
        return False
    letters = sum(c.isalpha() for c in short) / len(short.replace(" ", ""))
    if not command and (re.search(formulas.CJK, short) or (len(short) > 80 and letters > 0.65)):
        return False
    return bool(command) or any(c in short for c in formulas.SYMBOLS)


def found(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", formulas.formulas(F.col("t"), **options).alias("f")).collect()
    return [[tuple(x) for x in r.f] for r in sorted(rows)]


def test_known_formulas(spark):
    s = Settings(formula_min=1)
    text = "Price is $5, not a formula. Inline math is $E=mc^2$.\n$$\\frac{a}{b}=c$$\n\\begin{equation}x^2+y^2=z^2\\end{equation}"
    got = found(spark, [text, "Use $$a_i=b_i+c_i$$ in the proof.", None, ""], s=s)
    assert [(x[2], x[3]) for x in got[0]] == [("inline", "E=mc^2"), ("display", "\\frac{a}{b}=c"), ("environment", "\\begin{equation}x^2+y^2=z^2\\end{equation}")]
    assert [text[a:b] for a, b, *_ in got[0]][:2] == ["$E=mc^2$", "$$\\frac{a}{b}=c$$"]
    assert [x[3] for x in got[1]] == ["a_i=b_i+c_i"] and got[2:] == [[], []]
    got = found(spark, [r"$[12]$ $^{1,2,*}$ $Q$ $E=mc^2$ $$x+y=z$$"], text_only=True, references=True, notes=True)
    assert [x[3] for x in got[0]] == ["x+y=z"]
    got = found(spark, ["$$a=b$$\n\n$$b=c$$\n\nparagraph\n\n$$c=d$$"], group=True)
    assert [(x[3], x[4]) for x in got[0]] == [("a=b\n\nb=c", 2), ("c=d", 1)]


@pytest.mark.parametrize("flags", [{}, {"references": True, "notes": True}, {"text_only": True}])
def test_formulas_equal_plain_python(spark, flags):
    rnd = random.Random(len(flags))
    bits = ["$", "$$", "\\$", "\\[", "\\]", "\\(", "\\)", "\\begin{align}", "\\end{align}", "\\begin{cases}", "\\end{cases}", "<math >", "</MATH>", "x=1+2", "a_i", "\\frac{a}{b}", "[3, 4]", "^{1,2}", "汉字", "é", "word ", "\n", "\n\n", " " , "plain text of many words " * 4]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(400)]
    s = Settings(formula_min=3)
    for group in (False, True):
        got = found(spark, texts, s=s, group=group, **flags)
        want = [plain_formulas(t, s, flags, group) for t in texts]
        assert got == want and sum(map(len, want)) > 100


def test_unclosed_formulas_are_linear():
    for opening in ("\\begin{split}", "$$", "\\[", "<math ", "$a"):
        assert len(formulas.spans_of(opening * 200_000, formulas.Rules())) < 2
