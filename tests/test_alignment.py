"""Alignment of texts to blocks against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from evidenceframe import ingestion_queries
from evidenceframe.operators import alignment
from evidenceframe.operators.layout import SOURCE_PRIORITY

BLOCKS = "source string, ord int, block_id string, text string, page int, section string, box array<double>, source_kind string"


def plain(texts, blocks):
    out = {}
    for source, i, text in texts:
        a, best = "".join((text or "").split()), None
        for s, at, block, held, page, section, box, kind in blocks:
            b = "".join((held or "").split())
            if s != source or not a or not b or (page is None and section is None):
                continue
            score = min(len(a), len(b)) if a in b or b in a else 40 if (len(a) >= 40 and a[:40] in b) or (len(b) >= 40 and b[:40] in a) else 0
            offer = (score, SOURCE_PRIORITY.get(kind or "unknown", 10), box is not None, -at)
            if score and (best is None or offer > best[0]):
                best = (offer, block)
        if best:
            out[i] = (best[1], best[0][0])
    return out


def aligned(spark, texts, blocks):
    got = alignment.best_blocks(spark.createDataFrame(texts, "source string, text_id int, text string"), spark.createDataFrame(blocks, BLOCKS))
    return {r.text_id: (r.block_id, r.score) for r in got.collect()}


@pytest.mark.parametrize("shared", [False, True])
def test_alignment_equals_all_pairs(spark, shared):
    """Texts cut from blocks and blocks from texts, whole, by their openings, short ones, and with one opening shared by all."""
    rnd = random.Random(int(shared))
    word = lambda: rnd.choice(["alpha", "beta", "γδ", "x", "longer-word", "1999"])
    opening = " ".join(["page", "of", "the", "annual", "report", "with", "one", "long", "heading", "line"]) if shared else ""
    blocks, texts = [], []
    for at in range(90):
        text = f"{opening} " + " ".join(word() for _ in range(rnd.choice([1, 2, 5, 12, 40])))
        blocks.append((f"s{at % 2}", at, f"b{at}", rnd.choice([text, text, f" {text}\n", None, "  "]), rnd.choice([1, 1, None]), rnd.choice([None, "h"]), rnd.choice([None, [1.0]]), rnd.choice(list(SOURCE_PRIORITY) + [None, "other"])))
    for i in range(120):
        base = rnd.choice(blocks)[3] or "alpha"
        a = rnd.randrange(len(base))
        texts.append((f"s{i % 2}", i, rnd.choice([base, base[a:], base[: a + 1], base + " " + word(), base[:60] + " else", word(), None, ""])))
    want = plain(texts, blocks)
    assert aligned(spark, texts, blocks) == want and len(want) > 60


def test_equal_scores_take_the_better_block(spark):
    text = "some words that are in every block of the document and then more"
    blocks = [("s", 0, "first", text, 1, None, None, "layout"), ("s", 1, "boxed", text, 1, None, [1.0], "layout"), ("s", 2, "better", text, None, "h", None, "content_list"), ("s", 3, "nowhere", text + " x", None, None, [1.0], "content_list")]
    assert aligned(spark, [("s", 1, text), ("t", 2, text)], blocks) == {1: ("better", len(text.replace(" ", "")))}
    assert aligned(spark, [("s", 1, text)], blocks[:2]) == {1: ("boxed", len(text.replace(" ", "")))}


def test_minimizers_of_a_part_are_those_of_the_whole(spark):
    rnd = random.Random(1)
    whole = "".join(rnd.choice("abcdé汉𝛼") for _ in range(500))
    rows = spark.createDataFrame([(0, whole)] + [(i, whole[a : a + 16 + i]) for i, a in enumerate(range(0, 480, 9), 1)] + [(99, "short"), (100, None)], "i int, t string")
    got = {r.i: set(r.m) for r in rows.select("i", alignment.minimizers(F.col("t")).alias("m")).collect()}
    assert all(m and m <= got[0] for i, m in got.items() if 0 < i < 54) and not got[99] and not got[100] and len(got[0]) < 200


def test_minimizers_carry_no_text(spark):
    """Texts of a thousand characters have some hundreds of minimizers each; no row of those may hold the text."""
    rnd = random.Random(5)
    rows = [("s", "".join(rnd.choices("abcdefgh", k=1000))) for _ in range(40)]
    texts = spark.createDataFrame(rows, "source string, text string")
    patterns = spark.createDataFrame([(s, t[100:160]) for s, t in rows], "source string, pattern string")
    found = alignment.occurrences(patterns, texts)
    assert {tuple(r) for r in found.collect()} == {("s", t[100:160], t) for _, t in rows}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    grams = [line for line in plan.split("\n") if "Generate explode" in line]
    assert grams and not any("text#" in line.split("Generate", 1)[1].split("[key#")[0] and "pattern" not in line for line in grams if "text#" in line), grams


@pytest.mark.parametrize("most", [0, 30_000])
def test_large_documents_are_looked_up_by_keys(spark, monkeypatch, most):
    """All documents, or one of two, beyond what is walked: the same rows."""
    rnd = random.Random(7)
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "γδ", "x", "longer-word", "1999"]) for _ in range(n))
    blocks = [(s, at, f"{s}{at}", words(rnd.choice([1, 5, 12, 40])), 1, None, rnd.choice([None, [1.0]]), rnd.choice(["layout", "model", None])) for s, n in (("s", 3), ("t", 60)) for at in range(n)]
    texts = [(b[0], i, rnd.choice([b[3], b[3][5:], b[3] + " end", b[3][:70] + " else"])) for i, b in enumerate(blocks)]
    monkeypatch.setattr(alignment, "WALKED", most)
    large = alignment._crowded(spark.createDataFrame(texts, "source string, text_id int, text string"), spark.createDataFrame(blocks, BLOCKS))
    assert sorted(r.source for r in large) == (["s", "t"] if most == 0 else ["t"])
    want = plain(texts, blocks)
    assert aligned(spark, texts, blocks) == want and len(want) > 40


def test_texts_and_blocks_are_shuffled_once(spark):
    blocks = spark.createDataFrame([("s", 0, "b", "some words", 1, None, None, "layout")], BLOCKS)
    plan = alignment.best_blocks(spark.createDataFrame([("s", 1, "some")], "source string, text_id int, text string"), blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_lines_are_numbered_in_their_row(spark, tmp_path):
    texts = ["", "a\n\né𝛼汉\n", None, "one", "\n", "x" * 3000 + "\nlast"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    blocks = ingestion_queries._line_blocks(spark, str(tmp_path)).where("type <> 'table' or source_kind is null or source_kind <> 'model'")
    want = {(f"{d}:{i}", line, sum(len(x) + 1 for x in t.split("\n")[: i - 1]) // 1500 + 1) for d, t in enumerate(texts) if t is not None for i, line in enumerate(t.split("\n"), 1)}
    assert {(r.block_id, r.text, r.page) for r in blocks.collect()} == want
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
