import math
import random
import time
import uuid

import pytest
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidenceframe.functions import boxes, text
from evidenceframe.operators import chunking, evidence, expansion, fusion, lexical, metrics, variants
from evidenceframe.settings import Settings
from evidenceframe.sources import files
from evidenceframe.streaming import events


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_chunks_have_overlap(spark):
    docs = spark.createDataFrame([(1, "A" * 120), (2, ""), (3, None), (4, "  ab  ")], "doc_id long, text string")
    got = chunking.chunk_documents(docs, Settings(chunk_size=50, chunk_overlap=10, chunk_min=5)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.char_start) for r in got] == [(1, 0, 0), (1, 1, 40), (1, 2, 80), (4, 0, 0)]
    assert got[-1].text == "ab"


def test_table_chunks_repeat_the_header(spark):
    table = "\n".join(["| a |", "| --- |", *[f"| {i} |" for i in range(5)]])
    got = one(spark, chunking.table_chunks(F.lit(table), Settings(table_small_rows=3, table_group_rows=2)))
    assert len(got) == 3 and all(c.split("\n")[1] == "| --- |" for c in got)
    assert one(spark, chunking.table_chunks(F.lit(table))) == [table]
    assert one(spark, chunking.table_chunks(F.lit(""))) == []


def test_chunks_of_a_long_table_cut_its_lines_once(spark):
    """40 000 rows, which took minutes while each group cut the whole table again."""
    began = time.time()
    table = F.concat(F.lit("| a |\n| --- |\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("| "), i.cast("string"), F.lit(" |"))), "\n"))
    got = spark.range(1).select(table.alias("t")).select(F.explode(chunking.table_chunks(F.col("t"))).alias("c")).agg(F.count("*"), F.sum(F.size(F.split("c", "\n")) - 2)).first()
    assert tuple(got) == (5_000, 40_000) and time.time() - began < 60


def test_html_table(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td> </td></tr></table>"
    assert one(spark, chunking.html_table_markdown(F.lit(html))).split("\n") == ["| a | b |", "| --- | --- |", "| 1 |  |"]


def test_point_id(spark):
    name = "d:text:3"
    assert one(spark, text.point_id(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_bm25_finds_the_terms_and_counts_repeats(spark):
    nodes = spark.createDataFrame([("1", "linux find search file"), ("2", "database index"), ("3", "...")], "node_id string, text string")
    q = spark.createDataFrame([(1, "find file"), (2, "find find file file")], "query_id long, text string")
    got = {r.query_id: r for r in lexical.search(lexical.build(nodes), q).collect()}
    assert got[1].node_id == "1" and got[2].score == pytest.approx(2 * got[1].score, abs=2e-6)


def test_search_sends_the_best_of_each_task_and_not_each_pair(spark):
    """200 nodes share a word with each of 5 questions: at most k a task and question leave it, and they are the right ones."""
    rnd = random.Random(3)
    texts = {f"n{i:03}": " ".join(["the", *rnd.choices(["a", "b", "c", "d"], k=rnd.randint(0, 4))]) for i in range(200)}
    asked = {i: "the a " + " ".join(rnd.choices("bcde", k=3)) for i in range(5)}
    index = lexical.build(spark.createDataFrame(list(texts.items()), "node_id string, text string").repartition(2))
    questions = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    terms = questions.select("query_id", F.explode(text.tokens(F.col("text"))).alias("term"), F.lit(1.0).alias("weight"))
    assert lexical.best_nodes(index.counted, terms, 6, lambda tf, dl: tf).count() <= 2 * 5 * 6
    mean = sum(len(t.split()) for t in texts.values()) / 200
    df = {w: sum(w in t.split() for t in texts.values()) for w in "the a b c d".split()}

    def score(q: str, t: list[str]) -> float:
        norm = lambda tf: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
        return round(sum(math.log(1 + (200 - df[w] + 0.5) / (df[w] + 0.5)) * norm(t.count(w)) for w in q.split() if w in df), 6)

    want = {(q, n, r) for q, words in asked.items() for r, n in enumerate(sorted(texts, key=lambda n: (-score(words, texts[n].split()), n))[:6], 1)}
    assert {(r.query_id, r.node_id, r["rank"]) for r in lexical.search(index, questions, 6).collect()} == want


def test_tokens_lower_after_cutting(spark):
    assert one(spark, text.tokens(F.lit("Ab-c_1 数据 É"))) == ["ab", "c_1", "数", "据"]


def test_rrf_sums_and_keeps_first_order(spark):
    schema = "query_id long, node_id string, score double, rank int"
    a = spark.createDataFrame([(1, "A", 0.9, 1)], schema)
    b = spark.createDataFrame([(1, "A", 0.8, 1), (1, "B", 0.7, 2)], schema)
    got = fusion.rrf([("vector", a), ("bm25", b)], top=2).orderBy("rank").collect()
    assert [r.node_id for r in got] == ["A", "B"] and got[0].channel == "bm25"
    assert got[0].score_rrf == pytest.approx(2 / 61, abs=1e-9) and got[0].score_vector == 0.9


def test_composite_of_one_hit(spark):
    hits = spark.createDataFrame([(1, "A", 0.8, None, 0.02)], "query_id long, node_id string, score_vector double, score_bm25 double, score_rrf double")
    assert fusion.composite(hits).first().score_composite == pytest.approx((0.8 * 0.3 + 1.0 * 0.25) / 0.55, abs=1e-6)


def test_threshold_removes_with_reason(spark):
    hits = spark.createDataFrame([(1, "a", 0.2, 1), (1, "b", 0.8, 2), (1, "c", None, 3)], "query_id long, node_id string, score_composite double, rank int")
    got = {r.node_id: r for r in fusion.split_by_threshold(hits, 0.5).collect()}
    assert (got["a"].removed_reason, got["a"].removed_rank) == ("score_threshold_failed", 1) and got["b"].passed and got["c"].passed


def test_expansion_inherits(spark):
    seeds = spark.createDataFrame([(1, "s", 0.8, 1, "text", 1, 1)], "query_id long, node_id string, score double, rank int, modality string, doc_id long, page int")
    edges = spark.createDataFrame([("s", "related_table_node_ids", 0, "t"), ("s", "prev_id", 0, "p"), ("s", "same_page_node_ids", 0, "w")], "src_id string, relation string, pos int, dst_id string")
    nodes = spark.createDataFrame([("t", "table"), ("p", "text"), ("w", "text")], "node_id string, modality string")
    nodes = nodes.selectExpr("node_id", "modality", "1L as doc_id", "1 as page", "false as whole_image", "cast(null as double) as composite")
    got = {r.node_id: r.score for r in expansion.expand(seeds, edges, nodes).collect()}
    assert got == {"s": 0.8, "t": 0.72, "p": 0.4}


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0)], "query_id long, rank int, grade double")
    totals = spark.createDataFrame([(1, 4, [1.0, 2.0, 1.0, 1.0]), (2, 0, [])], "query_id long, relevant long, ideal array<double>")
    got = {r.query_id: r for r in metrics.ranking_metrics(ranked, totals).collect()}
    assert (got[1].mrr, got[1].recall, got[1].precision_at_3) == (0.5, 0.5, pytest.approx(2 / 3, abs=1e-6))
    assert got[1].ap == pytest.approx((1 / 2 + 2 / 3) / 4, abs=1e-6) and got[2].hit_rate == 0.0 and got[2].ndcg == 0.0


def test_region_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 1, [100.0, 100.0, 300.0, 300.0]), (1, 2, 1, [700.0, 700.0, 900.0, 900.0])], "case_id int, hit_id int, page int, box array<double>")
    regions = spark.createDataFrame([(1, 1, [120.0, 120.0, 280.0, 280.0])], "case_id int, page int, box array<double>")
    got = metrics.region_metrics(hits, regions).first()
    assert (got.bbox_precision, got.max_iou, got.relevant) == (0.5, 0.64, True)


@given(st.lists(st.tuples(*[st.integers(0, 12)] * 4), max_size=5))
@limits(max_examples=12, deadline=None)
def test_union_area_counts_cells(spark, raw):
    found = [[float(min(a, c)), float(min(b, d)), float(max(a, c)), float(max(b, d))] for a, b, c, d in raw]
    cells = {(x, y) for x0, y0, x1, y1 in found for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}
    df = spark.createDataFrame([(found,)], "b array<array<double>>")
    assert df.select(boxes.union_area(F.col("b")).alias("x")).first().x == len(cells)


def test_keyword_coverage_and_gate(spark):
    assert one(spark, evidence.keyword_terms(F.lit("What is the BERT base 12 of BERT"))) == ["bert", "base"]
    assert one(spark, evidence.keyword_terms(F.lit("请介绍模型 v1.2/base-x 45% 2021 this was"))) == ["模", "型", "v1.2/base-x", "this", "was"]
    assert one(spark, evidence.keyword_coverage(F.array(F.lit("bert"), F.lit("fine_tune")), F.lit("BERT fine-tune"))) == 1.0
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id long, text string")
    hits = spark.createDataFrame([(1, "a", "s1", 0.9, 1, "alpha"), (1, "b", "s2", 0.8, 2, "beta")], "query_id long, node_id string, source string, score double, rank int, text string")
    got = {r.query_id: r.decision for r in evidence.gate(q, hits).collect()}
    assert got == {1: "pass", 2: "refuse"}
    # Few keywords are a reason, not a retry; a missing slot is retried where refusal is not allowed.
    q = spark.createDataFrame([(1, "delta epsilon"), (2, "gamma")], "query_id long, text string")
    got = {r.query_id: r for r in evidence.gate(q, hits, allow_refusal=False).collect()}
    assert (got[1].decision, got[1].gate_reasons) == ("pass", ["soft_missing_keyword", "low_keyword_coverage"])
    assert (got[2].decision, got[2].gate_reasons) == ("retry", ["missing_hits", "soft_missing_keyword", "low_keyword_coverage"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: One\ntags: [x, y]\n---\n\nBody\n")
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / "t.csv").write_text("a,b\n1\n")
    (tmp_path / "cases.jsonl").write_text('# note\n{"id": "1", "question": "q"}\n\n')
    got = files.read_markdown(spark, str(tmp_path)).orderBy("title").collect()
    assert [(r.title, r.tags, r.content) for r in got] == [("One", ["x", "y"], "Body"), ("b", [], "plain")]
    assert files.read_tables(spark, str(tmp_path)).first().markdown == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert files.read_cases(spark, str(tmp_path / "cases.jsonl")).first().question == "q"
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "question": "q"}\n{"id": "2"}\n')
    with pytest.raises(Exception, match="without a question: 2"):
        files.read_cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_streams_match_tables(spark, tmp_path):
    rows = spark.sql("select id event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) ts, id % 3 user_id, 'a' event_type, double(id) value from range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in events.windowed_counts(rows).collect()}


def test_anchors_in_any_field(spark):
    fields = ("text", "table_markdown", "formula_latex", "caption", "ocr_text", "object_description", "title", "section")
    rows = [(i, ["sigma_1"], *["Sigma_{1} of it" if i == j else None for j in range(8)]) for i in range(9)]
    kind = "i int, anchors array<string>, " + ", ".join(f"{f} string" for f in fields)
    hits = spark.createDataFrame(rows, kind)
    assert {r.i: r.shares_anchor for r in variants.with_shared_anchor(hits).collect()} == {i: i < 8 for i in range(9)}
    assert {r.i for r in variants.with_shared_anchor(hits.select("i", "anchors", "text")).where("shares_anchor").collect()} == {0}
