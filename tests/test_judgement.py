from numbers import Number

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidenceframe.operators import evaluation, fusion, lexical, linking, markdown_tables, projections, routing, stages, vectors

DIR = "/root/testdata/sf0.001"
SOME = """vec01_question_topk vec05_hash_embedding flt03_filter_fallback met10_token_overlap rrk01_rerank join16_stage_compare win03_inferred_removals met05_chunk_recall met06_page_metrics met13_answer_metrics
met15_assertions flt09_relation_rules rte04_rewrite fus05_default_tasks lex06_table_topk ext02_table_blocks""".split()


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return round(float(v), 5) if isinstance(v, Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(str, map(plain, r))) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "part orders lineitem events documents embeddings benchmark conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, DIR).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_vectors_with_nulls_and_names(spark):
    some = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 2.0]), ("d", [1.0, None]), ("e", [1.0, 0.0])], "node_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("r", None)], "query_id string, embedding array<double>")
    got = [(r.query_id, r.node_id, r.score, r["rank"]) for r in vectors.top_k(some, asked, 3, key="node_id").orderBy("rank").collect()]
    assert got == [("q", "a", 1.0, 1), ("q", "e", 1.0, 2), ("q", "c", 0.0, 3)]
    assert vectors.top_k(some.limit(0), asked, key="node_id").count() == vectors.top_k(some, asked.limit(0), key="node_id").count() == 0


def test_floor_never_lets_low_hits_back(spark):
    kind = "query_id int, vec_id int, score double, rank int"
    few = spark.createDataFrame([(1, 1, 0.9, 1), (2, 1, 0.1, 1), (3, 1, 0.1, 1)], kind)
    all_ = spark.createDataFrame([(1, 9, 0.95, 1), (2, 9, 0.5, 1), (2, 8, 0.1, 2), (3, 9, 0.1, 1)], kind)
    got = {(r.query_id, r.vec_id, r.fallback_used) for r in vectors.with_fallback(few, all_, 0.15).collect()}
    assert got == {(1, 1, False), (2, 9, True)}


def test_filters(spark):
    nodes = spark.createDataFrame([("a", "x", 1, ["t", "u"]), ("b", "y", 2, None), ("c", None, 1, ["v"])], "node_id string, source string, page int, tags array<string>")
    kept = lambda c: [r.node_id for r in nodes.where(c).orderBy("node_id").collect()]
    assert kept(lexical.matches({"page": "1", "tags": ["u", "z"], "other": 5})) == ["a"] and kept(lexical.matches({"source": "y"})) == ["b"] and kept(lexical.matches(None)) == ["a", "b", "c"]
    assert kept(vectors.store_filter({"metadata.page": [1, 3], "source": None})) == ["a", "c"] and kept(vectors.store_filter({"page": 2, "source": "x"})) == []


def test_composite_stages(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.5, 0.4, None, None, None), (1, "b", None, None, 0.7, "inherited_relationship_v1", 0.0), (2, "c", 0.8, None, None, None, 0.3)],
        "query_id int, node_id string, score_vector double, score_composite double, inherited_score double, score_policy string, score double",
    ).withColumns({"score_bm25": F.lit(None).cast("double"), "score_rrf": F.lit(None).cast("double")})
    score = lambda stage, df=hits: {r.node_id: r.score_composite for r in fusion.composite(df, stage).collect()}
    assert score("final") == {"a": 0.4, "b": 0.7, "c": 0.8} and score("initial") == {"a": 0.5, "b": 0.7, "c": 0.8}
    low = hits.where("node_id = 'c'").withColumn("score_composite_prior", F.lit(0.1))
    assert score("rerank", low)["c"] == pytest.approx(0.56)
    got = spark.range(1).select(*[fusion.threshold_of(F.lit(s)).alias(s) for s in ("initial", "final", "retry_1_rerank")]).first()
    assert list(got) == [0.0, 0.2, 0.0]


def test_page_metrics_without_specs_hits_or_pages(spark):
    hits = spark.createDataFrame([(1, 1, "s", 3), (2, 1, "s", None), (3, 1, "s", 1)], "query_id int, rank int, source string, page int")
    specs = spark.createDataFrame([(1, None, 4), (1, "", 4), (2, "s", 1), (4, "s", 1)], "query_id int, spec_source string, spec_page int")
    got = {r.query_id: list(r)[1:] for r in evaluation.page_metrics(hits, specs, 1).collect()}
    assert got == {1: [1.0] * 4, 2: [None] * 4, 3: [None] * 4, 4: [0.0] * 4}


def test_carry_and_citations(spark):
    kind = "query_id int, node_id string, rank int, score double, label string, dropped boolean"
    first = spark.createDataFrame([(1, "a", 1, 0.9, "weak", None), (1, "b", 2, 0.4, "relevant", None), (1, "c", 3, 0.3, "strong", None)], kind)
    second = spark.createDataFrame([(1, "a", 1, 0.5, "Strong ", False), (1, "b", 2, 0.9, "strong", False), (1, "d", 3, 0.9, "strong", True)], kind)
    got = [(r.node_id, r.from_stage, r.place) for r in evaluation.carry_select(first, second).orderBy("place").collect()]
    assert got == [("b", "rerank", 1), ("a", "expanded", 2)]
    context = spark.createDataFrame([(1, "s", 0), (2, "s", 1)], "query_id int, source string, chunk_index int")
    held = evaluation.citations_hold(spark.createDataFrame([(1, "s", 0), (1, "s", 0)], context.schema), context)
    assert {r.query_id: r.citation_ok for r in held.collect()} == {1: True, 2: False}


def test_status_and_states(spark):
    cases = {"stable": (1, 1, 1), "new_in_rerank,dropped_after_rerank": (None, 1, None), "new_in_final": (None, None, 2), "dropped_after_initial": (3, None, None), "promoted_by_rerank,demoted_after_retry": (3, 1, 2)}
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "want string, a int, b int, c int")
    assert all(r.want == r.got for r in df.select("want", stages.rank_status(F.col("a"), F.col("b"), F.col("c")).alias("got")).collect())


def test_edges_of_texts_and_labels(spark):
    one = spark.range(1)
    text = F.lit("a | b\n--- | ---\n\nx | y\nplain")
    got = one.select(markdown_tables.table_blocks(text).alias("b"), markdown_tables.table_blocks(F.lit(None).cast("string")).alias("none")).first()
    assert [(x.start, x.end, x.kind) for x in got.b] == [(0, 16, "markdown")] and got.none == []
    assert one.select(markdown_tables.is_table_like(F.lit("see <TABLE>"))).first()[0]
    maps = one.select(projections.label_map(F.lit(None).cast("string")).alias("a"), projections.label_map(F.lit("x:1, x : 2,y:z")).alias("b")).first()
    assert maps.a == {} and maps.b == {"x": 2.0}
    with pytest.raises(Exception, match="a vector must have 3 numbers"):
        one.select(projections.sized(F.array(F.lit(1.0)), 3)).collect()
    assert one.select(linking.relation_weight(F.lit("odd")), linking.relation_priority(F.lit("odd"))).first()[:] == (0.6, 10)
    assert one.select(routing.rewritten(F.lit(" ? "), F.array().cast("array<string>"))).first()[0] == " ? "


def test_a_long_table_does_not_overflow_the_stack(spark):
    """30 000 lines with pipes, and a line without any of 30 000 characters before them."""
    rows = "\n".join(["| a | b |", "| --- | --- |", *[f"| {i} | x |" for i in range(30_000)]])
    text = "x" * 30_000 + "\n" + rows
    got = spark.range(1).select(F.lit(text).alias("t")).select(F.explode(markdown_tables.table_blocks(F.col("t"))).alias("b")).select("b.start", "b.end", "b.markdown").collect()
    assert [tuple(r) for r in got] == [(30_001, len(text), rows)]
