"""A question's few hits: searched once for an object, and brought to the nodes, which are not shuffled for them."""

import pytest

from evidenceframe.operators import linking, selection
from evidenceframe.plans import retrieval


@pytest.fixture
def no_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def corpus(spark, tmp_path):
    docs = [(i, f"alpha beta{i % 3} gamma " * 90) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta1"), (2, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return retrieval.Corpus(spark, str(tmp_path))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_channels_are_searched_once(corpus, monkeypatch):
    asked, search = [], retrieval.lexical.search
    monkeypatch.setattr(retrieval.lexical, "search", lambda *a, **k: asked.append(1) or search(*a, **k))
    hits, routes = corpus.scored().count(), corpus.routes().count()
    assert len(asked) == 1 and 0 < hits <= routes


def test_nodes_are_not_shuffled_for_few_hits(corpus, no_threshold):
    hits = corpus.fused().select("query_id", "node_id")
    window = linking.page_window(hits, corpus.nodes)
    assert "SortMergeJoin" not in plan_of(window) and window.count() > 0
    assert {r.node_id for r in corpus.with_text(hits).collect()} == {r.node_id for r in hits.collect()}
    assert "SortMergeJoin" not in plan_of(corpus.routes())


def test_image_context_ranks_texts_of_the_hits_pages_only(spark, no_threshold):
    nodes = spark.createDataFrame([("i", "image", 1, 1, 0), ("t", "text", 1, 1, 1), ("far", "text", 2, 1, 0)], "node_id string, modality string, doc_id long, page int, chunk_index int")
    hits = spark.createDataFrame([(1, "i", 0.8, 1)], "query_id long, node_id string, score double, rank int")
    got = selection.image_context(hits, nodes)
    assert "LeftSemi" in plan_of(got)
    assert [(r.node_id, r.channel) for r in got.orderBy("rank").collect()] == [("i", "search"), ("t", "image_context")]
