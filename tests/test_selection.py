from evidenceframe.operators import selection

HITS = "query_id int, node_id string, score double, rank int"


def test_distinct_and_head_tail(spark):
    hits = spark.createDataFrame([(1, f"n{i}", 1.0 - i / 20, i + 1) for i in range(12)] + [(1, "n0", 0.1, 13), (2, "a", 0.5, 1)], HITS)
    once = selection.distinct_hits(hits)
    assert once.where("query_id = 1").count() == 12
    got = [r.node_id for r in selection.head_tail(once).where("query_id = 1").orderBy("rank").collect()]
    assert got == [f"n{i}" for i in (0, 1, 2, 3, 4, 5, 10, 11)]
    assert selection.head_tail(once).where("query_id = 2").count() == 1
    assert selection.distinct_hits(hits.limit(0)).count() == 0


def test_image_context_takes_the_first_image(spark):
    nodes = [("i1", 1, 1, "image", 0), ("i2", 1, 1, "image", 1), ("i3", 2, None, "image", 0)] + [(f"t{k}", 1, 1, "text", k) for k in range(2, 7)]
    nodes = spark.createDataFrame(nodes, "node_id string, doc_id int, page int, modality string, chunk_index int")
    hits = spark.createDataFrame([(1, "i1", 0.8, 1), (1, "t2", 0.6, 2), (1, "i2", 0.2, 3), (1, "i3", 0.1, 4)], HITS)
    got = [(r.node_id, round(r.score, 6), r.channel) for r in selection.image_context(hits, nodes).orderBy("rank").collect()]
    assert got == [("i1", 0.8, "search"), ("t2", 0.6, "search"), ("t3", 0.56, "image_context"), ("t4", 0.56, "image_context"), ("i2", 0.2, "search"), ("i3", 0.1, "search")]


def test_carried_hits_replace_in_place(spark):
    now = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], HITS)
    old = spark.createDataFrame([(1, "b", 0.3, 1), (1, "c", 0.7, 2), (2, "d", 0.1, 1)], HITS)
    got = [tuple(r) for r in selection.carried_forward(now, old).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 0.9, 1, None), (1, "b", 0.3, 2, "replaced"), (1, "c", 0.7, 3, "added"), (2, "d", 0.1, 1, "added")]


def test_dropped_before(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "a", 0.8, 1)], HITS)
    kept, removed = selection.without_dropped(hits, hits.where("query_id = 1 and node_id = 'a'"))
    assert {tuple(r)[:2] for r in kept.collect()} == {(1, "b"), (2, "a")} and removed.count() == 1
