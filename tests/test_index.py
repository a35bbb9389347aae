"""The index is cut and counted in arrays: it equals the column functions, is made once a text and filters without a join."""

import random

from pyspark.sql import functions as F

from evidenceframe.functions import text
from evidenceframe.operators import lexical, vectors
from evidenceframe.plans.retrieval import Corpus

ODD = ["", " ", None, "A-b--c -d- e_f_-g", "Kelvin Été naïve x", "中文A b-c中", "Ａ－b ﬁx", "İx ΣΣ", "a b\x85", "-", "a" * 3000]


def test_tokens_in_a_task_equal_the_columns(spark):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("aB1_- -.é中K\n") for _ in range(rnd.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = df.select("text", text.tokens(F.col("text")).alias("t"), text.mixed_tokens(F.col("text")).alias("m"), F.lower(F.coalesce("text", F.lit(""))).alias("low")).collect()
    for r in rows:
        assert r.text is None or [w.decode() for w in text.token_bytes(r.text)] == r.t
        assert [w.decode() for w in text.mixed_bytes(r.low)] == r.m


def test_counted_nodes(spark):
    nodes = spark.createDataFrame([("1", "b a b", "x"), ("2", "...", "x"), ("3", None, None)], "node_id string, text string, origin string")
    index = lexical.build(nodes, ("origin",))
    got = {r.node_id: (r.dl, dict(zip(r.terms, r.tfs, strict=True)), r.origin) for r in index.counted.collect()}
    assert got == {"1": (3, {"b": 2, "a": 1}, "x"), "2": (0, {}, "x"), "3": (None, {}, None)}
    assert tuple(index.corpus.first()) == (3, 1.5) and {r.term: r.df for r in index.terms.collect()} == {"a": 1, "b": 1}
    assert vectors.hash_vectors(nodes, 8).count() == 3


def test_filtered_search_does_not_shuffle_the_index(spark, tmp_path):
    docs = [(i, f"alpha beta{i} " * 20, f"src{i % 3}") for i in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = Corpus(spark, str(tmp_path))
    got = lexical.search(c.index, c.questions, where=F.col("origin").isin("src1", "src2"))
    names = {r.node_id: r.doc_id for r in c.nodes.collect()}
    assert {names[r.node_id] for r in got.collect()} == {1, 2, 4, 5, 7, 8}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_texts_beyond_ascii_are_folded_in_python(spark):
    """Python gets a null in place of an ASCII text, so that a batch there is small."""
    df = spark.createDataFrame([("Plain A-b",), ("Ａ－b ﬁX",), ("", ), (None,)], "text string")
    form = df.select(text.folded(F.col("text")).alias("f"))
    assert [r.f for r in form.collect()] == ["plain a-b", "a-b fix", "", ""]
    plan = form._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan.split("ArrowEvalPython")[1] and "octet_length" in plan
