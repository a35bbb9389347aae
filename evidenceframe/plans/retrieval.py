"""The retrieval plan over the driver's tables: chunks, channels, fusion, scores, metrics."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.text import tokens
from ..operators import chunking, fusion, lexical, metrics, vectors
from ..settings import DEFAULTS


class Corpus:
    """One corpus: nodes, indexes and results. Nodes, postings and vectors are built on first use and
    kept in the shared folder for the session, so that a corpus is chunked and tokenised once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def mark(self) -> str:
        return store.fingerprint(self.spark, [f"{self.dir}/documents.parquet"], DEFAULTS)

    @cached_property
    def nodes(self) -> DataFrame:
        return store.built(self.spark, "nodes", self.mark, lambda: chunking.text_nodes(self.documents))

    @cached_property
    def questions(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def index(self) -> lexical.Bm25Index:
        return self._indexed("", self.nodes, ("origin",))

    @cached_property
    def page_index(self) -> lexical.Bm25Index:
        """Pages as nodes, each with the text of its chunks."""
        pages = lexical.page_groups(self.nodes).select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("node_id"), "text")
        return self._indexed("page_", pages)

    def _indexed(self, kind: str, nodes: DataFrame, carried: tuple[str, ...] = ()) -> lexical.Bm25Index:
        counted = store.built(self.spark, f"{kind}counted", self.mark, lambda: lexical.counted_of(nodes, carried))
        terms = store.built(self.spark, f"{kind}terms", self.mark, lambda: lexical.terms_of(counted))
        return lexical.Bm25Index(counted, terms, store.built(self.spark, f"{kind}corpus", self.mark, lambda: lexical.corpus_of(counted)))

    @cached_property
    def vectors(self) -> DataFrame:
        """(node_id, embedding): the offline provider, hashed tokens."""
        return store.built(self.spark, "vectors", self.mark, lambda: vectors.hash_vectors(self.nodes, DEFAULTS.hash_dim))

    def asked_vectors(self) -> DataFrame:
        return vectors.hash_vectors(self.questions, DEFAULTS.hash_dim, "query_id")

    def kept(self, df: DataFrame) -> DataFrame:
        return store.kept(self.spark, df)

    def vector(self, k: int = DEFAULTS.top_k) -> DataFrame:
        """The vector channel: (query_id, node_id, score, rank) by cosine, at the least score or above."""
        return vectors.top_k(self.vectors, self.asked_vectors(), k, key="node_id").where(F.col("score") >= DEFAULTS.min_vector_score)

    def bm25(self) -> lexical.Bm25Index:
        return self.index

    def cover(self, k: int = 12) -> DataFrame:
        """Nodes by the share of the question's distinct terms that they hold."""
        return lexical.term_cover(self.index, self.questions, k)

    @cached_property
    def channels(self) -> dict[str, DataFrame]:
        """The hits of each channel, searched once for this object."""
        return {"vector": self.kept(self.vector()), "bm25": self.kept(lexical.search(self.index, self.questions))}

    @cached_property
    def _fused(self) -> DataFrame:
        return self.kept(fusion.rrf(list(self.channels.items())))

    def fused(self) -> DataFrame:
        return self._fused

    def with_text(self, hits: DataFrame) -> DataFrame:
        """Hits with the source, page and text of their nodes; the nodes are read where they lie, not shuffled."""
        return self.kept(lexical.small(hits).join(self.nodes.select("node_id", "source", "page", "text"), "node_id"))

    def scored(self) -> DataFrame:
        return fusion.composite(self.fused())

    def scored_texts(self) -> DataFrame:
        hits = self.scored().select("query_id", "node_id", "rank", F.col("score_composite").alias("score"))
        return self.with_text(hits)

    def routes(self) -> DataFrame:
        """(query_id, channel, node_id, source): the hits of each channel before fusion."""
        vector, bm25 = (hits.select("query_id", F.lit(name).alias("channel"), "node_id") for name, hits in self.channels.items())
        # dealt again, as Spark 4.1 may take the union for partitioned by query
        return lexical.small(vector.union(bm25).repartition("query_id")).join(self.nodes.select("node_id", "source"), "node_id")

    def relevant(self) -> DataFrame:
        """(query_id, doc_id) of documents that contain the question's passage, all of it.

        A passage is found by three tokens that follow one another inside it, which a document that
        contains it has too; only those documents are searched for the whole passage. Passages of
        fewer than five tokens have no such three, and are looked for in every document.
        """
        asked = self.questions.select("query_id", F.col("text").alias("passage"), tokens(F.col("text")).alias("w"))
        key = lambda w, i: F.xxhash64(F.concat_ws(" ", F.slice(w, i + 1, F.lit(3))))
        long = lexical.small(asked.where(F.size("w") >= 5).select("query_id", "passage", key(F.col("w"), F.lit(1)).alias("key")))
        words = self.documents.select("doc_id", tokens(F.col("text")).alias("w")).where(F.size("w") >= 3)
        grams = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: key(F.col("w"), i)))).alias("key"))
        near = grams.join(long, "key").select("doc_id", "query_id", "passage")
        near = self.documents.select("doc_id", "text").join(lexical.small(near), "doc_id").where(F.col("text").contains(F.col("passage")))
        brief = asked.where(F.size("w") < 5).select("query_id", "passage")
        found = near.select("query_id", "doc_id")
        if not brief.limit(1).count():
            return found
        return found.union(self.documents.join(lexical.small(brief), F.col("text").contains(F.col("passage"))).select("query_id", "doc_id"))

    def ranking_metrics(self, k: int = 10) -> DataFrame:
        right = self.relevant()
        totals = right.groupBy("query_id").agg(F.count("*").alias("relevant"))
        totals = self.questions.select("query_id").join(totals, "query_id", "left").na.fill(0, ["relevant"])
        totals = totals.withColumn("ideal", F.array_repeat(F.lit(1.0), F.col("relevant").cast("int")))
        hits = lexical.small(self.scored().select("query_id", "node_id", "rank")).join(self.nodes.select("node_id", "doc_id"), "node_id")
        graded = hits.join(right.withColumn("grade", F.lit(1.0)), ["query_id", "doc_id"], "left").na.fill(0.0, ["grade"])
        return metrics.ranking_metrics(graded, totals, k)

    def answers(self) -> DataFrame:
        """The flagship: the best six nodes of each question with the scores that ranked them."""
        best = lexical.ranked(self.scored().drop("rank"), "score_composite", 6, "node_id")
        out = lexical.small(best).join(self.nodes.select("node_id", "doc_id", "page", "text"), "node_id")
        return out.select("query_id", "rank", "node_id", "doc_id", "page", "channel", "score_rrf", "score_composite", F.left("text", F.lit(200)).alias("snippet"))
