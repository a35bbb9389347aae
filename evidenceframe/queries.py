"""One query for each operator group over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import boxes
from .functions.text import overlap_ratio, token_estimate, tokens
from .operators import chunking, derived, evidence, expansion, fusion, layout, lexical, linking, metrics, relevance, rerank, selection, splitting, variants, vectors
from .plans.retrieval import Corpus
from .sources import history
from .streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Shared parts of the SQL.
TOKENS = r"list_transform(regexp_extract_all({}, '[\x{{4e00}}-\x{{9fff}}]|[a-zA-Z0-9_]+'), lambda t: lower(t))"
CHUNKS = r"""
body AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, body, length(body) AS n,
  unnest(generate_series(0, CASE WHEN length(body) <= 900 THEN 0 ELSE CAST(ceil((length(body) - 900) / 780.0) * 780 AS BIGINT) END, 780)) AS char_start
  FROM body WHERE length(body) > 0),
pieces AS (SELECT doc_id, n, char_start, least(char_start + 900, n) AS char_end,
  regexp_replace(substring(body, char_start + 1, 900), '^\s+|\s+$', '', 'g') AS text FROM starts),
nodes AS (SELECT md5('doc-' || doc_id) || ':text:' || (row_number() OVER w - 1) AS node_id, doc_id, 'doc-' || doc_id AS source,
  row_number() OVER w - 1 AS chunk_index, CAST((row_number() OVER w - 1) // 3 + 1 AS INTEGER) AS page, char_start, char_end, text
  FROM pieces WHERE length(text) >= 80 OR (char_end = n AND length(text) > 0) WINDOW w AS (PARTITION BY doc_id ORDER BY char_start))
"""
POSTINGS = f"""
words AS (SELECT node_id, doc_id, page, {TOKENS.format("text")} AS words FROM nodes),
postings AS (SELECT term, node_id, any_value(doc_id) AS doc_id, any_value(len(words)) AS dl, count(*) AS tf FROM (SELECT node_id, doc_id, words, unnest(words) AS term FROM words) GROUP BY term, node_id),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM words)
"""
MIXED = r"regexp_extract_all(lower({}), '[\x{{4e00}}-\x{{9fff}}]|[a-zA-Z0-9_]+(?:[-_][a-zA-Z0-9_]+)*')"
HASHED = """
{0}t AS (SELECT {1}, md5(unnest({2})) AS d FROM {3}),
{0}s AS (SELECT {1}, CAST('0x' || substring(d, 1, 8) AS BIGINT) % {4} AS bucket, sum(CASE WHEN CAST('0x' || substring(d, 9, 2) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM {0}t GROUP BY ALL),
{0}v AS (SELECT {1}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {1})) AS v FROM {0}s QUALIFY sum(v * v) OVER (PARTITION BY {1}) > 0)
"""
VECTOR = f"""
{HASHED.format("n", "node_id", MIXED.format("text"), "nodes", 128)}, {HASHED.format("q", "item_id", MIXED.format("text"), "benchmark", 128)},
dots AS (SELECT item_id AS query_id, node_id, round(sum(qv.v * nv.v), 6) AS score FROM qv JOIN nv USING (bucket) GROUP BY ALL),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM dots WHERE score >= 0.15 QUALIFY rank <= 12)
"""
ASKED = f"""
asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL)
"""


def _bm25(where: str = "") -> str:
    return f"""
scored AS (SELECT query_id, node_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term) CROSS JOIN corpus {where} GROUP BY query_id, node_id),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 12)
"""


# Chunks and nodes


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, text FROM nodes")
def chk01_sliding_chunks(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"))


@query(f"WITH {CHUNKS} SELECT node_id, doc_id, source, CAST(chunk_index AS INTEGER) AS chunk_index, page, length(text) AS n FROM nodes")
def prj01_text_nodes(spark, sf_dir):
    nodes = chunking.text_nodes(table(spark, sf_dir, "documents"))
    return nodes.select("node_id", "doc_id", "source", "chunk_index", "page", F.length("text").cast("bigint").alias("n"))


@query(f"""WITH {CHUNKS}, h AS (SELECT node_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(node_id)) AS d FROM nodes)
SELECT node_id, substring(d, 1, 8) || '-' || substring(d, 9, 4) || '-5' || substring(d, 14, 3) || '-' ||
  substring('89ab', instr('0123456789abcdef', substring(d, 17, 1)) % 4 + CASE WHEN instr('0123456789abcdef', substring(d, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1) || substring(d, 18, 3) || '-' || substring(d, 21, 12) AS point_id FROM h""")
def prj01_point_ids(spark, sf_dir):
    return chunking.with_point_ids(chunking.text_nodes(table(spark, sf_dir, "documents"))).select("node_id", "point_id")


def _brand_tables(spark, sf_dir):
    """A markdown table of the parts of each brand."""
    line = F.concat_ws(" | ", F.lit(""), F.col("p_partkey").cast("string"), "p_name", "p_type", F.lit(""))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.trim(line).alias("line")))).alias("r"))
    return rows.select("p_brand", F.concat(F.lit("| key | name | type |\n| --- | --- | --- |\n"), F.array_join(F.transform("r", lambda x: x.line), "\n")).alias("markdown"))


@query("""WITH r AS (SELECT p_brand, '| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' |' AS line, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, CAST(CASE WHEN n <= 12 THEN 0 ELSE i // 8 END AS INTEGER) AS part, '| key | name | type |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS chunk
FROM r GROUP BY p_brand, CASE WHEN n <= 12 THEN 0 ELSE i // 8 END""")
def chk05_table_chunks(spark, sf_dir):
    return _brand_tables(spark, sf_dir).select("p_brand", F.posexplode(chunking.table_chunks(F.col("markdown"))).alias("part", "chunk"))


@query("""SELECT p_brand, '| key | name | type |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || regexp_replace(trim(p_name), '\\s+', ' ', 'g') || ' | ' || regexp_replace(trim(p_type), '\\s+', ' ', 'g') || ' |', chr(10) ORDER BY p_partkey) AS fingerprint FROM part GROUP BY p_brand""")
def ext09_table_fingerprint(spark, sf_dir):
    return _brand_tables(spark, sf_dir).select("p_brand", chunking.table_fingerprint(F.col("markdown")).alias("fingerprint"))


@query("""SELECT n_regionkey AS region, '| ' || string_agg(n_nationkey || ' | ' || n_name || ' |', chr(10) || '| ' ORDER BY n_nationkey) AS body,
  CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey""")
def ext01_html_table(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.transform("r", lambda x: F.concat(F.lit("<tr><td>"), x.n_nationkey.cast("string"), F.lit("</td>\n<td class='n'> <b>"), x.n_name, F.lit("</b> </td></tr>")))
    html = F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr><tr><td> </td></tr>"), F.array_join(cells, ""), F.lit("</table>"))
    lines = F.split(chunking.html_table_markdown(html), "\n")
    return rows.select(F.col("n_regionkey").alias("region"), F.array_join(F.slice(lines, 3, F.size(lines)), "\n").alias("body"), (F.size(lines) - 2).alias("n"))


# Lexical search


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, greatest(1, length(text) // 4) AS estimate FROM (SELECT doc_id, text, {TOKENS.format('text')} AS w FROM documents)")
def lex01_tokens(spark, sf_dir):
    w = tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"), token_estimate(F.col("text")).alias("estimate"))


@query(f"WITH {CHUNKS}, {POSTINGS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(avgdl, 6) AS avgdl FROM terms CROSS JOIN corpus")
def lex02_term_statistics(spark, sf_dir):
    index = Corpus(spark, sf_dir).bm25()
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.terms.crossJoin(F.broadcast(index.corpus)).select("term", "df", F.round(idf, 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {CHUNKS}, {POSTINGS}, {ASKED}, {_bm25()} SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM bm25")
def lex03_bm25_topk(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return lexical.search(c.bm25(), c.questions)


@query(f"WITH {CHUNKS}, {POSTINGS}, {ASKED}, {_bm25('WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN (' + chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src2' + chr(39) + '))')} SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM bm25")
def flt01_bm25_filtered(spark, sf_dir):
    """Only nodes of two sources may be returned; statistics stay those of all nodes."""
    c = Corpus(spark, sf_dir)
    return lexical.search(c.bm25(), c.questions, where=F.col("origin").isin("src1", "src2"))


@query(f"WITH {CHUNKS} SELECT doc_id, page, count(*) AS n_nodes, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM nodes GROUP BY doc_id, page")
def agg01_page_groups(spark, sf_dir):
    return lexical.page_groups(Corpus(spark, sf_dir).nodes)


PAGES = f"WITH {CHUNKS.replace('nodes AS', 'small AS')}, nodes AS (SELECT doc_id || '/' || page AS node_id, doc_id, page, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM small GROUP BY doc_id, page)"


@query(f"{PAGES}, {POSTINGS}, {ASKED}, {_bm25()} SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 8")
def lex05_page_topk(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return lexical.search(c.page_index, c.questions, k=8)


# Vector search


def _vector_sql(score: str, k: int = 12) -> str:
    return f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round({score}, 6) + 0.0 AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 6) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= {k}"""


def _vector(spark, sf_dir, metric):
    vecs = table(spark, sf_dir, "embeddings")
    return vectors.top_k(vecs, vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), metric=metric)


@query(_vector_sql("list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"))
def vec01_cosine_topk(spark, sf_dir):
    return _vector(spark, sf_dir, "cosine")


@query(_vector_sql("list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"))
def vec01_dot_topk(spark, sf_dir):
    return _vector(spark, sf_dir, "dot")


@query(_vector_sql("-list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"))
def vec01_euclid_topk(spark, sf_dir):
    return _vector(spark, sf_dir, "euclid")


def _some_labels(labels: str) -> str:
    return f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 {labels}) WHERE rank <= 12"""


@query(f"""WITH f AS (SELECT * FROM ({_some_labels("AND CAST(v.label AS VARCHAR) IN ('1', '2', '3')")}) WHERE score >= 0.5), w AS (SELECT * FROM ({_some_labels("")}) WHERE score >= 0.5)
SELECT *, false AS fallback_used FROM f UNION ALL SELECT *, true FROM w WHERE query_id NOT IN (SELECT query_id FROM f)""")
def flt03_filter_fallback(spark, sf_dir):
    """A search among three labels; a query without a hit at the floor asks again without the filter."""
    vecs = table(spark, sf_dir, "embeddings")
    asked = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    some = vectors.top_k(vecs.where(vectors.store_filter({"metadata.label": [1, 2, 3], "source": None})), asked)
    return vectors.with_fallback(some, vectors.top_k(vecs, asked), 0.5)


@query(_some_labels("AND CAST(v.label AS VARCHAR) = '2'"))
def flt02_store_filter(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    asked = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k(vecs.where(vectors.store_filter({"label": 2})), asked)


@query(f"""WITH {HASHED.format("b", "item_id", MIXED.format("text"), "benchmark", 64)}
SELECT item_id, CAST(i AS INTEGER) AS bucket, round(coalesce(v, 0.0), 6) + 0.0 AS value FROM benchmark CROSS JOIN generate_series(0, 63) g(i) LEFT JOIN bv USING (item_id) WHERE bv.bucket = i
UNION ALL SELECT item_id, CAST(i AS INTEGER), 0.0 FROM benchmark b CROSS JOIN generate_series(0, 63) g(i) WHERE NOT EXISTS (SELECT 1 FROM bv WHERE bv.item_id = b.item_id AND bv.bucket = i)""")
def vec05_hash_embedding(spark, sf_dir):
    found = vectors.hash_vectors(table(spark, sf_dir, "benchmark"), 64, key="item_id")
    return found.select("item_id", F.posexplode("embedding").alias("bucket", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query(f"WITH {CHUNKS}, {VECTOR} SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM vec")
def vec01_question_topk(spark, sf_dir):
    """The vector channel over all nodes."""
    return Corpus(spark, sf_dir).vector()


@query("""SELECT label, CAST(i AS INTEGER) AS i, round(sum(v * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1), 6) AS value
FROM (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def vec03_weighted_mean(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7 + 1).alias("weight"), "embedding")
    return vectors.merged(vecs, "label").select("label", F.posexplode("embedding").alias("i", "value")).withColumn("value", F.round("value", 6))


# Fusion and scores

FUSED = f"""
{_bm25()}, {VECTOR},
overlap AS (SELECT query_id, node_id, round(CAST(shared_n AS DOUBLE) / nq, 6) AS score FROM (
  SELECT query_id, node_id, count(*) AS shared_n FROM asked JOIN postings USING (term) GROUP BY ALL) JOIN (SELECT query_id, count(*) AS nq FROM asked GROUP BY query_id) USING (query_id)),
cover AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM overlap QUALIFY rank <= 12),
stacked AS (SELECT query_id, node_id, score, rank, 0 AS src_no, 'vector' AS channel FROM vec UNION ALL SELECT query_id, node_id, score, rank, 1, 'bm25' FROM bm25),
sums AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score_rrf, max(CASE WHEN channel = 'vector' THEN score END) AS score_vector,
  max(CASE WHEN channel = 'bm25' THEN score END) AS score_bm25, min(src_no * 1000 + rank) AS seen, max(CASE WHEN channel = 'bm25' THEN 'bm25' END) AS other FROM stacked GROUP BY query_id, node_id),
fused AS (SELECT query_id, node_id, score_rrf, score_vector, score_bm25, coalesce(other, 'vector') AS channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score_rrf DESC, seen) AS INTEGER) AS rank FROM sums QUALIFY rank <= 12)
"""
NORMS = """
normed AS (SELECT *, least(1, greatest(0, coalesce(score_vector, score_rrf))) AS vn,
  CASE WHEN score_bm25 IS NULL THEN NULL WHEN max(score_bm25) OVER w > min(score_bm25) OVER w THEN (score_bm25 - min(score_bm25) OVER w) / (max(score_bm25) OVER w - min(score_bm25) OVER w) WHEN score_bm25 > 0 THEN 1.0 ELSE 0.0 END AS bn,
  CASE WHEN max(score_rrf) OVER w > min(score_rrf) OVER w THEN (score_rrf - min(score_rrf) OVER w) / (max(score_rrf) OVER w - min(score_rrf) OVER w) ELSE 1.0 END AS rn
  FROM fused WINDOW w AS (PARTITION BY query_id)),
composite AS (SELECT query_id, node_id, rank, round(least(1, greatest(0, (vn * 0.3 + coalesce(bn * 0.1, 0) + rn * 0.25) / (0.3::DOUBLE + CASE WHEN bn IS NULL THEN 0 ELSE 0.1 END + 0.25))), 6) AS score_composite FROM normed)
"""
BASE = f"WITH {CHUNKS}, {POSTINGS}, {ASKED}, {FUSED}, {NORMS}"


@query(f"{BASE} SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM cover")
def topk01_term_cover(spark, sf_dir):
    return Corpus(spark, sf_dir).cover()


@query(f"{BASE} SELECT query_id, node_id, score_rrf, score_vector, score_bm25, channel, rank FROM fused")
def fus02_rrf(spark, sf_dir):
    return Corpus(spark, sf_dir).fused()


@query(f"{BASE} SELECT query_id, node_id, rank, score_composite FROM composite")
def scr01_composite(spark, sf_dir):
    return Corpus(spark, sf_dir).scored().select("query_id", "node_id", "rank", "score_composite")


@query(f"{BASE} SELECT query_id, node_id, score_composite >= 0.55 AS passed, CASE WHEN score_composite < 0.55 THEN 'score_threshold_failed' END AS removed_reason, CASE WHEN score_composite < 0.55 THEN rank END AS removed_rank FROM composite")
def flt04_threshold(spark, sf_dir):
    return fusion.split_by_threshold(Corpus(spark, sf_dir).scored(), 0.55).select("query_id", "node_id", "passed", "removed_reason", "removed_rank")


@query(f"""{BASE}, v AS (SELECT query_id, node_id, score, 'raw' AS variant FROM cover UNION ALL SELECT query_id, node_id, 0.5, 'bm25' FROM bm25),
m AS (SELECT query_id, node_id, max(score) AS score, count(*) AS variant_hits FROM v GROUP BY ALL)
SELECT query_id, node_id, round(least(1, score + CASE WHEN variant_hits > 1 THEN least(0.12, (variant_hits - 1) * 0.03) ELSE 0 END), 6) AS score, variant_hits FROM m""")
def fus01_variants(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    stacked = c.cover().select("query_id", "node_id", "score", F.lit("raw").alias("variant")).union(lexical.search(c.bm25(), c.questions).select("query_id", "node_id", F.lit(0.5), F.lit("bm25")))
    return fusion.variant_boost(fusion.merge_variants(stacked)).select("query_id", "node_id", "score", "variant_hits")


@query(f"{BASE} SELECT query_id, node_id, CAST(b.rank AS INTEGER) AS rank_before, f.rank AS rank_after, CASE WHEN b.rank IS NULL THEN 'new' WHEN f.rank IS NULL THEN 'dropped' WHEN f.rank < b.rank THEN 'promoted' WHEN f.rank > b.rank THEN 'demoted' ELSE 'kept' END AS status FROM bm25 b FULL JOIN fused f USING (query_id, node_id)")
def win02_rank_flow(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return metrics.rank_flow(c.channels["bm25"], c.fused())


@query(f"""{BASE}, l AS (SELECT query_id, list(node_id) AS old FROM bm25 GROUP BY 1), r AS (SELECT query_id, list(node_id) AS new FROM cover GROUP BY 1)
SELECT query_id, round(CAST(len(list_filter(new, lambda x: NOT list_contains(old, x))) AS DOUBLE) / len(list_distinct(old || new)), 6) AS gain,
  round(CAST(len(list_intersect(old, new)) AS DOUBLE) / least(len(old), len(new)), 6) AS overlap FROM l JOIN r USING (query_id)""")
def set03_evidence_gain(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    old = lexical.search(c.bm25(), c.questions).groupBy("query_id").agg(F.collect_list("node_id").alias("old"))
    new = c.cover().groupBy("query_id").agg(F.collect_list("node_id").alias("new"))
    return old.join(new, "query_id").select("query_id", F.round(evidence.evidence_gain(F.col("old"), F.col("new")), 6).alias("gain"), F.round(overlap_ratio(F.col("old"), F.col("new")), 6).alias("overlap"))


# Edges


@query(f"""WITH {CHUNKS} SELECT node_id AS src_id, 'prev_id' AS relation, lag(node_id) OVER w AS dst_id FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index) QUALIFY dst_id IS NOT NULL
UNION ALL SELECT node_id, 'next_id', lead(node_id) OVER w AS dst_id FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index) QUALIFY dst_id IS NOT NULL""")
def ext17_adjacent_edges(spark, sf_dir):
    return linking.adjacent_edges(Corpus(spark, sf_dir).nodes)


@query(f"WITH {CHUNKS} SELECT a.node_id AS src_id, 'same_page_node_ids' AS relation, b.node_id AS dst_id FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.node_id <> b.node_id QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY b.chunk_index) <= 30")
def ext17_same_page_edges(spark, sf_dir):
    return linking.same_page_edges(Corpus(spark, sf_dir).nodes)


@query(f"""WITH {CHUNKS}, m AS (SELECT *, CASE WHEN chunk_index % 4 = 2 THEN 'table' ELSE 'text' END AS modality FROM nodes)
SELECT node_id, (SELECT max_by(b.node_id, b.chunk_index) FROM m b WHERE b.doc_id = a.doc_id AND b.modality = 'text' AND b.chunk_index < a.chunk_index) AS context_prev_node_id,
  (SELECT min_by(b.node_id, b.chunk_index) FROM m b WHERE b.doc_id = a.doc_id AND b.modality = 'text' AND b.chunk_index > a.chunk_index) AS context_next_node_id FROM m a WHERE modality <> 'text'""")
def ext17a_nearest_text(spark, sf_dir):
    nodes = Corpus(spark, sf_dir).nodes.withColumn("modality", F.when(F.col("chunk_index") % 4 == 2, "table").otherwise("text"))
    return linking.nearest_text(nodes)


@query(f"""{BASE}, spots AS (SELECT DISTINCT query_id, doc_id, n.page FROM fused JOIN nodes n USING (node_id))
SELECT DISTINCT query_id, n.node_id, n.doc_id, n.page FROM spots JOIN nodes n ON n.doc_id = spots.doc_id AND n.page BETWEEN spots.page - 1 AND spots.page + 1
WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = spots.query_id AND f.node_id = n.node_id)""")
def join02_page_window(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return linking.page_window(c.fused().select("query_id", "node_id"), c.nodes)


@query(f"""{BASE}, adj AS (SELECT node_id AS src, lag(node_id) OVER w AS p, lead(node_id) OVER w AS x FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
e AS (SELECT src, 'prev_id' AS relation, p AS dst FROM adj WHERE p IS NOT NULL UNION ALL SELECT src, 'next_id', x FROM adj WHERE x IS NOT NULL),
o AS (SELECT query_id, c.node_id AS src, relation, dst, rank, CAST(round(CAST(least(1, greatest(0, score_composite * 0.5)) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS inherited FROM composite c JOIN e ON e.src = c.node_id
  WHERE score_composite >= 0.45 AND rank <= 4 AND NOT EXISTS (SELECT 1 FROM composite z WHERE z.query_id = c.query_id AND z.node_id = e.dst)),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, src ORDER BY relation, dst) <= 2)
SELECT query_id, dst AS node_id, src AS from_node_id, relation, inherited AS inherited_score FROM k QUALIFY row_number() OVER (PARTITION BY query_id, dst ORDER BY inherited DESC, rank, src) = 1""")
def join01_expand(spark, sf_dir):
    """What the neighbours of the best hits bring, in mode auto."""
    return _expanded(spark, sf_dir, "auto")


@query()
def join01_expand_routed(spark, sf_dir):
    """The same for routed questions, with the pages around; tests/test_expansion.py compares with a plain walk."""
    return _expanded(spark, sf_dir, "routed")


@query()
def join01_expand_retry(spark, sf_dir):
    return _expanded(spark, sf_dir, "retry", "possible_conflict")


def _expanded(spark, sf_dir, mode, reason=None):
    c = Corpus(spark, sf_dir)
    none = F.lit(None)
    nodes = c.nodes.select("node_id", "doc_id", "page", "chunk_index", F.lit("text").alias("modality"), none.cast("boolean").alias("whole_image"), none.cast("double").alias("composite"))
    seeds = c.kept(lexical.small(c.scored().select("query_id", "node_id", F.col("score_composite").alias("score"), "rank")).join(nodes.select("node_id", "modality", "doc_id", "page"), "node_id"))
    # Edges of the documents that have a hit; no other is followed.
    near = c.kept(nodes.join(lexical.small(seeds.select("doc_id").distinct()), "doc_id", "left_semi"))
    edges = linking.adjacent_edges(near).withColumn("pos", F.lit(0))
    found = expansion.expand(seeds, edges, near, mode, reason).where("relation is not null")
    return found.select("query_id", "node_id", "from_node_id", "relation", F.col("score").alias("inherited_score"))


# Rerank, evidence, metrics


F1 = f"""
q AS (SELECT item_id AS query_id, {MIXED.format('text')} AS w FROM benchmark),
qtok AS (SELECT query_id, t, count(*) AS c FROM (SELECT query_id, unnest(w) AS t FROM q) GROUP BY ALL),
hw AS (SELECT query_id, node_id, rank, {MIXED.format('text')} AS words FROM fused JOIN nodes USING (node_id)),
ht AS (SELECT query_id, node_id, t, count(*) AS tf FROM (SELECT query_id, node_id, unnest(words) AS t FROM hw) GROUP BY ALL),
ov AS (SELECT hw.query_id, hw.node_id, hw.rank, any_value(len(words)) AS nw, coalesce(sum(CASE WHEN qtok.c IS NOT NULL THEN least(qtok.c, ht.tf) END), 0) AS shared_n FROM hw LEFT JOIN ht ON ht.query_id = hw.query_id AND ht.node_id = hw.node_id LEFT JOIN qtok ON qtok.query_id = hw.query_id AND qtok.t = ht.t GROUP BY ALL),
pr AS (SELECT query_id, node_id, rank, CAST(shared_n AS DOUBLE) / len(q.w) AS p, CAST(shared_n AS DOUBLE) / nw AS r FROM ov JOIN q USING (query_id)),
rr AS (SELECT query_id, node_id, rank AS previous_rank, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS rerank_score FROM pr),
rer AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, previous_rank) AS INTEGER) AS rerank_rank FROM rr)
"""


@query(f"{BASE}, {F1} SELECT query_id, node_id, previous_rank, rerank_score, rerank_rank, CASE WHEN rerank_rank > 8 THEN 'reranker_not_selected' WHEN rerank_rank > 6 THEN 'context_top_n_limit' END AS removed_reason FROM rer")
def rrk01_rerank(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return rerank.rerank(c.with_text(c.fused()), c.questions).select("query_id", "node_id", "previous_rank", "rerank_score", "rerank_rank", "removed_reason")


@query()
def prj13_prompt_context(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return rerank.prompt_context(c.with_text(c.fused()))


@query(f"""{BASE}, graded AS (SELECT c.query_id, c.rank, CASE WHEN contains(d.text, b.text) THEN 1.0 ELSE 0.0 END AS grade FROM composite c JOIN nodes n USING (node_id) JOIN documents d ON d.doc_id = n.doc_id JOIN benchmark b ON b.item_id = c.query_id),
tot AS (SELECT item_id AS query_id, count(*) FILTER (WHERE contains(d.text, b.text)) AS relevant FROM benchmark b, documents d GROUP BY item_id),
run AS (SELECT *, sum(grade) OVER (PARTITION BY query_id ORDER BY rank) AS h FROM graded WHERE rank <= 10),
agg AS (SELECT query_id, sum(grade) AS hits, count(*) AS ret, min(CASE WHEN grade > 0 THEN rank END) AS first, sum(CASE WHEN rank <= 1 THEN grade ELSE 0 END) AS h1, sum(CASE WHEN rank <= 3 THEN grade ELSE 0 END) AS h3,
  sum(CASE WHEN grade > 0 THEN h / rank ELSE 0 END) AS ps, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM run GROUP BY query_id),
full_ AS (SELECT t.query_id, relevant, coalesce(hits, 0) AS hits, coalesce(ret, 0) AS ret, first, coalesce(h1, 0) AS h1, coalesce(h3, 0) AS h3, coalesce(ps, 0) AS ps, coalesce(dcg, 0) AS dcg,
  coalesce((SELECT sum(1.0 / log2(i + 1)) FROM generate_series(1, least(relevant, 10)) g(i)), 0) AS ideal FROM tot t LEFT JOIN agg USING (query_id))
SELECT query_id, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS mrr, round(h1::DOUBLE, 6) AS precision_at_1, round(h3::DOUBLE / 3, 6) AS precision_at_3,
  round(hits::DOUBLE / greatest(ret, 1), 6) AS precision, round(CASE WHEN relevant = 0 THEN 0 ELSE hits::DOUBLE / relevant END, 6) AS recall, round(ps::DOUBLE / least(greatest(relevant, 1), 10), 6) AS ap,
  round(CASE WHEN ideal = 0 THEN 0 ELSE dcg / ideal END::DOUBLE, 6) AS ndcg FROM full_""")
def met01_ranking_metrics(spark, sf_dir):
    return Corpus(spark, sf_dir).ranking_metrics()


@query(f"""WITH a AS (SELECT conv_id, turn, {MIXED.format('text')} AS w FROM conversations WHERE text IS NOT NULL), p AS (SELECT x.conv_id, x.turn, x.w AS l, y.w AS r FROM a x JOIN a y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
c AS (SELECT conv_id, turn, t, count(*) FILTER (WHERE s = 0) AS a, count(*) FILTER (WHERE s = 1) AS b FROM (SELECT conv_id, turn, unnest(l) AS t, 0 AS s FROM p UNION ALL SELECT conv_id, turn, unnest(r), 1 FROM p) GROUP BY conv_id, turn, t),
k AS (SELECT conv_id, turn, len(l) AS nl, len(r) AS nr, coalesce((SELECT sum(least(a, b)) FROM c WHERE c.conv_id = p.conv_id AND c.turn = p.turn), 0) AS shared_n FROM p),
v AS (SELECT conv_id, turn, CASE WHEN nl + nr = 0 THEN 1 WHEN nl = 0 THEN 0 ELSE shared_n::DOUBLE / nl END AS p, CASE WHEN nl + nr = 0 THEN 1 WHEN nr = 0 THEN 0 ELSE shared_n::DOUBLE / nr END AS r FROM k)
SELECT conv_id, turn, round(p, 6) AS token_precision, round(r, 6) AS token_recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS token_f1 FROM v""")
def met10_token_overlap(spark, sf_dir):
    """Each turn of a conversation against the next."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("prediction")).join(after, ["conv_id", "turn"]).withColumn("case_id", F.struct("conv_id", "turn"))
    return metrics.token_overlap(pairs).select("case_id.conv_id", "case_id.turn", "token_precision", "token_recall", "token_f1")


def _boxes(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    x, y = 500 + 400 * e(0), 500 + 400 * e(1)
    box = F.array(x, y, x + 50 + 300 * F.abs(e(2)), y + 50 + 300 * F.abs(e(3)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("case_id"), F.col("vec_id").alias("hit_id"), (F.col("vec_id") % 3).cast("int").alias("page"), box.alias("box"))


@query("""WITH b AS (SELECT vec_id, vec_id // 24 AS case_id, vec_id % 3 AS page, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT vec_id, case_id, page, [400 + 300 * e[1], 400 + 300 * e[2], 450 + 300 * e[1] + 200 * abs(e[3]), 450 + 300 * e[2] + 200 * abs(e[4])] AS x, [400 + 300 * e[5], 400 + 300 * e[6], 450 + 300 * e[5] + 200 * abs(e[7]), 450 + 300 * e[6] + 200 * abs(e[8])] AS y FROM b),
m AS (SELECT h.vec_id, h.case_id, greatest(0, least(h.x[3], r.y[3]) - greatest(h.x[1], r.y[1])) * greatest(0, least(h.x[4], r.y[4]) - greatest(h.x[2], r.y[2])) AS i, (h.x[3] - h.x[1]) * (h.x[4] - h.x[2]) + (r.y[3] - r.y[1]) * (r.y[4] - r.y[2]) AS a
  FROM s h LEFT JOIN s r ON h.case_id = r.case_id AND h.page = r.page),
v AS (SELECT vec_id, case_id, coalesce(max(i / (a - i)), 0) AS v FROM m GROUP BY ALL)
SELECT case_id, count(*) AS n_hits, round(max(v), 6) AS max_iou, round(avg(CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS bbox_precision, bool_or(v > 0.5) AS relevant FROM v GROUP BY case_id""")
def met07_region_metrics(spark, sf_dir):
    """Each vector's first box against the box of the next four numbers of every vector of its case and page."""
    return metrics.region_metrics(_side(spark, sf_dir, 0, "hit_id"), _side(spark, sf_dir, 4, "region_id"))


def _side(spark, sf_dir, i: int, name: str, *more):
    """Boxes of four numbers of the vectors, of which 24 neighbouring ones are a case."""
    e = lambda j: F.col("embedding")[i + j].cast("double")
    x, y = 400 + 300 * e(0), 400 + 300 * e(1)
    box = F.array(x, y, x + 50 + 200 * F.abs(e(2)), y + 50 + 200 * F.abs(e(3)))
    case = F.floor(F.col("vec_id") / 24).alias("case_id")
    return table(spark, sf_dir, "embeddings").select(case, F.col("vec_id").alias(name), (F.col("vec_id") % 3).cast("int").alias("page"), box.alias("box"), *more)


_DERIVED = """b AS (SELECT vec_id, label, vec_id // 24 AS case_id, CAST(vec_id % 3 AS INTEGER) AS page, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT vec_id, label, case_id, page, [400 + 300 * e[1], 400 + 300 * e[2], 450 + 300 * e[1] + 200 * abs(e[3]), 450 + 300 * e[2] + 200 * abs(e[4])] AS x, [400 + 300 * e[5], 400 + 300 * e[6], 450 + 300 * e[5] + 200 * abs(e[7]), 450 + 300 * e[6] + 200 * abs(e[8])] AS y FROM b),
p AS (SELECT r.case_id, r.vec_id AS spec, h.vec_id AS node_id, h.case_id = r.case_id AS own, greatest(0, least(h.x[3], r.y[3]) - greatest(h.x[1], r.y[1])) * greatest(0, least(h.x[4], r.y[4]) - greatest(h.x[2], r.y[2])) AS i, (h.x[3] - h.x[1]) * (h.x[4] - h.x[2]) + (r.y[3] - r.y[1]) * (r.y[4] - r.y[2]) AS a
  FROM s r JOIN s h ON h.label = r.label AND h.page = r.page),
m AS (SELECT case_id, node_id, spec, i / (a - i) AS iou FROM p WHERE i / (a - i) > 0.1)"""


@query(f"WITH {_DERIVED} SELECT case_id, node_id, round(max(iou), 6) AS iou, arg_max(spec, (iou, -spec)) AS spec_idx FROM m GROUP BY ALL")
def join14_derived_labels(spark, sf_dir):
    """All vectors' first boxes as an index against the regions of their next four numbers, of the same label and page."""
    got = derived.best_regions(*_derived(spark, sf_dir))
    return got.select("case_id", "node_id", F.round("iou", 6).alias("iou"), "spec_idx")


@query(f"""WITH {_DERIVED}, l AS (SELECT DISTINCT case_id, node_id FROM m), w AS (SELECT case_id, count(*) AS wanted FROM l GROUP BY 1),
h AS (SELECT s.case_id, count(*) AS n, count(l.node_id) AS r, count(*) FILTER (WHERE s.vec_id % 2 = 0) AS precise FROM s LEFT JOIN l ON l.case_id = s.case_id AND l.node_id = s.vec_id GROUP BY 1),
v AS (SELECT case_id, n, r, coalesce(wanted, 0) AS w, precise::DOUBLE / n AS p, r::DOUBLE / n AS q, r::DOUBLE / nullif(wanted, 0) AS rec FROM h LEFT JOIN w USING (case_id))
SELECT case_id, CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END AS bbox_hit_rate, CASE WHEN w = 0 THEN 0 ELSE round(p, 6) END AS bbox_precision, coalesce(round(rec, 6), 0) AS bbox_recall, CASE WHEN w = 0 OR p + rec = 0 THEN 0 ELSE round(2 * p * rec / (p + rec), 6) END AS bbox_f1,
  CASE WHEN w = 0 THEN 0 ELSE round(q, 6) END AS bbox_region_precision, coalesce(round(rec, 6), 0) AS bbox_region_recall, CASE WHEN w = 0 OR q + rec = 0 THEN 0 ELSE round(2 * q * rec / (q + rec), 6) END AS bbox_region_f1 FROM v""")
def met08_derived_metrics(spark, sf_dir):
    """The boxes of a case's own vectors as its hits, those of even number above the threshold."""
    specs, index = _derived(spark, sf_dir)
    hits = index.select(F.floor(F.col("node_id") / 24).alias("case_id"), "node_id", "page", "box", (F.col("node_id") % 2 == 0).alias("precise"))
    return derived.counted_metrics(hits, specs, index)


def _derived(spark, sf_dir):
    label = F.col("label").cast("string").alias("source")
    return _side(spark, sf_dir, 4, "spec_idx", label), _side(spark, sf_dir, 0, "node_id", label).drop("case_id")


@query()
def met07_region_areas(spark, sf_dir):
    """All MET-07 metrics, of the same boxes. Both tables are whole."""
    return metrics.region_areas(_side(spark, sf_dir, 0, "hit_id"), _side(spark, sf_dir, 4, "region_id"))


@query()
def fn07_union_area(spark, sf_dir):
    return boxes.union_areas(_boxes(spark, sf_dir), "case_id", "page").withColumn("covered", F.round("covered", 3))


# Words and numbers that are no keywords, and what a word is.
STOP = "'" + "','".join(
    "a an and are as at be by for from how in is it of on or the to what which with 的 了 在 是 和 与 或 中 上 下 第 页 该 请 吗 多 少 一 个 些 什 么 帮 我 简 单 介 绍 说 明 概 括 讲 述".split()
) + "'"
TERMS = rf"list_distinct(list_filter(list_transform(regexp_extract_all({{}}, '[\x{{{{4e00}}}}-\x{{{{9fff}}}}]|[a-zA-Z][a-zA-Z0-9_./-]*|[0-9]+(?:\.[0-9]+)?%?'), lambda t: lower(t)), lambda w: w NOT IN ({STOP}) AND NOT regexp_full_match(w, '[0-9]+(\.[0-9]+)?%?')))"
COVERED = r"CASE WHEN len(terms) = 0 THEN 1.0 ELSE CAST(len(list_filter(terms, lambda t: contains(lower(evidence), t) OR contains(regexp_replace(lower(evidence), '[\s_./-]+', '', 'g'), regexp_replace(t, '[\s_./-]+', '', 'g')))) AS DOUBLE) / len(terms) END"


@query(f"""WITH
k AS (SELECT item_id, {TERMS.format("b.text")} AS terms, s.turn_text AS evidence
  FROM benchmark b JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS turn_text FROM conversations GROUP BY conv_id) s ON s.conv_id = b.item_id)
SELECT item_id, CAST(len(terms) AS INTEGER) AS n_terms, round({COVERED}, 6) AS coverage FROM k""")
def evd04_keyword_coverage(spark, sf_dir):
    """Words of each benchmark item that occur in the conversation of the same number."""
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    talk = talk.select(F.col("conv_id").alias("item_id"), F.array_join(F.transform("t", lambda x: x.text), " ").alias("evidence"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", evidence.keyword_terms(F.col("text")).alias("terms"))
    return asked.join(talk, "item_id").select("item_id", F.size("terms").alias("n_terms"), F.round(evidence.keyword_coverage(F.col("terms"), F.col("evidence")), 6).alias("coverage"))


@query(f"""{BASE}, h AS (SELECT query_id, node_id, score_composite AS score, doc_id FROM composite JOIN nodes USING (node_id)),
t AS (SELECT query_id, count(*) AS hit_count, max(score) AS top_score, list_avg(list_sort(list(score), 'DESC')[1:5]) AS avg_top5, count(DISTINCT doc_id)::DOUBLE / count(*) AS source_diversity FROM h GROUP BY query_id)
SELECT query_id, hit_count, round(top_score, 6) AS top_score, round(avg_top5, 6) AS avg_top5, round(source_diversity, 6) AS source_diversity FROM t""")
def evd03_features(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    f = evidence.features(c.scored_texts())
    return f.select("query_id", "hit_count", F.round("top_score", 6).alias("top_score"), F.round("avg_top5", 6).alias("avg_top5"), F.round("source_diversity", 6).alias("source_diversity"))


#: What questions of the gate ask for besides their text.
ASKS = {0: " on page 2", 1: " in doc-3.pdf", 2: ", how many, 45%?", 3: " 公式", 4: " 对比", 5: " whether 第 1 页"}
_NUMBERS = r"regexp_extract_all({}, '[0-9]+(?:\.[0-9]+)?%?')"


@query(rf"""{BASE},
posed AS (SELECT item_id AS query_id, text || CASE item_id % 7 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in ASKS.items())} ELSE '' END AS q FROM benchmark),
slots AS (SELECT query_id, q, {TERMS.format("q")} AS terms, CASE item_id % 7 WHEN 0 THEN 2 WHEN 5 THEN 1 END AS page_ref, regexp_extract(lower(q), '[\w\x{{4e00}}-\x{{9fff}} ._-]+\.pdf') AS file,
  list_filter([CASE WHEN regexp_matches(q, '表|统计|对比|排名|百分比|增长|下降|多少') THEN 'table' END, CASE WHEN regexp_matches(lower(q), '图片|图像|截图|图中|示意图|趋势图|视觉|照片|figure|fig\.|chart|screenshot|diagram|photo') THEN 'image' END,
    CASE WHEN regexp_matches(lower(q), '公式|方程|表达式|latex|formula|equation') THEN 'formula' END], lambda m: m IS NOT NULL) AS kinds,
  list_distinct(list_filter({_NUMBERS.format("q")}, lambda v: rtrim(v, '%') NOT IN (coalesce(CAST(CASE item_id % 7 WHEN 0 THEN 2 WHEN 5 THEN 1 END AS VARCHAR), '')))) AS numbers FROM posed JOIN (SELECT item_id AS query_id, item_id FROM benchmark) USING (query_id)),
h AS (SELECT query_id, node_id, rank, greatest(0, least(1, score_composite)) AS score, source, page, text || ' ' || source AS text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM composite JOIN nodes USING (node_id)),
t AS (SELECT query_id, count(*) AS hit_count, max(score) AS top_score, list_avg(list_sort(list(score), 'DESC')[1:5]) AS avg_top5, count(DISTINCT source)::DOUBLE / count(*) AS diversity, string_agg(text, ' ' ORDER BY rank) AS evidence, list(DISTINCT page) AS pages,
  lower(string_agg(DISTINCT source, ' ')) AS sources FROM h GROUP BY query_id),
six AS (SELECT query_id, bool_or(pos) AND bool_or(neg) AS mixed, bool_or(pos AND neg) AS same, count(DISTINCT CASE WHEN len(v) > 0 THEN source || ':' || page END) AS places, len(list_distinct(flatten(list(v)))) AS n_values FROM (
  SELECT query_id, source, page, regexp_matches(text, '(?i:\b(?:yes|true|support|supports|supported)\b)') AS pos, regexp_matches(text, '(?i:\b(?:no|false|not|cannot|can''t)\b)') AS neg, {_NUMBERS.format("text")} AS v FROM h WHERE place <= 6) GROUP BY query_id),
ids AS (SELECT query_id, list(node_id) FILTER (WHERE c = 'v') AS vn, list(node_id) FILTER (WHERE c = 'b') AS bn, list(DISTINCT source) FILTER (WHERE c = 'v') AS vs, list(DISTINCT source) FILTER (WHERE c = 'b') AS bs
  FROM (SELECT query_id, node_id, 'v' AS c FROM vec UNION ALL SELECT query_id, node_id, 'b' FROM bm25) JOIN nodes USING (node_id) GROUP BY query_id),
x AS (SELECT s.*, coalesce(hit_count, 0) AS hit_count, coalesce(top_score, 0) AS top_score, coalesce(avg_top5, 0) AS avg_top5, coalesce(diversity, 0) AS diversity, coalesce(evidence, '') AS evidence, coalesce(sources, '') AS sources, coalesce(pages, []) AS pages,
  coalesce(CASE WHEN vn IS NULL OR bn IS NULL THEN 0.5 ELSE greatest(len(list_intersect(vn, bn))::DOUBLE / least(len(vn), len(bn)), 0.5 * len(list_intersect(vs, bs)) / least(len(vs), len(bs))) END, CASE WHEN hit_count > 0 THEN 0.5 ELSE 0 END) AS consistency,
  coalesce(mixed, FALSE) AS mixed, coalesce(same, FALSE) AS same, coalesce(places, 0) AS places, coalesce(n_values, 0) AS n_values,
  regexp_matches(q, '(?i:^\s*(?:is|are|was|were|do|does|did|can|could|should|would|will|has|have)\b)|(?i:\b(?:whether|true|false|supported|contradict|contradiction|conflict|consistent|inconsistent)\b)|对比') AS polar,
  len(numbers) > 0 OR regexp_matches(q, '(?i:\b(?:how many|how much|percent|percentage|accuracy|score|rate|increase|decrease|number|numeric|value|statistics|rank)\b)') AS counts
  FROM slots s LEFT JOIN t USING (query_id) LEFT JOIN six USING (query_id) LEFT JOIN ids USING (query_id)),
y AS (SELECT *, {COVERED} AS coverage, list_filter([CASE WHEN hit_count < 2 THEN 'hits' END, CASE WHEN page_ref IS NOT NULL AND NOT list_contains(pages, page_ref) THEN 'page' END, CASE WHEN file <> '' AND NOT contains(sources, trim(file)) THEN 'source' END,
    CASE WHEN len(numbers) > 0 AND len(list_filter(numbers, lambda v: contains(lower(evidence), v))) = 0 THEN 'numeric' END] || list_transform(kinds, lambda k: 'modality:' || k), lambda z: z IS NOT NULL) AS missing,
  list_filter([CASE WHEN polar AND same THEN 'same_hit_positive_negative' END, CASE WHEN polar AND mixed THEN 'mixed_positive_negative_evidence' END, CASE WHEN counts AND places > 1 AND n_values > 1 THEN 'numeric_value_conflict' END], lambda z: z IS NOT NULL) AS reasons,
  CASE WHEN page_ref IS NOT NULL OR regexp_matches(q, '第|页|上下文|图中') THEN 1 ELSE 0 END + CASE WHEN file <> '' THEN 1 ELSE 0 END + CASE WHEN len(numbers) > 0 THEN 1 ELSE 0 END + len(kinds) AS n_slots FROM x),
z AS (SELECT *, CASE WHEN list_contains(reasons, 'same_hit_positive_negative') THEN 'high' WHEN len(reasons) > 0 THEN 'medium' ELSE 'none' END AS level, CASE WHEN n_slots = 0 THEN 1.0 ELSE (n_slots - len(list_filter(missing, lambda m: m <> 'hits')))::DOUBLE / n_slots END AS slot_coverage,
  len(kinds) = 0 AND coverage < 0.5 AS few FROM y),
w AS (SELECT *, CASE WHEN hit_count = 0 THEN 0 ELSE round_even(least(1, (0.3 * top_score + 0.2 * avg_top5 + 0.15 * consistency + 0.1 * CASE WHEN regexp_matches(q, '对比|compare|different') THEN diversity ELSE 1 END + 0.1 * slot_coverage + 0.05 * round(coverage, 6)) / 0.9
  * CASE level WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.95 ELSE 1 END), 4) END AS support FROM z),
l AS (SELECT *, CASE WHEN support <= 0 THEN 'none' WHEN support >= 0.75 AND len(missing) = 0 THEN 'strong' WHEN support >= 0.45 THEN 'partial' ELSE 'weak' END AS support_level FROM w)
SELECT query_id, CAST(hit_count AS BIGINT) AS hit_count, round(slot_coverage, 6) AS slot_coverage, round(coverage, 6) AS keyword_coverage, round(consistency, 6) AS score_consistency, array_to_string(missing, ',') AS missing_slots, level AS conflict_level, array_to_string(reasons, ',') AS conflict_reasons,
  CAST(support AS DOUBLE) AS support_score, support_level, CASE WHEN len(missing) > 0 THEN 'refuse' WHEN support_level IN ('partial', 'strong') THEN 'pass' ELSE 'retry' END AS decision, CASE WHEN few AND len(terms) > 0 THEN 'keyword' ELSE '' END AS soft_missing_slots,
  array_to_string(list_transform(missing, lambda m: 'missing_' || m) || list_filter([CASE WHEN few AND len(terms) > 0 THEN 'soft_missing_keyword' END, CASE WHEN level = 'high' THEN 'possible_conflict' END, CASE WHEN list_contains(reasons, 'numeric_value_conflict') THEN 'numeric_value_conflict' END,
    CASE WHEN level <> 'high' AND len(reasons) > 0 THEN 'possible_conflict' END], lambda z: z IS NOT NULL) || list_filter(reasons, lambda z: z <> 'numeric_value_conflict') || CASE WHEN few THEN ['low_keyword_coverage'] ELSE [] END, ',') AS gate_reasons FROM l""")
def evd02_gate(spark, sf_dir):
    """Questions that also ask for pages, a file, numbers, a formula or a comparison."""
    c = Corpus(spark, sf_dir)
    more = F.lit("")
    for i, text in ASKS.items():
        more = F.when(F.col("query_id") % 7 == i, text).otherwise(more)
    got = evidence.gate(c.questions.withColumn("text", F.concat("text", more)), c.scored_texts(), routes=c.routes())
    lists = ("missing_slots", "conflict_reasons", "soft_missing_slots", "gate_reasons")
    return got.drop("top_score", "avg_top5", "source_diversity").withColumns({n: F.array_join(n, ",") for n in lists})


# Events


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str01_windowed_counts(spark, sf_dir):
    return events.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_id, user_id, value FROM events WHERE value >= 80")
def str02_slow_stages(spark, sf_dir):
    return events.slow_stages(table(spark, sf_dir, "events"), "value", 80).select("event_id", "user_id", "value")


@query("SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, count(*) FILTER (WHERE n_chars >= 2000) AS long_docs FROM documents GROUP BY source, lang")
def agg03_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("n_chars") >= 2000).alias("long_docs"))


@query("""SELECT 'quality' AS metric, round(avg(quality), 6) AS value, count(quality) AS n FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 6), count(toxic) FROM labels""")
def agg11_metric_means(spark, sf_dir):
    return metrics.summary(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'missing_result' WHEN l.quality = 1 THEN 'passed' ELSE 'failed' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)""")
def join10_case_results(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    outcome = F.when(F.col("quality").isNull(), "missing_result").when(F.col("quality") == 1, "passed").otherwise("failed")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), outcome.alias("outcome"))


# Splits, layout blocks, relevance and history


@query()
def chk07_hard_split(spark, sf_dir):
    """Parts of every document; a fold that SQL does not express, so the tests compare with brute force."""
    parts = splitting.hard_split(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("part", "text"))


def _blocks(spark, sf_dir):
    """Events as the layout blocks of a document for each user."""
    kind, where = F.expr("(event_id * 7 + user_id) % 5"), F.expr("CAST(floor(value / 25) AS BIGINT)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), F.col("event_id").alias("ord"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("block_id"),
        F.when(kind < 2, "heading").when(kind < 4, "text").otherwise("table").alias("type"),
        F.when(F.expr("event_id % 6 <> 0"), F.concat_ws(" ", "event_type", kind.cast("string"))).alias("text"),
        F.when(F.expr("event_id % 11 <> 0"), F.expr("CAST(event_id % 4 + 1 AS INT)")).alias("page"),
        F.when(F.expr("event_id % 3 <> 0"), F.array(where.cast("double"), F.lit(0.0), (where * 2 + 10).cast("double"), F.lit(10.0))).alias("box"),
        F.when(where % 4 == 0, "layout").when(where % 4 == 1, "block_list").when(where % 4 == 2, "model").alias("source_kind"),
    )


BLOCKS = """
blocks AS (SELECT user_id AS source, event_id AS ord, 'b' || event_id AS block_id,
  CASE WHEN (event_id * 7 + user_id) % 5 < 2 THEN 'heading' WHEN (event_id * 7 + user_id) % 5 < 4 THEN 'text' ELSE 'table' END AS type,
  CASE WHEN event_id % 6 <> 0 THEN event_type || ' ' || (event_id * 7 + user_id) % 5 END AS text,
  CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 4 + 1 AS INTEGER) END AS page,
  CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value / 25) AS BIGINT) END AS x,
  CASE CAST(floor(value / 25) AS BIGINT) % 4 WHEN 0 THEN 'layout' WHEN 1 THEN 'block_list' WHEN 2 THEN 'model' END AS source_kind FROM events)
"""


@query(f"""WITH {BLOCKS}, l AS (SELECT *, lag(type) OVER (PARTITION BY source ORDER BY ord) AS before FROM blocks)
SELECT block_id, CAST(nullif(sum(CASE WHEN type = 'heading' AND before IS DISTINCT FROM 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ord), 0) AS INTEGER) AS title_region FROM l""")
def chk08b_title_regions(spark, sf_dir):
    return layout.title_regions(_blocks(spark, sf_dir)).select("block_id", "title_region")


@query(f"""WITH {BLOCKS}, runs AS (SELECT b.*, sum(CASE WHEN type <> 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM blocks b),
h AS (SELECT source, coalesce(run, 0) AS run, max_by(block_id, ord) AS heading_block, max_by(text, ord) AS heading_text FROM runs WHERE type = 'heading' AND text IS NOT NULL GROUP BY ALL)
SELECT block_id, heading_block, heading_text FROM runs r LEFT JOIN h ON h.source = r.source AND h.run = coalesce(r.run, 0) AND r.type = 'text'""")
def chk08c_heading_context(spark, sf_dir):
    return layout.heading_context(_blocks(spark, sf_dir)).select("block_id", "heading_block", "heading_text")


@query(f"""WITH {BLOCKS}, u AS (SELECT *, coalesce(source_kind, 'unknown') AS k FROM blocks WHERE type IN ('text', 'heading', 'formula') AND page IS NOT NULL AND text IS NOT NULL),
g AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY CASE k WHEN 'layout' THEN 105 WHEN 'block_list' THEN 105 WHEN 'model' THEN 80 ELSE 10 END DESC, count(x) DESC, count(*) DESC, min(ord)) AS r FROM u GROUP BY source, k)
SELECT block_id, coalesce(source_kind, 'none') AS source_kind FROM u JOIN g USING (source, k) WHERE r = 1""")
def ext10_best_source_kind(spark, sf_dir):
    return layout.best_source_kind(_blocks(spark, sf_dir)).select("block_id", F.coalesce("source_kind", F.lit("none")).alias("source_kind"))


@query(f"""WITH {BLOCKS}, g AS (SELECT source, x, count(*) AS n, min(ord) AS first FROM blocks WHERE x IS NOT NULL GROUP BY source, x)
SELECT source, CAST(x AS DOUBLE) AS x0, CAST(x * 2 + 10 AS DOUBLE) AS x1, n FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, x, first) = 1""")
def ext18_consensus_box(spark, sf_dir):
    return layout.consensus_boxes(_blocks(spark, sf_dir), "source").select("source", F.col("box")[0].alias("x0"), F.col("box")[2].alias("x1"), "n")


@query(f"WITH {BLOCKS} SELECT source, coalesce(page, 0) AS page, type, count(*) AS n, count(x) AS with_box, count(text) AS with_text FROM blocks GROUP BY source, page, type")
def ext19_block_diagnostics(spark, sf_dir):
    return layout.diagnostics(_blocks(spark, sf_dir)).withColumn("page", F.coalesce("page", F.lit(0)))


def _judged(spark, sf_dir):
    """Lines of an order as ranked hits, and three specifications for each order: a page, a source, both."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.row_number().over(order).alias("rank"), F.col("l_partkey").cast("string").alias("node_id"),
        F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat(F.lit("Mode "), F.col("l_returnflag"), F.lit("-"), F.col("l_linestatus")).alias("source"),
    )
    spec = F.explode(F.expr("""array(
        named_struct('spec_idx', 0, 'spec_id', cast(null as string), 'spec_page', cast(o_orderkey % 7 as int), 'spec_source', cast(null as string), 'grade', 1.0D),
        named_struct('spec_idx', 1, 'spec_id', null, 'spec_page', null, 'spec_source', 'mode a', 'grade', 2.0D),
        named_struct('spec_idx', 2, 'spec_id', null, 'spec_page', 3, 'spec_source', 'N-O', 'grade', null))""")).alias("s")
    return hits, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), spec).select("query_id", "s.*")


@query("""WITH hits AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rank, l_linenumber AS page, l_returnflag AS a, l_linestatus AS b FROM lineitem),
m AS (SELECT h.*, o_orderkey IS NOT NULL AND a = 'A' AS s1, o_orderkey IS NOT NULL AND abs(page - o_orderkey % 7) <= 1 AS s0, o_orderkey IS NOT NULL AND abs(page - 3) <= 1 AND a = 'N' AND b = 'O' AS s2 FROM hits h LEFT JOIN orders ON o_orderkey = query_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN s1 THEN 1 WHEN s0 THEN 0 WHEN s2 THEN 2 ELSE -1 END AS INTEGER) AS spec_idx, CASE WHEN s1 THEN 2.0::DOUBLE WHEN s0 OR s2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade FROM m""")
def flt13_spec_grades(spark, sf_dir):
    got = relevance.graded(*_judged(spark, sf_dir), page_tolerance=1)
    return got.select("query_id", "rank", F.coalesce("spec_idx", F.lit(-1)).alias("spec_idx"), "grade")


@query()
def join11_spec_match_once(spark, sf_dir):
    """Each specification serves one hit; the choice is sequential, so the tests compare with brute force."""
    got = relevance.graded(*_judged(spark, sf_dir), page_tolerance=1, once=True)
    return got.select("query_id", "rank", F.coalesce("spec_idx", F.lit(-1)).alias("spec_idx"), "grade")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def src26_latest_record(spark, sf_dir):
    records = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return history.latest_records(records, "user_id", order="event_id")


@query()
def qry01_query_variants(spark, sf_dir):
    """Variants of each benchmark question; decomposition of characters is beyond SQL, so tests give examples."""
    return variants.query_variants(Corpus(spark, sf_dir).questions)


TOKEN = r"[A-Za-z][A-Za-z0-9_.-]*|[0-9]+(?:\.[0-9]+)?"


@query(f"""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(text, '{TOKEN}'), lambda w: length(w) >= 3 OR regexp_matches(w, '[0-9_]')) AS w FROM benchmark),
e AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
f AS (SELECT item_id, arg_min(word, i) AS word, min(i) AS i FROM e GROUP BY item_id, lower(word))
SELECT item_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS keywords FROM t LEFT JOIN f USING (item_id) GROUP BY item_id""")
def qry03_keyword_variant(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", variants.keyword_variant(F.col("text")).alias("keywords"))


@query()
def flt07_anchor_overlap(spark, sf_dir):
    """Hits of each question with whether they share a loose anchor with it."""
    c = Corpus(spark, sf_dir)
    asked = c.questions.select("query_id", variants.anchors(F.col("text"), strong=False).alias("anchors"))
    hits = c.with_text(c.kept(lexical.search(c.bm25(), c.questions))).join(asked, "query_id")
    return variants.with_shared_anchor(hits).select("query_id", "node_id", "rank", "shares_anchor")


# Choosing hits


LINES = """
h AS (SELECT l_orderkey AS query_id, l_partkey AS node_id, l_extendedprice AS score, l_returnflag AS flag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey, l_quantity) AS rank FROM lineitem),
d AS (SELECT query_id, node_id, score, flag, row_number() OVER (PARTITION BY query_id ORDER BY rank, node_id) AS rank FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY rank) = 1))
"""


def _lines(spark, sf_dir):
    """Lines of an order as hits by price; a part may be there twice."""
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("node_id"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("flag"), F.row_number().over(order).alias("rank")
    )


@query(f"WITH {LINES} SELECT query_id, node_id, score, flag, CAST(rank AS INTEGER) AS rank FROM d")
def set01_distinct_hits(spark, sf_dir):
    return selection.distinct_hits(_lines(spark, sf_dir))


@query(f"""WITH {LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM d)
SELECT query_id, node_id, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 6 OR rank > n - 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8""")
def topk02_head_tail(spark, sf_dir):
    return selection.head_tail(selection.distinct_hits(_lines(spark, sf_dir))).select("query_id", "node_id", "rank")


@query(f"""WITH {LINES}, a AS (SELECT * FROM d WHERE rank <= 4), b AS (SELECT query_id, node_id, score / 2 AS score, rank FROM d WHERE flag = 'A'),
m AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.node_id, b.node_id) AS node_id, coalesce(b.score, a.score) AS score, a.rank AS r0, b.rank AS r1 FROM a FULL JOIN b ON a.query_id = b.query_id AND a.node_id = b.node_id)
SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r0 IS NULL, r0, r1) AS INTEGER) AS rank, CASE WHEN r1 IS NULL THEN 'none' WHEN r0 IS NULL THEN 'added' ELSE 'replaced' END AS carry FROM m""")
def join08_carry_forward(spark, sf_dir):
    hits = selection.distinct_hits(_lines(spark, sf_dir))
    got = selection.carried_forward(hits.where("rank <= 4"), hits.where("flag = 'A'").withColumn("score", F.col("score") / 2))
    return got.withColumn("carry", F.coalesce("carry", F.lit("none")))


@query(f"""WITH {LINES} SELECT query_id, node_id, CAST(rank AS INTEGER) AS rank, (query_id, node_id) IN (SELECT query_id, node_id FROM h WHERE flag = 'R') AS removed FROM h""")
def flt11_dropped_before(spark, sf_dir):
    hits = _lines(spark, sf_dir)
    kept, removed = selection.without_dropped(hits, hits.where("flag = 'R'"))
    both = kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))
    return both.select("query_id", "node_id", "rank", "removed")


@query(f"""WITH {CHUNKS}, {POSTINGS}, {ASKED}, {_bm25()}, m AS (SELECT node_id, doc_id, page, chunk_index, CASE WHEN chunk_index % 3 = 0 THEN 'image' ELSE 'text' END AS modality FROM nodes),
hits AS (SELECT query_id, node_id, score / 100 AS score, rank FROM bm25),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY chunk_index, node_id) AS k FROM m WHERE modality = 'text' QUALIFY k <= 3),
added AS (SELECT query_id, t.node_id, least(1, greatest(0, hits.score * 0.7)) AS score, rank AS a, k AS b, 'image_context' AS channel FROM hits JOIN m USING (node_id) JOIN t ON t.doc_id = m.doc_id AND t.page = m.page
  WHERE m.modality = 'image' AND (query_id, t.node_id) NOT IN (SELECT query_id, node_id FROM hits) QUALIFY row_number() OVER (PARTITION BY query_id, t.node_id ORDER BY rank, k) = 1),
u AS (SELECT query_id, node_id, score, rank AS a, 0 AS b, 'search' AS channel FROM hits UNION ALL SELECT * FROM added)
SELECT query_id, node_id, round(score, 6) AS score, channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, channel = 'image_context', a, b) AS INTEGER) AS rank FROM u""")
def join05_image_context(spark, sf_dir):
    """Search hits, every third chunk taken for an image, with the texts of their pages."""
    c = Corpus(spark, sf_dir)
    nodes = c.nodes.withColumn("modality", F.when(F.col("chunk_index") % 3 == 0, "image").otherwise("text"))
    hits = c.kept(lexical.search(c.bm25(), c.questions).withColumn("score", F.col("score") / 100))
    return selection.image_context(hits, nodes).withColumn("score", F.round("score", 6))


@query("SELECT source AS category, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS passed, round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*), 6) AS pass_rate FROM documents JOIN labels USING (doc_id) GROUP BY source")
def agg10_category_breakdown(spark, sf_dir):
    judged = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    counts = judged.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"))
    return counts.withColumn("pass_rate", F.round(F.col("passed") / F.col("n"), 6))
