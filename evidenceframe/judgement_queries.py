"""Queries of evaluation, stages and routing over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions.text import folded, mixed_of, normal_of
from .operators import context, evaluation, evidence, grading, lexical, linking, markdown_tables, projections, rerank, retry, routing, stages
from .plans.retrieval import Corpus
from .queries import ASKED, BASE, CHUNKS, MIXED, POSTINGS, _bm25, _brand_tables, query, table
from .settings import DEFAULTS

# Functions of text


@query(f"SELECT doc_id, CAST(len({MIXED.format('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({MIXED.format('text')})) AS BIGINT) AS n_distinct, length(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS n_normal FROM documents")
def fn02_mixed_tokens(spark, sf_dir):
    """Tokens and normal form; the tables hold no text that the compatibility form changes otherwise."""
    forms = table(spark, sf_dir, "documents").select("doc_id", folded(F.col("text")).alias("form"))
    words = forms.select("doc_id", mixed_of(F.col("form")).alias("w"), normal_of(F.col("form")).alias("t"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.length("t").cast("bigint").alias("n_normal"))


# Stages: lines of an order as hits of three stages. The first ranks by price; the reranked stage
# leaves out returned lines and ranks by quantity; the last keeps three of it, by discount.

STAGES = ["initial", "rerank", "final"]
STAGED = """
lines AS (SELECT l_orderkey AS query_id, (l_partkey * 1000 + l_suppkey) * 10 + l_linenumber AS node_id, l_returnflag AS flag, l_linestatus AS status, l_suppkey AS source, CAST(l_linenumber AS INTEGER) AS page, l_quantity AS q, l_discount AS d, l_tax AS tax, l_extendedprice AS price,
  l_partkey % 4 - 1 AS g FROM lineitem),
s0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, node_id) AS rank FROM lines),
s1 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY q DESC, node_id) AS rank) FROM s0 WHERE flag <> 'R'),
s2 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY d DESC, node_id) AS rank) FROM s1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d DESC, node_id) <= 3),
hits AS (SELECT *, 'initial' AS stage FROM s0 UNION ALL SELECT *, 'rerank' FROM s1 UNION ALL SELECT *, 'final' FROM s2),
graded AS (SELECT *, CAST(greatest(g, 0) AS DOUBLE) AS grade FROM hits)
"""


def _staged(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("node_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("source"),
        F.col("l_linenumber").cast("int").alias("page"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"), (F.col("l_partkey") % 4 - 1).alias("g"),
    )
    rank = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "node_id"))
    s0 = lines.withColumn("rank", rank("price"))
    s1 = s0.where("flag <> 'R'").withColumn("rank", rank("q"))
    s2 = s1.withColumn("rank", rank("d")).where("rank <= 3")
    hits = [s.withColumn("stage", F.lit(n)) for s, n in zip((s0, s1, s2), STAGES, strict=True)]
    # dealt again, as Spark 4.1 may take the union for partitioned by query
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).withColumn("grade", F.greatest("g", F.lit(0)).cast("double")).repartition("query_id", "node_id")


@query(f"""WITH {STAGED}, w AS (SELECT query_id, node_id, min(CASE WHEN stage = 'initial' THEN rank END) AS a, min(CASE WHEN stage = 'rerank' THEN rank END) AS b, min(CASE WHEN stage = 'final' THEN rank END) AS c FROM hits GROUP BY ALL)
SELECT query_id, node_id, a AS initial_rank, b AS rerank_rank, c AS final_rank, coalesce(nullif(concat_ws(',', CASE WHEN a IS NULL AND b IS NOT NULL THEN 'new_in_rerank' END, CASE WHEN a IS NULL AND b IS NULL AND c IS NOT NULL THEN 'new_in_final' END,
  CASE WHEN a IS NOT NULL AND b IS NULL AND c IS NULL THEN 'dropped_after_initial' END, CASE WHEN b IS NOT NULL AND c IS NULL THEN 'dropped_after_rerank' END, CASE WHEN b < a THEN 'promoted_by_rerank' WHEN b > a THEN 'demoted_by_rerank' END,
  CASE WHEN c < b THEN 'promoted_after_retry' WHEN c > b THEN 'demoted_after_retry' END), ''), 'stable') AS status FROM w""")
def join16_stage_compare(spark, sf_dir):
    return stages.compare(_staged(spark, sf_dir), STAGES)


REMOVED = """removed AS (SELECT query_id, node_id, 'rerank' AS stage FROM s0 WHERE flag = 'R' AND status = 'O')"""


@query(f"""WITH {STAGED}, {REMOVED}, gone AS (
  SELECT s0.*, 'initial' AS from_stage, 'rerank' AS stage FROM s0 WHERE (query_id, node_id) NOT IN (SELECT query_id, node_id FROM s1) AND (query_id, node_id) NOT IN (SELECT query_id, node_id FROM removed)
  UNION ALL SELECT s1.*, 'rerank', 'final' FROM s1 WHERE (query_id, node_id) NOT IN (SELECT query_id, node_id FROM s2))
SELECT query_id, node_id, from_stage, stage, CAST(rank AS INTEGER) AS previous_rank, CASE WHEN q > 48 THEN 'agent_chunk_drop' WHEN status = 'F' AND d = 0 THEN 'agent_irrelevant_label' WHEN tax < 0.01 THEN 'agent_low_relevance_score' WHEN d > 0.09 THEN 'score_threshold_failed'
  WHEN stage = 'rerank' THEN 'reranker_not_selected' ELSE 'unknown_removed' END AS reason FROM gone""")
def win03_inferred_removals(spark, sf_dir):
    """Hits that a stage lost, with WIN-04's reasons: some dropped by an agent, some listed as removed."""
    hits = _staged(spark, sf_dir)
    removed = hits.where("stage = 'initial' and flag = 'R' and status = 'O'").select("query_id", "node_id", F.lit("rerank").alias("stage"))
    told = hits.withColumns({"dropped": F.col("q") > 48, "label": F.when((F.col("status") == "F") & (F.col("d") == 0), "Irrelevant"), "relevance": F.col("tax") * 25, "passed": F.col("d") <= 0.09})
    return stages.inferred_removals(told, removed, STAGES)


@query(f"""WITH {STAGED}, r AS (SELECT query_id, CASE WHEN flag = 'R' THEN 'reranker_not_selected' WHEN flag = 'N' THEN 'context_top_n_limit' END AS reason FROM s0 WHERE flag <> 'A' UNION ALL SELECT query_id, NULL FROM s2)
SELECT query_id, coalesce(reason, 'unknown') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def agg09_removed_reasons(spark, sf_dir):
    hits = _staged(spark, sf_dir)
    reason = F.when(F.col("flag") == "R", "reranker_not_selected").when(F.col("flag") == "N", "context_top_n_limit")
    first = hits.where("stage = 'initial' and flag <> 'A'").select("query_id", reason.alias("reason"))
    last = hits.where("stage = 'final'").select("query_id", F.lit(None).cast("string").alias("reason"))
    return stages.reason_counts(stages.merged_removals(first, last))


@query(f"""WITH {STAGED} SELECT query_id, node_id, stage, CASE WHEN NOT (status = 'F' OR q > 30) THEN CASE WHEN stage IN ('rerank') THEN 'not_graded_yet' ELSE 'not_graded' END END AS agent,
CASE WHEN tax > 0.06 THEN CASE WHEN d > 0.05 THEN 'relevant' WHEN d > 0 THEN 'partial' ELSE 'irrelevant' END WHEN grade > 0 OR page IN (2, 4) THEN 'relevant' ELSE 'irrelevant' END AS state FROM graded""")
def sup89_hit_states(spark, sf_dir):
    """Relevance and agent states; a tax above 0.06 stands for a hit with a region, the discount for its IoU."""
    agent = stages.agent_status(F.col("stage"), F.when(F.col("status") == "F", "weak"), F.when(F.col("q") > 30, 0.5))
    none = F.lit(None)
    state = stages.relevance_state(F.when(F.col("tax") > 0.06, F.col("d") * 10), none.cast("double"), none.cast("boolean"), none.cast("string"), F.col("grade"), F.col("page"), F.array(F.lit(2), F.lit(4)))
    return _staged(spark, sf_dir).select("query_id", "node_id", "stage", agent.alias("agent"), state.alias("state"))


# Metrics of stages


@query(f"""WITH {STAGED}, r AS (SELECT query_id, stage, rank, grade FROM graded)
SELECT query_id, CASE WHEN max(CASE WHEN rank <= 2 THEN grade END) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, round(coalesce(1.0::DOUBLE / min(CASE WHEN rank <= 2 AND grade > 0 THEN rank END), 0), 6) AS mrr,
  count(*) FILTER (WHERE rank <= 1 AND grade > 0)::DOUBLE AS precision_at_1, round(count(*) FILTER (WHERE rank <= 3 AND grade > 0) / 3.0::DOUBLE, 6) AS precision_at_3,
  round(count(*) FILTER (WHERE rank <= 2 AND grade > 0)::DOUBLE / greatest(1, count(*) FILTER (WHERE rank <= 2)), 6) AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS ap, NULL::DOUBLE AS ndcg FROM r WHERE stage = 'rerank' GROUP BY query_id""")
def met04_partial_metrics(spark, sf_dir):
    return evaluation.partial_metrics(_staged(spark, sf_dir).where("stage = 'rerank'").select("query_id", "rank", "grade"), k=2)


@query(f"""WITH {STAGED}, f AS (SELECT query_id, count(DISTINCT node_id) AS n_all FROM graded WHERE grade > 0 GROUP BY query_id), t AS (SELECT query_id, stage, count(DISTINCT node_id) FILTER (WHERE grade > 0 AND rank <= 2) AS n FROM graded GROUP BY ALL)
SELECT query_id, stage, round(CASE WHEN coalesce(n_all, 0) = 0 THEN 0.0::DOUBLE ELSE n::DOUBLE / n_all END, 6) AS recall FROM t LEFT JOIN f USING (query_id)""")
def met05_chunk_recall(spark, sf_dir):
    return evaluation.chunk_recall(_staged(spark, sf_dir), k=2)


@query(f"""WITH {STAGED}, f AS (SELECT DISTINCT query_id, node_id FROM graded WHERE grade > 0) SELECT query_id, count(*) AS n, min(node_id) AS first FROM f GROUP BY query_id""")
def set05_relevant_union(spark, sf_dir):
    keys = evaluation.relevant_keys(_staged(spark, sf_dir))
    return keys.groupBy("query_id").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))


@query(f"""WITH {STAGED}, h AS (SELECT query_id, rank, 'supplier-' || source AS source, CASE WHEN page < 6 THEN page END AS page FROM s1),
sp AS (SELECT DISTINCT query_id, src, pg FROM (SELECT o_orderkey AS query_id, unnest([NULL, 'Supplier 1', NULL]) AS src, unnest([o_orderkey % 6 + 1, 2, 4]) AS pg FROM orders WHERE o_orderkey % 3 <> 0)),
want AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pg, src) AS spec_no FROM sp),
pairs AS (SELECT h.*, spec_no FROM h JOIN want USING (query_id) WHERE abs(page - pg) <= 1 AND (src IS NULL OR contains(replace(h.source, '-', ''), 'supplier1') OR contains('supplier1', replace(h.source, '-', '')))),
c AS (SELECT query_id, count(DISTINCT spec_no) AS covered, min(rank) AS first FROM pairs GROUP BY query_id), ri AS (SELECT query_id, count(*) AS n_right FROM (SELECT DISTINCT query_id, source, page FROM pairs) GROUP BY query_id),
re AS (SELECT query_id, count(*) AS n, count(DISTINCT CASE WHEN page IS NOT NULL THEN source || '/' || page END) AS pages FROM h GROUP BY query_id), ex AS (SELECT query_id, count(*) AS expected FROM want GROUP BY query_id),
qs AS (SELECT query_id FROM sp UNION SELECT query_id FROM h), a AS (SELECT *, expected IS NOT NULL AND (n IS NULL OR pages > 0) AS judged FROM qs LEFT JOIN ex USING (query_id) LEFT JOIN re USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN ri USING (query_id))
SELECT query_id, CASE WHEN judged THEN CASE WHEN covered > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS page_hit_rate, CASE WHEN judged THEN round(coalesce(1.0::DOUBLE / first, 0), 6) END AS page_mrr,
  CASE WHEN judged THEN round(CASE WHEN coalesce(pages, 0) = 0 THEN 0 ELSE coalesce(n_right, 0)::DOUBLE / pages END, 6) END AS page_precision, CASE WHEN judged THEN round(coalesce(covered, 0)::DOUBLE / expected, 6) END AS page_recall FROM a""")
def met06_page_metrics(spark, sf_dir):
    """Reranked lines as hits, their number as page (unknown from 6 on), against three pages an order; two orders in three are judged."""
    hits = _staged(spark, sf_dir).where("stage = 'rerank'").select("query_id", "rank", F.concat(F.lit("supplier-"), F.col("source").cast("string")).alias("source"), F.when(F.col("page") < 6, F.col("page")).alias("page"))
    spec = F.explode(F.expr("array(named_struct('spec_source', cast(null as string), 'spec_page', cast(o_orderkey % 6 + 1 as int)), named_struct('spec_source', 'Supplier 1', 'spec_page', 2), named_struct('spec_source', '', 'spec_page', 4))")).alias("s")
    specs = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("query_id"), spec).select("query_id", "s.*")
    return evaluation.page_metrics(hits, specs, tolerance=1)


@query(f"WITH {STAGED}, f AS (SELECT * FROM graded WHERE rank <= 2) SELECT stage, count(DISTINCT node_id) AS chunks, count(DISTINCT CASE WHEN grade > 0 THEN node_id END) AS relevant_chunks FROM f GROUP BY stage")
def agg13_chunk_summary(spark, sf_dir):
    return evaluation.chunk_summary(_staged(spark, sf_dir), top=2)


@query(f"WITH {STAGED} SELECT query_id, stage, count(*) AS total, count(*) FILTER (WHERE grade > 0) AS relevant, bool_or(grade > 0 AND rank = 1) AS top1 FROM graded GROUP BY query_id, stage")
def agg15_stage_summary(spark, sf_dir):
    return evaluation.stage_summary(_staged(spark, sf_dir))


@query(f"WITH {STAGED} SELECT stage, metric, round(avg(v), 6) AS value, count(v) AS n FROM (SELECT stage, unnest(['grade', 'discount']) AS metric, unnest([grade, CASE WHEN q > 10 THEN d::DOUBLE END]) AS v FROM graded) GROUP BY stage, metric")
def agg12_metrics_report(spark, sf_dir):
    records = _staged(spark, sf_dir).select("stage", "grade", F.when(F.col("q") > 10, F.col("d").cast("double")).alias("discount"))
    return evaluation.report(records, ["grade", "discount"])


@query("""SELECT query_id, round(0.3 * coalesce(a, 0) + 0.2 * coalesce(b, 0) + 0.2 * coalesce(c, 0) + 0.1 * coalesce(d, 0) + 0.2 * coalesce(e, 0) / 100, 6) AS objective
FROM (SELECT l_orderkey * 10 + l_linenumber AS query_id, l_discount::DOUBLE AS a, l_tax::DOUBLE AS b, CASE WHEN l_returnflag <> 'R' THEN l_discount::DOUBLE END AS c, l_tax::DOUBLE * 2 AS d, l_quantity::DOUBLE AS e FROM lineitem)""")
def agg14_objective(spark, sf_dir):
    d, t = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    value = evaluation.objective(d, t, F.when(F.col("l_returnflag") != "R", d), t * 2, F.col("l_quantity").cast("double"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), F.round(value, 6).alias("objective"))


# Retries and citations


@query(f"""WITH {STAGED}, c AS (SELECT query_id, node_id, 0 AS side, rank, d * 8 AS score, status, tax FROM s1 UNION ALL SELECT query_id, node_id, 1, rank, d * 9, status, tax FROM s0),
ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY side, rank) AS k FROM c WHERE NOT tax > 0.07 AND score >= 0.35 AND status = 'O'),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY side, rank, node_id) AS place FROM ok WHERE k = 1)
SELECT query_id, node_id, CASE WHEN side = 0 THEN 'rerank' ELSE 'expanded' END AS from_stage, CAST(rank AS INTEGER) AS previous_rank, round(score, 6)::DOUBLE AS score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 4""")
def topk03_carry_select(spark, sf_dir):
    hits = _staged(spark, sf_dir).withColumns({"label": F.when(F.col("status") == "O", "Strong").otherwise("weak"), "dropped": F.col("tax") > 0.07})
    side = lambda stage, by: hits.where(F.col("stage") == stage).select("query_id", "node_id", "rank", (F.col("d") * by).alias("score"), "label", "dropped")
    return evaluation.carry_select(side("rerank", 8), side("initial", 9)).withColumn("score", F.round("score", 6).cast("double"))


@query(f"WITH {STAGED}, f AS (SELECT query_id, node_id, min(rank) AS rank FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, node_id) AS k FROM f) SELECT query_id, string_agg(node_id::VARCHAR, ',' ORDER BY k) AS node_ids FROM r WHERE k <= 6 GROUP BY query_id")
def topk04_supporting_ids(spark, sf_dir):
    return evaluation.supporting(_staged(spark, sf_dir)).select("query_id", F.array_join("node_ids", ",").alias("node_ids"))


@query(f"""WITH {STAGED}, c AS (SELECT query_id, source, CASE WHEN q > 45 THEN page + 1 ELSE page END AS chunk_index FROM s1 WHERE d < 0.05), k AS (SELECT DISTINCT query_id, source, page AS chunk_index, 1 AS there FROM s0),
j AS (SELECT c.query_id, count(*) AS cited, count(*) FILTER (WHERE there IS NULL) AS wrong FROM c LEFT JOIN k USING (query_id, source, chunk_index) GROUP BY c.query_id)
SELECT query_id, coalesce(cited, 0) AS cited, coalesce(wrong, 0) AS wrong, coalesce(cited, 0) > 0 AND coalesce(wrong, 0) = 0 AS citation_ok FROM (SELECT DISTINCT query_id FROM s0) LEFT JOIN j USING (query_id)""")
def join09_citations(spark, sf_dir):
    hits = _staged(spark, sf_dir)
    cited = hits.where("stage = 'rerank' and d < 0.05").select("query_id", "source", F.when(F.col("q") > 45, F.col("page") + 1).otherwise(F.col("page")).alias("chunk_index"))
    return evaluation.citations_hold(cited, hits.where("stage = 'initial'").select("query_id", "source", F.col("page").alias("chunk_index")))


@query("""SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'P' THEN 'finalize' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'build_prompt' WHEN o_orderkey % 4 >= 2 THEN 'finalize' WHEN o_totalprice > 300000 THEN 'finalize' WHEN o_custkey * 10 > 12000 THEN 'finalize'
  WHEN o_orderkey % 4 > 0 AND o_custkey % 100 < 5 THEN 'finalize' ELSE 'local_retry' END AS retry, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 >= 2 OR o_totalprice > 300000 OR o_custkey * 10 > 12000 THEN 'finalize' ELSE 'local_retry' END AS citation,
  CASE WHEN o_orderstatus = 'O' THEN 'evidence_gate' WHEN o_orderkey % 3 > 0 AND o_orderkey % 4 <= 0 THEN 'local_retry' ELSE 'build_prompt' END AS rerank FROM orders""")
def rte05_decisions(spark, sf_dir):
    """Orders as states of a run: decisions after the gate, the citations and the rerank (RTE-05 to 07)."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    state = {"refusal": s == "P", "evidence_ok": (s == "F") & (k % 2 == 0), "retry_count": k % 4, "elapsed_ms": F.col("o_totalprice") / 10, "tokens": F.col("o_custkey") * 10, "gain": F.col("o_custkey") % 100 / 100, "citation_ok": k % 5 == 0}
    return table(spark, sf_dir, "orders").select(
        k.alias("query_id"), routing.retry_decision(state).alias("retry"), routing.citation_decision(state).alias("citation"), routing.after_rerank(s == "O", k % 3 > 0, k % 4).alias("rerank")
    )


@query("""WITH d AS (SELECT o_orderkey AS query_id, list_sort(list_distinct(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'page' END, CASE WHEN o_orderkey % 3 = 0 THEN 'modality:table' END, CASE WHEN o_orderkey % 5 = 0 THEN 'page' ELSE '' END,
  CASE WHEN o_orderstatus IN ('P', 'O') THEN 'possible_conflict' END, CASE WHEN o_orderkey % 7 = 0 THEN 'need_cross_doc' END, CASE WHEN o_orderkey % 4 = 0 THEN 'citation_failure' END, CASE WHEN o_custkey % 100 < 45 THEN 'low_support_score' END], lambda x: x <> ''))) AS r FROM orders)
SELECT query_id, array_to_string(r, ',') AS reasons FROM d""")
def sup72_retry_reasons(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    lists = [F.array(F.when(k % 2 == 0, "page"), F.when(k % 3 == 0, "modality:table")), F.array(F.when(k % 5 == 0, "page").otherwise(""))]
    level = F.when(s == "P", "high").when(s == "O", "medium").otherwise("none")
    reasons = routing.retry_reasons(lists, level, k % 7 == 0, k % 4 != 0, F.col("o_custkey") % 100 / 100)
    return table(spark, sf_dir, "orders").select(k.alias("query_id"), F.array_join(reasons, ",").alias("reasons"))


ASKS = "(SELECT item_id, CASE item_id % 4 WHEN 0 THEN '  Please ' || text || '?' WHEN 1 THEN 'what is ' || text WHEN 2 THEN '请介绍下' || text || '是什么' ELSE text END AS q FROM benchmark)"


def _asks(spark, sf_dir):
    k, t = F.col("item_id") % 4, F.col("text")
    q = F.when(k == 0, F.concat(F.lit("  Please "), t, F.lit("?"))).when(k == 1, F.concat(F.lit("what is "), t)).when(k == 2, F.concat(F.lit("请介绍下"), t, F.lit("是什么"))).otherwise(t)
    return table(spark, sf_dir, "benchmark").select("item_id", q.alias("q"))


@query(f"""WITH a AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), '^(please\\s+|what\\s+is\\s+)', '', 'i'), '^(请|帮我|麻烦|简单)?(介绍下|介绍一下|说明下|解释下)', ''), '(是什么|是多少|多少|吗|呢|？|\\?)$', ''), '^\\s+|\\s+$', '', 'g') AS q FROM {ASKS})
SELECT item_id, concat_ws(' ', nullif(q, ''), CASE WHEN item_id % 3 = 0 THEN '数值 百分比 统计 指标 value percent' END, CASE WHEN item_id % 2 = 0 THEN '表格 table 指标 数值' END) AS query FROM a""")
def rte04_rewrite(spark, sf_dir):
    reasons = F.array(F.when(F.col("item_id") % 3 == 0, "missing_numeric"), F.when(F.col("item_id") % 2 == 0, "modality:table"))
    return _asks(spark, sf_dir).select("item_id", routing.rewritten(F.col("q"), F.array_compact(reasons)).alias("query"))


TAILS = ["对比 Figure", " 第3页", " 排名 Compare", " chart", " FORMULA", " SIGMA 该页", " plain", " Chart", " 图1 equation", " 不同文档 多少"]


def _any(words: tuple[str, ...], text: str = "q") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(f"""WITH a AS (SELECT item_id, regexp_replace(text || {TAILS!r}[CAST(item_id % 10 + 1 AS BIGINT)], '^\\s+|\\s+$', '', 'g') AS q FROM benchmark),
k AS (SELECT *, CASE WHEN {_any(routing.TABLE)} THEN 'table' WHEN {_any(routing.IMAGE)} THEN 'image' WHEN {_any(routing.FORMULA, 'lower(q)')} THEN 'formula' WHEN {_any(routing.PAGE)} THEN 'page' END AS kind FROM a)
SELECT item_id AS query_id, coalesce(kind || '_qa', 'general') AS intent, concat_ws(',', kind, 'text') AS modalities, {_any(routing.CROSS_DOC)} OR contains(lower(q), 'compare') AS cross_doc, {_any(routing.PAGE)} AS page_level,
  CASE WHEN kind IN ('table', 'image', 'page') THEN kind || '_first' ELSE 'text_first' END AS route FROM k""")
def rte01_question_analysis(spark, sf_dir):
    """Questions with an ending that asks for something."""
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("item_id") % len(TAILS)).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", tail).alias("text"))
    return routing.analysed(asked).withColumn("modalities", F.array_join("modalities", ","))


def _calls(words: str) -> str:
    return " OR ".join(f"contains(lower(text), '{w.strip()}')" for w in words.split(","))


@query(f"""WITH c AS (SELECT item_id, unnest(['vector', 'bm25', CASE WHEN {_calls(routing.TRIGGERS['table'])} THEN 'table' END, CASE WHEN {_calls(routing.TRIGGERS['formula'])} THEN 'formula' END, CASE WHEN {_calls(routing.TRIGGERS['image'])} THEN 'image' END]) AS channel, unnest([1, 2, 3, 4, 5]) AS o
  FROM (SELECT item_id, text || CASE WHEN item_id % 3 = 0 THEN ' the Figure' WHEN item_id % 3 = 1 THEN ' Table, sigma' ELSE '' END AS text FROM benchmark))
SELECT item_id AS query_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY o) - 1 AS INTEGER) AS place, channel, CASE WHEN channel = 'table' THEN 8 ELSE 12 END AS top_k FROM c WHERE channel IS NOT NULL""")
def fus05_default_tasks(spark, sf_dir):
    """Questions, some with a word that calls for figures, tables or formulas."""
    tail = F.when(F.col("item_id") % 3 == 0, " the Figure").when(F.col("item_id") % 3 == 1, " Table, sigma").otherwise("")
    return routing.default_tasks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", tail).alias("text")))


@query("""WITH t AS (SELECT l_orderkey AS query_id, l_returnflag AS channel, l_partkey AS part, (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey AS place FROM lineitem)
SELECT query_id, channel, min(place) AS place, arg_min(part, place) AS part, CASE channel WHEN 'A' THEN 'table' WHEN 'N' THEN 'named' ELSE 'text' END AS vector FROM t GROUP BY query_id, channel""")
def fus04_first_task(spark, sf_dir):
    """Lines as tasks: of several for a channel the first runs, on the vector that its channel searches."""
    place = (F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")
    tasks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), place.cast("bigint").alias("place"), F.col("l_returnflag").alias("channel"), F.col("l_partkey").alias("part"))
    kind = F.when(F.col("channel") == "A", "table").when(F.col("channel") == "N", "image").otherwise("vector")
    return routing.first_of_channel(tasks).withColumn("vector", routing.vector_name(kind, F.when(F.col("channel") == "N", "named")))


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, list(length(text) ORDER BY chunk_index)[1:6] AS n FROM nodes GROUP BY doc_id) SELECT doc_id, greatest(1, CAST((doc_id % 50 + list_sum(n)) // 4 AS BIGINT)) AS tokens FROM t""")
def rte08_token_estimate(spark, sf_dir):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x.text)
    found = Corpus(spark, sf_dir).nodes.groupBy("doc_id").agg(texts.alias("texts"))
    return found.select("doc_id", routing.token_estimate(F.repeat(F.lit("x"), (F.col("doc_id") % 50).cast("int")), F.col("texts")).alias("tokens"))


@query(f"""WITH {CHUNKS.replace("nodes AS", "every AS")}, nodes AS (SELECT * FROM every WHERE chunk_index % 3 = 1), {POSTINGS}, {ASKED}, {_bm25()} SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 8""")
def lex06_table_topk(spark, sf_dir):
    """Every third chunk taken for a table: the table retriever has its own statistics."""
    c = Corpus(spark, sf_dir)
    nodes = c.nodes.withColumn("modality", F.when(F.col("chunk_index") % 3 == 1, "table").otherwise("text"))
    return lexical.table_search(nodes, c.questions)


# Gate and rerank


@query(f"""WITH {STAGED}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN flag = 'A' AND d >= 0.03 THEN 0 ELSE 1 END, d DESC, rank) AS place FROM s0),
k AS (SELECT *, flag = 'A' AND d >= 0.03 AND place <= 3 AS candidate FROM c)
SELECT query_id, node_id, candidate, CAST(least(greatest(8, 6 + count(*) FILTER (WHERE candidate) OVER (PARTITION BY query_id)), count(*) OVER (PARTITION BY query_id)) AS INTEGER) AS top_n FROM k""")
def rrk02_guardrail(spark, sf_dir):
    """Lines as hits; those of flag A share an anchor with the question."""
    hits = _staged(spark, sf_dir).where("stage = 'initial'").select("query_id", "node_id", "rank", (F.col("d") * 10).cast("double").alias("score"), (F.col("flag") == "A").alias("shares_anchor"))
    return rerank.guardrail(hits).select("query_id", "node_id", "candidate", "top_n")


@query(f"""WITH {STAGED}, m AS (SELECT DISTINCT query_id, rank, m FROM (SELECT query_id, rank, unnest([CASE flag WHEN 'A' THEN 'table' WHEN 'N' THEN 'image' ELSE 'text' END, CASE WHEN q > 40 THEN 'table' END, CASE WHEN q < 10 THEN 'image' END, CASE WHEN d > 0.08 THEN 'formula' END, CASE WHEN page < 3 OR status = 'O' THEN 'page' END]) AS m FROM s0) WHERE m IS NOT NULL)
SELECT query_id, m AS modality, count(*) AS n FROM m GROUP BY ALL""")
def agg04_modality_coverage(spark, sf_dir):
    hits = _staged(spark, sf_dir).where("stage = 'initial'")
    told = hits.select(
        "query_id", F.when(F.col("flag") == "A", "table").when(F.col("flag") == "N", "image").alias("modality"), F.when(F.col("q") > 40, "| a |").alias("table_markdown"), F.when(F.col("q") < 10, "a.png").alias("image_path"),
        F.when(F.col("d") > 0.08, "x").otherwise("").alias("formula_latex"), F.when(F.col("page") < 3, F.col("page")).alias("page"), F.when(F.col("status") == "O", "page").otherwise("bm25").alias("channel"),
    )
    return evidence.modality_coverage(told)


NORMAL = "CASE WHEN flag = 'A' THEN d::DOUBLE * 12 END AS rr, CASE WHEN status = 'F' THEN tax::DOUBLE * 5 END AS sv, CASE WHEN q > 20 THEN 0.02::DOUBLE * rank END AS rrf, CASE WHEN q > 10 THEN q::DOUBLE / 40 END AS sc"


@query(f"""WITH {STAGED}, x AS (SELECT query_id, node_id, rank, {NORMAL} FROM s0), y AS (SELECT *, coalesce(rrf, sv, sc, 0) AS raw FROM x)
SELECT query_id, node_id, round(least(1, greatest(0, coalesce(rr, sv, CASE WHEN rrf IS NULL THEN sc END, 1 / log2(rank + 1)))), 6) AS by_rank, round(least(1, greatest(0, raw)), 6) AS raw,
  round(CASE WHEN max(raw) OVER w <= min(raw) OVER w THEN 1.0::DOUBLE ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END, 6) AS by_range FROM y WINDOW w AS (PARTITION BY query_id)""")
def evd09_normal_scores(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    hits = _staged(spark, sf_dir).where("stage = 'initial'").select(
        "query_id", "node_id", "rank", F.when(F.col("flag") == "A", d("d") * 12).alias("rerank_score"), F.when(F.col("status") == "F", d("tax") * 5).alias("score_vector"),
        F.when(F.col("q") > 20, 0.02 * F.col("rank")).alias("score_rrf"), F.lit(None).cast("double").alias("score_bm25"), F.when(F.col("q") > 10, d("q") / 40).alias("score"),
    )
    for mode, name in (("rank", "by_rank"), ("raw", "raw"), ("minmax", "by_range")):
        hits = evidence.normal_scores(hits, mode).withColumn(name, F.round("normal", 6))
    return hits.select("query_id", "node_id", "by_rank", "raw", "by_range")


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, list_distinct(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'missing_page' END, CASE WHEN o_orderkey % 3 = 0 THEN 'low_support' END, CASE WHEN o_custkey % 4 = 0 THEN 'missing_modality:table' END, CASE WHEN o_custkey % 3 = 0 THEN 'low_support' END], lambda x: x IS NOT NULL)) AS r,
  greatest(o_orderkey % 10 / 10.0, least(1, o_custkey % 13 / 10.0))::DOUBLE AS s, ['none', 'weak', 'partial', 'strong'][CAST(greatest(o_orderkey % 4, o_custkey % 4) + 1 AS BIGINT)] AS l, ['none', 'low', 'medium', 'high'][CAST(greatest(o_orderkey % 3, o_custkey % 4) + 1 AS BIGINT)] AS f, o_orderkey % 2 = 0 OR o_custkey % 2 = 0 AS p FROM orders),
y AS (SELECT *, CASE WHEN list_has_any(r, ['missing_page', 'missing_modality:table']) THEN CASE WHEN f = 'high' THEN 'refuse' ELSE 'retry' END WHEN p THEN 'pass' ELSE 'retry' END AS d FROM x)
SELECT k AS query_id, round(s, 6) AS support_score, l AS support_level, f AS conflict_level, d AS decision, CASE WHEN d <> 'pass' AND len(r) = 0 THEN 'agent_or_rule_requires_retry' ELSE array_to_string(list_sort(r), ',') END AS reasons FROM y""")
def evd13_merge_critique(spark, sf_dir):
    """Orders as verdicts of the rules (by key) and of a critic (by customer)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    support, conflict = ("none", "weak", "partial", "strong"), ("none", "low", "medium", "high")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("query_id"), F.array_compact(F.array(F.when(k % 5 == 0, "missing_page"), F.when(k % 3 == 0, "low_support"))).alias("gate_reasons"), (k % 10 / 10).alias("support_score"), pick(support, k % 4).alias("support_level"),
        pick(conflict, k % 3).alias("conflict_level"), F.when(k % 2 == 0, "pass").otherwise("retry").alias("decision"), F.array_compact(F.array(F.when(c % 4 == 0, "missing_modality:table"), F.when(c % 3 == 0, "low_support"))).alias("c_gate_reasons"),
        (c % 13 / 10).alias("c_support_score"), pick(support, c % 4).alias("c_support_level"), pick(conflict, c % 4).alias("c_conflict_level"), F.when(c % 2 == 0, "pass").otherwise("retry").alias("c_decision"),
    )
    got = evidence.merged_with_critique(rows)
    return got.select("query_id", F.round("support_score", 6).alias("support_score"), "support_level", "conflict_level", "decision", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


# Grades and advice

GRADED = """g AS (SELECT query_id, node_id, rank, d::DOUBLE * 10 AS score, CASE WHEN q > 25 THEN tax::DOUBLE * 10 END AS rr, CASE flag WHEN 'A' THEN 'irrelevant' WHEN 'N' THEN CASE WHEN status = 'O' THEN 'strong' ELSE 'weak' END END AS label, tax::DOUBLE * 8 AS rel, q < 6 AS anchor, q > 48 AS flagged FROM s0)"""


def _graded(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    label = F.when(F.col("flag") == "A", "irrelevant").when(F.col("flag") == "N", F.when(F.col("status") == "O", "strong").otherwise("weak"))
    return _staged(spark, sf_dir).where("stage = 'initial'").select(
        "query_id", "node_id", "rank", (d("d") * 10).alias("score"), F.when(F.col("q") > 25, d("tax") * 10).alias("rerank_score"), label.alias("label"), (d("tax") * 8).alias("relevance"),
        (F.col("q") < 6).alias("shares_anchor"), (F.col("q") > 48).alias("flagged"),
    )


AFTER = "round(CASE WHEN label IS NULL THEN score ELSE least(1, greatest(0, score + CASE label WHEN 'irrelevant' THEN -0.2 WHEN 'weak' THEN -0.05 ELSE 0.1 END)) END, 6)"


@query(f"""WITH {STAGED}, {GRADED}, r AS (SELECT *, CASE WHEN label = 'irrelevant' AND least(1, rel) < 0.25 THEN 'label_and_score_threshold' END AS why FROM g)
SELECT query_id, node_id, {AFTER} AS score_after, why AS drop_reason, why IS NOT NULL AND NOT anchor AS dropped, CASE WHEN why IS NOT NULL AND anchor THEN 'query_anchor_overlap' END AS protected, CASE WHEN why IS NOT NULL AND NOT anchor THEN 'agent_irrelevant_label' END AS removed_reason FROM r""")
def grd02_apply_grades(spark, sf_dir):
    return grading.graded(_graded(spark, sf_dir)).select("query_id", "node_id", F.round("score_after", 6).alias("score_after"), "drop_reason", "dropped", "protected", "removed_reason")


@query(f"""WITH {STAGED}, {GRADED}, r AS (SELECT *, CASE WHEN label IS NULL THEN NULL WHEN flagged THEN 'agent_drop_flag' WHEN label = 'irrelevant' THEN 'label' WHEN least(1, rel) < 0.25 THEN 'score_threshold' END AS why FROM g),
p AS (SELECT *, CASE WHEN why IS NULL THEN NULL WHEN label <> 'irrelevant' AND score >= 0.55 THEN 'prior_score' WHEN label <> 'irrelevant' AND rr >= 0.7 THEN 'rerank_score' WHEN anchor THEN 'query_anchor_overlap' END AS guard FROM r)
SELECT query_id, node_id, why AS drop_reason, why IS NOT NULL AND guard IS NULL AS dropped, guard AS protected, CASE WHEN why IS NOT NULL AND guard IS NULL THEN CASE WHEN label = 'irrelevant' THEN 'agent_irrelevant_label' WHEN why = 'score_threshold' THEN 'agent_low_relevance_score' ELSE 'agent_chunk_drop' END END AS removed_reason FROM p""")
def flt10_drop_rules(spark, sf_dir):
    """The rules with any one reason enough to drop, and their protections."""
    got = grading.graded(_graded(spark, sf_dir), replace(DEFAULTS, drop_needs_both=False))
    return got.select("query_id", "node_id", "drop_reason", "dropped", "protected", "removed_reason")


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'table_first' ELSE 'text_first' END AS r, ['page_first', 'cross_doc', 'sideways'][CAST(o_custkey % 3 + 1 AS BIGINT)] AS ar, o_custkey % 10 / 10.0 AS conf, CASE WHEN o_custkey % 7 = 0 THEN 'sound' ELSE 'table' END AS am FROM orders),
e AS (SELECT *, concat_ws(',', CASE WHEN ar = 'sideways' THEN 'invalid_route' END, CASE WHEN conf < 0.55 THEN 'low_route_confidence' END, CASE WHEN am = 'sound' THEN 'invalid_modalities' END) AS errors FROM x)
SELECT k AS query_id, CASE WHEN errors = '' THEN ar ELSE r END AS route, CASE WHEN errors = '' THEN CASE WHEN k % 2 = 0 THEN 'text,table' ELSE 'table' END ELSE CASE WHEN k % 2 = 0 THEN 'text' ELSE '' END END AS modalities,
  k % 5 = 0 OR (errors = '' AND c % 2 = 0) AS cross_doc, errors = '' AND c % 4 = 1 AS page_level, errors, errors = '' AS used FROM e""")
def flt12a_route_merge(spark, sf_dir):
    """Orders as routes of the rules (by key) and of an agent (by customer)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("query_id"), F.when(k % 3 == 0, "table_first").otherwise("text_first").alias("route"), F.when(k % 2 == 0, F.array(F.lit("text"))).alias("modalities"), (k % 5 == 0).alias("cross_doc"), F.lit(None).cast("boolean").alias("page_level"),
        F.get(F.array(F.lit("page_first"), F.lit("cross_doc"), F.lit("sideways")), (c % 3).cast("int")).alias("a_route"), (c % 10 / 10).alias("a_confidence"), F.array(F.when(c % 7 == 0, "sound").otherwise("table")).alias("a_modalities"),
        (c % 2 == 0).alias("a_cross_doc"), (c % 4 == 1).alias("a_page_level"),
    )
    got = grading.merged_routes(rows)
    return got.withColumns({"modalities": F.array_join("modalities", ","), "errors": F.array_join("errors", ",")})


@query("""SELECT l_orderkey AS query_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, CASE WHEN l_returnflag = 'R' THEN 'invalid_channel' WHEN l_linestatus = 'F' AND l_partkey % 2 = 0 THEN 'invalid_filters' END AS error, CAST(greatest(1, least(32, CAST(l_quantity AS INTEGER) - 3)) AS INTEGER) AS top_k FROM lineitem""")
def flt12_plan_tasks(spark, sf_dir):
    key = F.when((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 2 == 0), "colour").otherwise("source")
    tasks = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.when(F.col("l_returnflag") == "R", "smell").otherwise("bm25").alias("channel"),
        (F.col("l_quantity").cast("int") - 3).alias("top_k"), F.create_map(key, F.lit("x")).alias("filters"),
    )
    return grading.valid_tasks(tasks).drop("channel", "filters")


@query(f"""WITH {STAGED}, r AS (SELECT query_id, CASE WHEN q > 45 THEN 'agent_chunk_drop' WHEN d < 0.02 THEN 'score_threshold_failed' WHEN flag = 'A' THEN 'context_top_n_limit' WHEN flag = 'N' THEN 'citation_not_selected' ELSE 'unknown_removed' END AS reason, status = 'O' AS inferred FROM s0)
SELECT query_id, count(*) AS removed, count(*) FILTER (WHERE reason = 'agent_chunk_drop') AS agent, count(*) FILTER (WHERE reason = 'score_threshold_failed') AS threshold, count(*) FILTER (WHERE reason = 'context_top_n_limit') AS topk, count(*) FILTER (WHERE inferred) AS inferred FROM r GROUP BY query_id""")
def agg16_removed_summary(spark, sf_dir):
    reason = F.when(F.col("q") > 45, "agent_chunk_drop").when(F.col("d") < 0.02, "score_threshold_failed").when(F.col("flag") == "A", "context_top_n_limit").when(F.col("flag") == "N", "citation_not_selected").otherwise("unknown_removed")
    hits = _staged(spark, sf_dir).where("stage = 'initial'")
    return grading.removed_summary(hits.select("query_id", reason.alias("reason"), (F.col("status") == "O").alias("inferred")))


@query(f"""WITH {STAGED}, x AS (SELECT query_id, list(d::DOUBLE * 12 - 0.1) AS v FROM s0 GROUP BY query_id), g AS (SELECT query_id, list_filter(v, lambda z: z > 0) AS v FROM x)
SELECT query_id, round(CASE WHEN len(v) = 0 THEN 0.0::DOUBLE WHEN len(v) = 1 THEN least(1, v[1]) ELSE greatest(0, 1 - least(1, list_max(v) - list_min(v))) END, 6) AS score_consistency FROM g""")
def agg08_span_consistency(spark, sf_dir):
    scores = _staged(spark, sf_dir).where("stage = 'initial'").groupBy("query_id").agg(F.collect_list(F.col("d").cast("double") * 12 - 0.1).alias("v"))
    return scores.select("query_id", F.round(grading.span_consistency(F.col("v")), 6).alias("score_consistency"))


@query(f"""{BASE}, f AS (SELECT query_id, node_id, round(score_composite * 0.7071067811865476::DOUBLE, 6) AS sc, rank FROM composite), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, rank, node_id) AS r FROM f)
SELECT query_id, node_id, sc AS score_composite, CAST(r AS INTEGER) AS rank, sc >= 0.2 AS passed, CASE WHEN sc < 0.2 THEN CAST(r AS INTEGER) END AS removed_rank FROM o""")
def fin01_final_hits(spark, sf_dir):
    """The final stage keeps the composites it is given, here the side of a square for its diagonal, so that no product is a tie in rounding."""
    hits = Corpus(spark, sf_dir).scored().withColumn("score_composite", F.col("score_composite") * 0.7071067811865476)
    return grading.final_hits(hits).select("query_id", "node_id", "score_composite", "rank", "passed", "removed_rank")


# Context of tables and formulas among the hits

_AROUND = """kinds AS (SELECT *, CASE chunk_index % 4 WHEN 2 THEN 'table' WHEN 3 THEN 'formula' ELSE 'text' END AS modality FROM nodes),
near AS (SELECT a.node_id, max(CASE WHEN b.chunk_index < a.chunk_index THEN b.chunk_index END) AS before, min(CASE WHEN b.chunk_index > a.chunk_index THEN b.chunk_index END) AS after, any_value(a.doc_id) AS doc_id
  FROM kinds a JOIN kinds b ON a.doc_id = b.doc_id AND b.modality = 'text' WHERE a.modality <> 'text' GROUP BY a.node_id),
hits AS (SELECT query_id, node_id, rank, score_composite AS score, doc_id, modality, CASE WHEN rank % 7 <> 0 THEN ['irrelevant', 'strong', 'weak', 'relevant'][CAST(rank % 4 + 1 AS BIGINT)] END AS label FROM composite JOIN kinds USING (node_id))"""


@query(f"""{BASE}, {_AROUND}
SELECT query_id, h.node_id, k.node_id AS context_id, CAST(row_number() OVER (PARTITION BY query_id, h.node_id ORDER BY CASE k.chunk_index WHEN before THEN 0 WHEN after THEN 1 ELSE 2 END, k.chunk_index) AS INTEGER) AS place
FROM hits h JOIN near n ON n.node_id = h.node_id JOIN nodes a ON a.node_id = h.node_id JOIN kinds k ON k.doc_id = h.doc_id AND k.modality = 'text' AND (k.chunk_index IN (before, after) OR k.page = a.page)""")
def join06_context_hits(spark, sf_dir):
    return _contexts(spark, sf_dir)[1]


@query(f"""{BASE}, {_AROUND},
f AS (SELECT query_id, h.node_id, h.rank, h.label, k.node_id AS context_id, EXISTS (SELECT 1 FROM hits x WHERE x.query_id = h.query_id AND x.node_id = k.node_id) AS there
  FROM hits h JOIN near n USING (node_id) JOIN kinds k ON k.doc_id = h.doc_id AND k.chunk_index = coalesce(before, after) WHERE h.label IS NOT NULL),
a AS (SELECT *, min(CASE WHEN NOT there AND label = 'strong' THEN rank END) OVER (PARTITION BY query_id, context_id) AS adder FROM f),
c AS (SELECT *, CASE WHEN there OR adder < rank THEN 'present' WHEN adder = rank THEN 'added' ELSE 'missing' END AS context FROM a),
gift AS (SELECT query_id, context_id AS node_id, sum(CASE label WHEN 'strong' THEN 0.06 WHEN 'relevant' THEN 0.02 ELSE 0 END) AS by_ FROM c WHERE context = 'present' GROUP BY ALL),
own AS (SELECT query_id, node_id, context_id, context, CASE context WHEN 'present' THEN CASE label WHEN 'irrelevant' THEN -0.1 WHEN 'weak' THEN -0.03 WHEN 'relevant' THEN 0.03 ELSE 0.08 END WHEN 'added' THEN 0.08 ELSE 0 END AS by_ FROM c)
SELECT query_id, node_id, CAST(h.rank AS INTEGER) AS rank, round(least(1, greatest(0, score + coalesce(o.by_, 0)) + coalesce(g.by_, 0)), 6) AS score_after, context_id, context, FALSE AS is_added FROM hits h LEFT JOIN own o USING (query_id, node_id) LEFT JOIN gift g USING (query_id, node_id)
UNION ALL SELECT c.query_id, c.context_id, CAST((SELECT max(rank) FROM hits h WHERE h.query_id = c.query_id) + row_number() OVER (PARTITION BY c.query_id ORDER BY c.rank) AS INTEGER), round(least(1, 0.7 + coalesce(g.by_, 0)), 6), NULL, NULL, TRUE FROM c LEFT JOIN gift g ON g.query_id = c.query_id AND g.node_id = c.context_id WHERE context = 'added'""")
def join07_related_context(spark, sf_dir):
    hits, contexts = _contexts(spark, sf_dir)
    return context.related_context(hits, contexts).withColumn("score_after", F.round("score_after", 6))


def _contexts(spark, sf_dir):
    """The best hits, every fourth chunk a table and the next a formula, with labels by rank; the documents' texts are the pool."""
    c = Corpus(spark, sf_dir)
    nodes = c.nodes.select("node_id", "doc_id", "page", "chunk_index", F.when(F.col("chunk_index") % 4 == 2, "table").when(F.col("chunk_index") % 4 == 3, "formula").otherwise("text").alias("modality"))
    label = F.when(F.col("rank") % 7 != 0, F.get(F.array(*map(F.lit, ("irrelevant", "strong", "weak", "relevant"))), (F.col("rank") % 4).cast("int")))
    hits = c.kept(lexical.small(c.scored().select("query_id", "node_id", F.col("rank").cast("int").alias("rank"), F.col("score_composite").alias("score"), label.alias("label"))).join(nodes, "node_id"))
    docs = hits.select("query_id", "doc_id").distinct()
    near = c.kept(nodes.join(lexical.small(docs.select("doc_id").distinct()), "doc_id", "left_semi"))
    around = linking.nearest_text(near)
    single = around.select(F.col("node_id").alias("src_id"), F.explode(F.map_from_arrays(F.array(F.lit("context_prev_node_id"), F.lit("context_next_node_id")), F.array("context_prev_node_id", "context_next_node_id"))).alias("relation", "dst_id"))
    pages = linking.same_page_edges(near).join(near.select(F.col("node_id").alias("dst_id"), F.col("chunk_index").alias("pos")), "dst_id")
    edges = single.where("dst_id is not null").withColumn("pos", F.lit(0)).unionByName(pages.select("src_id", "relation", "dst_id", "pos"))
    return hits, context.context_hits(hits, edges, near.join(docs, "doc_id").select("query_id", "node_id", "modality"))


# Retry plans: each turn of a conversation as a question that failed for reasons of its number

_FAILED = """turns AS (SELECT conv_id || ':' || turn AS query_id, conv_id * 7 + turn AS n FROM conversations WHERE text IS NOT NULL),
r AS (SELECT query_id, n, n % 9 = 0 AS cross_doc, n % 10 <> 0 AS citation_ok, n % 11 / 10.0 AS best, n % 3 = 0 AS keyword, n % 7 = 0 AS hits, n % 4 = 0 AS numeric, n % 5 = 0 AS page, n % 6 = 0 AS tables, n % 8 = 0 AS conflict, n % 100 < 45 AS weak FROM turns),
ops AS (SELECT query_id, unnest([CASE WHEN keyword THEN {'o': 1, 'channel': 'bm25', 'k': 18} END, CASE WHEN hits THEN {'o': 2, 'channel': 'bm25', 'k': 18} END, CASE WHEN hits THEN {'o': 3, 'channel': 'page', 'k': 8} END, CASE WHEN numeric THEN {'o': 4, 'channel': 'table', 'k': 8} END,
  CASE WHEN numeric THEN {'o': 5, 'channel': 'bm25', 'k': 18} END, CASE WHEN page THEN {'o': 6, 'channel': 'page', 'k': 8} END, CASE WHEN tables THEN {'o': 7, 'channel': 'table', 'k': 8} END, CASE WHEN conflict OR cross_doc THEN {'o': 8, 'channel': 'relationship', 'k': 12} END,
  CASE WHEN (weak OR hits OR NOT citation_ok) AND best >= 0.55 THEN {'o': 9, 'channel': 'relationship', 'k': 12} END]) AS op FROM r),
had AS (SELECT query_id, unnest([{'o': -3, 'channel': 'vector', 'k': 12}, CASE WHEN n % 2 = 0 THEN {'o': -2, 'channel': 'bm25', 'k': CASE WHEN n % 12 = 0 THEN 30 ELSE 8 END} END, CASE WHEN n % 5 < 2 THEN {'o': -1, 'channel': 'table', 'k': 5} END]) AS op FROM r),
grown AS (SELECT query_id, (hits OR weak OR NOT citation_ok) AS g FROM r)"""


@query(f"""WITH {_FAILED},
base AS (SELECT query_id, op.o AS o, op.channel AS channel, CASE WHEN g THEN greatest(op.k, least(32, greatest(op.k + 1, CAST(ceil(op.k * 1.5) AS INTEGER)))) ELSE op.k END AS k FROM had JOIN grown USING (query_id) WHERE op IS NOT NULL
  UNION ALL SELECT query_id, op.o, op.channel, op.k FROM ops WHERE op IS NOT NULL),
tasks AS (SELECT query_id, channel, min(o) AS o, max(k) AS top_k FROM base GROUP BY ALL),
step AS (SELECT query_id, 1 + CASE WHEN page THEN 1 ELSE 0 END + CASE WHEN conflict OR cross_doc THEN 1 ELSE 0 END + CASE WHEN (weak OR hits OR NOT citation_ok) AND best >= 0.55 THEN 1 ELSE 0 END AS w FROM r)
SELECT query_id, channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INTEGER) AS place, CAST(top_k AS INTEGER) AS top_k, CASE WHEN w > 1 THEN CAST(least(3, w) AS INTEGER) END AS page_window FROM tasks JOIN step USING (query_id)""")
def rte03_retry_plan(spark, sf_dir):
    plans = retry.plan_retry(_failed(spark, sf_dir))
    return plans.select("query_id", "page_window", F.posexplode("tasks").alias("place", "t")).select("query_id", "t.channel", "place", "t.top_k", "page_window")


@query(f"""WITH {_FAILED},
advice AS (SELECT query_id, n, ['page', 'bogus', 'bm25'][1:n % 4] AS add_, ['vector', 'image', 'odd'][1:n % 3 + 1] AS more, CASE WHEN n % 6 = 1 THEN 7 WHEN n % 6 = 2 THEN 0 END AS w, n % 13 = 0 AS wrong FROM r),
base AS (SELECT query_id, op.o AS o, op.channel AS channel, op.k AS k FROM had WHERE op IS NOT NULL
  UNION ALL SELECT query_id, i, add_[i], CASE WHEN add_[i] = 'page' THEN 8 ELSE 12 END FROM (SELECT query_id, add_, unnest(range(1, len(add_) + 1)) AS i FROM advice WHERE NOT wrong) WHERE add_[i] <> 'bogus'),
tasks AS (SELECT query_id, channel, min(o) AS o, max(k) AS k FROM base GROUP BY ALL)
SELECT query_id, channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INTEGER) AS place, CAST(CASE WHEN NOT wrong AND list_contains(more, channel) THEN greatest(k + 1, k * 3 // 2) ELSE k END AS INTEGER) AS top_k,
  CASE WHEN wrong THEN NULL WHEN w = 7 THEN 3 WHEN w = 0 THEN 1 END AS page_window, CASE WHEN wrong THEN 'invalid_filters:colour' ELSE array_to_string(list_transform(list_filter(add_, lambda c: c = 'bogus'), lambda c: 'invalid_channel:' || c) || list_transform(list_filter(more, lambda c: c = 'odd'), lambda c: 'invalid_top_k_channel:' || c), ',') END AS errors, NOT wrong AS used
FROM tasks JOIN advice USING (query_id)""")
def flt12b_retry_advice(spark, sf_dir):
    """Plans of the same turns with an adviser's changes, some of them not allowed."""
    n, strings = F.col("n"), lambda *names: F.array(*map(F.lit, names))
    advised = _failed(spark, sf_dir).withColumns({
        "query_text": F.col("question"), "a_query_text": F.lit("again"), "a_add": F.slice(strings("page", "bogus", "bm25"), F.lit(1), (n % 4).cast("int")), "a_increase": F.slice(strings("vector", "image", "odd"), F.lit(1), (n % 3 + 1).cast("int")),
        "a_page_window": F.when(n % 6 == 1, 7).when(n % 6 == 2, 0), "a_filters": F.when(n % 13 == 0, F.create_map(F.lit("colour"), F.lit("red"))).otherwise(F.create_map(F.lit("source"), F.lit("src1"))), "page_window": F.lit(None).cast("int"),
    })
    got = retry.merged_advice(advised)
    return got.select("query_id", "page_window", F.array_join("errors", ",").alias("errors"), "used", F.posexplode("tasks").alias("place", "t")).select("query_id", "t.channel", "place", "t.top_k", "page_window", "errors", "used")


def _failed(spark, sf_dir):
    n = F.col("n")
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), (F.col("conv_id") * 7 + F.col("turn")).alias("n"), F.col("text").alias("question"))
    empty = F.expr(retry.NONE)
    task = lambda channel, k: F.struct(F.lit(channel).alias("channel"), F.lit("q").alias("query_text"), (k if not isinstance(k, int) else F.lit(k)).alias("top_k"), empty.alias("filters"), empty.alias("metadata"))
    had = F.array_compact(F.array(task("vector", 12), F.when(n % 2 == 0, task("bm25", F.when(n % 12 == 0, 30).otherwise(8))), F.when(n % 5 < 2, task("table", 5))))
    slots = {"missing_keyword": n % 3 == 0, "hits": n % 7 == 0, "insufficient_hits": n % 7 == 0, "missing_numeric": n % 4 == 0, "page": n % 5 == 0, "missing_modality:table": n % 6 == 0}
    missing = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in slots.items()]))
    level, support = F.when(n % 8 == 0, "high").otherwise("none"), (n % 100) / 100
    reasons = routing.retry_reasons([missing], level, n % 9 == 0, n % 10 != 0, support)
    none = F.array().cast("array<string>")
    return turns.select(
        "query_id", "n", "question", had.alias("tasks"), F.lit(None).cast("int").alias("page_window"), empty.alias("filters"), missing.alias("missing_slots"), reasons.alias("reasons"), level.alias("conflict_level"),
        none.alias("conflict_reasons"), (n % 9 == 0).alias("cross_doc"), (n % 10 != 0).alias("citation_ok"), (n % 11 / 10).alias("best_score"), F.lit(0).alias("retry_count"),
    )


# Answers


@query(r"""WITH a AS (SELECT c.conv_id, string_agg(c.text, ' ' ORDER BY turn) AS answer FROM conversations c GROUP BY conv_id),
k AS (SELECT a.conv_id, answer, list_filter(string_split(b.text, ' ')[1:6], lambda w: trim(w) <> '') AS words, b.text AS reference FROM a JOIN benchmark b ON b.item_id = a.conv_id)
SELECT conv_id AS case_id, CAST(length(answer) AS INTEGER) AS answer_chars, CAST(CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 2 END AS INTEGER) AS citation_count, CASE WHEN conv_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_citation,
  CASE WHEN regexp_replace(lower(CASE WHEN conv_id % 2 = 0 THEN reference || '!' ELSE answer END), '[^\p{L}\p{N}_]+', '', 'g') = regexp_replace(lower(reference), '[^\p{L}\p{N}_]+', '', 'g') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match,
  CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda w: contains(regexp_replace(lower(CASE WHEN conv_id % 2 = 0 THEN reference || '!' ELSE answer END), '[^\p{L}\p{N}_]+', '', 'g'), regexp_replace(lower(w), '[^\p{L}\p{N}_]+', '', 'g'))))::DOUBLE / len(words), 6) END AS keyword_recall,
  CASE WHEN conv_id % 3 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS expected_source_recall FROM (SELECT conv_id, words, reference, CASE WHEN conv_id % 2 = 0 THEN reference || '!' ELSE answer END AS answer FROM k)""")
def met13_answer_metrics(spark, sf_dir):
    """Conversations as answers to the benchmark item of their number; every second answers with the item itself."""
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    talk = talk.select(F.col("conv_id").alias("item_id"), F.array_join(F.transform("t", lambda x: x.text), " ").alias("answer"))
    k = F.col("item_id")
    cases = talk.join(table(spark, sf_dir, "benchmark"), "item_id").select(
        k.alias("case_id"), F.when(k % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("answer")).alias("prediction"), F.col("text").alias("reference"), F.slice(F.split("text", " "), 1, 6).alias("keywords"),
        F.when(k % 3 > 0, F.array(F.lit("Report A.pdf"), F.lit(""))).alias("citations"), F.array(F.lit("report_a"), F.lit("report a"), F.lit(" ")).alias("sources"),
    )
    return evaluation.answer_metrics(cases)


@query("""SELECT p_partkey AS case_id, least(1, greatest(0, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size / 40.0 END))::DOUBLE AS ai_correctness, 0.5::DOUBLE AS ai_completeness, CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ai_relevance,
  CASE WHEN p_size % 5 = 0 THEN 0.25::DOUBLE ELSE round(0.5 * least(1, greatest(0, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size / 40.0 END))::DOUBLE + 0.15 + CASE WHEN p_size > 25 THEN 0.2 ELSE 0 END, 6) END AS ai_overall FROM part""")
def met14_judge_scores(spark, sf_dir):
    """Parts as a judge's answers: some without a correctness, some with an overall score of their own."""
    n = F.col("p_size")
    fields = [F.when(n % 7 != 0, F.concat(F.lit('"correctness": '), (n / 40.0).cast("string"))), F.lit('"completeness": 0.5'), F.concat(F.lit('"relevance": '), F.when(n > 25, "7").otherwise("-1")), F.when(n % 5 == 0, '"overall": 0.25')]
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.concat(F.lit("Well:\n{"), F.concat_ws(", ", *fields), F.lit("} so.")).alias("answer"))
    return evaluation.judge_scores(raw).drop("ai_score_100")


@query("""SELECT o_orderkey AS case_id, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 AND NOT (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'low')) THEN 'missing_any_expected_answer_keyword' END,
  CASE WHEN o_orderkey % 2 = 1 AND NOT (contains(lower(o_orderpriority), 'urgent') AND contains(lower(o_orderpriority), 'low')) THEN 'missing_expected_answer_keywords' END, CASE WHEN contains(lower(o_orderpriority), 'medium') THEN 'forbidden_answer_keywords' END,
  CASE WHEN o_orderstatus <> 'O' THEN 'missing_citation_sources' END, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'route_mismatch' END, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0 THEN 'gate_decision_mismatch' END,
  CASE WHEN o_orderkey % 6 = 1 AND o_orderkey % 4 <> 0 THEN 'refusal_expected_but_not_observed' END, CASE WHEN o_orderkey % 6 = 2 AND o_orderkey % 4 = 0 THEN 'refusal_not_expected_but_observed' END,
  CASE WHEN o_custkey % 100 < 40 THEN 'support_score_too_low' END, CASE WHEN o_orderkey % 4 > 2 THEN 'retry_count_too_high' END) AS failures FROM orders""")
def met15_assertions(spark, sf_dir):
    k, s, text = F.col("o_orderkey"), F.col("o_orderstatus"), lambda *x: F.array(*[F.lit(v) for v in x])
    rows = table(spark, sf_dir, "orders").select(
        k.alias("case_id"), F.col("o_orderpriority").alias("answer"), text("Urgent", "LOW", "").alias("expected_keywords"), F.when(k % 2 == 0, "any").otherwise("all").alias("keywords_mode"), text("medium").alias("forbidden_keywords"),
        F.array(s).alias("citations"), text("O").alias("expected_sources"), s.alias("route"), F.when(k % 3 == 0, "F").alias("expected_route"), F.when(k % 4 == 0, "refuse").otherwise("pass").alias("gate_decision"),
        F.when(k % 5 == 0, "refuse").alias("expected_gate"), (F.col("o_custkey") % 100 / 100).alias("support_score"), F.lit(0.4).alias("min_support_score"), (k % 4).alias("retry_count"), F.lit(2).alias("max_retry_count"),
        F.lit(None).cast("boolean").alias("refusal"), F.when(k % 6 == 1, True).when(k % 6 == 2, False).alias("should_refuse"), F.lit(None).cast("string").alias("uncertain_text"),
    )
    return evaluation.assertions(rows).select("case_id", F.array_join("failures", ",").alias("failures"))


# Relations, projections and tables in text

FAMILY = "CASE WHEN r LIKE 'related%' THEN 'related' WHEN r LIKE 'context%' OR r IN ('prev_id', 'next_id') THEN 'context' WHEN r IN ('same_page_node_ids', 'page_window') THEN 'page' ELSE 'structure' END"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['parent_id', 'prev_id', 'next_id', 'context_prev_node_id', 'context_next_node_id', 'doc_prev_node_id', 'doc_next_node_id', 'child_ids', 'context_node_ids', 'same_page_node_ids', 'related_table_node_ids', 'related_formula_node_ids', 'related_image_node_ids', 'page_window'][CAST(l_partkey % 14 + 1 AS BIGINT)] AS r, CASE l_returnflag WHEN 'A' THEN 'auto' WHEN 'N' THEN 'routed' ELSE 'retry' END AS mode, CASE WHEN l_linestatus = 'O' THEN 'possible_conflict' ELSE 'weak' END AS reason,
  l_discount::DOUBLE * 10 AS seed, CASE WHEN l_linenumber % 2 = 0 THEN l_tax::DOUBLE * 10 END AS own FROM lineitem), f AS (SELECT *, {FAMILY} AS family FROM x),
w AS (SELECT *, CASE WHEN r = 'related_table_node_ids' THEN 0.9 WHEN r = 'related_formula_node_ids' THEN 0.85 WHEN r = 'related_image_node_ids' THEN 0.8 WHEN r LIKE 'context%' OR r IN ('parent_id', 'child_ids') THEN 0.6 WHEN r IN ('prev_id', 'next_id') OR r LIKE 'doc%' THEN 0.5 ELSE 0.3 END::DOUBLE AS weight FROM f)
SELECT l_orderkey AS query_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, CAST(CASE WHEN family = 'related' THEN 100 WHEN r LIKE 'context%' THEN 80 WHEN family = 'context' THEN 60 WHEN r = 'same_page_node_ids' THEN 40 WHEN family = 'structure' THEN 30 ELSE 20 END AS INTEGER) AS priority, weight,
  CASE mode WHEN 'auto' THEN family IN ('related', 'context') WHEN 'retry' THEN family IN ('context', 'page') OR (family = 'structure' AND reason = 'possible_conflict') ELSE true END AS allowed,
  CASE WHEN family = 'related' THEN 'related_modality' WHEN family IN ('page', 'structure') AND mode <> 'auto' THEN mode WHEN family = 'context' THEN 'context' ELSE 'relationship' END AS pool,
  CASE WHEN family = 'related' THEN 0.3 WHEN family = 'context' THEN 0.45 WHEN mode <> 'auto' THEN 0.55 END::DOUBLE AS threshold, round(greatest(least(1, seed * weight), coalesce(0.2 * own + 0.8 * least(1, seed * weight), 0)), 6) AS inherited FROM w""")
def flt09_relation_rules(spark, sf_dir):
    """Lines as edges in a mode: admission, pool, threshold, weight, priority and inherited score."""
    names = F.array(*[F.lit(x) for x in linking.RELATIONS])
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.get(names, (F.col("l_partkey") % 14).cast("int")).alias("r"),
        F.when(F.col("l_returnflag") == "A", "auto").when(F.col("l_returnflag") == "N", "routed").otherwise("retry").alias("mode"), F.when(F.col("l_linestatus") == "O", "possible_conflict").otherwise("weak").alias("reason"),
        (F.col("l_discount").cast("double") * 10).alias("seed"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("double") * 10).alias("own"),
    )
    r, m = F.col("r"), F.col("mode")
    return lines.select(
        "query_id", "line", "part", "supplier", linking.relation_priority(r).alias("priority"), linking.relation_weight(r).alias("weight"), linking.allowed_in_mode(r, m, F.col("reason")).alias("allowed"),
        linking.candidate_pool(r, m).alias("pool"), linking.seed_threshold(r, m).alias("threshold"), F.round(linking.inherited_score(F.col("seed"), r, F.col("own")), 6).alias("inherited"),
    )


PARTS = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'formula' WHEN 2 THEN 'image' ELSE 'text' END AS m, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 7 <> 0 THEN p_name END AS t, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS tm, CASE WHEN p_partkey % 2 = 0 THEN 'f(' || p_brand || ')' END AS fl, CASE WHEN p_partkey % 4 <> 0 THEN 'a/b/' || p_type END AS ip, p_brand AS source FROM part"


def _part_nodes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("node_id"), F.when(F.col("p_size") % 4 == 0, "table").when(F.col("p_size") % 4 == 1, "formula").when(F.col("p_size") % 4 == 2, "image").otherwise("text").alias("modality"),
        F.when(k % 3 == 0, "").when(k % 7 != 0, F.col("p_name")).alias("text"), F.when(k % 5 != 0, F.col("p_type")).alias("table_markdown"), F.when(k % 2 == 0, F.concat(F.lit("f("), F.col("p_brand"), F.lit(")"))).alias("formula_latex"),
        F.when(k % 4 != 0, F.concat(F.lit("a/b/"), F.col("p_type"))).alias("image_path"), F.col("p_brand").alias("source"),
    )


@query(f"""WITH p AS ({PARTS}) SELECT p_partkey AS node_id, coalesce(CASE m WHEN 'table' THEN tm WHEN 'formula' THEN fl END, t, '') AS index_text,
  CASE WHEN m = 'image' THEN coalesce(nullif(t, ''), 'Image file: ' || split_part(coalesce(ip, source), '/', -1)) ELSE coalesce(CASE m WHEN 'table' THEN tm WHEN 'formula' THEN fl END, t, '') END AS embedding_text,
  trim(concat_ws(chr(10), nullif(t, ''), tm, fl)) AS rerank_text, concat_ws(' ', coalesce(t, ''), fl, tm, source) AS evidence_text FROM p""")
def prj04_node_texts(spark, sf_dir):
    """Parts as nodes: the texts that go to the index, the embedding, the reranker and the gate (PRJ-03, 04, 11, 12)."""
    m, t, tm, fl = (F.col(c) for c in ("modality", "text", "table_markdown", "formula_latex"))
    return _part_nodes(spark, sf_dir).select(
        "node_id", projections.index_text(m, t, tm, fl).alias("index_text"), projections.embedding_text(m, t, tm, fl, F.col("image_path"), F.col("source")).alias("embedding_text"),
        projections.rerank_text("text", "table_markdown", "formula_latex").alias("rerank_text"), projections.evidence_text("text", "formula_latex", "table_markdown", "source").alias("evidence_text"),
    )


@query("SELECT vec_id, round(list_sum((embedding::DOUBLE[])[1:8]), 6) AS head, 8 AS n FROM embeddings")
def prj07_vector_size(spark, sf_dir):
    cut = table(spark, sf_dir, "embeddings").select("vec_id", projections.sized(F.col("embedding"), 8).alias("v"))
    return cut.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("head"), F.size("v").alias("n"))


KINDS = ["Figure_Caption", "table_footnote", "page_header", "inline_equation", "chart", "html_table", "sub_title", "image_body", "list", "", "TABLE ", "figure_group"]
FILES = ["x/content_list_v2.json", "a_Content_List.json", "pdf_info.json", "b\\Layout.json", "block_list.json", "middle.json", "readme.md", "my_model.json"]
SAYS = ["图表", " Chart", "网页截图", "PHOTO", "drawing", "document"]


@query(f"""WITH e AS (SELECT event_id, {KINDS!r}[CAST(event_id % 12 + 1 AS BIGINT)] AS k, {FILES!r}[CAST(event_id % 8 + 1 AS BIGINT)] AS f, {SAYS!r}[CAST(event_id % 6 + 1 AS BIGINT)] AS s, 'p. ' || event_id % 40 AS p FROM events), l AS (SELECT *, trim(lower(k)) AS r, lower(replace(f, chr(92), '/')) AS n FROM e)
SELECT event_id, CASE WHEN r = '' THEN 'text' WHEN r IN ('image_caption', 'figure_caption', 'chart_caption', 'image_footnote', 'chart_footnote') THEN 'image_caption' WHEN r IN ('table_caption', 'table_footnote') THEN 'text' WHEN r LIKE 'page!_%' ESCAPE '!' THEN 'page_marker' WHEN contains(r, 'equation') THEN 'formula'
  WHEN r = 'chart' THEN 'image_semantic' WHEN r IN ('table', 'html_table') THEN 'table' WHEN contains(r, 'title') THEN 'heading' WHEN contains(r, 'image') OR contains(r, 'figure') THEN 'image' ELSE 'text' END AS block_type,
  CASE WHEN contains(n, 'content_list_v2') THEN 'content_list_v2' WHEN contains(n, 'content_list') THEN 'content_list' WHEN contains(n, 'pdf_info') THEN 'pdf_info' WHEN contains(n, 'layout') THEN 'layout' WHEN contains(n, 'block_list') THEN 'block_list' WHEN contains(n, 'middle') OR contains(n, 'model') THEN 'model' END AS source_kind,
  CASE trim(lower(s)) WHEN '图表' THEN 'chart' WHEN 'chart' THEN 'chart' WHEN '网页截图' THEN 'screenshot' WHEN 'photo' THEN 'photo' WHEN 'document' THEN 'document' ELSE 'unknown' END AS scene, CAST(event_id % 40 + 1 AS INTEGER) AS page FROM l""".replace("b\\\\Layout", "b\\Layout"))
def sup13_block_kinds(spark, sf_dir):
    """Events as blocks: kind, kind of file, scene and page (SUP-13, 16, 48, FN-12)."""
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values)).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", projections.block_type(pick(KINDS)).alias("block_type"), projections.source_kind(pick(FILES)).alias("source_kind"), projections.scene_type(pick(SAYS)).alias("scene"),
        projections.page_of(F.concat(F.lit("p. "), (F.col("event_id") % 40).cast("string")), zero_based=True).alias("page"),
    )


HEADS = ["FFD8FFE000104A46494600", "89504E470D0A1A0A0000", "524946460000000057454250", "5249464600000000574156452020", "424D36", "49492A0008", "0000001866747970686569630000", "00000018667479706D7034320000", "25504446"]


@query(f"SELECT event_id, ['image/jpeg', 'image/png', 'image/webp', NULL, 'image/bmp', 'image/tiff', 'image/heic', NULL, NULL][CAST(event_id % 9 + 1 AS BIGINT)] AS mime FROM events")
def sup49_image_mime(spark, sf_dir):
    head = F.get(F.array(*[F.lit(h) for h in HEADS]), (F.col("event_id") % 9).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", projections.image_mime(F.unhex(head)).alias("mime"))


@query("SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::DOUBLE + (o_custkey % 10) / 10 AS relevant, CASE WHEN o_orderkey % 2 = 0 THEN -0.5 END::DOUBLE AS weak, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END - CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS n FROM orders")
def fn17_label_map(spark, sf_dir):
    """Label maps in text: a label twice, a label without a number, one without a name."""
    k = F.col("o_orderkey")
    number = F.format_string("%.1f", F.when(k % 3 == 0, 2.0).otherwise(1.0) + (F.col("o_custkey") % 10) / 10)
    text = F.concat_ws(",", F.lit(" relevant: 9"), F.lit("none"), F.lit(":4"), F.when(k % 2 == 0, "weak:-0.5"), F.lit("bad:x"), F.concat(F.lit("relevant :"), number), F.when(k % 3 == 0, "c:1"))
    got = table(spark, sf_dir, "orders").select(k.alias("query_id"), projections.label_map(text).alias("m"))
    return got.select("query_id", F.col("m")["relevant"].alias("relevant"), F.col("m")["weak"].alias("weak"), F.size("m").alias("n"))


def _texts_with_tables(spark, sf_dir):
    """Each brand's table between lines of prose, lines with a pipe that make no table, and an HTML table."""
    html = F.concat(F.lit("<TABLE x><tr><th>a|b</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td></tr></TABLE>"))
    tables = _brand_tables(spark, sf_dir)
    return tables.select("p_brand", F.concat(F.lit("Some é words\nno | table\n\n"), F.col("markdown"), F.lit("\n\nthen "), html, F.lit(" and\nend")).alias("text"))


@query("""WITH r AS (SELECT p_brand, '| key | name | type |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' |', chr(10) ORDER BY p_partkey) AS md FROM part GROUP BY p_brand),
b AS (SELECT p_brand, md, length(md) AS n, 'then <TABLE x><tr><th>a|b</th></tr><tr><td>' || p_brand || '</td></tr></TABLE> and' AS h FROM r)
SELECT p_brand, CAST(0 AS INTEGER) AS part, 'markdown' AS kind, 25 AS "start", 25 + n + 1 AS "end", md AS markdown, 'Some é words' || chr(10) || 'no | table' || chr(10) || chr(10) || chr(10) || chr(10) || 'then ' || chr(10) || ' and' || chr(10) || 'end' AS rest FROM b
UNION ALL SELECT p_brand, 1, 'html', 25 + n + 7, 25 + n + 7 + length(h) - 9, '| a|b |' || chr(10) || '| --- |' || chr(10) || '| ' || p_brand || ' |', 'Some é words' || chr(10) || 'no | table' || chr(10) || chr(10) || chr(10) || chr(10) || 'then ' || chr(10) || ' and' || chr(10) || 'end' FROM b""")
def ext02_table_blocks(spark, sf_dir):
    """Tables in text with their places, and the text without them (EXT-02 to 04, JOIN-15)."""
    texts = _texts_with_tables(spark, sf_dir).withColumn("blocks", markdown_tables.table_blocks(F.col("text")))
    texts = texts.withColumn("rest", markdown_tables.without_tables(F.col("text"), F.col("blocks")))
    return texts.select("p_brand", "rest", F.posexplode("blocks").alias("part", "b")).select("p_brand", "part", "b.kind", "b.start", "b.end", "b.markdown", "rest")
