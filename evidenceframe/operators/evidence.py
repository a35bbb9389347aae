"""Evidence gate: slots, coverage, support score, level and decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip01, compact, overlap_ratio
from ..settings import DEFAULTS, Settings

# Words of a question that are no keywords, and the words that it falls into.
STOPWORDS = (
    "a an and are as at be by for from how in is it of on or the to what which with "
    "的 了 在 是 和 与 或 中 上 下 第 页 该 请 吗 多 少 一 个 些 什 么 帮 我 简 单 介 绍 说 明 概 括 讲 述"
).split()
WORD = r"[一-鿿]|[a-zA-Z][a-zA-Z0-9_./-]*|\d+(?:\.\d+)?%?"
PURE_NUMBER = r"^\d+(?:\.\d+)?%?$"
# Numbers, file names, pages.
NUMBER = r"(?<![A-Za-z])(?:19|20)\d{2}(?!\d)|\d+(?:\.\d+)?%?"
SOURCE = r"(?iU)[\w一-鿿 ._-]+\.(?:pdf|md|docx?|txt|pptx?|xlsx?)"
PAGES = (r"第\s*(\d+)\s*页", r"(?i)\bpage\s*(\d+)\b", r"(?i)\bp\.?\s*(\d+)\b")
# Words of a question that ask for a modality, or for a page.
MODALITY_WORDS = {
    "table": "表 统计 对比 排名 百分比 增长 下降 多少".split(),
    "image": "图片 图像 截图 图中 示意图 趋势图 视觉 照片 figure fig. chart screenshot diagram photo".split(),
    "formula": "公式 方程 表达式 latex formula equation".split(),
}
PAGE_WORDS = "第 页 该页 上下文 图中".split()
# Words of questions that compare, that may be answered yes or no, and that ask for numbers.
COMPARING = "对比 差异 多个文档 冲突 比较 compare different".split()
YES_NO_FIRST = "is are was were do does did can could should would will has have".split()
YES_NO = "whether true false supported contradict contradiction conflict consistent inconsistent".split()
YES_NO_CJK = "是否 是不是 能否 可否 有没有 对吗 正确吗 成立吗 支持吗 冲突 矛盾 一致 不一致 对比 差异 不同文档".split()
COUNTING = ["how many", "how much", *"percent percentage accuracy score rate increase decrease number numeric value statistics rank".split()]
COUNTING_CJK = "多少 数值 数量 百分比 占比 比例 准确率 得分 分数 指标 增长 下降 排名 统计 表格 平均 最高 最低".split()
# Words of evidence that denies or affirms; the CJK ones that affirm count without the sign before them.
DENIES, DENIES_CJK = "no false not cannot can't".split(), "不是 不支持 不可以 不存在 没有 无".split()
AFFIRMS, AFFIRMS_CJK = "yes true support supports supported".split(), ("不 是", "不 支持", "不 可以", "不 存在", "没 有")


def _any_of(words: list[str] | tuple[str, ...], around: str = "") -> str:
    return around + "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")" + around


_COMPARES = _any_of(COMPARING)
_POLAR = "|".join((r"(?i:^\s*" + _any_of(YES_NO_FIRST) + r"\b)", "(?i:" + _any_of(YES_NO, r"\b") + ")", _any_of(YES_NO_CJK)))
_COUNTED = "(?i:" + _any_of(COUNTING, r"\b") + ")|" + _any_of(COUNTING_CJK)
_NEGATIVE = "(?i:" + _any_of(DENIES, r"\b") + ")|" + _any_of(DENIES_CJK)
_POSITIVE = "(?i:" + _any_of(AFFIRMS, r"\b") + ")|" + "|".join("(?<!{}){}".format(*x.split()) for x in AFFIRMS_CJK)


def keyword_terms(question: Column) -> Column:
    """Distinct words of a question in order, without stop words and numbers."""
    words = F.transform(F.regexp_extract_all(question, F.lit(WORD), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS) & ~w.rlike(PURE_NUMBER)))


def page_refs(question: Column) -> Column:
    """Page numbers that a question names, as text without leading zeros."""
    found = [F.regexp_extract_all(question, F.lit(p), F.lit(1)) for p in PAGES]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")))


def numeric_refs(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit(NUMBER), F.lit(0)))


def source_refs(question: Column) -> Column:
    """File names that a question names."""
    return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(SOURCE), F.lit(0)), lambda x: F.lower(F.trim(x))))


def modality_refs(question: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(question).rlike(_any_of(words)), F.lit(m)) for m, words in MODALITY_WORDS.items()]))


def keyword_coverage(terms: Column, evidence: Column) -> Column:
    """Share of terms in the evidence text, as they are or without separators; 1 without terms."""
    low = F.lower(evidence)
    tight = compact(low)
    found = F.filter(terms, lambda t: low.contains(t) | tight.contains(compact(t)))
    return F.when(F.size(terms) == 0, 1.0).when(F.coalesce(low, F.lit("")) == "", 0.0).otherwise(F.size(found) / F.size(terms))


def features(hits: DataFrame) -> DataFrame:
    """Per query: number of hits, top and mean score of the best five, diversity of sources.

    hits: query_id, node_id, source, score, text. Evidence is the texts in order of rank.
    """
    scores = F.sort_array(F.collect_list("score"), asc=False)
    texts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    out = hits.groupBy("query_id").agg(
        F.count("*").alias("hit_count"), F.max("score").alias("top_score"), scores.alias("scores"),
        (F.count_distinct("source") / F.count("*")).alias("source_diversity"), F.array_join(F.transform(texts, lambda t: t.text), " ").alias("evidence"),
    )
    five = F.slice("scores", 1, 5)
    mean = F.aggregate(five, F.lit(0.0), lambda s, x: s + x) / F.size(five)
    return out.withColumn("avg_top5", mean).drop("scores")


#: The features of the support score, in the order of ``support_weights``.
FEATURES = ("top_score", "avg_top5", "score_consistency", "rerank_score", "source_diversity", "slot_coverage", "keyword_coverage")


def support_score(values: list[tuple[Column, float | Column]], hits: Column, conflict: Column | None = None) -> Column:
    """Weighted mean of the clipped values, lowered by conflicts, with 4 decimals."""
    total = sum((clip01(v) * w for v, w in values), F.lit(0.0)) / sum(w for _, w in values)
    if conflict is not None:
        total = total * F.when(conflict == "high", 0.9).when(conflict == "medium", 0.95).otherwise(1.0)
    return F.when(hits <= 0, 0.0).otherwise(F.bround(clip01(total), 4))


def support_level(score: Column, missing: Column, s: Settings = DEFAULTS) -> Column:
    return (
        F.when(score <= 0, "none").when((score >= s.support_strong) & (missing == 0), "strong").when(score >= s.support_min, "partial").otherwise("weak")
    )


def consistency(routes: DataFrame) -> DataFrame:
    """(query_id, score_consistency): how far the vector and BM25 hits (query_id, channel, node_id, source) agree."""
    of = lambda channel, c: F.coalesce(F.collect_set(F.when(F.col("channel") == channel, F.col(c))), F.array())
    got = routes.groupBy("query_id").agg(*[of(k, c).alias(f"{k}_{c}") for k in ("vector", "bm25") for c in ("node_id", "source")])
    both = F.greatest(overlap_ratio(F.col("vector_node_id"), F.col("bm25_node_id")), 0.5 * overlap_ratio(F.col("vector_source"), F.col("bm25_source")))
    one = (F.size("vector_node_id") == 0) | (F.size("bm25_node_id") == 0)
    return got.select("query_id", F.when(one, 0.5).otherwise(both).alias("score_consistency"))


def _conflicts(tolerance: float) -> Column:
    """Reasons from ``first``, the best six hits of a question."""
    flags = F.transform("first", lambda h: F.struct(h.source.alias("source"), h.text.rlike(_POSITIVE).alias("pos"), h.text.rlike(_NEGATIVE).alias("neg")))
    any_ = lambda f: F.exists(flags, f)
    mixed = any_(lambda h: h.pos) & any_(lambda h: h.neg)
    polar = F.col("cross_doc") | F.col("question").rlike(_POLAR)
    tables = F.transform("first", lambda h: F.struct(F.concat_ws(":", h.source, h.page).alias("at"), F.regexp_extract_all(h.text, F.lit(NUMBER), F.lit(0)).alias("values")))
    tables = F.filter(tables, lambda t: F.size(t["values"]) > 0)
    values = F.array_distinct(F.flatten(F.transform(tables, lambda t: t["values"])))
    values = number_buckets(values, tolerance) if tolerance > 0 else values
    asks = (F.size("numbers") > 0) | F.col("question").rlike(_COUNTED)
    numeric = asks & (F.size(F.array_distinct(F.transform(tables, lambda t: t["at"]))) > 1) & (F.size(values) > 1)
    found = (
        (polar & any_(lambda h: h.pos & h.neg), "same_hit_positive_negative"), (polar & mixed, "mixed_positive_negative_evidence"),
        (numeric, "numeric_value_conflict"), (F.col("cross_doc") & mixed, "cross_source_polarity_conflict"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in found]))


def gate(
    questions: DataFrame, hits: DataFrame, min_hits: int = 2, min_coverage: float = 0.5, s: Settings = DEFAULTS,
    routes: DataFrame | None = None, tolerance: float = 0.0, allow_refusal: bool = True,
) -> DataFrame:
    """Per question (query_id, text): features, slots, conflicts, support score and level, the decision and its reasons.

    hits may also have page, modality, rerank_score and the scores of their channels; questions may have
    cross_doc. ``routes`` are the hits of the channels, for the consistency. Without rerank scores
    their weight is left out. Partial or strong support passes if no hard slot (hits, or a page, source, number or
    modality that the question names) is missing, and the rest is retried; a missing one is refused where that is
    allowed. Few keywords are a reason to state, not one to retry.
    """
    for name, kind in (("page", "int"), ("modality", "string"), ("rerank_score", "double")):
        hits = hits if name in hits.columns else hits.withColumn(name, F.lit(None).cast(kind))
    for name in ("score_rrf", "score_vector", "score_bm25"):
        hits = hits if name in hits.columns else hits.withColumn(name, F.lit(None).cast("double"))
    hits = normal_scores(hits).withColumns({"score": F.col("normal"), "text": F.concat_ws(" ", "text", "source")})
    best = F.array_sort(F.collect_list(F.struct("rank", "node_id", "source", F.col("page").cast("string").alias("page"), "text")))
    seen = hits.groupBy("query_id").agg(
        best.alias("all"), F.collect_set("modality").alias("modalities"), F.collect_set(F.col("page").cast("string")).alias("pages"), F.max("rerank_score").alias("rerank_score"),
        F.lower(F.concat_ws(" ", F.collect_set(F.col("source").cast("string")))).alias("sources"),
    )
    cross = F.coalesce(F.col("cross_doc"), F.lit(False)) if "cross_doc" in questions.columns else F.lit(False)
    asked = questions.select("query_id", F.coalesce("text", F.lit("")).alias("question"), cross.alias("cross_doc"))
    text = F.col("question")
    asked = asked.withColumns({"terms": keyword_terms(text), "page_refs": page_refs(text), "source_refs": source_refs(text), "modality_refs": modality_refs(text)})
    asked = asked.withColumn("numbers", F.filter(numeric_refs(text), lambda v: ~F.array_contains("page_refs", F.regexp_replace(v, "%$", ""))))
    got = asked.join(features(hits), "query_id", "left").join(seen, "query_id", "left")
    got = got.withColumns({"hit_count": F.coalesce("hit_count", F.lit(0)), "top_score": F.coalesce("top_score", F.lit(0.0)), "avg_top5": F.coalesce("avg_top5", F.lit(0.0)), "source_diversity": F.coalesce("source_diversity", F.lit(0.0))})
    got = got.withColumns({"evidence": F.coalesce("evidence", F.lit("")), "sources": F.coalesce("sources", F.lit(""))} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("pages", "modalities")})
    got = got.withColumn("keyword_coverage", F.round(keyword_coverage(F.col("terms"), F.col("evidence")), 6))
    got = got.join(consistency(routes), "query_id", "left") if routes is not None else got.withColumn("score_consistency", F.lit(None).cast("double"))
    got = got.withColumn("score_consistency", F.coalesce("score_consistency", F.when(F.col("hit_count") > 0, 0.5).otherwise(0.0)))
    got = got.withColumn("first", F.slice(F.coalesce("all", F.array()), 1, 6))

    low = F.lower("evidence")
    absent = [
        ("hits", F.col("hit_count") < min_hits),
        ("page", (F.size("page_refs") > 0) & ~F.arrays_overlap("page_refs", "pages")),
        ("source", F.exists("source_refs", lambda x: ~F.col("sources").contains(x))),
        ("numeric", (F.size("numbers") > 0) & ~F.exists("numbers", lambda v: low.contains(v))),
    ]
    absent += [(f"modality:{m}", F.array_contains("modality_refs", m) & ~F.array_contains("modalities", m)) for m in MODALITY_WORDS]
    slots = [(F.size("page_refs") > 0) | text.rlike(_any_of(PAGE_WORDS)), F.size("source_refs") > 0, F.size("numbers") > 0]
    n_slots = sum((x.cast("int") for x in slots), F.size("modality_refs"))
    got = got.withColumn("missing_slots", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in absent])))
    uncovered = F.size(F.filter("missing_slots", lambda x: x != "hits"))
    got = got.withColumn("slot_coverage", F.when(n_slots == 0, 1.0).otherwise((n_slots - uncovered) / n_slots))
    got = got.withColumn("conflict_reasons", _conflicts(tolerance))
    high = F.arrays_overlap("conflict_reasons", F.array(F.lit("same_hit_positive_negative"), F.lit("cross_source_polarity_conflict")))
    got = got.withColumn("conflict_level", F.when(high, "high").when(F.size("conflict_reasons") > 0, "medium").otherwise("none"))

    values = {name: F.coalesce(name, F.lit(0.0)) for name in FEATURES}
    values["source_diversity"] = F.when(F.col("cross_doc") | text.rlike(_COMPARES), F.col("source_diversity")).otherwise(1.0)
    weights = dict(zip(FEATURES, s.support_weights, strict=True))
    weights["rerank_score"] = F.when(F.col("rerank_score") > 0, weights["rerank_score"]).otherwise(0.0)
    missing = F.size("missing_slots")
    score = support_score([(values[name], weights[name]) for name in FEATURES], F.col("hit_count"), F.col("conflict_level"))
    got = got.withColumn("support_score", score).withColumn("support_level", support_level(F.col("support_score"), missing, s))
    supported = (missing == 0) & F.col("support_level").isin("partial", "strong")
    decision = F.when(supported, "pass").when((missing > 0) & F.lit(allow_refusal), "refuse").otherwise("retry")
    few = (F.size("modality_refs") == 0) & (F.col("keyword_coverage") < min_coverage)
    soft = F.when(few & (F.size("terms") > 0), F.array(F.lit("keyword"))).otherwise(F.array().cast("array<string>"))
    got = got.withColumn("soft_missing_slots", soft).withColumn("gate_reasons", gate_reasons(few))
    return got.select(
        "query_id", "hit_count", *[F.round(c, 6).alias(c) for c in ("top_score", "avg_top5", "score_consistency", "source_diversity", "slot_coverage")], "keyword_coverage",
        "missing_slots", "conflict_level", "conflict_reasons", "support_score", "support_level", decision.alias("decision"),
        "soft_missing_slots", "gate_reasons",
    )


def gate_reasons(few: Column) -> Column:
    """Reasons in order, each once: hard slots, soft ones, conflicts that weigh, then what is only advice."""
    high, numeric = F.col("conflict_level") == "high", F.array_contains("conflict_reasons", "numeric_value_conflict")
    named = lambda c, prefix: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    if_ = lambda c, *names: F.when(c, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    parts = [
        named("missing_slots", "missing_"), named("soft_missing_slots", "soft_missing_"), if_(high, "possible_conflict"), if_(numeric, "numeric_value_conflict"),
        if_(F.size("conflict_reasons") > 0, "possible_conflict"), F.col("conflict_reasons"), if_(few, "low_keyword_coverage"),
    ]
    return F.array_distinct(F.concat(*parts))


def modality_coverage(hits: DataFrame) -> DataFrame:
    """(query_id, modality, n): hits by modality; one with a table, image, formula or page counts for these too."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kinds = [
        F.coalesce(F.nullif("modality", F.lit("")), F.lit("text")), F.when(text("table_markdown"), "table"), F.when(text("image_path"), "image"), F.when(text("formula_latex"), "formula"),
        F.when(F.col("page").isNotNull() | (F.col("channel") == "page"), "page"),
    ]
    return hits.select("query_id", F.explode(F.array_distinct(F.array_compact(F.array(*kinds)))).alias("modality")).groupBy("query_id", "modality").agg(F.count("*").alias("n"))


def normal_scores(hits: DataFrame, mode: str = "rank") -> DataFrame:
    """Add ``normal`` to hits (query_id, rank, rerank_score, score_rrf, score_vector, score_bm25, score).

    rank: the rerank score, else the vector's, else a score that no fusion made, else 1 / log2(rank + 1).
    raw: the first score there is. minmax: that one over the query's, 1 where they are all alike.
    """
    raw = F.coalesce("score_rrf", "score_vector", "score_bm25", "score", F.lit(0.0))
    if mode == "raw":
        value = raw
    elif mode == "minmax":
        of_query = Window.partitionBy("query_id")
        low, high = F.min(raw).over(of_query), F.max(raw).over(of_query)
        value = F.when(high <= low, 1.0).otherwise((raw - low) / (high - low))
    else:
        value = F.coalesce("rerank_score", "score_vector", F.when(F.col("score_rrf").isNull(), F.col("score")), 1 / F.log2(F.col("rank") + 1))
    return hits.withColumn("normal", clip01(value))


def merged_with_critique(rows: DataFrame, s: Settings = DEFAULTS, allow_refusal: bool = True) -> DataFrame:
    """The rules' verdict and a critic's in one, by conservative rules.

    rows: query_id, gate_reasons, support_score, support_level, conflict_level, decision, and the same
    with ``c_`` before them, of the critic (whose reasons are the actions it recommends).
    """
    none = F.array().cast("array<string>")
    reasons = F.array_distinct(F.concat(F.coalesce("gate_reasons", none), F.coalesce("c_gate_reasons", none)))
    stronger = lambda a, b, names: F.get(F.array(*map(F.lit, names)), F.greatest(*[F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("int") - 1) for c in (a, b)]))
    out = rows.select(
        "query_id", reasons.alias("reasons"), F.greatest("support_score", clip01(F.col("c_support_score"))).alias("support_score"),
        stronger("support_level", "c_support_level", ("none", "weak", "partial", "strong")).alias("support_level"), stronger("conflict_level", "c_conflict_level", ("none", "low", "medium", "high")).alias("conflict_level"),
        F.col("decision").alias("__rule"), F.col("c_decision").alias("__critic"),
    )
    hard = F.exists("reasons", lambda x: x.isin("insufficient_hits", "missing_page", "missing_source", "missing_numeric") | x.startswith("missing_modality:"))
    one = (F.col("__rule") == "pass") | (F.col("__critic") == "pass")
    decision = F.when(hard & (F.col("conflict_level") == "high") & F.lit(allow_refusal), "refuse").when(hard, "retry").when(one, "pass").otherwise("retry")
    out = out.withColumn("decision", decision)
    empty = (F.col("decision") != "pass") & (F.size("reasons") == 0)
    return out.withColumn("reasons", F.when(empty, F.array(F.lit("agent_or_rule_requires_retry"))).otherwise(F.col("reasons"))).drop("__rule", "__critic")


def number_buckets(values: Column, tolerance: float) -> Column:
    """Numbers that count as one: half-even rounding to multiples of the tolerance; percentages stay apart."""
    bucket = lambda v: F.bround(F.regexp_replace(v, "%", "").cast("double") / tolerance).cast("bigint").cast("string")
    return F.array_distinct(F.transform(values, lambda v: F.concat(bucket(v), F.when(v.endswith("%"), "%").otherwise(""))))


def evidence_gain(old: Column, new: Column) -> Column:
    union = F.size(F.array_union(old, new))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_except(new, old)) / union)
