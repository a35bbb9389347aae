"""Rules that route a question: channels to search, retries, rewrites and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings

# Words that call a channel.
TRIGGERS = {
    "table": "表格,列表,table,tabular,row,column",
    "formula": "公式,方程,表达式,formula,equation,ratio,sigma,theta,tau",
    "image": "image,figure,fig.,plot,graph,curve,axis,legend,panel,subplot,caption,图,图像,曲线",
}
# What a rewritten question is given for a missing slot.
ADDITIONS = {
    "numeric": "数值 百分比 统计 指标 value percent",
    "modality:table": "表格 table 指标 数值",
    "modality:formula": "公式 latex equation formula",
    "modality:image": "图片 图像 图中 image figure",
    "page": "第X页 page X 上下文",
}


# Words of a question that tell what it asks for.
CROSS_DOC = ("对比", "差异", "多个文档", "不同文档")
PAGE = ("第", "页", "图中", "该页", "右上角", "左下角")
TABLE = ("表", "统计", "增长", "下降", "排名", "百分比", "多少")
IMAGE = (
    "图片", "图像", "照片", "截图", "图中", "图 ", "图1", "图2", "图3", "示意图", "趋势图", "视觉", "figure", "fig.", "chart", "plot", "graph", "curve", "caption", "panel", "subplot", "legend", "axis",
    "screenshot", "diagram", "photo",
)
FORMULA = ("公式", "方程", "表达式", "latex", "equation", "formula", "ratio", "sigma", "theta", "tau")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def analysed(questions: DataFrame) -> DataFrame:
    """(query_id, intent, modalities, cross_doc, page_level, route) of questions (query_id, text).

    Words for tables, images and pages count in the case they have, those for formulas in any case. A
    formula question has no route of its own.
    """
    q = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    page = _holds(q, PAGE)
    kind = F.when(_holds(q, TABLE), "table").when(_holds(q, IMAGE), "image").when(_holds(F.lower(q), FORMULA), "formula").when(page, "page")
    out = questions.select("query_id", kind.alias("kind"), (_holds(q, CROSS_DOC) | F.lower(q).contains("compare")).alias("cross_doc"), page.alias("page_level"))
    intent = F.coalesce(F.concat("kind", F.lit("_qa")), F.lit("general"))
    route = F.when(F.col("kind").isin("table", "image", "page"), F.concat("kind", F.lit("_first"))).otherwise("text_first")
    return out.select("query_id", intent.alias("intent"), F.array_compact(F.array("kind", F.lit("text"))).alias("modalities"), "cross_doc", "page_level", route.alias("route"))


def any_keyword(text: Column, keywords: str) -> Column:
    """Whether the text holds one of the keywords, which commas part, in any case."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for word in (w.strip().lower() for w in keywords.split(",")):
        out = out | low.contains(word) if word else out
    return out


def default_tasks(questions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, place, channel, top_k): the channels of each question (query_id, text), in order.

    Vector and BM25 always, tables, formulas and images where a word of the question calls for them.
    """
    tops = {"vector": s.top_k, "bm25": s.top_k, "table": s.table_top_k, "formula": s.top_k, "image": s.top_k}
    tasks = [F.struct(F.lit(c).alias("channel"), F.lit(n).alias("top_k")) for c, n in tops.items()]
    calls = [t if c not in TRIGGERS else F.when(any_keyword(F.col("text"), TRIGGERS[c]), t) for t, c in zip(tasks, tops, strict=True)]
    return questions.select("query_id", F.posexplode(F.array_compact(F.array(*calls))).alias("place", "t")).select("query_id", "place", "t.channel", "t.top_k")


def first_of_channel(tasks: DataFrame) -> DataFrame:
    """Of several tasks (query_id, place, channel, ...) for one channel the first runs."""
    rest = [c for c in tasks.columns if c not in ("query_id", "channel")]
    return tasks.groupBy("query_id", "channel").agg(F.min_by(F.struct(*rest), "place").alias("t")).select("query_id", "channel", "t.*")


def vector_name(channel: Column, explicit: Column) -> Column:
    """The named vector that a channel searches; an explicit name comes first."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(channel.isin("table", "image"), channel).otherwise("text"))


def token_estimate(question: Column, texts: Column, s: Settings = DEFAULTS) -> Column:
    """A quarter of the characters of a question and of the first texts that go to the prompt, 1 at least."""
    used = F.aggregate(F.transform(F.slice(texts, 1, s.context_top), F.length), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(question, F.lit(""))) + used) / 4)).cast("bigint")


def retry_decision(state: dict[str, Column], s: Settings = DEFAULTS) -> Column:
    """finalize, build_prompt or local_retry, from refusal, evidence_ok, retry_count, elapsed_ms, tokens and gain."""
    return (
        F.when(state["refusal"], "finalize").when(state["evidence_ok"], "build_prompt").when(state["retry_count"] >= s.max_retries, "finalize")
        .when(state["elapsed_ms"] > s.budget_ms, "finalize").when(state["tokens"] > s.budget_tokens, "finalize")
        .when((state["retry_count"] > 0) & (state["gain"] < s.min_gain), "finalize").otherwise("local_retry")
    )


def citation_decision(state: dict[str, Column], s: Settings = DEFAULTS) -> Column:
    """finalize or local_retry after the citations are verified."""
    done = state["citation_ok"] | (state["retry_count"] >= s.max_retries) | (state["elapsed_ms"] > s.budget_ms) | (state["tokens"] > s.budget_tokens)
    return F.when(done, "finalize").otherwise("local_retry")


def after_rerank(gate_enabled: Column, retry_enabled: Column, retry_count: Column) -> Column:
    """Where a question goes after the rerank: without a gate, to one retry and then to the prompt."""
    return F.when(gate_enabled, "evidence_gate").when(retry_enabled & (retry_count <= 0), "local_retry").otherwise("build_prompt")


def retry_reasons(lists: list[Column], conflict_level: Column, cross_doc: Column, citation_ok: Column, support: Column, s: Settings = DEFAULTS) -> Column:
    """The distinct reasons for a retry, sorted: those of the lists, and what the state says."""
    none = F.array().cast("array<string>")
    said = [
        F.when(conflict_level.isin("medium", "high"), F.lit("possible_conflict")), F.when(cross_doc, F.lit("need_cross_doc")), F.when(~citation_ok, F.lit("citation_failure")),
        F.when(F.coalesce(support, F.lit(0.0)) < s.support_min, F.lit("low_support_score")),
    ]
    whole = F.concat(*[F.coalesce(x, none) for x in lists], F.array(*said))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda x: F.coalesce(x != "", F.lit(False)))))


def rewritten(question: Column, reasons: Column) -> Column:
    """A question without its polite beginning and question words, with words for what was missing."""
    q = F.regexp_replace(F.regexp_replace(question, r"^\s+|\s+$", ""), r"(?i)^(please\s+|what\s+is\s+)", "")
    q = F.regexp_replace(q, "^(请|帮我|麻烦|简单)?(介绍下|介绍一下|说明下|解释下)", "")
    q = F.regexp_replace(F.regexp_replace(q, r"(是什么|是多少|多少|吗|呢|？|\?)$", ""), r"^\s+|\s+$", "")
    wanted = [F.when(F.array_contains(reasons, name) | F.array_contains(reasons, f"missing_{name}"), F.lit(words)) for name, words in ADDITIONS.items()]
    out = F.concat_ws(" ", F.nullif(q, F.lit("")), *wanted)
    return F.coalesce(F.nullif(out, F.lit("")), question)
