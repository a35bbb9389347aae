"""Retry planning and merged advice against a plain walk over the reasons."""

import math
import random

from pyspark.sql import functions as F

from evidenceframe.operators import retry
from evidenceframe.operators.grading import CHANNELS, FILTERS

ROW = (
    "query_id int, question string, tasks array<struct<channel:string,query_text:string,top_k:int,filters:map<string,string>,metadata:map<string,string>>>, page_window int, filters map<string,string>, "
    "missing_slots array<string>, reasons array<string>, conflict_level string, conflict_reasons array<string>, cross_doc boolean, citation_ok boolean, best_score double, retry_count int"
)
REASONS = (
    "insufficient_hits missing_hits hits low_support_score citation_failure low_keyword_coverage keyword missing_keyword numeric missing_numeric source missing_page page "
    "modality:table missing_modality:formula modality:image possible_conflict numeric_value_conflict cross_source_polarity_conflict need_cross_doc other"
).split()


def cap(k):
    return max(1, min(32, k))


def grow(k):
    return cap(max(k + 1, math.ceil(k * 1.5)))


def plain_retry(row, query):
    """(tasks, page window, actions) after one reason after another."""
    reasons = set(row["reasons"])
    tasks = [dict(t, filters=dict(t["filters"]), metadata=dict(t["metadata"])) for t in row["tasks"]]
    window, actions = row["page_window"], []
    if any(t["query_text"] != query for t in tasks):
        actions.append("rewrite_query")
    for t in tasks:
        t["query_text"] = query

    def everything():
        before = [t["top_k"] for t in tasks]
        for t in tasks:
            t["top_k"] = max(t["top_k"], grow(t["top_k"]))
        if before != [t["top_k"] for t in tasks]:
            actions.append("increase_top_k")

    def task(channel, top_k, more=False, **metadata):
        top_k = grow(cap(top_k)) if more else cap(top_k)
        found = next((t for t in tasks if t["channel"] == channel), None)
        if not found:
            tasks.append({"channel": channel, "query_text": query, "top_k": top_k, "filters": dict(row["filters"]), "metadata": {"retry": "true"} | metadata})
            actions.append(f"add_{channel}")
            return
        new = dict(found, top_k=max(found["top_k"], top_k), filters=found["filters"] | row["filters"], metadata=found["metadata"] | metadata)
        if new != found:
            found.update(new)
            actions.append(f"update_{channel}")

    def wider():
        nonlocal window
        new = min(3, (1 if window is None else window) + 1)
        if new != window:
            window = new
            actions.append("expand_page_window")

    if reasons & {"insufficient_hits", "missing_hits", "low_support_score", "citation_failure"} or not row["citation_ok"]:
        everything()
    if reasons & {"low_keyword_coverage", "keyword", "missing_keyword"}:
        task("bm25", 12, True)
    if reasons & {"insufficient_hits", "hits", "missing_hits"}:
        task("bm25", 12, True)
        task("page", 8)
    if reasons & {"numeric", "missing_numeric"}:
        task("table", 8)
        task("bm25", 12, True)
    if reasons & {"source", "missing_source"}:
        task("bm25", 12, True)
    if reasons & {"page", "missing_page"}:
        task("page", 8)
        wider()
    for name, k in (("table", 8), ("formula", 12), ("image", 12)):
        if reasons & {f"modality:{name}", f"missing_modality:{name}"}:
            task(name, k)
    conflicts = ["numeric_value_conflict", "cross_source_polarity_conflict", "possible_conflict"]
    why = "need_cross_doc" if row["cross_doc"] or "need_cross_doc" in reasons else next((r for r in conflicts if r in reasons), "")
    if row["cross_doc"] or row["conflict_level"] in ("medium", "high") or reasons & set(conflicts) or row["conflict_reasons"]:
        task("relationship", 12, expansion_mode="routed", expansion_reason=why)
        wider()
    if reasons & {"low_support_score", "insufficient_hits", "missing_hits", "citation_failure"} and row["best_score"] >= 0.55:
        task("relationship", 12, expansion_mode="retry", expansion_reason=why or "agent_context_expand")
        wider()
        actions.append("agent_context_expand")
    if not actions:
        everything()
    return tasks, window, actions or ["no_retry_plan_change"]


def some_tasks(rnd, query):
    return [
        {"channel": c, "query_text": rnd.choice([query, "old", None]), "top_k": rnd.choice([1, 8, 12, 18, 32, 40]), "filters": rnd.choice([{}, {"source": "a"}, {"page": "1"}]), "metadata": rnd.choice([{}, {"x": "1"}])}
        for c in rnd.sample(CHANNELS, rnd.randrange(4))
    ]


def as_dict(t):
    return dict(t.asDict(), filters=t.filters or {}, metadata=t.metadata or {})


def test_retry_equals_a_plain_walk(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        rows.append({
            "query_id": i, "question": "How so", "tasks": some_tasks(rnd, "How so"), "page_window": rnd.choice([None, 1, 2, 3]), "filters": rnd.choice([{}, {"source": "b"}]), "missing_slots": [],
            "reasons": rnd.sample(REASONS, rnd.choice([0, 0, 1, 2, 5])), "conflict_level": rnd.choice(["none", "none", "high"]), "conflict_reasons": rnd.choice([[], [], ["possible_conflict"]]),
            "cross_doc": rnd.random() < 0.2, "citation_ok": rnd.random() < 0.8, "best_score": rnd.choice([0.2, 0.55, 0.9]), "retry_count": 1,
        })
    got = {r.query_id: r for r in retry.plan_retry(spark.createDataFrame([tuple(r.values()) for r in rows], ROW)).collect()}
    for row in rows:
        r = got[row["query_id"]]
        tasks, window, actions = plain_retry(row, r.query_text)
        assert ([as_dict(t) for t in r.tasks], r.page_window, r.actions, r.retry_count) == (tasks, window, actions, 2), row
    assert {a for r in got.values() for a in r.actions} >= {"no_retry_plan_change", "add_bm25", "update_bm25", "agent_context_expand", "rewrite_query"}


def test_retry_of_empty_plans(spark):
    rows = spark.createDataFrame([(1, "what is x?", None, None, None, None, ["missing_numeric"], None, None, None, None, None, None), (2, "y", None, None, None, None, None, None, None, None, None, None, None)], ROW)
    got = {r.query_id: r for r in retry.plan_retry(rows).collect()}
    assert got[1].query_text.startswith("x ") and [(t.channel, t.top_k) for t in got[1].tasks] == [("table", 8), ("bm25", 18)] and got[1].actions == ["add_table", "add_bm25"]
    assert (got[2].tasks, got[2].page_window, got[2].actions) == ([], None, ["no_retry_plan_change"])
    assert retry.plan_retry(rows.limit(0)).count() == 0


def plain_advice(row):
    wrong = sorted(k for k in row["a_filters"] or {} if k not in FILTERS)
    if wrong:
        return row["query_text"], row["tasks"], row["page_window"], [f"invalid_filters:{','.join(wrong)}"], False
    query, errors, used = row["a_query_text"] or row["query_text"] or row["question"], [], False
    tasks = [dict(t, query_text=query or t["query_text"]) for t in row["tasks"]]
    used = bool(query)
    for c in row["a_add"]:
        if c not in CHANNELS:
            errors.append(f"invalid_channel:{c}")
            continue
        used, k = True, {"page": 8, "table": 8}.get(c, 12)
        t = next((t for t in tasks if t["channel"] == c), None)
        if t:
            t.update(query_text=query, top_k=max(t["top_k"], k), filters=t["filters"] | row["a_filters"])
        else:
            tasks.append({"channel": c, "query_text": query, "top_k": k, "filters": dict(row["a_filters"]), "metadata": {"agent": "true"}})
    for c in row["a_increase"]:
        t = next((t for t in tasks if t["channel"] == c), None)
        if c not in CHANNELS:
            errors.append(f"invalid_top_k_channel:{c}")
        elif t:
            used, t["top_k"] = True, cap(max(t["top_k"] + 1, int(t["top_k"] * 1.5)))
    window = row["page_window"] if row["a_page_window"] is None else max(1, min(3, row["a_page_window"]))
    seen = set()
    tasks = [t for t in tasks if not (t["channel"] in seen or seen.add(t["channel"]))]
    return query, tasks, window, errors, used or row["a_page_window"] is not None


def test_advice_equals_a_plain_walk(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(200):
        tasks = some_tasks(rnd, "q")
        rows.append({
            "query_id": i, "question": "q0", "query_text": rnd.choice(["q1", "", None]), "tasks": tasks + tasks[: rnd.randrange(2)], "page_window": rnd.choice([None, 2]), "a_query_text": rnd.choice(["new", "", None]),
            "a_add": rnd.sample([*CHANNELS, "bogus"], rnd.randrange(3)), "a_increase": rnd.sample([*CHANNELS, "bogus"], rnd.randrange(3)), "a_page_window": rnd.choice([None, 0, 2, 9]),
            "a_filters": rnd.choice([{}, {"source": "z"}, {"nope": "1", "bad": "2"}, {"tags": "t"}]),
        })
    kind = "query_id int, question string, query_text string, tasks " + ROW.split("tasks ")[1].split(", page_window")[0] + ", page_window int, a_query_text string, a_add array<string>, a_increase array<string>, a_page_window int, a_filters map<string,string>"
    got = {r.query_id: r for r in retry.merged_advice(spark.createDataFrame([tuple(r.values()) for r in rows], kind)).collect()}
    for row in rows:
        r = got[row["query_id"]]
        assert (r.query_text, [as_dict(t) for t in r.tasks], r.page_window, r.errors, r.used) == plain_advice(row), row


def test_add_if_missing(spark):
    rows = spark.createDataFrame([([("bm25", "q", 3, {}, {"a": "1"}), ("bm25", "q", 4, {}, {})],), ([],)], "tasks array<struct<channel:string,query_text:string,top_k:int,filters:map<string,string>,metadata:map<string,string>>>")
    new = F.struct(F.lit("bm25").alias("channel"), F.lit("n").alias("query_text"), F.lit(9).alias("top_k"), F.expr(retry.NONE).alias("filters"), F.create_map(F.lit("b"), F.lit("2")).alias("metadata"))
    got = [[(t.query_text, t.top_k, t.metadata) for t in r.t] for r in rows.select(retry.added_if_missing(F.col("tasks"), new).alias("t")).collect()]
    assert got == [[("q", 3, {"a": "1", "b": "2"}), ("q", 4, {})], [("n", 9, {"b": "2"})]]
