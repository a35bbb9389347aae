"""Retrieval plans of questions after a failed round: what rules and an adviser change in them.

A plan is a row: its tasks in an array, its page window, its query. What the reasons for the retry
ask for becomes a list of steps, and a fold over that list gives the new plan, one row at a time and
without Python. A step for a channel raises the channel's first task or adds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .grading import CHANNELS, FILTERS
from .routing import rewritten

TASK = "struct<channel:string,query_text:string,top_k:int,filters:map<string,string>,metadata:map<string,string>>"
STEP = "struct<kind:string,channel:string,top_k:int,metadata:map<string,string>>"
NONE = "cast(map() as map<string,string>)"


def capped(top_k: Column, s: Settings = DEFAULTS) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(s.retry_top_most), top_k)).cast("int")


def scaled(top_k: Column, s: Settings = DEFAULTS, up: bool = True) -> Column:
    """A larger top_k: by the factor, rounded up or down, and by one at least, within the cap."""
    more = top_k * s.retry_factor
    return capped(F.greatest(top_k + 1, (F.ceil(more) if up else F.floor(more)).cast("int")), s)


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps, of equal keys the value of the second."""
    empty = F.expr(NONE)
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(y, x))


def _entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(F.coalesce(m, F.expr(NONE))))


def _task(channel: Column, query: Column, top_k: Column, filters: Column, metadata: Column) -> Column:
    return F.struct(channel.alias("channel"), query.alias("query_text"), top_k.cast("int").alias("top_k"), filters.alias("filters"), metadata.alias("metadata"))


def _with(t: Column, **new: Column) -> Column:
    get = lambda name: new.get(name, t[name])
    return _task(get("channel"), get("query_text"), get("top_k"), get("filters"), get("metadata"))


def upserted(tasks: Column, new: Column, fresh: Column | None = None) -> tuple[Column, Column]:
    """Tasks with the new one in them, and add, update or null: what was done.

    The first task of its channel takes the new query, the larger top_k and the filters and
    metadata of both; without one ``fresh``, or else the new one, comes last.
    """
    place = F.array_position(F.transform(tasks, lambda t: t["channel"]), new["channel"]) - 1
    old = F.get(tasks, place.cast("int"))
    filters, metadata = merged_maps(old["filters"], new["filters"]), merged_maps(old["metadata"], new["metadata"])
    changed = (
        ~old["query_text"].eqNullSafe(new["query_text"]) | (new["top_k"] > old["top_k"])
        | (_entries(filters) != _entries(old["filters"])) | (_entries(metadata) != _entries(old["metadata"]))
    )
    better = _with(old, query_text=new["query_text"], top_k=F.greatest(old["top_k"], new["top_k"]), filters=filters, metadata=metadata)
    done = F.when(place < 0, F.array_append(tasks, new if fresh is None else fresh)).otherwise(F.transform(tasks, lambda t, i: F.when(i == place, better).otherwise(t)))
    return done, F.when(place < 0, "add").when(changed, "update")


def added_if_missing(tasks: Column, new: Column) -> Column:
    """Tasks with the new one last, unless its channel has one, which then only takes its metadata."""
    place = F.array_position(F.transform(tasks, lambda t: t["channel"]), new["channel"]) - 1
    kept = F.transform(tasks, lambda t, i: F.when(i == place, _with(t, metadata=merged_maps(t["metadata"], new["metadata"]))).otherwise(t))
    return F.when(place < 0, F.array_append(tasks, new)).otherwise(kept)


def relationship_reason(reasons: Column, cross_doc: Column) -> Column:
    """Why neighbours are looked at; empty without a reason."""
    first = F.when(cross_doc | F.array_contains(reasons, "need_cross_doc"), "need_cross_doc")
    for name in ("numeric_value_conflict", "cross_source_polarity_conflict", "possible_conflict"):
        first = first.when(F.array_contains(reasons, name), name)
    return first.otherwise("")


def steps(row: Column, s: Settings = DEFAULTS) -> Column:
    """The steps that the reasons of a row (a struct) ask for, in order.

    grow raises every task, task one channel, window the page window, note only says so.
    """
    reasons = row["reasons"]
    any_of = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    missing = lambda slot: any_of(slot, f"missing_{slot}")

    def step(when: Column, kind: str, channel: str | None = None, top_k: int | None = None, more: bool = False, metadata: Column | None = None) -> Column:
        top = capped(F.lit(top_k), s)
        values = F.struct(
            F.lit(kind).alias("kind"), F.lit(channel).cast("string").alias("channel"), (scaled(top, s) if more else top).alias("top_k"),
            (F.expr(NONE) if metadata is None else metadata).alias("metadata"),
        )
        return F.when(when, values.cast(STEP))

    hits = any_of("insufficient_hits") | missing("hits")
    why = relationship_reason(reasons, row["cross_doc"])
    conflict = row["cross_doc"] | row["conflict_level"].isin("medium", "high") | (F.size(row["conflict_reasons"]) > 0) | any_of("possible_conflict", "numeric_value_conflict", "cross_source_polarity_conflict")
    context = any_of("low_support_score", "insufficient_hits", "missing_hits", "citation_failure") & (row["best_score"] >= s.context_seed_score)
    mode = lambda name, reason: F.create_map(F.lit("expansion_mode"), F.lit(name), F.lit("expansion_reason"), reason)
    bm25, page, related = ("bm25", s.top_k), ("page", s.page_top_k), ("relationship", s.top_k)
    return F.array_compact(F.array(
        step(any_of("insufficient_hits", "missing_hits", "low_support_score", "citation_failure") | ~row["citation_ok"], "grow"),
        step(any_of("low_keyword_coverage") | missing("keyword"), "task", *bm25, more=True),
        step(hits, "task", *bm25, more=True), step(hits, "task", *page),
        step(missing("numeric"), "task", "table", s.table_top_k), step(missing("numeric"), "task", *bm25, more=True),
        step(missing("source"), "task", *bm25, more=True),
        step(missing("page"), "task", *page), step(missing("page"), "window"),
        *[step(missing(f"modality:{m}"), "task", m, k) for m, k in (("table", s.table_top_k), ("formula", s.top_k), ("image", s.top_k))],
        step(conflict, "task", *related, metadata=mode("routed", why)), step(conflict, "window"),
        step(context, "task", *related, metadata=mode("retry", F.when(why == "", "agent_context_expand").otherwise(why))), step(context, "window"), step(context, "note"),
    ))


def plan_retry(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, query_text, tasks, page_window, actions, retry_count) after the reasons of each row.

    rows: query_id, question, tasks (array of channel, query_text, top_k, filters, metadata),
    page_window, filters, missing_slots, reasons (``routing.retry_reasons``), conflict_level, conflict_reasons, cross_doc, citation_ok, best_score
    (of the evidence so far) and retry_count. Where no reason changes anything every task is raised.
    """
    none = F.array().cast("array<string>")
    flags = {"cross_doc": False, "citation_ok": True, "best_score": 0.0, "conflict_level": "none", "retry_count": 0}
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in flags.items()} | {c: F.coalesce(c, none) for c in ("missing_slots", "reasons", "conflict_reasons")})
    inputs = F.struct(
        F.coalesce("tasks", F.array()).cast(f"array<{TASK}>").alias("tasks"), rewritten(F.col("question"), F.array_union("reasons", "missing_slots")).alias("query"), F.col("page_window").cast("int").alias("window"),
        F.coalesce(F.col("filters"), F.expr(NONE)).alias("filters"), *["reasons", "conflict_reasons"], *[c for c in flags],
    )
    # as a lambda variable, what a row brings is made once and not for each step
    out = rows.select("query_id", F.explode(F.transform(F.array(inputs), lambda x: planned(x, s))).alias("plan"))
    return out.select("query_id", "plan.query_text", "plan.tasks", F.col("plan.window").alias("page_window"), "plan.actions", "plan.retry_count")


def planned(row: Column, s: Settings = DEFAULTS) -> Column:
    """(query_text, tasks, window, actions, retry_count) of a row: the fold of its steps over its plan."""
    query, filters = row["query"], row["filters"]
    start = F.struct(
        F.transform(row["tasks"], lambda t: _with(t, query_text=query)).alias("tasks"), row["window"].alias("window"),
        F.when(F.exists(row["tasks"], lambda t: ~t["query_text"].eqNullSafe(query)), F.array(F.lit("rewrite_query"))).otherwise(F.array().cast("array<string>")).alias("actions"),
    )

    def grown(state: Column) -> Column:
        more = F.transform(state["tasks"], lambda t: _with(t, top_k=F.greatest(t["top_k"], scaled(t["top_k"], s))))
        changed = F.exists(state["tasks"], lambda t: scaled(t["top_k"], s) > t["top_k"])
        return F.struct(more.alias("tasks"), state["window"].alias("window"), F.when(changed, F.array_append(state["actions"], F.lit("increase_top_k"))).otherwise(state["actions"]).alias("actions"))

    def step(state: Column, x: Column) -> Column:
        more = lambda when, name: F.when(when, F.array_append(state["actions"], name)).otherwise(state["actions"])
        # what marks a task as the retry's own is not given to one that was there
        new = _task(x["channel"], query, x["top_k"], filters, x["metadata"])
        tasks, said = upserted(state["tasks"], new, _with(new, metadata=merged_maps(F.create_map(F.lit("retry"), F.lit("true")), x["metadata"])))
        wide = F.least(F.lit(s.retry_window_most), F.coalesce(state["window"], F.lit(s.expand_pages)) + s.retry_window_step)
        task = F.struct(tasks.alias("tasks"), state["window"].alias("window"), more(said.isNotNull(), F.concat_ws("_", said, x["channel"])).alias("actions"))
        window = F.struct(state["tasks"].alias("tasks"), wide.alias("window"), more(~state["window"].eqNullSafe(wide), F.lit("expand_page_window")).alias("actions"))
        note = F.struct(state["tasks"].alias("tasks"), state["window"].alias("window"), F.array_append(state["actions"], F.lit("agent_context_expand")).alias("actions"))
        return F.when(x["kind"] == "grow", grown(state)).when(x["kind"] == "task", task).when(x["kind"] == "window", window).otherwise(note)

    def finished(state: Column) -> Column:
        return F.when(F.size(state["actions"]) > 0, state).otherwise(grown(state))

    def told(state: Column) -> Column:
        actions = F.when(F.size(state["actions"]) > 0, state["actions"]).otherwise(F.array(F.lit("no_retry_plan_change")))
        return F.struct(query.alias("query_text"), state["tasks"].alias("tasks"), state["window"].alias("window"), actions.alias("actions"), (row["retry_count"] + 1).alias("retry_count"))

    return F.get(F.transform(F.array(F.aggregate(steps(row, s), start, step, finished)), told), F.lit(0))


def merged_advice(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, query_text, tasks, page_window, errors, used): plans with an adviser's changes (FLT-12b).

    rows: query_id, question, query_text, tasks, page_window, and of the advice a_query_text, a_add, a_increase (arrays of channels),
    a_page_window, a_filters. A filter that is not allowed rejects all of it, a channel only itself.
    """
    tops = {"vector": s.top_k, "bm25": s.top_k, "page": s.page_top_k, "table": s.table_top_k}
    none = F.array().cast("array<string>")
    list_ = lambda c: F.transform(F.coalesce(c, none), lambda x: F.coalesce(x, F.lit("")))
    allowed = lambda x: x.isin(*CHANNELS)
    query = F.coalesce(F.nullif("a_query_text", F.lit("")), F.nullif("query_text", F.lit("")), F.col("question"))
    filters = F.coalesce(F.col("a_filters"), F.expr(NONE))
    wrong = F.filter(F.array_sort(F.map_keys(filters)), lambda k: ~k.isin(*FILTERS))
    rows = rows.withColumns({"tasks": F.coalesce("tasks", F.array()).cast(f"array<{TASK}>"), "__query": query, "__wrong": wrong, "__add": F.filter(list_("a_add"), allowed), "__more": F.filter(list_("a_increase"), allowed)})
    start = F.transform("tasks", lambda t: _with(t, query_text=F.when(F.col("__query") != "", F.col("__query")).otherwise(t["query_text"])))

    def top_of(channel: Column) -> Column:
        out = F.lit(s.top_k)
        for name, k in tops.items():
            out = F.when(channel == name, k).otherwise(out)
        return capped(out, s)

    def add(tasks: Column, channel: Column) -> Column:
        new = _task(channel, F.col("__query"), top_of(channel), filters, F.expr(NONE))
        return upserted(tasks, new, _with(new, metadata=F.create_map(F.lit("agent"), F.lit("true"))))[0]

    def raise_(tasks: Column, channel: Column) -> Column:
        place = F.array_position(F.transform(tasks, lambda t: t["channel"]), channel) - 1
        return F.transform(tasks, lambda t, i: F.when(i == place, _with(t, top_k=scaled(t["top_k"], s, up=False))).otherwise(t))

    def first_of_each(tasks: Column) -> Column:
        names = F.transform(tasks, lambda t: t["channel"])
        return F.filter(tasks, lambda t, i: F.array_position(names, t["channel"]) - 1 == i)

    rows = rows.withColumn("__tasks", F.aggregate("__add", start, add)).withColumn("__tasks", F.aggregate("__more", F.col("__tasks"), raise_))
    known = F.transform(F.col("__tasks"), lambda t: t["channel"])
    bad = lambda c, name: F.transform(F.filter(list_(c), lambda x: ~allowed(x)), lambda x: F.concat(F.lit(f"{name}:"), x))
    good = F.size("__wrong") == 0
    window = F.when(F.col("a_page_window").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(s.retry_window_most), F.col("a_page_window")))).cast("int")
    used = good & ((F.col("__query") != "") | (F.size("__add") > 0) | F.exists("__more", lambda x: F.array_contains(known, x)) | window.isNotNull())
    errors = F.when(good, F.concat(bad("a_add", "invalid_channel"), bad("a_increase", "invalid_top_k_channel"))).otherwise(F.array(F.concat(F.lit("invalid_filters:"), F.array_join("__wrong", ","))))
    return rows.select(
        "query_id", F.when(good, F.col("__query")).otherwise(F.col("query_text")).alias("query_text"), F.when(good, first_of_each(F.col("__tasks"))).otherwise(F.col("tasks")).alias("tasks"),
        F.when(good & window.isNotNull(), window).otherwise(F.col("page_window")).alias("page_window"), errors.alias("errors"), used.alias("used"),
    )
