"""Expansion against a plain walk over seeds, relations and edges."""

import random

import pytest

from evidenceframe.operators import expansion

WEIGHT = {"parent_id": 0.6, "prev_id": 0.5, "next_id": 0.5, "doc_next_node_id": 0.5, "context_node_ids": 0.6, "same_page_node_ids": 0.3, "page_window": 0.3, "related_table_node_ids": 0.9, "related_formula_node_ids": 0.85, "related_image_node_ids": 0.8}
PRIORITY = {"prev_id": 60, "next_id": 60, "context_node_ids": 80, "parent_id": 30, "doc_next_node_id": 30, "same_page_node_ids": 40, "page_window": 20, "related_table_node_ids": 100, "related_formula_node_ids": 100, "related_image_node_ids": 100}
CONTEXT, PAGE = {"prev_id", "next_id", "context_node_ids"}, {"same_page_node_ids", "page_window"}


def walk(seeds, edges, nodes, mode, reason):
    out = {n: (s, None) for n, s, *_ in seeds}
    total, spent = {}, {}

    def offer(no, score, rel, node):
        _, _, modality, whole, own = nodes[node]
        related, context, page = rel.startswith("related"), rel in CONTEXT, rel in PAGE
        if mode == "auto" and not (related or context):
            return
        if mode == "retry" and (related or (not context and not page and reason != "possible_conflict")):
            return
        pool = "related_modality" if related else "context" if context else mode
        mine = spent.get((no, pool), 0)
        if related:
            want = {"t": "table", "f": "formula", "i": "image"}[rel[8]]
            if modality != want or (want == "image" and mode == "auto" and whole) or no > 6 or score < 0.3 or seeds[no - 1][2] != "text" or total.get(pool, 0) >= 8 or mine >= 3:
                return
        elif context:
            if no > 4 or score < 0.45 or mine >= 2 or modality != "text":
                return
        elif no > 3 or score < 0.55 or total.get(pool, 0) >= {"routed": 20, "retry": 12}[mode] or mine >= {"routed": 5, "retry": 4}[mode] or (mode == "routed" and modality == "image"):
            return
        gets = min(1.0, score * WEIGHT[rel])
        gets = max(gets, 0.2 * own + 0.8 * gets) if own is not None else gets
        if node in out:
            have, by = out[node]
            if by is None or (PRIORITY[rel], gets) <= (PRIORITY[by], have):
                return
        else:
            total[pool] = total.get(pool, 0) + 1
        out[node] = (gets, rel)
        spent[no, pool] = mine + 1

    for no, (n, score, _, doc, page) in enumerate(seeds, 1):
        for rel in WEIGHT:
            if rel == "page_window":
                continue
            for dst in edges.get((n, rel), []):
                offer(no, score, rel, dst)
        if mode != "auto":
            for p in (page - 1, page, page + 1):
                for node in sorted(k for k, v in nodes.items() if v[:2] == (doc, p)):
                    offer(no, score, "page_window", node)
    return {n: (round(s, 6), r) for n, (s, r) in out.items()}


@pytest.mark.parametrize(("mode", "reason"), [("auto", None), ("routed", None), ("retry", "possible_conflict"), ("retry", "weak")])
def test_expansion_equals_a_plain_walk(spark, mode, reason):
    rnd = random.Random(21)
    nodes = {f"n{i:03}": (rnd.randrange(4), rnd.randrange(1, 9), rnd.choice(["text", "text", "table", "formula", "image"]), rnd.random() < 0.3, rnd.choice([None, None, 0.9])) for i in range(120)}
    names = [r for r in WEIGHT if r != "page_window"]
    edges = {(n, r): rnd.sample(sorted(nodes), rnd.randrange(4)) for n in nodes for r in names}
    queries = {q: [(n, round(0.95 - 0.05 * k * rnd.random(), 3), nodes[n][2], *nodes[n][:2]) for k, n in enumerate(rnd.sample(sorted(nodes), 9))] for q in range(6)}
    seeds = spark.createDataFrame([(q, n, s, k, m, d, p) for q, rows in queries.items() for k, (n, s, m, d, p) in enumerate(rows, 1)], "query_id int, node_id string, score double, rank int, modality string, doc_id int, page int")
    links = spark.createDataFrame([(n, r, k, d) for (n, r), ds in edges.items() for k, d in enumerate(ds)], "src_id string, relation string, pos int, dst_id string")
    places = spark.createDataFrame([(n, *v) for n, v in nodes.items()], "node_id string, doc_id int, page int, modality string, whole_image boolean, composite double")
    got = {}
    for r in expansion.expand(seeds, links, places, mode, reason).collect():
        got.setdefault(r.query_id, {})[r.node_id] = (r.score, r.relation)
    for q, rows in queries.items():
        assert got[q] == {n: (pytest.approx(s, abs=2e-6), r) for n, (s, r) in walk(rows, edges, nodes, mode, reason).items()}
    assert expansion.expand(seeds.limit(0), links, places, mode, reason).count() == 0
