"""Context of tables and formulas against a walk over the hits of each query."""

import random

from evidenceframe.operators import context as c

HITS = "query_id int, node_id string, rank int, score double, modality string, label string, from_node_id string"
EDGES = "src_id string, relation string, pos int, dst_id string"


def plain_contexts(hit, edges, pool):
    wanted = [hit[6]] if hit[6] else []
    for relation in c.CONTEXT_RELATIONS:
        wanted += [d for _, d in sorted((p, d) for s, r, p, d in edges if s == hit[1] and r == relation)]
    return list(dict.fromkeys(w for w in wanted if pool.get((hit[0], w)) == "text")) if hit[4] in ("table", "formula") else []


def plain_policy(hits, edges, pool):
    clip = lambda x: max(0.0, min(1.0, x))
    scores = {h[1]: h[3] for h in hits}
    said, added = {}, []
    for h in sorted(hits, key=lambda h: h[2]):
        found = plain_contexts(h, edges, pool)
        if h[5] is None or not found:
            continue
        node, label, near = h[1], h[5], found[0]
        if near in scores:
            if c.WITH_CONTEXT.get(label):
                scores[node] = clip(scores[node] + c.WITH_CONTEXT[label])
            if c.CONTEXT_THERE.get(label):
                scores[near] = clip(scores[near] + c.CONTEXT_THERE[label])
            said[node] = (near, "present")
        elif label in c.ADDING:
            scores[node] = clip(scores[node] + c.CONTEXT_ADDED[label])
            scores[near] = c.ADDED_SCORE[label]
            added.append(near)
            said[node] = (near, "added")
        else:
            said[node] = (near, "missing")
    last = max(h[2] for h in hits)
    out = {(h[1], h[2], *said.get(h[1], (None, None)), False) for h in hits} | {(n, last + 1 + i, None, None, True) for i, n in enumerate(added)}
    return out, scores


def test_policy_equals_a_walk(spark):
    rnd = random.Random(6)
    names = [f"n{i}" for i in range(14)]
    kinds = {n: rnd.choice(["text", "text", "table", "formula", None]) for n in names}
    edges = sorted({(a, rnd.choice([*c.CONTEXT_RELATIONS, "next_id"]), p, rnd.choice(names)) for a in names for p in range(4)})
    hits, pool = [], {}
    for q in range(60):
        for rank, n in enumerate(rnd.sample(names, rnd.randrange(1, 10)), 1):
            hits.append((q, n, rank, rnd.choice([0.01, 0.3, 0.97]), kinds[n], rnd.choice([None, "other", *c.ADDED_SCORE]), rnd.choice([None, None, rnd.choice(names)])))
        pool |= {(q, n): kinds[n] or "text" for n in names if rnd.random() < 0.7}
    frames = spark.createDataFrame(hits, HITS), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(*k, v) for k, v in pool.items()], "query_id int, node_id string, modality string")
    contexts = c.context_hits(*frames)
    listed = {}
    for r in sorted(contexts.collect(), key=lambda r: r.place):
        listed.setdefault((r.query_id, r.node_id), []).append(r.context_id)
    assert listed == {(h[0], h[1]): f for h in hits if (f := plain_contexts(h, edges, pool))}
    got = c.related_context(frames[0], contexts).collect()
    seen = set()
    for q in range(60):
        want, scores = plain_policy([h for h in hits if h[0] == q], edges, pool)
        mine = [r for r in got if r.query_id == q]
        assert {(r.node_id, r.rank, r.context_id, r.context, r.is_added) for r in mine} == want
        assert all(abs(scores[r.node_id] - r.score_after) < 1e-9 for r in mine)
        seen |= {x[3] for x in want}
    assert seen == {None, "present", "added", "missing"}


def test_no_hits(spark):
    hits, edges = spark.createDataFrame([], HITS), spark.createDataFrame([], EDGES)
    contexts = c.context_hits(hits, edges, hits)
    assert contexts.count() == 0 and c.related_context(hits, contexts).count() == 0
