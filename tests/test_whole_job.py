import random

import pytest

from evidenceframe.operators import evidence, metrics
from evidenceframe.plans.retrieval import Corpus


def test_relevance_needs_the_whole_passage(spark, tmp_path):
    opening = "the same opening words of a passage " * 3
    passage = opening + "and then its own end"
    docs = [(1, f"before {passage} after"), (2, f"before {opening}and then another end"), (3, "nothing"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, opening + "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in Corpus(spark, str(tmp_path)).relevant().collect()] == [(7, 1)]


def region_truth(hits, regions, counted=0.1):
    """The reference's bbox metrics of one case: hits (page, box), regions (page, box)."""

    def common(a, b):
        c = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
        return c if c[2] > c[0] and c[3] > c[1] else None

    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    cells = lambda b: {(x, y) for x in range(b[0], b[2]) for y in range(b[1], b[3])}
    best = []
    for page, box in hits:
        shared = [(size(c) if (c := common(box, other)) else 0, size(other)) for p, other in regions if p == page]
        best.append(max((i / (size(box) + n - i) for i, n in shared), default=0.0))
    p = sum(v > counted for v in best) / len(best)
    covered = sum(len(set().union(*[cells(c) for q, box in hits if q == page and (c := common(box, other))])) for page, other in regions)
    r = covered / sum(size(other) for _, other in regions)
    f1 = 2 * p * r / (p + r) if p + r else 0.0
    return [float(covered > 0), p, r, f1, p, r, f1, max(best)]


def test_region_areas_equal_brute_force(spark):
    rnd = random.Random(6)

    def box():
        x, y = rnd.randrange(2, 30), rnd.randrange(2, 30)
        return [x, y, x + rnd.randrange(1, 20), y + rnd.randrange(1, 20)]

    cases = {i: ([(rnd.randrange(2), box()) for _ in range(rnd.randrange(1, 6))], [(rnd.randrange(2), box()) for _ in range(rnd.randrange(1, 5))]) for i in range(25)}
    cases[90] = [(1, [100, 100, 300, 300]), (1, [700, 700, 900, 900])], [(1, [120, 120, 280, 280])]
    cases[91] = [(1, [0, 0, 50, 100]), (1, [50, 0, 100, 100])], [(1, [0, 0, 100, 100])]
    rows = lambda k: [(c, n, p, [float(v) for v in b]) for c, both in cases.items() for n, (p, b) in enumerate(both[k])]
    kind = "case_id long, {} long, page int, box array<double>"
    hits = spark.createDataFrame([*rows(0), (95, 0, 1, [1.0, 1.0, 9.0, 9.0]), (97, 0, 1, [1.0, 1.0, 2000.0, 9.0])], kind.format("hit_id"))
    regions = spark.createDataFrame([*rows(1), (96, 0, 1, [1.0, 1.0, 9.0, 9.0]), (97, 0, 1, [1.0, 1.0, 9.0, 9.0])], kind.format("region_id"))
    got = {r[0]: list(r[1:]) for r in metrics.region_areas(hits, regions).collect()}
    for i, (h, s) in cases.items():
        assert got[i] == pytest.approx(region_truth(h, s), abs=1e-6)
    assert got[90][1:4] == pytest.approx([0.5, 1.0, 2 / 3], abs=1e-6) and got[91][1:3] == [1.0, 1.0]
    assert got[95] == got[96] == got[97] == [None] * 8


def test_gate_slots_weights_and_conflicts(spark):
    asked = {1: "alpha on page 3", 2: "alpha on page 9", 3: "alpha in 2021", 4: "alpha in 1999", 5: "b.pdf", 6: "z.pdf", 7: "is alpha supported", 8: "how many alpha", 9: "alpha", 10: "chart of alpha", 11: "is alpha so"}
    hit = lambda q, n, t: (q, f"n{n}", f"{'ab'[n]}.pdf", 0.8, n + 1, t, 3)
    texts = {q: ("alpha in 2021", "alpha") for q in asked} | {7: ("alpha yes", "alpha not"), 8: ("alpha 10", "alpha 20"), 11: ("alpha true, not false", "alpha")}
    hits = spark.createDataFrame([hit(q, n, t) for q, both in texts.items() for n, t in enumerate(both)], "query_id long, node_id string, source string, score double, rank int, text string, page int")
    routes = spark.createDataFrame([(9, "vector", "n0", "a.pdf"), (9, "vector", "n1", "b.pdf"), (9, "bm25", "n1", "b.pdf"), (9, "bm25", "n2", "c.pdf")], "query_id long, channel string, node_id string, source string")
    got = {r.query_id: r for r in evidence.gate(spark.createDataFrame(list(asked.items()), "query_id long, text string"), hits, routes=routes).collect()}
    missing = {2: ["page"], 4: ["numeric"], 6: ["source"], 10: ["modality:image"]}
    assert {q: r.missing_slots for q, r in got.items()} == {q: missing.get(q, []) for q in asked}
    assert {q for q, r in got.items() if r.decision == "refuse"} == set(missing)
    assert [got[q].conflict_level for q in (7, 8, 9, 11)] == ["medium", "medium", "none", "high"]
    # rerank is left out: the other six weights add up to 0.9
    score = lambda consistency, slots, keyword, factor: round((0.3 * 0.8 + 0.2 * 0.8 + 0.15 * consistency + 0.1 + 0.1 * slots + 0.05 * keyword) / 0.9 * factor, 4)
    assert got[9].support_score == pytest.approx(score(0.5, 1, 1, 1), abs=1e-4)
    assert got[2].support_score == pytest.approx(score(0.5, 0, got[2].keyword_coverage, 1), abs=1e-4)
    assert got[7].support_score == pytest.approx(score(0.5, 1, got[7].keyword_coverage, 0.95), abs=1e-4)
    assert got[11].support_score == pytest.approx(score(0.5, 1, got[11].keyword_coverage, 0.9), abs=1e-4)
