"""Jaccard components against brute force: large groups, frequent tokens in parts, ids that clash, one row of each."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evidenceframe.llm import common, jaccard_join

SCHEMA = "doc_id long, text string, lang string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(texts):
    """Smallest index that links reach, for each text."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [find(i) for i in range(len(texts))]


def group_of_near_copies(rnd, n, words=80, most=5):
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        mine = list(base)
        for _ in range(rnd.randrange(most)):
            mine[rnd.randrange(words)] = f"x{rnd.randrange(50)}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize(("wide", "id_bits"), [(jaccard_join.WIDE_HEADS, 64), (20, 64), (40, 6)])
def test_large_group_equals_brute_force(spark, wide, id_bits):
    rnd = random.Random(6)
    texts = group_of_near_copies(rnd, 260) + group_of_near_copies(rnd, 60, 40, 9)
    texts += [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(9))) for _ in range(60)] + [None, "", "w0 w1 w2 w3 w4 w5"]
    rnd.shuffle(texts)
    want = roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = jaccard_join.jaccard_components(docs, wide=wide, id_bits=id_bits).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(shingles(t)), want[i]) for i, t in enumerate(texts)}


def test_links_of_a_large_group_grow_with_its_size(spark):
    """Links that go into the components: one a class and few more, not one for each shared token."""
    seen = []

    def counted(links, a="a", b="b"):
        seen.append(links.count())
        return whole(links, a, b)

    whole, common.connected_components = common.connected_components, counted
    try:
        for n in (200, 400):
            texts = group_of_near_copies(random.Random(n), n)
            jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
            assert sum(seen) <= 1.5 * n
            seen.clear()
    finally:
        common.connected_components = whole


def test_near_misses_of_a_large_group_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Classes that share most of a text, each but one with edits of its own: those too far apart to link meet nobody."""
    rnd, n, base = random.Random(3), 240, [f"w{i}" for i in range(130)]
    texts = []
    for i in range(n):
        mine = list(base)
        for at in rnd.sample(range(130), 4 if i % 2 else 1):
            mine[at] = f"own{i}x{at}"
        texts.append(" ".join(mine))
    texts[7] = " ".join(base)
    want, compared, whole = roots(texts), [], jaccard_join.written

    def counted(df, name):
        out = whole(df, name)
        if name in ("opened", "near", "pairs"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(enumerate(want))
    assert len(set(want)) > n // 4
    assert sum(compared) <= 4 * n, compared


def test_components(spark):
    rnd = random.Random(9)
    chain = [(i, i + 1) for i in range(0, 40)] + [(100 - i, 99 - i) for i in range(30)] + [(7, 7)]
    links = chain + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    root = {}
    for a, b in links:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    got = common.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == set(root.items())
    assert common.connected_components(spark.createDataFrame(links, "a long, b long").limit(0)).count() == 0


def test_one_of_each_by_row(spark):
    base = " ".join(f"w{i}" for i in range(30))
    near, other = base.replace("w29", "zz"), " ".join(f"o{i}" for i in range(30))
    rows = [(5, base, "x"), (5, base, "y"), (5, other, "x"), (6, near, "x"), (None, near, "x"), (7, None, "x"), (7, None, "y"), (8, " ", "x"), (None, other + " end", "x"), (None, "alone here in this row", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("mark", "root", "c", "d", "r", "m", "n", "cid", "stays")])
    got = [(r.doc_id, r.text) for r in jaccard_join.keep_one_of_each(docs).collect()]
    want = [(5, base), (5, other), (7, None), (7, None), (8, " "), (None, "alone here in this row")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert jaccard_join.keep_one_of_each(docs).columns == docs.columns
    assert jaccard_join.keep_one_of_each(docs.limit(0)).count() == 0
