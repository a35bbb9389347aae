"""The mix by row: copies against a plain version, repeated and null ids, clashing names, sources at their cap."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidenceframe.llm import common, source_mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def targets_of(rows):
    """Targets by source: shares by weight, at most three times the source, the excess to the others."""
    size = Counter()
    for _, text, _, source, _ in rows:
        size[source] += size_of(text)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total, full = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, sum(size.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (total - sum(3 * size[s] for s in full)) / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            return {s: 3.0 * size[s] if s in full else weight[s] * level for s in names}
        full |= over


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    text = lambda n: " ".join(rnd.choice("abcdefgh") for _ in range(n))
    out = [(i, text(rnd.randrange(60)), "en", rnd.choice(["a", "b", "c", None]), 0) for i in range(160)]
    out += [(None, text(rnd.randrange(1, 14)), "en", "a", 0) for _ in range(40)]
    out += [(500, "same words here", "en", "b", 0)] * 37 + [(7, "other text of a repeated id", "en", "c", 0), (8, None, "en", "c", 0), (9, "", "en", "tiny", 0), (10, "one", "en", "tiny", 0)]
    return out


def test_copies_by_row(spark, rows):
    extra = ("copy", "copies", "size", "s", "z", "h", "cut", "each", "rate", "target")
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in extra])
    mixed = source_mix.mix(docs).collect()
    want, taken = targets_of(rows), Counter()
    assert Counter((r.doc_id, r.source, r.size) for r in mixed) == Counter((i, s, size_of(t)) for i, t, _, s, _ in rows)
    for r in mixed:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, w in want.items():  # no document of one word has room where a gap is left
        assert abs(taken[s] - w) < max(2, 0.01 * w)
    # larger documents never have a lower rate in a source that grows, nor a higher one in one that shrinks
    rates = defaultdict(dict)
    for r in mixed:
        rates[r.source][r.size] = r.rate
    for s, by in rates.items():
        values = [by[z] for z in sorted(by) if z]
        assert values == sorted(values) or values == sorted(values, reverse=True), s
    again = source_mix.mixed_documents(docs)
    assert again.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    copies = Counter((r.doc_id, r.text, r.source) for r in again.collect())
    by_mix = Counter()
    texts = defaultdict(list)
    for i, t, _, s, _ in rows:
        texts[i, s, size_of(t)].append(t)
    for r in mixed:
        by_mix[r.doc_id, r.source, r.size] += r.copies
    assert Counter({k: n for k, n in by_mix.items() if n}) == sum((Counter({(i, s, size_of(t)): n}) for (i, t, s), n in copies.items()), Counter())
    assert all(n <= 3 * sum(x[0] == i and x[1] == t for x in rows) for (i, t, _), n in copies.items())
    numbered = Counter((r.doc_id, r.text, r.copy) for r in again.collect())
    assert all(numbered[i, t, 1] >= numbered[i, t, 2] >= numbered[i, t, 3] for i, t, _ in numbered)


def test_reruns_agree_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    runs = [sorted(map(str, source_mix.mix(docs.repartition(n)).collect())) for n in (1, 3)]
    assert runs[0] == runs[1]
    assert source_mix.mix(docs.limit(0)).count() == source_mix.mixed_documents(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], DOCS)
    assert [(r.size, r.target, r.taken) for r in source_mix.mix(only).collect()] == [(0, 0.0, 0)] * 2


def test_work_tables_go(spark, tmp_path):
    import os

    with common.scratch(spark):
        path = common.work_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert os.path.exists(path)
    assert not os.path.exists(path)
