"""Stages of the pipeline on nulls, repeated rows, empty tables and columns with clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(pipeline.STAGES)
EXTRA = ("copy", "copies", "n_lines", "n_dropped", "score", "host", "mark", "root", "cid", "size", "s", "z", "h", "each", "positive")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    base = " ".join(f"w{i}" for i in range(30))
    item = "one two three four five six seven eight nine ten"
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (1, "other text of the same id", "en", "a", 2), (2, base.replace("w29", "zz"), "en", "b", 3), (None, base, "en", None, None), (None, None, None, None, None), (3, "", "en", "a", 0)]
    rows += [(4, f"see {item} here", "en", "a", 4), (5, "menu\nfirst", "en", "c", 5), (6, "menu\nsecond one", "en", "c", 6), (7, "long " * 30_000, "en", "d", 7)]
    rows += [(20 + i, f"plain words number {i} of a row" + (" vilest" if i % 5 == 0 else ""), "en", "e", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(20, 220)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "a b"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)]), folder


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, odd, name):
    docs, wide, folder = odd
    plain, more = STAGES[name](spark, docs, folder), STAGES[name](spark, wide, folder)
    got = texts(plain)
    have = texts(docs)
    if name == "source mix":
        assert plain.columns == [*docs.columns, "copy"] and more.columns == [c for c in wide.columns if c != "copy"] + ["copy"]
        assert all(n <= 3 * have[k] for k, n in got.items()) and set(got) <= set(have)
    else:
        assert plain.columns == docs.columns and more.columns == wide.columns
        values = {tuple(r[c] for c in EXTRA) for r in more.collect()}
        assert values == {tuple(range(len(EXTRA)))}
    assert texts(more) == got
    base = next(k for k in have if k[0] == 1 and k[1].startswith("w0"))
    if name == "toxicity":
        assert {k for k in have if k not in got} == {k for k in have if k[1] and "vilest" in k[1]}
        assert all(got[k] == have[k] for k in got)
    elif name == "line dedup":
        want = Counter({(i, {"menu\nfirst": "first", "menu\nsecond one": "second one"}.get(t, t)): n for (i, t), n in have.items()})
        want[1, ""] = want.pop(base)  # a line that two of five pages share goes as well
        assert got == want
    elif name == "n-gram Jaccard join":
        assert got[base] == 1 and (None, base[1]) not in got and not any(i == 2 for i, _ in got)
        assert got[1, "other text of the same id"] == got[None, None] == got[3, ""] == 1
    elif name == "benchmark decontamination":
        assert have - got == Counter({k: n for k, n in have.items() if k[0] == 4})
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0
