import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["chk01_sliding_chunks", "lex03_bm25_topk", "vec01_cosine_topk", "scr01_composite", "join01_expand", "met01_ranking_metrics"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, DIR).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
