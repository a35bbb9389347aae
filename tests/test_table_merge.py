"""Tables as one, against plain walks over the blocks and nodes of each document."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from evidenceframe.operators import table_merge as t
from evidenceframe.operators.layout import SOURCE_PRIORITY

BLOCKS = "source string, ord int, block_id string, text string, page int, box array<double>, source_kind string, raw_type string"
NODES = "source string, doc_id string, node_id string, chunk_index int, modality string, text string, page int, section string, page_source string, source_kind string, raw_type string, structured_duplicates int"
TABLES = ["| a | b |\n| --- | :-: |\n| 1 | 2 |", "|a|b|\n|---|---|\n| 1|2 |", "| a | b |\n| 1 | 3 |", "plain text", "plain  text", "", None]


def near(a, b):
    if a is None or b is None:
        return True
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return (u > 0 and i / u >= 0.8) or max(abs(x - y) for x, y in zip(a, b, strict=True)) <= 2


def mark(text):
    rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in (text or "").splitlines() if "|" in x]
    rows = [r for r in rows if not all(c and set(c) <= set("-: ") for c in r)]
    return "\n".join("|".join("".join(c.split()) for c in r) for r in rows) if rows else "".join((text or "").split())


def chart(b):
    return "chart" in (b[7] or "").lower() or "chart" in (b[6] or "").lower()


def plain_blocks(blocks, keep_charts):
    kept = []
    for b in sorted(blocks, key=lambda b: (b[0], b[1])):
        for c in kept if mark(b[3]) else ():
            a = c["best"]
            if a[0] != b[0] or mark(a[3]) != mark(b[3]) or (keep_charts and (chart(a) or chart(b))) or (a[4] and b[4] and a[4] != b[4]) or not near(a[5], b[5]):
                continue
            other = a[6] != b[6] or (a[7] and b[7] and a[7] != b[7] and not chart(a) and not chart(b)) or len(c["ids"]) > 1
            if a[5] or b[5] or bool(a[4] or a[5]) != bool(b[4] or b[5]) or other:
                c["ids"].append(b[2])
                key = lambda x: (x[4] is not None, x[5] is not None, SOURCE_PRIORITY.get(x[6] or "unknown", 10), len(x[3] or ""))
                c["best"] = b if key(b) > key(a) else a
                break
        else:
            kept.append({"best": b, "ids": [b[2]], "first": b[1]})
    return {(c["best"][0], c["best"][2], len(c["ids"]), frozenset(c["ids"]), c["first"]) for c in kept}


def test_blocks_equal_a_walk(spark):
    rnd = random.Random(4)
    boxes = [None, [0.0, 0.0, 100.0, 50.0], [1.0, 1.0, 101.0, 51.0], [0.0, 0.0, 100.0, 45.0], [300.0, 0.0, 400.0, 50.0], [3.0, 3.0, 104.0, 54.0]]
    blocks = [(f"s{i % 12}", i, f"b{i}", rnd.choice(TABLES), rnd.choice([None, 1, 1, 2]), rnd.choice(boxes), rnd.choice([None, "layout", "content_list", "model"]), rnd.choice([None, "table", "table_body", "chart"])) for i in range(360)]
    for keep in (True, False):
        got = t.coalesced_blocks(spark.createDataFrame(blocks, BLOCKS), keep).collect()
        assert {(r.source, r.block_id, r.duplicates, frozenset(r.merged_ids), r.first_ord) for r in got} == plain_blocks(blocks, keep)
        assert all(r.merged_ids[0] == r.block_id for r in got) and sum(len(r.merged_ids) for r in got) == len(blocks) and max(r.duplicates for r in got) > 2


def plain_nodes(nodes):
    kept, at = [], {}
    for n in sorted(nodes, key=lambda n: n[3]):
        text = n[5] or ""
        key = mark(text) if "|" in text else None
        rows = tuple(tuple(c.strip() for c in x.strip().strip("|").split("|")) for x in text.splitlines() if "|" in x)
        rows = tuple(r for r in rows if not all(c and set(c) <= set("-: ") for c in r))
        if n[4] != "table" or "chart" in (n[10] or "") or not rows or key is None:
            kept.append([n, []])
            continue
        key = (n[0], n[1], rows)
        if key not in at:
            at[key] = len(kept)
            kept.append([n, []])
            continue
        old, merged = kept[at[key]]
        quality = lambda x: (x[6] is not None, x[8] == "structured", x[11] or 0, bool(x[7]), -x[3])
        kept[at[key]] = [n, [old[2], *merged]] if quality(n) > quality(old) else [old, [*merged, n[2]]]
    return {(n[2], tuple(m)) for n, m in kept}


def test_nodes_equal_a_walk(spark):
    rnd = random.Random(2)
    nodes = [(f"s{i % 5}", "d", f"n{i}", i, rnd.choice(["table", "table", "table", "text"]), rnd.choice(TABLES), rnd.choice([None, 1]), rnd.choice([None, "", "x"]), rnd.choice([None, "structured"]), rnd.choice([None, "layout"]), rnd.choice([None, "chart_body"]), rnd.choice([None, 1, 3])) for i in range(150)]
    got = t.coalesced_nodes(spark.createDataFrame(nodes, NODES)).collect()
    assert {(r.node_id, tuple(r.merged_ids)) for r in got} == plain_nodes(nodes)
    by = {n[2]: n for n in nodes}
    for r in got:
        assert [o.node_id for o in r.occurrences] == r.merged_ids and all(o.page == by[o.node_id][6] for o in r.occurrences) and r.duplicates == 1 + len(r.merged_ids)
        counts = [by[i][11] for i in (r.node_id, *r.merged_ids)]
        most = max(c or 1 for c in counts)
        assert r.structured_duplicates == (most if most > 1 or counts[0] is not None else None)


def test_html_tables_are_their_markdown(spark):
    texts = ["<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n|---|---|\n| 1 | 2 |", "no table", "| --- | --- |", None]
    got = [r.k for r in spark.createDataFrame([(x,) for x in texts], "x string").select(t.content_key(F.col("x")).alias("k")).collect()]
    assert got[0] == got[1] == '[["a","b"],["1","2"]]' and got[2:] == [None] * 3


def test_blocks_alone_in_their_group_are_not_walked(spark):
    """Of a batch only its ends and the groups of several blocks are."""
    blocks = [("s", i, f"b{i}", f"| {i} |" if i < 297 else "| x |", None, None, "layout", "table") for i in range(300)]
    got = t.coalesced_blocks(spark.createDataFrame(blocks, BLOCKS).coalesce(1)).collect()
    assert sum(len(r.merged_ids) for r in got) == 300 and {r.block_id for r in got if r.first_ord < 297} == {f"b{i}" for i in range(297)}
    single = t._singles(pa.RecordBatch.from_pydict({"source": ["a", "a", "a", None, None, "b", "b", "c"], "mark": ["1", "2", "2", "2", "3", "3", "4", "4"]}))
    assert single.tolist() == [False, False, False, True, True, True, True, False]
