import random
import re

from pyspark.sql import functions as F

from evidenceframe.operators import layout, relevance, splitting, variants
from evidenceframe.settings import Settings
from evidenceframe.sources import history

LIMIT = 70
WIDTH = max(256, 4 * LIMIT)


def size(x):
    return max(1, len(x) // 4)


def cut(text, units):
    """Greedy packing by the given (separator, splitter) units, then windows."""
    text = text.strip()
    if not units:
        return [w for w in (text[i : i + WIDTH].strip() for i in range(0, len(text), WIDTH)) if w]
    (sep, pattern), rest = units[0], units[1:]
    pieces = [p.strip() for p in re.split(pattern, text) if p.strip()]
    if len(pieces) < 2:
        return cut(text, rest)
    out, now = [], None
    for p in pieces:
        longer = p if now is None else now + sep + p
        if size(longer) <= LIMIT:
            now = longer
        elif now is None:
            out += cut(p, rest)
        else:
            out.append(now)
            now = p
    return out + ([now] if now is not None else [])


def brute(text):
    text = (text or "").strip()
    if not text:
        return []
    if size(text) <= LIMIT:
        return [text]
    parts = cut(text, [("\n\n", r"\n\s*\n+"), (" ", r"(?<=[。！？!?\.])\s+|\n")])
    return [x for p in parts if p.strip() for x in ([p.strip()] if size(p.strip()) <= LIMIT else cut(p, []))]


def test_hard_split_equals_brute_force(spark):
    rng = random.Random(5)
    bits = ["alpha beta gamma", "x" * 400, "Stop here. And go!", "\n", "\n\n", "\n \n\n", "数据。 好", "w " * 90, "?", " "]
    texts = [None, "", "  \n ", "short"] + ["".join(rng.choice(bits) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.p for r in rows.select("i", splitting.hard_split(F.col("text"), s=Settings(split_tokens=LIMIT)).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]
    assert all(size(p) <= LIMIT for parts in got.values() for p in parts)


def test_table_split_repeats_the_header(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'v' * 40} |" for i in range(30))
    got = spark.createDataFrame([(table,)], "t string").select(splitting.hard_split(F.col("t"), True, Settings(split_tokens=LIMIT)).alias("p")).first().p
    assert len(got) > 3 and all(p.startswith("| a | b |\n| --- | --- |\n") and size(p) <= LIMIT for p in got)
    assert [line for p in got for line in p.split("\n")[2:]] == table.split("\n")[2:]


def test_spec_match_once_equals_brute_force(spark):
    rng = random.Random(3)
    hits = [(q, r, f"n{rng.randint(0, 4)}", f"d{rng.randint(0, 3)}", rng.choice([None, 1, 2, 3]), rng.choice(["Report A", "report-b", None])) for q in range(40) for r in range(1, rng.randint(2, 9))]
    specs = [(q, i, rng.choice([None, "", "N1", "d2"]), rng.choice([None, 1, 3]), rng.choice([None, "report", "A"]), rng.choice([None, 1.0, 2.0, 3.0])) for q in range(40) for i in range(rng.randint(0, 5))]
    plain = lambda x: re.sub(r"\W+", "", str(x or "")).lower()

    def met(h, s):
        stated = [x for x in s[2:5] if x not in (None, "")]
        inside = plain(s[4]) in plain(h[5]) or plain(h[5]) in plain(s[4])
        return bool(stated) and (not s[2] or plain(s[2]) in (plain(h[2]), plain(h[3]))) and (s[3] is None or h[4] is not None and abs(h[4] - s[3]) <= 1) and (not s[4] or bool(h[5]) and inside)

    for once in (False, True):
        want, used = {}, set()
        for h in sorted(hits, key=lambda h: h[:2]):
            ok = [((s[5] or 1.0), -s[1]) for s in specs if s[0] == h[0] and met(h, s) and not (once and (h[0], s[1]) in used)]
            grade, index = max(ok, default=(0.0, None))
            used.add((h[0], -index if ok else None))
            want[h[:2]] = (-index if ok else None, grade)
        a = spark.createDataFrame(hits, "query_id int, rank int, node_id string, doc_id string, page int, source string")
        b = spark.createDataFrame(specs, "query_id int, spec_idx int, spec_id string, spec_page int, spec_source string, grade double")
        assert {(r.query_id, r["rank"]): (r.spec_idx, r.grade) for r in relevance.graded(a, b, 1, once).collect()} == want


def test_headings_reach_the_next_text_only(spark):
    kinds = [("text", "t"), ("heading", "A"), ("heading", " "), ("text", "u"), ("text", "v"), ("heading", "B"), ("table", "x"), ("text", "w")]
    rows = spark.createDataFrame([("s", i, f"b{i}", k, t) for i, (k, t) in enumerate(kinds)], "source string, ord int, block_id string, type string, text string")
    got = layout.heading_context(layout.title_regions(rows)).orderBy("ord").collect()
    assert [r.heading_text for r in got] == [None, None, None, "A", None, None, None, None]
    assert [r.title_region for r in got] == [None, 1, 1, 1, 1, 2, 2, 2]
    assert layout.heading_context(rows.limit(0)).count() == 0


def test_history_round_trip(spark, tmp_path):
    folder = str(tmp_path / "history")
    for at, q in [(1, "a"), (2, "b"), (3, "a")]:
        history.append_history(spark.createDataFrame([(q, at, f"question {at}", "[]")], history.HISTORY), folder)
    records = history.read_history(spark, folder)
    assert {(r.query_id, r.at) for r in history.latest_records(records, "query_id").collect()} == {("a", 3), ("b", 2)}
    assert [r.at for r in history.latest_records(records).collect()] == [3]
    history.truncate_history(spark, folder)
    assert history.read_history(spark, folder).count() == 0
    assert history.latest_records(history.read_history(spark, folder)).count() == 0


def test_results_keep_the_last_line(spark, tmp_path):
    path = tmp_path / "results.jsonl"
    path.write_text('# note\n{"case_id": "1", "answer": "x"}\n\n{"id": "2", "result": {"answer": "y"}}\n{"case_id": "1", "answer": "z"}\n')
    got = history.read_results(spark, str(path), "answer string").collect()
    assert {(r.case_id, r.answer) for r in got} == {("1", "z"), ("2", "y")}


def test_query_variants(spark):
    asked = [(1, "  What is the\nflow?  "), (2, "Σ_{eff} in Fig. 3 of Café"), (3, "Which grant supported Deep-Sea work"), (4, " "), (5, None), (6, "πάθη ~5")]
    rows = variants.query_variants(spark.createDataFrame(asked, "query_id int, text string")).orderBy("query_id", "variant").collect()
    got = {q: [r.text for r in rows if r.query_id == q] for q in range(1, 7)}
    assert got[1] == ["What is the flow?", "What the flow"]
    assert got[2][0] == "Σ_{eff} in Fig. 3 of Café" and got[2][1] == "Sigma _{eff} in Fig. 3 of Cafe"
    assert got[2][3] == "figure fig caption plot curve Sigma 3"
    assert got[3] == ["Which grant supported Deep-Sea work", "funding financially supported program grant acknowledgement Deep-Sea"]
    assert got[4] == [] and got[5] == []
    assert got[6][1] == "pi alpha theta η approximately 5"
    x = spark.createDataFrame([("x_{1} y_2",)], "t string").select(variants.plain_symbols(F.col("t")).alias("p")).first().p
    assert x == "x_1 x 1 y_2 y 2"


def test_anchors(spark):
    rows = spark.createDataFrame([("What does Model-X2 in The Nature study of sigma say",), (None,)], "t string")
    got = rows.select(variants.anchors(F.col("t")).alias("a"), variants.anchors(F.col("t"), False).alias("b")).collect()
    assert got[0].a == ["model-x2", "sigma", "nature"] and set(got[0].b) == {"model-x2", "sigma", "nature", "study"}
    hits = rows.select(variants.anchors(F.col("t")).alias("anchors"), F.lit("The Σ term").alias("text"))
    assert [r.shares_anchor for r in variants.with_shared_anchor(hits).collect()] == [True, False]
