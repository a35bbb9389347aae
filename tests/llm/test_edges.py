"""Brute-force versions and odd rows: urls and bytes, short items, scans, ranges, labels of one class."""

import hashlib
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidenceframe.llm import common, decontaminate, fingerprint, line_dedup, quality, secret_scan, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def bytes_docs(spark, rows):
    """Rows (doc_id, bytes) as a table whose texts need not be UTF-8."""
    return spark.createDataFrame(rows, "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")


def test_archives_of_any_url(spark):
    body = "x" * 1200
    rows = [(1, "http://a/\r\nX-Page-ID: 9\r\n\r\nz", body), (2, "u:\u2028 b", body), (3, None, "é"), (3, "k", "é"), (3, "k", "é"), (None, "n", body), (4, "http://a: b", body), (4, "second", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("s"))
    got = warc.round_trip(pages, shard_bytes=100, file_bytes=500)
    got = [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_digest) for r in got.collect()]
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    urls = {(i, warc.CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", u or "")) for i, u, _ in rows}
    assert {(i, u) for i, u, *_ in got} == urls and len(got) == len(rows)
    kinds = Counter((i, k, r, d) for i, _, k, r, d in got)
    assert kinds == Counter({(1, "revisit", 4, digest(body)): 1, (2, "revisit", 4, digest(body)): 1, (None, "revisit", 4, digest(body)): 1, (4, "response", None, digest(body)): 1, (4, "revisit", 4, digest(body)): 1, (3, "response", None, digest("é")): 3})


def test_revisits_name_their_response():
    body = b"y" * 1500
    sha1 = hashlib.sha1(body).digest()
    first, second = (warc.record(kind, i, "u", body, sha1, refers).decode() for kind, i, refers in (("response", 7, None), ("revisit", 3, 7)))
    name = re.search(r"WARC-Record-ID: (\S+)", first)[1]
    assert re.search(r"WARC-Refers-To: (\S+)", second)[1] == name != re.search(r"WARC-Record-ID: (\S+)", second)[1]


def test_shards_divide_every_heavy_range(spark):
    ids = [i * 1000 + j for i in range(150) for j in range(6)]
    pages = spark.createDataFrame([(i, 50) for i in ids], "page_id long, payload_bytes long")
    starts = warc.shards(pages, 100, cells=160)
    cuts = [-1, *starts, 10**9]
    assert max(sum(a <= i < b for i in ids) for a, b in zip(cuts, cuts[1:], strict=False)) <= 2
    assert warc.shards(pages.limit(0), 100) == []


def test_ranges(spark):
    values = [None, -(2**63), -5, 0, 3, 3, 9, 2**63 - 1]
    cuts = [-5, 3, 10]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", common.range_of(F.col("v"), cuts).alias("n")).collect()
    assert [(r.v, r.n) for r in got] == [(v, 0 if v is None else sum(c <= v for c in cuts)) for v in values]


def test_secrets_equal_plain_expressions(spark):
    rnd = random.Random(14)
    bits = ["password", "PASSWD", "api-key", "apikey", "Api_Key", "token", "secret", "'", '"', "=", ":", " ", "  ", "AKIA", "ABCD1234", "Zz9+/_.=-", "hunter22", "deadbeef" * 4, "0af", "é", "\n", "ghp_", "\ufffd"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(300)] + [None, ""]
    kinds = {"assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32)}
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), list(kinds).index(k), f"{k}:{m.start()}:{m.end()}") for k, (e, holds) in kinds.items() for m in re.finditer(e, t or "") if holds(m))
        joined = ",".join(s for *_, s in spans)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in kinds] == [s for *_, s in spans]
    bad = secret_scan.scan_secrets(bytes_docs(spark, [(1, b"\xff\xfe token=abcdefgh12")])).first()
    assert bad.n_assign == 1 and bad.spans == "assign:3:19"


def folded(text):
    once = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", once).split()).encode()


def test_fingerprints_equal_plain_python(spark):
    rnd = random.Random(15)
    rows = [(i * 3, "".join(rnd.choice("ab Ａé\nﬁ") for _ in range(rnd.randrange(9)))) for i in range(80)] + [(30, "z"), (30, "z"), (30, "y"), (None, "q"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).repartition(3)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprint.fingerprint_documents(docs).collect())
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    mark = lambda t: xxhash.xxh3_128_hexdigest(folded(t))
    want = Counter()
    for at, (i, t) in enumerate(rows):
        other = rows[(at + 1) % len(rows)][1]
        whole = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        want[i, len(t), hashlib.sha256(whole.encode()).hexdigest(), mark(t), mark(whole), float(mark(t) == mark(whole)), float(mark(t) == mark(other))] += 1
    assert got == want
    one = fingerprint.fingerprint_documents(bytes_docs(spark, [(1, b"ab\xff")])).first()
    assert one.n_chars == 3 and one.edited_sha256 == hashlib.sha256("aba".encode()).hexdigest() and one.near_next == 1.0


def test_benchmark_items_with_insertions_deletions_and_few_words(spark):
    rnd = random.Random(16)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(i, [word() for _ in range(rnd.randrange(12, 50))]) for i in range(40)]
    docs = []
    for i, words in items:
        for kind in range(3):
            told, k = list(words), len(words) // 4
            for n in range(k):
                at = rnd.randrange(1, len(told) - 1)
                if kind == 0 or (kind == 2 and n % 2):
                    told.insert(at, "zzz")
                else:
                    del told[at]
            docs.append((100 * i + kind, " ".join([word() for _ in range(30)] + told + [word() for _ in range(30)])))
    docs += [(9000, "say good day to all"), (9001, "say good bye to all"), (9002, "good"), (9003, None), (9004, "day good"), (9005, "good good day")]
    bench = [(i, " ".join(w)) for i, w in items] + [(900, "Good day"), (901, None), (902, " ,"), (900, "good day")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    long = {(r.doc_id, r.item_id) for r in got if r.doc_id < 9000}
    assert len(long & {(100 * i + k, i) for i, _ in items for k in range(3)}) >= 0.95 * 120 and all(d // 100 == i for d, i in long)
    assert Counter((r.doc_id, r.item_id, r.edits, r.start_word, r.end_word) for r in got if r.doc_id >= 9000) == Counter({(9000, 900, 0, 1, 3): 2, (9005, 900, 0, 1, 3): 2})
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs[-6:], "doc_id long, text string"), spark.createDataFrame(bench[-4:], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {9001, 9002, 9003, 9004}


def test_lines_at_the_ratio_and_clashing_columns(spark):
    rows = [(i, f"line {i}\n" + ("tenth" if i < 2 else "x") + f"{'' if i < 2 else i}", "en", "a", 0) for i in range(20)] + [(50, "only page", "en", "b", 0), (51, "two\nfirst", "en", "c", 0), (52, "two\nsecond", "en", "c", 0), (53, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(7).alias("n_lines"), F.lit(8).alias("n_dropped"), F.lit(9).alias("host"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.host) for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[0] == ("line 0\ntenth", 2, 0, 9)  # 2 of 20 pages are not more than a tenth
    assert got[50] == ("only page", 1, 0, 9) and got[51] == ("first", 2, 1, 9) and got[53] == (None, 0, 0, 9)
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, ratio=0.09).collect()}[0] == "line 0"


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(i, 1, 0) for i in range(40)], [(i, 0, 1) for i in range(40)], [(i, None, None) for i in range(40)], [(None, 1, 1)] + [(i, i % 2, i % 2) for i in range(3)]])
def test_scores_with_few_labels(spark, labels):
    docs = spark.createDataFrame([(i, f"some words {i % 5} here" * (i % 3), "en", "s", 0) for i in range(40)] + [(None, None, None, None, None), (3, "again", "en", "s", 0)], DOCS)
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("score", "toxic", "quality", "held_out", "positive", "drawn", "m0")])
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for scored in (quality.score_quality(docs, truth), toxicity.score_toxicity(docs, truth)):
        rows = scored.collect()
        assert len(rows) == 42 and all(0 <= r.score <= 1 for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert toxicity.drop_toxic(docs, truth).columns == docs.columns and toxicity.score_toxicity(docs.limit(0), truth).count() == 0


def test_toxic_documents_go_and_the_risk_falls(spark):
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(20)) + (" vile nasty" if i % 5 == 0 else ""), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    truth = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity.drop_toxic(docs, truth).collect()} == {i for i in range(400) if i % 5}
    # the features by plain counting, and a risk that ends below where it starts
    present = [set(toxicity.Features().present(t.encode())) for _, t, *_ in rows]
    pos, unl = [p for i, p in enumerate(present) if i % 5 == 0], present
    count = lambda sets: np.bincount(np.concatenate([np.fromiter(s, np.int64) for s in sets]), minlength=1 << toxicity.BITS)
    good = toxicity.marking(count(pos), count(unl), len(pos), len(unl))
    assert set(good.tolist()) == {f for w in (b"vile", b"nasty") for f in toxicity.features_of(w)}
    arrays = [[np.array(sorted(s), np.uint32) for s in sets] for sets in (pos, unl)]
    model = toxicity.fit(*arrays, 0.2, good)

    def risk(score):
        plus, minus = (lambda s: float(np.logaddexp(0, -s))), (lambda s: float(np.logaddexp(0, s)))
        z = lambda s: score(s)
        return 0.2 * np.mean([plus(z(s)) for s in pos]) + max(0.0, np.mean([minus(z(s)) for s in unl]) - 0.2 * np.mean([minus(z(s)) for s in pos]))

    assert risk(lambda s: model.bias + sum(model.weights.get(f, 0.0) for f in s)) < 0.5 * risk(lambda s: np.log(0.25))


def test_tokens_that_begin_again_and_again_are_linear():
    began = time.time()
    words = secret_scan.automaton()
    for text in ("eyJ" * 350_000, "eyJ" * 200_000 + "." + "eyJ" * 150_000, "eyJa." * 200_000, "token" * 200_000, "password" + " " * 1_000_000, "AKIA" * 250_000, "ghp_" * 250_000, "-----BEGIN A" * 90_000):
        secret_scan.spans_of(text, text.lower(), words)
    assert time.time() - began < 16


def test_tokens_after_a_failed_beginning():
    head = secret_scan.base64.urlsafe_b64encode(b'{"alg":"x"}').decode().rstrip("=")
    text = f"eyJeyJabc {head}.a.b eyJx.eyJy {head}.c.d eyJ.{head}.e.f"
    found = [text[a:b] for a, kind, b in secret_scan.spans_of(text, text.lower(), secret_scan.automaton()) if kind == "jwt"]
    assert found == [f"{head}.a.b", f"{head}.c.d", f"{head}.e.f"]


def test_archives_on_any_path(spark, tmp_path):
    """A bare path, and one with a scheme, are the same folder on the default file system."""
    pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "v", "x" * 2000)], "page_id long, url string, html string")
    for folder in (f"{tmp_path}/bare", f"file://{tmp_path}/whole"):
        got = warc.read_warc(warc.write_warc(pages, folder), folder).collect()
        assert sorted((r.page_id, r.record_type) for r in got) == [(1, "revisit"), (2, "response")]
    assert warc.qualified(spark, "/a/b").startswith("file:/") and (tmp_path / "bare").is_dir() and (tmp_path / "whole").is_dir()


def test_archives_of_null_ids_alone(spark):
    pages = spark.createDataFrame([(None, "u", "x" * 3000), (None, "v", None), (None, "u", "x" * 3000)], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert sorted(r.payload_bytes for r in got) == [0, 3000, 3000] and {r.page_id for r in got} == {None}
