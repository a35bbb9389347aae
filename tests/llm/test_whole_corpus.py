import itertools
import random
from collections import Counter, defaultdict

import pytest

from evidenceframe.llm import jaccard_join


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_links_below_fifty_percent(spark):
    docs = []
    for i in range(0, 40, 2):
        same = [f"s{i}_{k}" for k in range(22)]
        docs += [(i + n, " ".join(same + [f"d{i + n}_{k}" for k in range(18)])) for n in range(2)]
    a, b = (shingles(t) for _, t in docs[:2])
    assert 30 <= 100 * len(a & b) / len(a | b) < 50
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), percent=30).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 2) for i, _ in docs}


def without_site_lines(docs):
    pages, seen = Counter(d.source for d in docs), Counter()
    for d in docs:
        seen.update({(d.source, x.strip()) for x in d.text.split("\n")} - {(d.source, "")})
    gone = {k for k, n in seen.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    return {d.doc_id: "\n".join(x for x in d.text.split("\n") if (d.source, x.strip()) not in gone) for d in docs}


def without_near_copies(docs):
    sets, root = {d.doc_id: shingles(d.text) for d in docs}, {d.doc_id: d.doc_id for d in docs}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_pipeline_stages_equal_plain_python(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [prose(30) for _ in range(4)]
    rows, leaks, toxic = [], set(), set()
    for i in range(480):
        text = prose(40)
        if i % 4 == 0:
            toxic.add(i)
            text += " vilewords nastyterm" * 3
        elif i % 31 == 0:
            leaks.add(i)
            told = items[i % 4].split()
            told[i % 30] = "zzz"
            text += " " + " ".join(told)
        elif i % 13 == 0:
            text = rows[i - 3 if (i - 3) % 4 else i - 2][1].split("\n")[-1] + " end"
        rows.append((i, (f"menu of s{i % 3}\n" if i % 2 else "") + text, "en", f"s{i % 3}"))
    rows = [(*r, len(r[1])) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(480)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    have, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for at, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        have.append(docs.collect())
    ids = [{d.doc_id for d in x} for x in have]
    assert len(ids[0] ^ (set(range(480)) - toxic)) <= 5
    want = without_site_lines(have[0])
    assert {d.doc_id: d.text for d in have[1]} == want and sum(want[d.doc_id] != d.text for d in have[0]) > 100
    assert all(d.n_chars == len(d.text) for d in have[1])
    assert ids[2] == without_near_copies(have[1]) < ids[1]
    assert ids[3] == ids[2] - leaks < ids[2]
    assert {d.doc_id: d.text for d in have[3]}.items() <= want.items()
    size, taken, copies = Counter(), Counter(), defaultdict(set)
    for d in have[3]:
        size[d.source] += len(d.text.split())
    for d in have[4]:
        taken[d.source] += len(d.text.split())
        copies[d.doc_id].add(d.copy)
        assert want[d.doc_id] == d.text
    assert ids[4] <= ids[3] and all(c == set(range(1, len(c) + 1)) and len(c) <= 3 for c in copies.values())
    assert sum(map(len, copies.values())) == len(have[4])
    for k, weight in (("s0", 1), ("s1", 2), ("s2", 3)):  # no source reaches three times its size
        assert abs(taken[k] - sum(size.values()) * weight / 6) <= 0.1 * taken[k] + 20
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, have[4]))
