"""Spelling variants, centroid clustering and language identification against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenceframe.llm import kmeans, language_id, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [(1, None, None, None, None), (None, "abcdef abcdef abcdef abcdeg", "en", "s", 13), (2, "", "en", "s", 0), (3, " \n\t 12 --", "en", None, 4), (4, "wordy " * 60_000, "en", "s", 1)]
    rows += [(5, "xyzxyz", "fr", "s", 5)] * 3 + [(6, "a" * 200_000, None, "s", 1)]
    extra = ("word", "n", "part", "kind", "key", "form", "root", "count", "held_out", "score", "below", "places")
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in extra])


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs):
    """Rows of spelling_variants in plain Python: all pairs."""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    close = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if near(a, b):
            close[a].append(b)
            close[b].append(a)
    best = {w: min(o, key=lambda x: (-words[x], x)) for w, o in close.items() if o}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(close[w]), words[form[w]] if w in form else None) for w, c in words.items()}


def some_words(seed, number):
    """Words over few letters with many one edit apart, equal runs and one long common beginning."""
    rnd = random.Random(seed)
    out = set()
    while len(out) < number:
        w = rnd.choice(["", "aaaa", "abababab", "ünder"]) + "".join(rnd.choice("abéÉß") for _ in range(rnd.randrange(3, 7)))
        out |= {w, w + rnd.choice("ab"), w[:-1] + "c"}
    return sorted(w for w in out if len(w) >= spelling.MIN_LENGTH)


def test_spelling_equals_brute_force(spark):
    rnd = random.Random(5)
    words = some_words(1, 260)
    docs = [(i, ", ".join(rnd.choice(words).title() if rnd.random() < 0.2 else rnd.choices(words, [1 + 40 * (k % 7 == 0) for k in range(len(words))])[0] for _ in range(60))) for i in range(80)]
    got = {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == variants(docs) and sum(r[1] is not None for r in got) > 50 and any(r[1] and r[1] != r[2] for r in got)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_merging_finds_each_pair_once(parts):
    """Pairs within ranges, between ranges and under divided nodes together are all pairs, each once."""
    words = some_words(parts, 150)
    n = {w: 3 + i % 11 for i, w in enumerate(words)}
    cuts, heavy = spelling.cuts_of(words, parts)
    assert cuts == sorted(set(cuts)) and len(cuts) <= parts - 1 or not cuts
    ends = [0, *[next((i for i, w in enumerate(words) if w >= c), len(words)) for c in cuts], len(words)]
    count, groups = Counter(), {}
    for k, (a, b) in enumerate(itertools.pairwise(ends)):
        own = words[a:b]
        for kind, key, word, c, m in spelling.merged(own, [n[w] for w in own], cuts[k - 1] if k else "", cuts[k] if k < len(cuts) else None, heavy):
            if kind == spelling.FOUND:
                count[key] += m
                assert n[word] == c and near(key, word)
            elif kind == spelling.MOVED and key in n:
                assert near(key, word)
                count.update([key, word])
            elif kind == spelling.MERGED:
                groups.setdefault(key, []).append(word)
    for same in groups.values():
        count.update({w: len(same) - 1 for w in same})
    assert {w: c for w, c in count.items() if c} == {w: c for w in words if (c := sum(near(w, o) for o in words))}


def test_light_words_move_seldom():
    """Each word is light below at most log2(words) nodes."""
    words = some_words(9, 400)
    light = Counter()
    for _, starts in spelling.branches(words):
        sizes = [b - a for a, b in itertools.pairwise(starts)]
        for i, (a, b) in enumerate(itertools.pairwise(starts)):
            if i != sizes.index(max(sizes)):
                light.update(range(a, b))
    assert max(light.values()) <= math.log2(len(words))


def test_spelling_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.spelling_variants(odd).collect()} == variants(docs)
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    ties = [(i, "aaaaa aaaab aaaac " * k) for i, k in ((1, 6), (2, 3))] + [(3, "aaaad " * 3)]
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(ties, "doc_id long, text string")).collect()}
    assert {w: (r.form, r.n_near) for w, r in got.items()} == {"aaaaa": (None, 3), "aaaab": (None, 3), "aaaac": (None, 3), "aaaad": ("aaaaa", 3)}


def test_letters_outside_ascii_keep_their_case(spark):
    got = [r.word for r in spelling.spelling_variants(spark.createDataFrame([(1, "ÉCOLE école École")] * 3, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted({"École".replace("E", "e"), "école"} - {"ecole"})


def lloyd(vectors, clusters, rounds):
    """Plain rounds over (vec_id, integers): {row: (cluster, distance)} and the centroids."""
    chosen = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in vectors)
    centroids = [v for _, v in chosen[:clusters]]
    for left in range(rounds, -1, -1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in vectors]
        if left:
            for k in range(len(centroids)):
                own = [v for (_, v), (_, a) in zip(vectors, at, strict=True) if a == k]
                if own:
                    centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return at, centroids


def floats(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("spread", "rounds"), [(0.02, 3), (0.6, 8)])
def test_clusters_equal_plain_rounds(spark, spread, rounds):
    rnd = np.random.default_rng(int(spread * 100))
    middle = rnd.normal(size=(9, 64))
    rows = [(i, (middle[i % 9] + spread * rnd.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(500 + i, [0.0] * 64) for i in range(12)] + [(7, [0.25] * 64)] * 2
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    at, centroids = lloyd(whole, 16, rounds)
    got = kmeans.cluster_vectors(floats(spark, rows), rounds=rounds).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter((i, k, d) for (i, _), (d, k) in zip(rows, at, strict=True))
    assert {r.cluster: r.centroid_sha256 for r in got} == {k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest() for _, k in at}
    assert {r.cluster: r.cluster_inertia for r in got} == {k: sum(d for d, c in at if c == k) for _, k in at}
    assert {r.inertia for r in got} == {sum(d for d, _ in at)}


def test_bounds_spare_distances_and_hold(spark):
    rnd = np.random.default_rng(4)
    middle = rnd.normal(size=(40, 64)) * 64
    x = np.floor(middle[rnd.integers(0, 40, 3000)] + 3 * rnd.normal(size=(3000, 64))).astype(np.int64)
    centroids = x[:16].copy()
    state = kmeans.scanned(x, centroids, 4)
    spared = 0
    for _ in range(6):
        now = np.array([x[state.cluster == k].sum(0) // max(1, (state.cluster == k).sum()) if (state.cluster == k).any() else centroids[k] for k in range(16)])
        drift = np.sqrt(kmeans.squared(now, centroids).astype(float))
        centroids, state = now, kmeans.moved(x, state, now, drift, 4)
        d2 = kmeans.to_all(x, centroids)
        assert (state.cluster == d2.argmin(1)).all()
        d = np.sqrt(d2)
        assert (state.upper >= d[np.arange(3000), state.cluster] - 1e-6).all()
        assert (state.lower <= np.take_along_axis(d, state.listed, 1) + 1e-6).all()
        others = d.copy()
        np.put_along_axis(others, np.concatenate([state.cluster[:, None], state.listed], 1), np.inf, 1)
        assert (state.rest <= others.min(1) + 1e-6).all()
        spared += (state.looked == 0).sum()
    assert spared > 3000 and (state.looked < 16).mean() > 0.9


def test_clusters_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0] * 63), (3, [1.0] * 65), (4, [nan] + [1.0] * 63), (5, [-inf] + [1.0] * 63), (6, [None] + [1.0] * 63), (None, [-0.01] * 64), (8, [0.5] * 64), (8, [0.5] * 64)]
    table = floats(spark, rows).select("*", F.lit(1).alias("cluster"), F.lit("x").alias("v"))
    got = sorted((r.vec_id or 0, r.distance, r.inertia) for r in kmeans.cluster_vectors(table).collect())
    assert got == [(0, 0, 0), (8, 0, 0), (8, 0, 0)]
    assert kmeans.cluster_vectors(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        kmeans.cluster_vectors(floats(spark, [(1, [3e30] * 64)])).collect()


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) < 0.05 * len(got)


def test_language_ignores_held_out_labels(spark):
    """Labels of held-out rows, ids and sources change no prediction."""
    rows = [(i, ("der und die nicht " if i % 2 else "the and of with ") * 5 + "x" * (i % 5), "de" if i % 2 else "en", "s", 1) for i in range(60)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    wrong = [(i, t, "zz" if i in held else lang, None, None) for i, t, lang, *_ in rows]
    a, b = (sorted(map(tuple, language_id.identify_languages(spark.createDataFrame(r, DOCS)).collect())) for r in (rows, wrong))
    assert a == b and {r[2] for r in a} == {"de", "en"}


def test_n_grams_equal_counting():
    text = "Größe, the 3 ÄPFEL!"
    letters = language_id.letters_of(text)
    assert letters == " größe the äpfel ".encode()
    want = np.zeros(language_id.PLACES)
    for n in language_id.ORDERS:
        for i in range(len(letters) - n + 1):
            code = 0
            for byte in letters[i : i + n]:
                code = (code * 257 + byte + 1) % 2**32
            want[(code * 2_654_435_761 % 2**32) >> 20] += 1
    assert (language_id.n_grams(letters) == want).all()
    long = language_id.letters_of("über den fluss " * 100_000)
    whole = Counter(long[i : i + 3] for i in range(len(long) - 2))
    assert language_id.n_grams(long).sum() == sum(len(long) - n + 1 for n in language_id.ORDERS) and len(whole) > 5


def test_nearest_equals_plain_cosine():
    rnd = np.random.default_rng(2)
    idf = rnd.uniform(1, 3, language_id.PLACES).astype(np.float32)
    texts = ["the and of with that", "der und die nicht das", "les des une que pour", ""]
    x = language_id.vectors(np.stack([language_id.n_grams(language_id.letters_of(t)) for t in texts[:3]]), idf)
    fitted = [(name, *language_id.spherical_means(x[i : i + 1])) for i, name in enumerate(("en", "de", "fr"))]
    model = language_id.Model(idf, fitted)
    for text, (name, score, rejected) in zip([*texts, "und das the der"], model.nearest([*texts, "und das the der"]), strict=True):
        if not text:
            assert (name, score, rejected) == ("und", 0.0, True)
            continue
        v = Counter()
        for place, c in enumerate(language_id.n_grams(language_id.letters_of(text))):
            v[place] = math.log1p(c) * float(idf[place])
        norm = math.sqrt(sum(w * w for w in v.values()))
        cosines = {lang: sum(v[p] / norm * float(c[0][p]) for p in range(language_id.PLACES)) for lang, c, _ in fitted}
        assert name == max(sorted(cosines), key=cosines.get) and abs(score - cosines[name]) < 1e-4
        assert rejected == (1 - score > language_id.SLACK + 1e-6)


def test_language_odd_rows(spark, odd):
    got = sorted(((r.doc_id or -1, r.lang_pred, r.held_out) for r in language_id.identify_languages(odd).collect()), key=str)
    assert [g[:2] for g in got if g[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")] and len(got) == odd.count()
    assert {g[1] for g in got if g[0] in (-1, 4, 5)} <= {"en", "fr"}
    assert language_id.identify_languages(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
