"""Spelling variants: pairs of words one edit apart, by merging the light subtrees of a trie.

The trie of all words is never stored: it is the sorted list of words, whose branching nodes are the
common prefixes of neighbours. At each node the child with the most words is heavy and the others
are light. Two words one edit apart part at exactly one node, where at most one of them is under the
heavy child, so it is enough to move the light words, once for each light edge above them, which
are at most log2(words):

* one character skipped: the word without its character at the node;
* replaced: with the heavy child's character instead, and, in one merged subtree of all light
  children, with any;
* the heavy child's character put before it (a word that ends at the node moves in this way too).

Where a moved word ends at a word's terminal, the two are one edit apart.

Words are dealt in ranges between cuts. A node that no cut divides lies whole in one task, which
merges its subtrees in memory. Nodes that cuts divide are the prefixes of the cuts, a few for each
task; of those, all tasks know the heavy child from the sample that gave the cuts, and their moved
words meet the terminals in a join.
"""

from __future__ import annotations

import os.path
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, rows_of, scratch, text_of, work_path, written

#: Letters of words: ASCII and those of Latin-1 from C0 on, as the contract has them.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
MISSPELT_ONE_IN = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: A task sends its counts on when it holds so many characters of distinct words.
HELD_CHARS = 4_000_000
#: Sampled words for each range of words.
SAMPLE = 32

FOUND, MOVED, MERGED = 0, 1, 2


def misspelt(head: int, run: str) -> str:
    """The run without one character if its hash says so; ``head`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), head)
    if h % MISSPELT_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches):
    def sent():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    held, size = Counter(), 0
    for batch in batches:
        for doc, raw in rows_of(batch):
            head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            # bytes.lower() lowers A to Z alone
            for run, n in Counter(RUN.findall(text_of((raw or b"").lower()))).items():
                word = misspelt(head, run)
                if len(word) >= MIN_LENGTH:
                    size += 0 if word in held else len(word)
                    held[word] += n
            if size > HELD_CHARS:
                yield sent()
                held, size = Counter(), 0
    yield sent()


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least five characters that occur three times or more."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(released(_counted), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def cuts_of(sample: list[str], parts: int) -> tuple[list[str], dict[str, str]]:
    """Cuts that deal the sampled words evenly, and the heavy character of every node that a cut divides.

    A cut is the shortest beginning of a sampled word that is above the sampled word before it.
    """
    sample = sorted(set(sample))
    at = sorted({len(sample) * i // parts for i in range(1, parts)} - {0})
    cuts = [sample[i][: len(os.path.commonprefix(sample[i - 1 : i + 1])) + 1] for i in at]
    divided = {cut[:d] for cut in cuts for d in range(len(cut))}
    below = Counter((word[:d], word[d]) for word in sample for d in range(len(word)) if word[:d] in divided)
    heavy: dict[str, str] = {}
    for node, char in sorted(below, key=lambda e: (-below[e], e)):
        heavy.setdefault(node, char)
    return cuts, heavy


def range_number(word: Column, cuts: list[str]) -> Column:
    @F.arrow_udf("int")
    def number(x: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, w) for w in x.to_pylist()], pa.int32())

    return number(word) if cuts else F.lit(0)


def branches(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(depth, starts) of each branching node of the trie of sorted words, deepest first.

    ``starts`` has the first word of each child, then the end of the last.
    """
    open_: list[tuple[int, list[int]]] = []
    for i in range(1, len(words) + 1):
        common = len(os.path.commonprefix(words[i - 1 : i + 1])) if i < len(words) else -1
        first = i - 1
        while open_ and open_[-1][0] > common:
            depth, starts = open_.pop()
            yield depth, [*starts, i]
            first = starts[0]
        if open_ and open_[-1][0] == common:
            open_[-1][1].append(i)
        elif common >= 0:
            open_.append((common, [first, i]))


def moved(word: str, depth: int, heavy: str) -> Iterator[str]:
    """The light word at its place in the heavy subtree: skipped, replaced, put before."""
    head, tail = word[:depth], word[depth + 1 :]
    # Of a run of equal characters the last is skipped, so that a pair is found once.
    if depth < len(word) and tail[:1] != word[depth]:
        yield head + tail
    if depth < len(word):
        yield head + heavy + tail
    yield head + heavy + word[depth:]


class Near:
    """Number of near words and the most frequent one, by place in a sorted list."""

    def __init__(self, n: list[int]):
        self.n, self.count, self.best = n, [0] * len(n), [-1] * len(n)

    def pair(self, i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            self.count[a] += 1
            best = self.best[a]
            if best < 0 or (self.n[b], -b) > (self.n[best], -best):
                self.best[a] = b


def merged(words: list[str], n: list[int], low: str, high: str | None, heavy: dict[str, str]) -> Iterator[tuple[int, str, str, int, int]]:
    """(kind, key, word, n, count) of one range of words, sorted and distinct.

    FOUND: the word ``key`` has ``count`` near words here, the most frequent is ``word`` with ``n``.
    MOVED: ``word`` with its ``n`` is near ``key``, should that be a word of another range.
    MERGED: light words of a divided node that have the same ``key`` differ in one character.
    """
    place = {w: i for i, w in enumerate(words)}
    near = Near(n)
    for depth, starts in branches(words):
        head = words[starts[0]][:depth]
        if head in heavy:
            continue
        children = list(zip(starts, starts[1:], strict=False))
        ends_here = len(words[starts[0]]) == depth
        largest = max(children[ends_here:], key=lambda c: c[1] - c[0])
        char = words[largest[0]][depth]
        light: dict[str, list[int]] = defaultdict(list)
        for child in children:
            if child == largest:
                continue
            for i in range(*child):
                for other in moved(words[i], depth, char):
                    if other in place:
                        near.pair(i, place[other])
                if len(words[i]) > depth:
                    light[words[i][depth + 1 :]].append(i)
        for same in light.values():
            for k, i in enumerate(same):
                for j in same[:k]:
                    near.pair(i, j)
    for i, word in enumerate(words):
        depth = 0
        while depth <= len(word) and (char := heavy.get(word[:depth])) is not None:
            if word[depth : depth + 1] != char:
                for other in moved(word, depth, char):
                    if low <= other and (high is None or other < high):
                        if other in place:
                            near.pair(i, place[other])
                    elif len(other) >= MIN_LENGTH:
                        yield MOVED, other, word, n[i], 1
                if depth < len(word):
                    yield MERGED, f"{word[:depth]}*{word[depth + 1 :]}", word, n[i], 1
            depth += 1
    for i, word in enumerate(words):
        if near.count[i]:
            yield FOUND, word, words[near.best[i]], n[near.best[i]], near.count[i]


def _merging(cuts: list[str], heavy: dict[str, str]):
    names, kinds = ["kind", "key", "word", "n", "count"], [pa.int8(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def ranges(batches):
        """The words of one range after another; a task may hold several."""
        part, words, n = None, [], []
        for batch in batches:
            for p, w, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if words:
                        yield part, words, n
                    part, words, n = p, [], []
                words.append(w)
                n.append(c)
        if words:
            yield part, words, n

    def task(batches):
        rows = []
        for part, words, n in ranges(batches):
            for row in merged(words, n, cuts[part - 1] if part else "", cuts[part] if part < len(cuts) else None, heavy):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return task


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, near): how many words are one edit away, and the most frequent of them."""
    spark = words.sparkSession
    parts = partitions(spark)
    share = min(1.0, SAMPLE * parts / max(1, words.count()))
    chosen = words.where(F.pmod(F.xxhash64("word"), F.lit(1_000_000_000)) < int(share * 1_000_000_000) + 1)
    cuts, heavy = cuts_of([r.word for r in chosen.select("word").collect()], parts)
    dealt = words.select(range_number(F.col("word"), cuts).alias("part"), "word", "n").repartitionById(len(cuts) + 1, "part")
    rows = dealt.sortWithinPartitions("part", "word").mapInArrow(released(_merging(cuts, heavy)), "kind byte, key string, word string, n long, count long")
    rows = written(rows, "errata")

    found = rows.where(F.col("kind") == FOUND).select(F.col("key").alias("word"), "count", F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")).alias("best"))
    ends = words.select(F.col("word").alias("key"), F.col("n").alias("key_n"))
    met = rows.where(F.col("kind") == MOVED).join(ends, "key")
    one = lambda word, near, n: F.struct(F.col(word).alias("word"), F.lit(1).cast("bigint").alias("count"), F.struct((-F.col(n)).alias("less"), F.col(near).alias("near")).alias("best"))
    met = met.select(F.explode(F.array(one("word", "key", "key_n"), one("key", "word", "n"))).alias("e")).select("e.*")
    # A key fixes all characters but one: as many words at most as there are letters.
    same = rows.where(F.col("kind") == MERGED).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")))).alias("all")).where(F.size("all") > 1)
    same = same.select("all", F.explode("all").alias("own")).select(
        F.col("own.near").alias("word"), (F.size("all") - 1).cast("bigint").alias("count"), F.when(F.col("all")[0] == F.col("own"), F.col("all")[1]).otherwise(F.col("all")[0]).alias("best")
    )
    all_ = found.unionByName(met).unionByName(same)
    return all_.groupBy("word").agg(F.sum("count").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last.

    Each round follows twice as many forms as the one before. A form occurs at least twice as often
    as its word, so there is no circle and the rounds are few.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        now = at.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("on"))
        now = written(now, "roots")
        at = now.select("word", "root")
        if not now.where("on").limit(1).count():
            return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts of ``docs`` (doc_id, text).

    A null or empty text has no words, bytes that are not UTF-8 are no letters, and a null doc_id is
    written as nothing before the colon. Repeated rows count each; of near words that occur equally
    often the smallest in code-point order is the form. Other columns are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    path = work_path(spark, "spelling")
    with scratch(spark):
        words = written(words_of(docs), "words")
        found = words.join(near_words(words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("form_n") >= 2 * F.col("n"), F.struct(F.col("near").alias("form"), "form_n")).alias("f"),
        ).select("word", "f.form", "n", "n_near", "f.form_n")
        found = written(found, "forms")
        last = roots(found.where("form is not null"))
        out = found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


#: The polynomial and the mask of crc32.
ORACLE_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT head, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(head || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS b FROM lowered),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) r(i)),
pairs AS (
    SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
    UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
), best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
forms AS (
    SELECT w.word, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""
