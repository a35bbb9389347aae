"""Canonical exact digests of documents.

The canonical form of a text is its NFKC normalisation, case-folded, with each run of white space
as one space. A 128-bit xxHash of it is the fingerprint. Texts whose fingerprints are equal are
compared byte by byte in canonical form; should two different forms share a
hash, the run stops rather than merge them, so equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, partitions, range_of, semi_join_bounded, text_of, texts_of, written


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split()).encode()


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _canonical(batches):
    for batch in batches:
        forms = [canonical(text_of(t)) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([xxhash.xxh3_128_hexdigest(f) for f in forms], pa.string()), pa.array(forms, pa.binary())], names=["fingerprint", "form"]
        )


def collisions(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(fingerprint) of buckets that hold different canonical forms.

    Only rows whose fingerprint occurs more than once are looked at. The least and the greatest
    form of a bucket are equal exactly if all are; both are kept up in the map tasks, so a bucket is
    never gathered.
    """
    repeated = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    ids = written(found.join(repeated, "fingerprint", "left_semi").where("doc_id is not null").select("doc_id").distinct(), "repeated")
    rows = semi_join_bounded(docs.select("doc_id", "text"), ids, "doc_id").mapInArrow(_canonical, "fingerprint string, form binary")
    ends = rows.groupBy("fingerprint").agg(F.min("form").alias("least"), F.max("form").alias("greatest")).where("least <> greatest")
    return ends.select("fingerprint")


def _with_next(batches):
    """Rows in order of (part, last, doc_id): each is worked on with the one after it."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
    held = None
    for batch in batches:
        rows = []
        for part, guest, doc, raw in zip(column_of(batch, "part"), column_of(batch, "guest"), column_of(batch, "doc_id"), texts_of(batch), strict=True):
            text = text_of(raw)
            mark = digest(text)
            if held is not None and held[0] == part:
                whole = edited(held[2], text)
                rows.append((held[1], len(held[2]), hashlib.sha256(whole.encode()).hexdigest(), held[3], digest(whole), mark))
            held = None if guest else (part, doc, text, mark)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): fingerprints of it, of its edit and of the next.

    The next document is the one with the next doc_id, after the last the first; rows of one doc_id
    follow each other by text, and a null doc_id comes first. A null text counts as empty; bytes that
    are not UTF-8 count as U+FFFD. The
    likeness of two exact digests is 1 if they are equal and 0 otherwise. A single row is its own
    next document.

    Documents are dealt into ranges of doc_id, whose bounds come from a sketch; any bounds give the
    same result, as each range also gets the first document of the range after it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(partitions(spark), docs.rdd.getNumPartitions())
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []))
    cuts = [int(c) for c in cuts]

    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_of(F.col("doc_id"), cuts)).cast("int")
    # The first document of each range that has any: as many rows as ranges.
    heads = sorted((r["part"], r["d"]) for r in docs.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("d")).collect())
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    own = docs.withColumn("part", part).withColumn("guest", F.lit(False))
    follow = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    guests = spark.createDataFrame([(d, p) for d, p in follow], "g long, part int")
    firsts = F.broadcast(guests)  # one row for each range
    visiting = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("g"))).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    visiting = visiting.select("doc_id", "text", "part", F.lit(True).alias("guest"))
    dealt = own.unionByName(visiting).repartition(n, "part").sortWithinPartitions("part", "guest", "doc_id", "text")
    found = dealt.mapInArrow(_with_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    found = written(found, "fingerprints")
    clash = collisions(docs, found.select("doc_id", "fingerprint"))
    if clash.limit(1).count():
        raise ValueError("two canonical texts share a 128-bit hash; salt the hash and run again")
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"),
    )

