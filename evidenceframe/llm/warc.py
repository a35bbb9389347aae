"""WARC: a deterministic sharded writer and a reader.

Records are sorted by page_id and dealt into shards by ranges of it. The ranges come from a
histogram of payload bytes, so the same table always gives the same files. Within a shard files
roll when their compressed size reaches a limit. Headers and digests are made anew for each record,
and a payload that an equal record with a larger page_id carries is written as a revisit.

Commit: tasks write under temporary names that no other attempt shares and return manifest rows,
which Spark's own committer keeps for the successful attempts alone. A second job gives the files
listed there their names, and the manifest next to them is written last. Files of lost attempts are
in no manifest.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column_of, partitions, range_of, text_of, texts_of, work_path, written

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 1000
#: A file is closed when its compressed size reaches this.
FILE_BYTES = 1 << 30
#: Bytes of payload in a shard: a 64th of all, but within these bounds.
SHARD_BYTES = (8 << 20, 1 << 30)
#: Rows that a join may broadcast, by count; above it both sides are shuffled.
SMALL = 400_000
#: Cells of the histogram in each round, about.
CELLS = 4096
DATE = "2020-01-01T00:00:00Z"
CONTROL = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs


def qualified(spark, path: str) -> str:
    """The URI of a path, a bare one on the cluster's default file system, as Spark's own readers take it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path there; the same on driver and executors."""
    return (pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


def record(kind: str, page_id, url: str, payload: bytes, sha1: bytes, refers_to) -> bytes:
    """A WARC/1.1 record. A revisit carries the HTTP header alone and names its response.

    Control characters of the url are written as percent escapes, as a header is one line.
    """
    digest = "sha1:" + b32encode(sha1).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    url = CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    response = f"response/{page_id}/{digest}"
    name = response if kind == "response" and len(payload) >= MIN_REVISIT else f"{kind}/{page_id}/{url}/{digest}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Digest: {digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Truncated: length"]
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'response/{refers_to}/{digest}')}>")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _first_record(name: str) -> bytes:
    body = f"software: evidenceframe\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 5, mtime=0)


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped WARC stream, one record in memory at a time."""
    data = b""
    unzip = zlib.decompressobj(31)

    def more() -> bytes | None:
        nonlocal unzip
        raw = unzip.unused_data if unzip.eof else b""
        raw = raw or stream.read(1 << 16)
        if not raw:
            return None
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        return unzip.decompress(raw)

    def fill(size: int) -> bool:
        nonlocal data
        parts, have = [data], len(data)
        while have < size:
            got = more()
            if got is None:
                data = b"".join(parts)
                return False
            parts.append(got)
            have += len(got)
        data = b"".join(parts)
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            got = more()
            if got is None:
                if data.strip():
                    raise ValueError("a WARC file ends within a record")
                return
            data += got
        lines = data[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {key.strip(): value.strip() for key, _, value in (line.partition(":") for line in lines[1:])}
        size = int(head["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a WARC file ends within a record")
        yield head, data[end + 4 : end + 4 + size]
        data = data[end + 4 + size + 4 :]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def shards(pages: DataFrame, shard_bytes: int | None = None, cells: int = CELLS) -> list[int]:
    """First page_ids of the shards after the first, from a histogram of payload bytes.

    Cells of equal width between the least and the greatest id are counted; those heavier than a
    shard are divided again, until none is or it holds one id. Only cell counts reach the driver.
    """
    low, high, total = pages.agg(F.min("page_id"), F.max("page_id"), F.sum("payload_bytes")).first()
    if low is None:
        return []
    shard_bytes = shard_bytes or min(max(total // 64, SHARD_BYTES[0]), SHARD_BYTES[1])
    todo, done = [(low, high + 1)], []
    inside = pages.select(F.col("page_id").alias("at"), F.lit(0).cast("bigint").alias("cell"), "payload_bytes")
    while todo:
        # All heavy cells at once; there are fewer than shards. A row's cell is its key, so each
        # round is one join with the table of heavy cells and one aggregation.
        per = max(2, cells // len(todo))
        wide = [(i, a, max(1, -(-(b - a) // per))) for i, (a, b) in enumerate(todo)]
        table = F.broadcast(pages.sparkSession.createDataFrame(wide, "cell long, a long, width long"))
        inside = inside.join(table, "cell").withColumn("k", F.floor((F.col("at") - F.col("a")) / F.col("width")))
        counts = inside.groupBy("cell", "k").agg(F.sum("payload_bytes").alias("n")).collect()
        heavy = {}
        ranges, todo = todo, []
        for i, k, n in counts:
            width = wide[i][2]
            cell = (ranges[i][0] + k * width, min(ranges[i][1], ranges[i][0] + (k + 1) * width), n)
            if n > shard_bytes and cell[1] - cell[0] > 1:
                heavy[i, k] = len(todo)
                todo.append(cell[:2])
            else:
                done.append(cell)
        if todo:
            names = F.broadcast(pages.sparkSession.createDataFrame([(i, k, new) for (i, k), new in heavy.items()], "cell long, k long, new long"))
            inside = inside.join(names, ["cell", "k"]).select("at", F.col("new").alias("cell"), "payload_bytes")
    starts, filled = [], 0
    for a, _, n in sorted(done):
        if filled and filled + n > shard_bytes:
            starts.append(a)
            filled = 0
        filled += n
    return starts


def _write(folder: str, prefix: str, file_bytes: int):
    names = ("temporary", "name", "records", "bytes", "sha256")

    def run(batches):
        fs, root = file_system(folder)
        attempt = uuid.uuid4().hex
        out, at, seq, done = None, None, 0, []
        size = count = 0
        summed = hashlib.sha256()
        seen: set[tuple] = set()
        last_id = object()

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"_temporary/{attempt}-{at:06d}-{seq:05d}", f"{prefix}-{at:06d}-{seq:05d}.warc.gz", count, size, summed.hexdigest()))
                out = None

        def put(data: bytes):
            nonlocal size
            out.write(data)
            summed.update(data)
            size += len(data)

        for batch in batches:
            columns = [column_of(batch, c) for c in ("shard", "page_id", "refers_to")]
            for shard, page, refers, url, payload in zip(*columns, texts_of(batch, "url"), texts_of(batch, "html"), strict=True):
                payload = payload or b""
                sha1 = hashlib.sha1(payload).digest()
                if page != last_id:
                    seen, last_id = set(), page
                kind = "response" if refers is None else "revisit"
                if refers is not None and refers == page and sha1 not in seen:
                    kind = "response"  # of rows that share the largest id, the first
                    seen.add(sha1)
                if out is not None and (shard != at or size >= file_bytes):
                    close()
                    seq = seq + 1 if shard == at else 0
                if out is None:
                    seq = seq if shard == at else 0
                    at, size, count, summed = shard, 0, 0, hashlib.sha256()
                    out = fs.open_output_stream(f"{root}/_temporary/{attempt}-{at:06d}-{seq:05d}", compression=None)
                    put(_member(_first_record(f"{prefix}-{at:06d}-{seq:05d}.warc.gz")))
                put(_member(record(kind, "" if page is None else page, text_of(url), payload, sha1, refers)))
                count += 1
        close()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [()] * 5, kinds, strict=True)], names=list(names))

    return run


def _commit(folder: str):
    def run(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for temporary, name, size in zip(*(column_of(batch, c) for c in ("temporary", "name", "bytes")), strict=True):
                info = fs.get_file_info([f"{root}/{temporary}", f"{root}/{name}"])
                if info[0].type == pafs.FileType.File:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                elif info[1].type != pafs.FileType.File or info[1].size != size:
                    raise FileNotFoundError(f"{temporary} is gone and {name} is not whole")
            yield batch

    return run


def write_warc(pages: DataFrame, folder: str, prefix: str = "part", file_bytes: int = FILE_BYTES, shard_bytes: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html; others ignored) as WARC files; returns the manifest.

    A null html is an empty payload, a null url an empty target, and a null page_id sorts first.
    Of records with equal payloads of ``MIN_REVISIT`` bytes or more the one with the largest page_id
    is the response; of rows that share that id too, the first in order of url. Equality is that of
    SHA-256 and length. An empty table gives no file and an empty manifest.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    facts = checkpointed(pages.select("page_id", F.octet_length("html").cast("bigint").alias("payload_bytes"), F.sha2("html", 256).alias("key")))
    starts = shards(facts.where("page_id is not null"), shard_bytes)
    groups = facts.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1")
    groups = checkpointed(groups.select("key", "refers_to"))
    rows = pages.join(_small(groups), F.sha2(pages.html, 256) == groups.key, "left").drop("key")
    # the response itself: refers_to is null, unless rows share its id; those are told apart in order
    twice = checkpointed(facts.where("page_id is not null").groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("twin")))
    rows = rows.join(_small(twice), rows.page_id == twice.twin, "left")
    rows = rows.withColumn("refers_to", F.when((F.col("refers_to") == F.col("page_id")) & F.col("twin").isNull(), F.lit(None)).otherwise(F.col("refers_to"))).drop("twin")
    rows = rows.withColumn("shard", range_of(F.col("page_id"), starts))
    n = max(partitions(spark), min(len(starts) + 1, 100_000))
    rows = rows.repartition(n, "shard") if starts else rows.coalesce(1)
    rows = rows.sortWithinPartitions("shard", "page_id", "url", "html")
    fs, root = file_system(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    manifest = written(rows.mapInArrow(_write(folder, prefix, file_bytes), "temporary string, name string, records long, bytes long, sha256 string"), "manifest")
    committed = manifest.mapInArrow(_commit(folder), manifest.schema).drop("temporary")
    committed.write.mode("overwrite").parquet(f"{folder}/_manifest")
    fs.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest")


def _read(folder: str):
    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def run(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for name in column_of(batch, "name"):
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in records_in(stream):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if b32encode(hashlib.sha1(block).digest()).decode() != head["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a block does not have its digest")
                        if payload is not None and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        page, refers = head["X-Page-ID"], head.get("X-Refers-To-Page-ID")
                        from_base32 = b32decode(digest).hex()
                        rows.append((int(page) if page else None, head["WARC-Target-URI"], kind, int(head["X-Payload-Length"]), from_base32, int(refers) if refers else None, payload))
                        size += len(block)
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return run


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the files that a manifest lists; digests of blocks and payloads are verified."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    spark, names = manifest.sparkSession, manifest.select("name")
    return names.repartition(max(1, partitions(spark)), "name").mapInArrow(_read(qualified(spark, folder)), schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    folder = work_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder, **options), folder)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND last <> page_id THEN last END AS refers_to
FROM p
"""
