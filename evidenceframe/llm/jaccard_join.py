"""N-gram Jaccard self-join by a token-group matrix.

A document's set holds the hashes of its distinct word shingles. Two documents link when
``100 * |intersection| >= percent * |union|``. The join is exact:

1. Documents with one and the same set form a class; from here on a class is one set.
2. Each class sends the head of its set (the part that two linked sets must share at least one
   token of, in an order that puts frequent tokens last) to buckets of tokens, with its size as a
   power of the ratio that linked sizes may have. A bucket yields the tokens that at least two
   classes of like size hold; classes apart in size hold different tokens from here on.
3. Classes that share a token meet one leader for each token. A class is compared with the likeliest
   of its leaders; links found join components, and then only leaders in other components are left.
   Classes close to a leader form a group with it, in parts of about ``GROUP``.
4. The classes close to one leader, if they are more than ``GROUP``, are its ball. A class linked with
   the leader cannot link with one that is not close to it (Jaccard distance keeps the triangle
   inequality). Within the ball, let c be a class in its middle and E(x) the tokens that only one of
   x and c has: x and y differ in as many tokens as E(x) and E(y). If u is not linked with c, a link of
   u and v needs more than half of E(v) in E(u), but for what v is longer than c: so each v shows a
   part of E(v), rare tokens first, in which u seeks all of E(u). Near misses, which differ from c
   each in its own way, thus meet nobody.
5. Token-group matrix: each group stores its token union as one column of bits, a bit for each hash
   bucket of tokens. Groups that share a token meet, but for what the balls have decided. A class has at most as many tokens in the
   other group as its own bits that the column also has; if that is too few, the group stays closed
   for it. The members of an opened group that are not yet in the class's component are bounded one
   by one in the same way. Of those, the likeliest of each two components are compared exactly
   first; then all that are still in different components.

Copies are never expanded into pairs, and no list is cut: what the leaders leave open, the matrix
decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, partitions, pieces, relabelled, released, rows_of, semi_join_bounded, written

PERCENT = 75
SHINGLE = 5
#: Classes in a group of the matrix, about.
GROUP = 16
#: Percent of similarity with its leader that the bits of a member must allow.
CLOSE = 50
#: Frequent tokens, known to all tasks, that go last in the order of tokens. This only decides how
#: long the lists of the first tokens are; any value gives the same links.
HINTS = 400_000
#: Bytes of packed heads in a bucket.
BUCKET_BYTES = 16 << 20
#: Bytes of a token in its bucket. Two tokens taken for one only add candidates.
TOKEN_BYTES = 5
#: A frequent token with more holders than this is dealt to several buckets.
WIDE_HEADS = 200_000
#: In place of the size, for tokens that are dealt to several buckets.
WIDE = 255

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, ids: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes. Fewer words than the width: the whole sequence is one shingle."""
    words = text.lower().split() if text else []  # bytes: A-Z only, split at 20 and 09-0D
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, n)
    k = min(width, n)
    s = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        s = s * _P + h[j : n - k + 1 + j]
    s ^= s >> np.uint64(29)
    s *= _M
    s ^= s >> np.uint64(32)
    return np.unique(s)


def bits_of(tokens: np.ndarray) -> bytes:
    """The set as bits, twice as many as tokens at least (a power of two)."""
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> int:
    """Bits as a number, folded to ``size`` bytes: what the same tokens give with fewer buckets."""
    x, have = int.from_bytes(bits, "little"), len(bits)
    while have > size:
        have //= 2
        x = (x >> (8 * have)) | (x & ((1 << (8 * have)) - 1))
    return x


def needed(n: int, m: int, percent: int) -> int:
    """The least intersection that links sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def bound(n: int, x: bytes, m: int, y: bytes) -> int:
    """Twice the intersection is at most this: what the bits show to differ is not in both sets."""
    size = min(len(x), len(y))
    return n + m - (folded(x, size) ^ folded(y, size)).bit_count()


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """False only if the bits prove that the sets differ in too many tokens."""
    return 100 * min(n, m) >= percent * max(n, m) and bound(n, x, m, y) >= 2 * needed(n, m, percent)


def may_hold(n: int, x: bytes, column: bytes, percent: int) -> bool:
    """Bound of query and group: the query's bits that the group's column lacks are tokens it lacks."""
    size = min(len(x), len(column))
    lacking = (folded(x, size) & ~folded(column, size)).bit_count()
    return 100 * (n - lacking) >= percent * n


def shown(f: int, m: int, k: int, percent: int) -> int:
    """How many of the ``f`` tokens in which v (of ``m`` tokens) and a class c (of ``k``) differ v shows.

    A class that links with v but not with c shares more than half of
    ``f - (100 - percent) / (100 + percent) * (m - k)`` of them: one among any so many, at least.
    """
    shared = (f * (100 + percent) - (100 - percent) * (m - k)) // (2 * (100 + percent)) + 1
    return max(0, f - shared + 1)


def core(percent: int) -> int:
    """Percent of likeness with a leader from which on a class links with none that is not close to the leader."""
    return max(percent, 100 - percent + min(CLOSE, percent))


def rare_first(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The tokens in the order that puts frequent ones last, others as they come."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        is_hot = hot[at] == tokens
        if is_hot.any():
            tokens = np.concatenate([tokens[~is_hot], tokens[is_hot][np.argsort(rank[at[is_hot]], kind="stable")]])
    return tokens


def head(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which two linked sets share one: frequent ones last, others by hash."""
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    return rare_first(tokens, hot, rank)[:size]


def size_class(n: int, percent: int) -> int:
    """Sizes of linked sets are in one class or in two that follow one another; below 256."""
    return int(np.log(n) / (1.0001 * np.log(max(100 / percent, 1.1))))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


class Ids:
    """The id of a set: 64 bits of its digest, and a new one for a set that shares them with another.

    ``renamed`` has the new ids by (id, check). By the birthday bound it is tiny: about 300 sets of
    10^11. ``bits`` makes ids short, for tests.
    """

    def __init__(self, bits: int = 64, renamed: dict[tuple[int, int], int] | None = None):
        self.bits, self.renamed = bits, renamed or {}

    def __call__(self, tokens: np.ndarray) -> tuple[int, int]:
        cid, check = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist()
        if self.bits < 64:
            cid &= (1 << self.bits) - 1
        return self.renamed.get((cid, check), cid), check


def _sets(batches: Iterator[pa.RecordBatch], width: int, seen: set | None, ids_of: Ids) -> Iterator[tuple[object, np.ndarray, int, int, bool]]:
    """(key, set, class id, check, first of its class in this task) for each row."""
    ids = WordHashes()
    for batch in batches:
        for doc, text in rows_of(batch):
            tokens = shingle_set(text, ids, width)
            cid, check = ids_of(tokens)
            first = bool(len(tokens)) and cid not in seen
            if first:
                seen.add(cid)
            yield doc, tokens, cid, check, first


def _first_pass(width: int, ids_of: Ids):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("hot", pa.bool_())])

    def run(batches):
        seen: set[tuple] = set()
        ids = WordHashes()
        rows, held, size = [], [], 0

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts > 1
            for t, c in zip(_signed(values[keep]).tolist(), counts[keep].tolist(), strict=True):
                rows.append((None, None, c, t, 0, None, True))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for (doc, text), mark in zip(rows_of(batch), column_of(batch, "mark"), strict=True):
                tokens = shingle_set(text, ids, width)
                cid, check = ids_of(tokens)
                first = bool(len(tokens)) and (cid, check) not in seen
                rows.append((doc, mark, len(tokens), cid, check, bits_of(tokens) if first else None, False))
                if first:
                    seen.add((cid, check))
                    held.append(tokens)
                    size += len(tokens)
                    if size > 2_000_000:
                        frequent()
                        held, size = [], 0
                if len(rows) >= 2048:
                    yield flush()
        if held:
            frequent()
        if rows:
            yield flush()

    return run


def _heads(width: int, percent: int, hot: np.ndarray, rank: np.ndarray, salts: np.ndarray, buckets: int, ids_of: Ids):
    """Heads of sets, packed by bucket. ``salts`` has in how many parts a frequent token is dealt."""

    def run(batches):
        seen: set[int] = set()
        tokens, owners, sizes, parts = [], [], [], []
        size = 0

        def flush():
            t, o, k = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
            bucket = (((t >> np.uint64(40)) + np.concatenate(parts) * _P) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            t, o, k, bucket = t[order], o[order], k[order], bucket[order]
            t = t.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[cut[1:], len(t)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cut]),
                    pa.array([t[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
                    pa.array([o[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
                    pa.array([k[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
                ],
                names=["bucket", "tokens", "owners", "sizes"],
            )

        for _, whole, cid, _, first in _sets(batches, width, seen, ids_of):
            if first:
                part = head(whole, hot, rank, percent)
                into = np.ones(len(part), np.uint64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, part), len(hot) - 1)
                    into = np.where(hot[at] == part, salts[at], 1).astype(np.uint64)
                tokens.append(part)
                owners.append(np.full(len(part), cid, np.int64))
                sizes.append(np.where(into > 1, WIDE, size_class(len(whole), percent)).astype(np.uint8))
                parts.append(np.uint64(cid % (1 << 64) * int(_M) % (1 << 64) >> 20) % into)
                size += len(part)
                if size > 400_000:
                    yield flush()
                    tokens, owners, sizes, parts, size = [], [], [], [], 0
        if tokens:
            yield flush()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Rows (token, cid, lead, many, wide) for the tokens of a bucket that two classes or more hold.

    A token that only two hold is one row: the other one is its leader. Of a token that is dealt in
    parts, each part has a leader of its own and all its rows stay; parts meet in the matrix.
    """
    low = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint8).reshape(-1, TOKEN_BYTES)
    t = np.zeros((len(low), 8), np.uint8)
    t[:, :TOKEN_BYTES] = low
    t = t.view(np.uint64).ravel()
    o = np.frombuffer(b"".join(table.column("owners").to_pylist()), np.int64)
    k = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.uint8)
    order = np.lexsort((o, k, t))
    t, o, k = t[order], o[order], k[order].astype(np.int64)
    keep = np.r_[True, (t[1:] != t[:-1]) | (o[1:] != o[:-1])]  # a class may come from many tasks
    t, o, k = t[keep], o[keep], k[keep]
    start = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] > k[:-1] + 1)])
    length = np.diff(np.r_[start, len(t)])
    wide = k == WIDE
    many = np.where(wide, 3, np.repeat(length, length))
    lead = np.repeat(np.minimum.reduceat(o, start), length)
    place = np.uint64(table.column("bucket")[0].as_py() * int(_M) % 2**64) + np.repeat(k[start], length).astype(np.uint64) * _P
    token = _signed((t ^ (t >> np.uint64(17))) * _P + np.where(wide, np.uint64(1), place))
    keep = (many > 2) | (many == 2) & (o != lead)
    return pa.table({"token": token[keep], "cid": o[keep], "lead": lead[keep], "many": many[keep].astype(np.int64), "wide": wide[keep]})


def _led(percent: int):
    """For pairs of a leader and a class: may they link, and how like they may be; distant ones go."""

    def run(batches):
        for batch in pieces(batches, 1024):
            a, na, xa, b, nb, xb = (column_of(batch, c) for c in ("a", "na", "xa", "b", "nb", "xb"))
            rows = [(p, q, may_link(n, x, m, y, percent), bound(n, x, m, y) / (n + m)) for p, n, x, q, m, y in zip(a, na, xa, b, nb, xb, strict=True) if may_link(n, x, m, y, min(CLOSE, percent))]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["a", "b", "may", "like"])

    return run


def _placed(percent: int, hot: np.ndarray, rank: np.ndarray):
    """For each class of a ball (of ``c``): whether it is of the core, and how far it seems from the ball's middle.

    Taken as the middle: the tokens that half of the ball holds, by the known counts of frequent
    tokens. This only picks a class to measure the others from; any gives the same links.
    """
    least = core(percent)

    def common(tokens, c):
        if not len(hot):
            return np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        return (hot[at] == tokens) & (2 * rank[at] >= c)

    def run(batches):
        for batch in pieces(batches, 64):
            a, b, many, ta, tb = (column_of(batch, c) for c in ("a", "b", "c", "ta", "tb"))
            inner, off = [], []
            for c, x, y in zip(many, ta, tb, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                added, gone = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                inner.append(100 * (len(y) - len(added)) >= least * (len(x) + len(added)))
                off.append(int((~common(added, c)).sum() + common(gone, c).sum()))
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(inner, pa.bool_()), pa.array(off, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "core", "off"])

    return run


def _apart(percent: int, hot: np.ndarray, rank: np.ndarray):
    """For each class of a ball: whether it links with the middle, and the tokens in which the two differ.

    The first ``part`` of the tokens are shown; those after them are there for a class that seeks.
    """

    def run(batches):
        for batch in pieces(batches, 64):
            a, b, ta, tb = (column_of(batch, c) for c in ("a", "b", "ta", "tb"))
            linked, parts, tokens = [], [], []
            for x, y in zip(ta, tb, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                added, gone = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                linked.append(100 * (len(y) - len(added)) >= percent * (len(x) + len(added)))
                parts.append(shown(len(added) + len(gone), len(y), len(x), percent))
                known = rare_first(np.concatenate([added, gone]), hot, rank)
                tokens.append(_signed(known[: parts[-1]] if linked[-1] else known))
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(parts, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "part", "tokens"])

    return run


def _grouped(table: pa.Table) -> pa.Table:
    """A group: its members, and its column of the matrix, the union of their bits (null if alone)."""
    members = sorted(zip(*(table.column(c).to_pylist() for c in ("cid", "root", "n", "bits")), strict=True))
    size = max(len(m[3]) for m in members)
    union = 0
    for *_, bits in members if len(members) > 1 else ():
        x, have = int.from_bytes(bits, "little"), len(bits)
        while have < size:  # fewer buckets: the token may be in either half
            x |= x << (8 * have)
            have *= 2
        union |= x
    cids, roots, ns, bits = zip(*members, strict=True)
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary())
    values = (cids, roots, ns, bits, union.to_bytes(size, "little") if len(members) > 1 else None)
    columns = [pa.array([list(v) if isinstance(v, tuple) else v], k) for v, k in zip(values, kinds, strict=True)]
    return pa.table([table.column("grp").slice(0, 1).combine_chunks(), *columns], names=["grp", "cids", "roots", "ns", "bits", "column"])


def _opened(percent: int, likeliest: bool):
    """Pairs of members of two groups that may link and are not in one component.

    ``likeliest``: of the pairs between two components only the one with the highest bound, and
    ``more`` where that leaves some out.
    """

    def run(batches):
        for batch in pieces(batches, 512):
            out = []
            left = zip(*(column_of(batch, c) for c in ("grp", "cids", "roots", "ns", "bits")), strict=True)
            right = zip(*(column_of(batch, c) for c in ("grp2", "cids2", "roots2", "ns2", "bits2", "column2")), strict=True)
            for (gi, ci, ri, ni, xi), (gj, cj, rj, nj, xj, column) in zip(left, right, strict=True):
                found = {}
                for a, ra, n, x in zip(ci, ri, ni, xi, strict=True):
                    if len(cj) > 1 and not may_hold(n, x, column, percent):
                        continue
                    for b, rb, m, y in zip(cj, rj, nj, xj, strict=True):
                        if ra != rb and may_link(n, x, m, y, percent):
                            found[min(a, b), max(a, b)] = (min(ra, rb), max(ra, rb)), bound(n, x, m, y) / (n + m)
                if likeliest:
                    best = {roots: pair for pair, (roots, _) in sorted(found.items(), key=lambda e: (e[1][1], e[0]))}
                    out += [(a, b, gi, gj, len(best) < len(found)) for a, b in best.values()]
                else:
                    out += [(a, b, gi, gj, False) for a, b in found]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=["a", "b", "grp", "grp2", "more"])

    return run


def _whole_sets(width: int, ids_of: Ids):
    def run(batches):
        seen: set[int] = set()
        for _, tokens, cid, _, first in _sets(batches, width, seen, ids_of):
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([cid], pa.int64()), pa.array([tokens.tobytes()], pa.binary())], names=["cid", "tokens"])

    return run


def _compared(percent: int):
    def run(batches):
        for batch in pieces(batches, 64):
            a, ta, b, tb = (column_of(batch, c) for c in ("a", "ta", "b", "tb"))
            out = []
            for i, x, y in zip(range(len(a)), ta, tb, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], names=["a", "b"])

    return run


def _classes(first: DataFrame, ids_of: Ids) -> tuple[DataFrame, DataFrame, Ids]:
    """Rows and classes of the first pass, under ids that no two sets share, and those ids.

    Sets are told apart by all 128 bits of their digest.
    """
    rows = first.where("not hot").select("doc_id", "mark", "n", "cid", "check")
    classes = first.where("not hot and n > 0").groupBy("cid", "check").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("bits").alias("bits"))
    classes = written(classes, "classes")
    twice = classes.groupBy("cid").agg(F.count("*").alias("k")).where("k > 1").select("cid")
    clash = classes.join(twice, "cid", "left_semi").select("cid", "check").collect()  # as few as the birthday bound allows
    if not clash:
        return rows, classes.drop("check"), ids_of
    keys = sorted((r["cid"], r["check"]) for r in clash)
    fresh = {k: int.from_bytes(xxhash.xxh3_128_digest(f"{k[0]}/{k[1]}".encode())[:8], "little", signed=True) for k in keys}
    table = F.broadcast(first.sparkSession.createDataFrame([(*k, v) for k, v in fresh.items()], "cid long, check long, fresh long"))

    def anew(df: DataFrame) -> DataFrame:
        return df.join(table, ["cid", "check"], "left").withColumn("cid", F.coalesce("fresh", "cid")).drop("fresh")

    classes = written(anew(classes), "classes")
    if classes.groupBy("cid").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        raise ValueError("two sets share an id, and their new ids too")
    return anew(rows), classes.drop("check"), Ids(ids_of.bits, fresh)


def _components(docs: DataFrame, percent: int, width: int, wide: int, id_bits: int) -> DataFrame:
    """(doc_id, mark, n, cid, root, component_id) for each row of docs (doc_id, mark, text)."""
    spark = docs.sparkSession
    ids_of = Ids(id_bits)
    first = written(docs.mapInArrow(released(_first_pass(width, ids_of)), "doc_id long, mark long, n long, cid long, check long, bits binary, hot boolean"), "sets")
    rows, classes, ids_of = _classes(first, ids_of)
    # Written first: the top rows are merged by a task, not by the driver.
    hints = written(first.where("hot").groupBy("cid").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "cid").limit(HINTS), "hints").toArrow()
    hot = hints.column("cid").to_numpy().astype(np.int64).view(np.uint64)
    by_hash = np.argsort(hot)
    hot, rank = hot[by_hash], hints.column("c").to_numpy().astype(np.int64)[by_hash]
    del hints
    ordered = (hot, rank)
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, partitions(spark), -(-int(total * (100 - percent) / 100 * (TOKEN_BYTES + 9)) // BUCKET_BYTES))
    shared = (
        docs.where("text is not null")
        .mapInArrow(released(_heads(width, percent, hot, rank, -(-rank // wide), buckets, ids_of)), "bucket long, tokens binary, owners binary, sizes binary")
        .groupBy("bucket")
        .applyInArrow(_shared, "token long, cid long, lead long, many long, wide boolean")
    )
    shared = written(shared, "shared")
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    other = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def sets_for(pairs: DataFrame) -> DataFrame:
        """(cid, tokens) of the classes of some pairs, from the text of one document of each."""
        ids = pairs.select(F.col("a").alias("cid")).distinct().union(pairs.select(F.col("b").alias("cid")).distinct()).distinct()
        reps = written(classes.join(ids, "cid", "left_semi").select("cid", F.col("rep").alias("doc_id")), "reps")
        whole = semi_join_bounded(docs, reps.where("doc_id is not null").select("doc_id").distinct(), "doc_id")
        if reps.where("doc_id is null").limit(1).count():
            whole = whole.select("doc_id", "text").union(docs.where("doc_id is null").select("doc_id", "text"))
        whole = whole.mapInArrow(released(_whole_sets(width, ids_of)), "cid long, tokens binary")
        return written(whole.join(reps.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "whole")

    def links(pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """Pairs that link, by their whole sets."""
        both = pairs.join(whole.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a").join(
            whole.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b"
        )
        return written(both.mapInArrow(released(_compared(percent)), "a long, b long"), "links")

    def ra_of(labels: DataFrame) -> DataFrame:
        return labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))

    def rb_of(labels: DataFrame) -> DataFrame:
        return labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))

    # One leader for each shared token. Of its leaders a class is first compared with the likeliest.
    met = written(shared.where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct(), "met")
    led = written(met.join(one, "a").join(other, "b").mapInArrow(released(_led(percent)), "a long, b long, may boolean, like double"), "led")
    may = led.where("may")
    best = written(may.groupBy("b").agg(F.max_by("a", F.struct("like", -F.col("a"))).alias("a")).select("a", "b"), "best")
    big = led.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > GROUP)
    ball = written(led.join(big, "a", "left_semi").select("a", "b"), "ball")
    whole = sets_for(may.select("a", "b").union(ball))
    nodes = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = relabelled(written(nodes.select("node", F.col("node").alias("root")), "labels"), links(best, whole))
    # Then with those that are still in another component.
    apart = may.select("a", "b").join(ra_of(labels), "a").join(rb_of(labels), "b").where("ra <> rb").select("a", "b").join(best, ["a", "b"], "left_anti")
    labels = relabelled(labels, links(apart, whole))

    # Balls. Where some are not in their leader's component, all are measured from a class in the middle.
    sets_a, sets_b = (whole.select(F.col("cid").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    balls = ball.join(big, "a").join(sets_a, "a").join(sets_b, "b").select("a", "b", "c", "ta", "tb")
    balls = written(balls.mapInArrow(released(_placed(percent, *ordered)), "a long, b long, core boolean, off long"), "balls")
    asked = balls.join(ra_of(labels), "a").join(rb_of(labels), "b").where("ra <> rb").select("a").distinct()
    middle = balls.join(asked, "a", "left_semi").groupBy("a").agg(F.min_by("b", F.struct("off", "b")).alias("mid"))
    members = balls.select("a", "b").union(middle.select("a", F.col("a").alias("b"))).join(middle, "a").where("b <> mid")
    members = written(members.select(F.col("mid").alias("a"), "b").distinct(), "members")
    members = members.join(sets_a, "a").join(sets_b, "b").mapInArrow(released(_apart(percent, *ordered)), "a long, b long, linked boolean, part int, tokens array<long>")
    members = written(members, "members")
    labels = relabelled(labels, members.where("linked").select("a", "b"))
    # Classes in the middle's component show, the others seek too.
    ends = members.join(ra_of(labels), "a").join(rb_of(labels), "b").withColumn("seek", F.expr("ra <> rb"))
    ends = ends.join(ends.where("seek").select("a").distinct(), "a", "left_semi")
    ends = ends.select("a", "b", "rb", "seek", "part", F.posexplode(F.when(F.col("seek"), F.col("tokens")).otherwise(F.slice("tokens", F.lit(1), F.col("part")))).alias("at", "token"))
    ends = written(ends.select("a", "b", "rb", "token", "seek", (F.col("at") < F.col("part")).alias("shows")), "ends")
    # Of the holders of a token, those in the component that has most of them do not meet one another.
    most = ends.groupBy("a", "token", "rb").agg(F.count("*").alias("c")).groupBy("a", "token").agg(F.max_by("rb", F.struct("c", "rb")).alias("major"), F.sum("c").alias("c"))
    ends = ends.join(most.where("c > 1").drop("c"), ["a", "token"])
    met_by = [F.explode(F.when(F.col("rb") != F.col("major"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(k)))).alias("by") for k in (0, 1)]
    seeks = ends.where("seek").select("a", "token", F.col("b").alias("u"), F.col("rb").alias("ru"), met_by[0])
    shows = ends.where("shows").select("a", "token", F.col("b").alias("v"), F.col("rb").alias("rv"), met_by[1])
    near = seeks.join(shows, ["a", "token", "by"]).where("ru <> rv").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    near = written(near.join(one, "a").join(other, "b").mapInArrow(released(_led(percent)), "a long, b long, may boolean, like double").where("may"), "near")

    # Groups of similar classes. A class close to no leader is a group of its own.
    kin = led.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("kin"))
    groups = labels.join(kin, "node", "left").select(F.col("node").alias("cid"), "root", F.coalesce("kin", "node").alias("kin"))
    # The sizes of large groups; they are met by parts, as a group may hold any share of the classes.
    salt = F.pmod(F.xxhash64("cid", F.lit(11)), F.lit(GROUP))
    sizes = groups.groupBy("kin").agg(F.count("*").alias("size")).where(F.col("size") > GROUP)
    sizes = sizes.select("kin", "size", F.explode(F.sequence(F.lit(0), F.lit(GROUP - 1)).cast("array<bigint>")).alias("salt"))
    groups = groups.withColumn("salt", salt).join(sizes, ["kin", "salt"], "left")
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.coalesce("size", F.lit(1)) / GROUP))
    groups = written(groups.select("cid", "root", F.xxhash64("kin", part).alias("grp")), "groups")

    # Groups that share a token and are not one component meet. Of a token's groups those that lie
    # in the component which has most of them do not meet one another.
    # Of one ball neither its core nor two other members meet: what links there is known.
    state = balls.select(F.col("a").alias("lead"), F.col("b").alias("cid"), F.when(F.col("core"), 2).otherwise(1).alias("state"))
    leaders = balls.select("a").distinct().select(F.col("a").alias("lead"), F.col("a").alias("cid"), F.lit(2).alias("state"))
    held = shared.where("many > 2").select("token", "cid", "lead", "wide").join(state.union(leaders), ["lead", "cid"], "left")
    held = held.withColumn("state", F.coalesce("state", F.lit(0))).where("wide or state < 2").join(groups, "cid")
    # In the parts of a wide token members of different balls meet.
    held = held.groupBy("token", "grp", "state", F.expr("if(wide, lead, 0)").alias("part"), "wide").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    held = written(held.withColumn("free", F.expr("wide or state = 0")), "held")
    most = held.where("free and r0 = r1").groupBy("token", "r0").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("r0", F.struct("c", "r0")).alias("major"))
    held = written(held.join(most, "token", "left").withColumn("odd", F.expr("not free or major is null or r0 <> major or r1 <> major")).drop("major"), "held")
    names = {"grp": "grp2", "state": "state2", "part": "part2", "free": "free2", "r0": "s0", "r1": "s1"}
    odd = held.where("odd").select("token", *(F.col(k).alias(v) for k, v in names.items()))
    known = "part = part2 and (state = 2 or state2 = 2 or state = 1 and state2 = 1)"
    meet = held.where("free").join(odd, "token").where(f"(not odd or not free2 or grp <= grp2) and not (r0 = r1 and s0 = s1 and r0 = s0) and not ({known})")
    meet = meet.select(F.least("grp", "grp2").alias("grp"), F.greatest("grp", "grp2").alias("grp2")).distinct()

    def matrix_of(groups: DataFrame) -> DataFrame:
        return written(groups.join(classes.select("cid", "n", "bits"), "cid").groupBy("grp").applyInArrow(
            _grouped, "grp long, cids array<long>, roots array<long>, ns array<long>, bits array<binary>, column binary"
        ), "matrix")

    def opened(matrix: DataFrame, meet: DataFrame, likeliest: bool) -> DataFrame:
        """Candidates of groups that meet, are of like size and open for one another."""
        ranges = matrix.select("grp", F.array_min("ns").alias("lo"), F.array_max("ns").alias("hi"))
        meet = meet.join(ranges, "grp").join(ranges.select(F.col("grp").alias("grp2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "grp2")
        meet = meet.where(f"100 * hi >= {percent} * lo2 and 100 * hi2 >= {percent} * lo").select("grp", "grp2")
        asked = matrix.select(*(F.col(c).alias(f"{c}2") for c in ("grp", "cids", "roots", "ns", "bits", "column")))
        found = meet.join(asked, "grp2").join(matrix.drop("column"), "grp")
        return written(found.mapInArrow(released(_opened(percent, likeliest)), "a long, b long, grp long, grp2 long, more boolean"), "opened")

    def still(pairs: DataFrame) -> DataFrame:
        """Pairs of different components, with their roots."""
        return pairs.join(ra_of(labels), "a").join(rb_of(labels), "b").where("ra <> rb")

    # Of what the balls found, too, the likeliest of each two components first.
    near_first = still(near).groupBy(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).agg(F.max_by(F.struct("a", "b"), F.struct("like", "a", "b")).alias("p")).select("p.a", "p.b")
    likely = opened(matrix_of(groups), meet, True)
    pairs = written(likely.select("a", "b").union(near_first).distinct().join(may, ["a", "b"], "left_anti"), "pairs")
    tried = may.select("a", "b").union(pairs)
    labels = relabelled(labels, links(pairs, sets_for(pairs)))
    late = written(still(near).select("a", "b").join(tried, ["a", "b"], "left_anti"), "late")
    rest = written(likely.where("more").select("grp", "grp2").distinct(), "rest")
    if rest.limit(1).count():
        some_groups = rest.select(F.explode(F.array("grp", "grp2")).alias("grp")).distinct()
        again = groups.drop("root").join(some_groups, "grp", "left_semi").join(labels.withColumnRenamed("node", "cid"), "cid").select("cid", "root", "grp")
        late = late.union(opened(matrix_of(again), rest, False).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")).distinct()
    if late.limit(1).count():
        pairs = written(late, "pairs")
        labels = relabelled(labels, links(pairs, sets_for(pairs)))

    merged = classes.select("cid", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    least = merged.groupBy("root").agg(F.min("rep").alias("component_id"))
    merged = merged.join(least, "root").select("cid", "root", "component_id")
    return rows.join(merged, "cid", "left").select("doc_id", "mark", "n", "cid", "root", "component_id")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, wide: int = WIDE_HEADS, id_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; others ignored).

    component_id is the smallest doc_id that links reach. Null or empty texts, and texts of white
    space, have no shingles and link with nothing. Repeated rows each return a row. Rows whose
    doc_id is null take part in links; alone, they have a null component_id. ``wide`` and
    ``id_bits`` change how the work is dealt, not the result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("mark"), F.col("text").cast("string").alias("text"))
    found = _components(docs, percent, width, wide, id_bits)
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (null last).

    Each row is judged by its own text, also where rows share a doc_id: of several texts of the
    smallest doc_id the one with the least hash stays, and of rows that repeat that doc_id and text
    one, whichever comes first. Rows without words are kept.
    """
    key, mark = F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))
    found = _components(docs.select(key.alias("doc_id"), mark.alias("mark"), F.col("text").cast("string").alias("text")), percent, width, WIDE_HEADS, 64)
    found = written(found.where("n > 0").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("c")), "judged")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("f")).select(F.col("root").alias("r"), "f.*")
    # One of a component's rows: small components are most, so the join is on the root alone.
    judged = found.join(first.select("r", F.col("doc_id").alias("d"), F.col("mark").alias("m")), F.col("root") == F.col("r"))
    stays = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    judged = judged.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "c", stays.alias("stays"))

    def named(rows: DataFrame, name: str) -> DataFrame:
        rows = written(rows.select("__doc", "__mark"), name)
        limit = 400_000
        return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows

    same = key.eqNullSafe(F.col("__doc")) & (mark == F.col("__mark"))
    kept = docs.join(named(judged.where("not stays"), "dropped"), same, "left_anti")
    repeated = named(judged.where("stays and c > 1"), "repeated")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, same, "left_semi").withColumn("__mark", mark).dropDuplicates(["doc_id", "__mark"]).drop("__mark")
    return kept.join(repeated, same, "left_anti").unionByName(once)
