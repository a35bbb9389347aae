"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over windows, exact verification.

A document is contaminated by a benchmark item of n words if some stretch of it is within
``n * (1 - SIMILARITY)`` word edits of the item.

1. Windows. Each position of a document starts an item-sized window. A window stays only if it
   holds as many benchmark word triples (pairs for items of 5 and 8 words) as any match must:
   ``n - q + 1 - q * k`` for k edits. The bound loses no match.
2. Embedding. The CGK random walk reads a window from its start; at step j it emits the current
   word and moves on or stays by a random bit of (j, word). Words within few edits fall back into
   step, so edit distance becomes Hamming distance. One walk serves windows of all lengths.
3. LSH. For each of ``WALKS`` walks and ``BANDS`` bands, ``SAMPLED`` steps are sampled below
   1.5 n; a window whose sampled words equal an item's is a candidate for that item.
4. Verification. Candidates are compared with the item by exact edit distance, with free ends.

The benchmark goes to the tasks in blocks of about ``BLOCK_WORDS`` words, one pass for each block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SQL, column_of, released, texts_of

SIMILARITY = 0.75
#: Items of fewer words have no windows that the bound could tell apart; they match where they stand word for word.
MIN_WORDS = 5
WALKS, BANDS, SAMPLED = 10, 4, 2
BLOCK_WORDS = 200_000
#: Bytes of text, and rows, worked on at a time.
CHUNK, ROWS = 2_000_000, 2_048

_BREAKS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * (128 - 62))


def words_of(text: bytes | None) -> list[bytes]:
    """Words without case (A-Z) and ASCII punctuation."""
    return text.lower().translate(_BREAKS).split() if text else []


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int(n * (1 - similarity) + 1e-9)


def _masks(pattern: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(pattern):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def edit_scores(masks: dict[int, int], n: int, text: list[int], free_start: bool) -> list[int]:
    """Least edits of the whole pattern and text[s:j] for j = 0, 1, ...; s = 0 unless the start is free.

    Bit-parallel (Myers 1999; Hyyrö 2003), with Python's integers as long words.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    scores = [n]
    for w in text:
        eq = masks.get(w, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(d0 | up)
        minus = d0 & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) if free_start else ((plus << 1) | 1)
        minus <<= 1
        up = (minus | ~(d0 | plus)) & full
        down = plus & d0 & full
        scores.append(score)
    return scores


def best_match(pattern: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the closest stretch of text, the earliest of those, or None."""
    scores = edit_scores(_masks(pattern), len(pattern), text, True)
    edits = min(scores)
    if edits > most:
        return None
    end = scores.index(edits)
    back = edit_scores(_masks(pattern[::-1]), len(pattern), text[:end][::-1], False)
    return edits, end - back.index(edits), end


class Index:
    """The benchmark items of a block, embedded."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float = SIMILARITY, seed: int = 5, walks: int = WALKS):
        rng = np.random.default_rng(seed)
        items = sorted((x for x in items if x[1]), key=lambda x: len(x[1]) < MIN_WORDS)
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)  # 0: in no item
        self.items = [(i, [self.vocabulary[w] for w in words]) for i, words in items]
        self.similarity, self.walks = similarity, walks
        self.lengths = sorted({len(p) for _, p in self.items if len(p) >= MIN_WORDS})
        self.brief: dict[int, list[int]] = {}  # short items by their first word
        for at, (_, p) in enumerate(self.items):
            if len(p) < MIN_WORDS:
                self.brief.setdefault(p[0], []).append(at)
        self.steps = 0
        if not self.lengths:
            return
        self.steps = max(2, int(1.5 * self.lengths[-1]) + 1)
        size = len(self.vocabulary) + 1
        self.coins = rng.integers(0, 2**63, (walks, -(-self.steps // 62), size), dtype=np.int64)
        # q-grams of all items as a bitmap; a false member only keeps a window that others drop
        self.bound = {}
        for n in self.lengths:
            k = allowed(n, similarity)
            q = 3 if n - 2 - 3 * k >= 1 else 2
            self.bound[n] = (q, max(1, n - q + 1 - q * k), n + k)
        self.mix = rng.integers(1, 2**63, 3, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.members = {}
        for q in {b[0] for b in self.bound.values()}:
            bits = np.zeros(1 << 22, bool)
            for _, p in (x for x in self.items if len(x[1]) >= MIN_WORDS):
                bits[self.grams(np.array(p, np.int64), q, np.arange(len(p) - q + 1))] = True
            self.members[q] = bits
        # sampled steps and the items' keys
        self.samples, self.keys = {}, {}
        self.odd = rng.integers(1, 2**63, (SAMPLED,), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for n in self.lengths:
            mine = [(at, p) for at, (_, p) in enumerate(self.items) if len(p) == n]
            rows = np.zeros((len(mine), 2 * n + self.steps + 2), np.int64)
            for r, (_, p) in enumerate(mine):
                rows[r, :n] = p
            flat, starts = rows.ravel(), np.arange(len(mine)) * rows.shape[1]
            for walk in range(walks):
                self.samples[n, walk] = np.array([rng.choice(int(1.5 * n), SAMPLED, replace=False) for _ in range(BANDS)])
                seen = self.walked(flat, starts, walk, int(1.5 * n))[self.samples[n, walk]]
                keys = self.key(seen)
                table: dict[int, list[int]] = {}
                for band, r in np.argwhere((seen > 0).all(axis=1)).tolist():
                    table.setdefault(int(keys[band, r]), []).append(mine[r][0])
                self.keys[n, walk] = (np.array(sorted(table), np.uint64), [table[x] for x in sorted(table)])

    def grams(self, ids: np.ndarray, q: int, at: np.ndarray) -> np.ndarray:
        h = ids[at].astype(np.uint64) * self.mix[0]
        for j in range(1, q):
            h += ids[at + j].astype(np.uint64) * self.mix[j]
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(20) & np.uint64((1 << 22) - 1)).astype(np.int64)

    def key(self, sampled: np.ndarray) -> np.ndarray:
        """Bucket of each band and window, from words sampled as (band, sample, window)."""
        out = np.arange(1, len(sampled) + 1, dtype=np.uint64)[:, None] << np.uint64(48)
        for j, odd in enumerate(self.odd):
            out = (out ^ sampled[:, j].astype(np.uint64)) * odd
        return out

    def walked(self, ids: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """What the walk emits at each step, for each start."""
        at, out = starts.copy(), np.empty((steps, len(starts)), np.int64)
        for j in range(steps):
            out[j] = ids[at]
            at += (self.coins[walk, j // 62][out[j]] >> (j % 62)) & 1
        return out

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, window starts) that share a bucket; ids ends with enough zeros for a walk."""
        if not self.lengths:
            return
        hits = {}
        for q, bits in self.members.items():
            known = ids[: len(ids) - q + 1] > 0
            for j in range(1, q):
                known &= ids[j : len(ids) - q + 1 + j] > 0
            at = np.flatnonzero(known)
            hits[q] = at[bits[self.grams(ids, q, at)]]
        stay = {}
        for n, (q, least, span) in self.bound.items():
            # least hits within span: a match around them starts between these two ends
            h = hits[q]
            if len(h) < least:
                continue
            first, last = h[: len(h) - least + 1], h[least - 1 :]
            close = last - first <= span - q
            low, high = np.maximum(last[close] - (span - q), 0), first[close]
            if len(low):
                low = np.maximum(low, np.concatenate([[0], high[:-1] + 1]))  # ends only grow: no start twice
                size = high - low + 1
                stay[n] = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        if not stay:
            return
        starts = np.unique(np.concatenate(list(stay.values())))
        stay = {n: np.searchsorted(starts, rows) for n, rows in stay.items()}
        steps = int(1.5 * max(stay))
        for walk in range(self.walks):
            seen = self.walked(ids, starts, walk, steps)
            for n, rows in stay.items():
                known, owners = self.keys[n, walk]
                if not len(known):
                    continue
                keys = self.key(seen[self.samples[n, walk][:, :, None], rows])
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                bands, same = np.nonzero(known[at] == keys)
                slots = at[bands, same]
                for slot in np.unique(slots):
                    where = starts[rows[np.unique(same[slots == slot])]]
                    for item in owners[slot]:
                        yield item, where

    def matches(self, docs: list[list[bytes]]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, start, end) for each contaminated document and item."""
        if not self.items:
            return []
        get = self.vocabulary.get
        offsets = np.cumsum([0] + [len(d) + 1 for d in docs])
        ids = np.zeros(offsets[-1] + self.steps + 2, np.int64)
        for d, o in zip(docs, offsets, strict=False):
            ids[o : o + len(d)] = list(map(get, d, repeat(0)))
        blocks: set[tuple[int, int, int]] = set()
        for item, where in self.candidates(ids):
            n = len(self.items[item][1])
            doc = np.searchsorted(offsets, where, side="right") - 1
            blocks.update(zip([item] * len(where), doc.tolist(), ((where - offsets[doc]) // n).tolist(), strict=True))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for at in np.flatnonzero(np.isin(ids, list(self.brief))).tolist() if self.brief else ():
            for item in self.brief[int(ids[at])]:
                pattern = self.items[item][1]
                doc = int(np.searchsorted(offsets, at, side="right")) - 1
                if (doc, item) not in best and ids[at : at + len(pattern)].tolist() == pattern:  # a zero parts the documents
                    best[doc, item] = (0, at - int(offsets[doc]), at - int(offsets[doc]) + len(pattern))
        bags = {item: Counter(self.items[item][1]) for item, _, _ in blocks}
        for item, doc, block in sorted(blocks):
            pattern = self.items[item][1]
            n, k = len(pattern), allowed(len(pattern), self.similarity)
            a = max(0, block * n - n - k)
            b = min(len(docs[doc]), (block + 2) * n + k)
            text = ids[offsets[doc] + a : offsets[doc] + b].tolist()
            bag = bags[item]
            if sum(min(c, text.count(w)) for w, c in bag.items()) < n - k:
                continue
            found = best_match(pattern, text, k)
            if found:
                entry = (found[0], a + found[1], a + found[2])
                if (doc, item) not in best or entry < best[doc, item]:
                    best[doc, item] = entry
        return [(doc, item, *entry) for (doc, item), entry in sorted(best.items())]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows, so that few texts are Python objects at a time."""
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def _matched(index: Index):
    names = ("doc_id", "item_id", "edits", "n_words", "start_word", "end_word")

    def run(batches):
        for batch in _pieces(batches):
            ids, texts = column_of(batch, "doc_id"), texts_of(batch)
            rows, at = [], 0
            while at < len(ids):
                first, size = at, 0
                while at < len(ids) and (at == first or size + len(texts[at] or b"") <= CHUNK):
                    size += len(texts[at] or b"")
                    at += 1
                for doc, item, edits, start, end in index.matches([words_of(t) for t in texts[first:at]]):
                    rows.append((ids[first + doc], index.items[item][0], edits, len(index.items[item][1]), start, end))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 6)], names=list(names))

    return run


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of about BLOCK_WORDS words."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD_SQL)))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield [(r["item_id"], words_of(r["text"].encode())) for r in sorted(rows, key=lambda r: (r["item_id"], r["text"]))]


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edits, n_words, start_word, end_word): what contaminates each document.

    A row for each row of ``docs`` and item with a match: the closest stretch, the earliest of
    those, in words (end exclusive). Clean documents return nothing, so null, empty and short texts
    do not, nor does anything match a null item or one without words; items of fewer than
    ``MIN_WORDS`` words match without edits. Items that repeat each return rows, and so do rows of ``docs`` that repeat.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, edits long, n_words long, start_word long, end_word long"
    out = None
    for items in blocks_of(benchmark):
        part = docs.mapInArrow(released(_matched(Index(items, similarity))), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(index: Index):
    def run(batches):
        for batch in _pieces(batches):
            texts = texts_of(batch)
            keep, at = np.ones(len(texts), bool), 0
            while at < len(texts):
                first, size = at, 0
                while at < len(texts) and (at == first or size + len(texts[at] or b"") <= CHUNK):
                    size += len(texts[at] or b"")
                    at += 1
                for doc, *_ in index.matches([words_of(t) for t in texts[first:at]]):
                    keep[first + doc] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that any item contaminates; all columns stay."""
    for items in blocks_of(benchmark):
        docs = docs.mapInArrow(released(_clean(Index(items, similarity))), docs.schema)
    return docs
