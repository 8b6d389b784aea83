"""Benchmark decontamination by SimHash windows.

Words are runs of letters and digits (and of all signs outside ASCII), in lower case. For each benchmark item of L
words the windows of L words of a document are compared with it by the weighted Jaccard similarity of their k-word
shingles, the weights being the numbers of occurrences; at ``threshold`` or more the window holds the item. Items of
fewer than k words are one shingle. A document shorter than the item is one window as a whole.

A window of n shingles and an item of c can only be that similar if they share threshold / (1 + threshold) * (n + c) of
them; windows of which fewer occur in the benchmark at all are left out by running sums. The others get a 256-bit
SimHash, in which the j-th occurrence of a shingle counts as a feature of its own: so every feature weighs 1, and the
weighted similarity is that of the sets of features. Items of the window's size are found by a multi-index of 32 8-bit
blocks: a table for each block tells for a block's value, as a mask over these items, those whose block differs in at
most b = radius // 32 bits. Two fingerprints within ``radius`` are that near in at least 32 - radius // (b + 1) blocks,
so the items that so many masks name are all items within the radius, and some more. Their whole fingerprints are
compared, and the exact similarity then decides. Adding the masks up takes 32 bits for each item of the window's size,
near or not: with a radius of nearly a third of the bits, lists of the near ones would hold a seventh of the items a block.

At a similarity of 0.8 each bit differs with probability 0.152 whatever the words are, 39 of 256 on average with a
deviation of 5.7; the default radius of 79 is passed by about one such window in 10^11.

The benchmark is broadcast; its size is checked against ``MAX_WORDS``. Null and empty texts and items match nothing.
Repeated documents are matched each; repeated items by each id. Rows of documents with a null id give no match, but
``keep_clean`` decides on every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of all items together that may be broadcast (about 100 bytes each).
MAX_WORDS = 5_000_000
RADIUS = 79
BLOCKS = 32
_BITS = 256
_AT_ONCE = 256  # windows that get fingerprints at once

WORD_GAPS = np.ones(256, dtype=bool)
WORD_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def lowered(text: str | None) -> str:
    """The text in lower case, with as many code points."""
    return text.replace("İ", "i").lower() if text else ""


def fingerprints(windows: np.ndarray) -> np.ndarray:
    """256-bit fingerprints (32 8-bit blocks) of windows, one row of shingles each."""
    count = windows.shape[1]
    s = np.sort(windows, axis=1)
    place = np.arange(count)
    first = np.where(np.diff(s, axis=1, prepend=s[:, :1]) != 0, place, 0)
    nth = (place - np.maximum.accumulate(first, axis=1)).astype(np.uint64)  # which occurrence of its shingle
    features = common.mix(s + nth * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros((len(s), _BITS), np.int32)
    for word in range(_BITS // 64):
        h = common.mix(features + np.uint64(word * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        bits = np.unpackbits(h.view(np.uint8).reshape(len(s), count, 8), axis=2)
        sums[:, word * 64 : (word + 1) * 64] = bits.sum(1, dtype=np.int32)
    return np.packbits(2 * sums > count, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sequences of shingles."""
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class MultiIndex:
    """Fingerprints by their blocks: for each block and value a bit mask of the fingerprints that are near in it (1 kB of
    tables a fingerprint)."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        near = radius // BLOCKS
        self.blocks = max(1, BLOCKS - radius // (near + 1))
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :, None] ^ prints.T[:, None, :])
        self.tables = np.packbits(apart <= near, axis=2, bitorder="little")  # block, value, mask

    def within(self, found: np.ndarray) -> list[np.ndarray]:
        """Numbers of the fingerprints within the radius of each of several."""
        masks = self.tables[np.arange(BLOCKS), found]  # fingerprint, block, mask
        times = np.unpackbits(masks, axis=2, count=len(self.prints), bitorder="little").sum(1, dtype=np.uint8)
        i, number = np.nonzero(times >= self.blocks)
        close = np.bitwise_count(self.prints[number] ^ found[i]).sum(1, dtype=np.int64) <= self.radius
        return np.split(number[close], np.cumsum(np.bincount(i[close], minlength=len(found)))[:-1])


class Index:
    """Items by number of words: their shingles and the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], k: int, threshold: float, radius: int):
        self.k, self.threshold = k, threshold
        h, first, _, _ = common.hash_words([lowered(t).encode() for _, t in items], WORD_GAPS) if items else (np.zeros(0, np.uint64), [0], None, None)
        by: dict[int, list] = {}
        for i, (item, _) in enumerate(items):
            words = h[first[i] : first[i + 1]]
            if len(words):
                by.setdefault(len(words), []).append((item, common.shingle(words, min(k, len(words)))))
        self.sizes = {size: (own, MultiIndex(fingerprints(np.stack([s for _, s in own])), radius), len(own[0][1])) for size, own in sorted(by.items())}
        self.known = {}  # by words a shingle: all shingles of items, and marks of their first bits
        for n in sorted({min(k, size) for size in self.sizes}):
            shingles = np.unique(np.concatenate([s for size, (own, _, _) in self.sizes.items() if min(k, size) == n for _, s in own]))
            marks = np.zeros(1 << 20, bool)
            marks[(shingles >> np.uint64(44)).astype(np.int64)] = True
            self.known[n] = (shingles, marks)

    def _hits(self, n: int, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that occur in items."""
        known, marks = self.known[n]
        at = np.flatnonzero(marks[(shingles >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(known, shingles[at])
        return at[known[np.minimum(low, len(known) - 1)] == shingles[at]]

    def find(self, words: np.ndarray):
        """Yields (item, first word, words, similarity): per item the most similar window, the first of ties."""
        best: dict[int, tuple] = {}
        for n in self.known:
            if len(words) < n:
                continue
            s = common.shingle(words, n)
            hits = self._hits(n, s)
            run = None
            for size, (own, index, count) in self.sizes.items() if len(hits) else ():
                if min(self.k, size) != n:
                    continue
                # of a document with fewer shingles than the item the window is the whole of it
                width = min(len(s), count)
                least = int(np.ceil(self.threshold / (1 + self.threshold) * (width + count) - 1e-9))
                if len(hits) < least or width < least:
                    continue
                if run is None:
                    run = np.zeros(len(s) + 1, np.int32)
                    run[hits + 1] = 1
                    run = np.cumsum(run, dtype=np.int32)
                starts = np.flatnonzero(run[width:] - run[:-width] >= least)
                for k in range(0, len(starts), _AT_ONCE):
                    part = starts[k : k + _AT_ONCE]
                    windows = s[part[:, None] + np.arange(width)]
                    for at, window, found in zip(part.tolist(), windows, index.within(fingerprints(windows))):
                        for i in found:
                            item, shingles = own[i]
                            sim = similarity(window, shingles)
                            if sim >= self.threshold - 1e-12 and (item not in best or (-sim, at) < (-best[item][2], best[item][0])):
                                best[item] = (at, min(size, len(words)), sim)
        for item, (at, size, sim) in sorted(best.items()):
            yield item, at, size, sim


def _index(benchmark: DataFrame, k: int, threshold: float, radius: int):
    """The broadcast index of a benchmark whose size is checked."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    words = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if words > MAX_WORDS * 6:
        raise ValueError(f"the benchmark has {words} characters; up to {MAX_WORDS * 6} may be broadcast: split it")
    return benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.orderBy("item_id", "text").collect()], k, threshold, radius))


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_char, end_char, similarity: per document and item the most similar window; positions are
    code points, end exclusive."""
    shared = _index(benchmark, k, threshold, radius)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        index: Index = shared.value
        for batch in common.small(batches):
            ids, raw = batch["doc_id"].to_pylist(), [lowered(t).encode() for t in batch["text"].to_pylist()]
            rows = []
            for base, part in common.chunks(raw):
                h, first, starts, ends = common.hash_words(part, WORD_GAPS)
                offset = 0
                for i, text in enumerate(part):
                    for item, at, size, sim in index.find(h[first[i] : first[i + 1]]):
                        a, b = int(starts[first[i] + at]) - offset, int(ends[first[i] + at + size - 1]) - offset
                        start = len(text[:a].decode())
                        rows.append((ids[base + i], item, start, start + len(text[a:b].decode()), sim))
                    offset += len(text) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return common.map_arrow(rows, run, "doc_id bigint, item_id bigint, start_char bigint, end_char bigint, similarity double")


def keep_clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item; each row is judged by itself, whatever its id."""
    shared, at = _index(benchmark, k, threshold, radius), docs.columns.index(text_col)
    rows = common.plain(docs)

    def run(batches):
        index: Index = shared.value
        for batch in common.small(batches):
            keep = []
            for _, part in common.chunks([lowered(t).encode() for t in batch.column(at).cast(pa.string()).to_pylist()]):
                h, first, _, _ = common.hash_words(part, WORD_GAPS)
                keep += [next(index.find(h[first[i] : first[i + 1]]), None) is None for i in range(len(part))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return common.map_arrow(rows, run, rows.schema).toDF(*docs.columns)
