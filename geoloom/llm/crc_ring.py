"""Importance resampling towards a target distribution, over n-grams hashed by a streaming ring of CRCs.

A text's words are its runs of ASCII letters, digits and all characters beyond ASCII, A-Z lowered. Its features are the
runs of 1 to n words, joined by a blank; a feature's bucket is the CRC-32 of its bytes modulo the number of buckets. One
scan of a document keeps the running CRC of each of the last n starts; a word extends them all by a blank and itself and
opens a new one, so that no feature is ever put together as a string. Long texts are scanned in pieces, between which the
ring is handed on: memory doesn't grow with a text.

A first pass counts buckets (each task adds up its own; the table has as many rows as buckets, however large the corpus).
The gain of a bucket is the log-ratio of its smoothed shares in target and corpus, a document's weight the sum of its
features' gains. Documents are drawn without replacement by Gumbel noise that a keyed hash of the id fixes: the highest
weight + noise win. Ranks come from sorted ranges with offsets, never from one task.

Nulls and empty texts have no features, weight 0 and too few words to be drawn. Rows are documents each for itself, also
where texts or ids repeat; equal scores of equal ids go by the written order. Rows with a null id count in the corpus, have
a null score and are never drawn. Empty tables give counts of 0 and no rows. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import components as cc

from . import common

BUCKETS = 10_000
#: Bytes of a text that are scanned at once.
PIECE = 1 << 20
#: Word bytes stay (A-Z lowered), all others become blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, PIECE bytes at a time."""
    at = 0
    while at < len(raw):
        part = raw[at : at + PIECE].translate(_WORDS)
        end = len(part) if at + PIECE >= len(raw) else part.rfind(b" ")
        while end < 0:  # a word longer than a piece
            part += raw[at + len(part) : at + len(part) + PIECE].translate(_WORDS)
            end = len(part) if at + len(part) >= len(raw) else part.rfind(b" ")
        yield part[:end].split()
        at += max(end, 1)


def scan(words: list[bytes], n: int, ring: list[int], out: list[int]) -> list[int]:
    """Appends the CRC of every run of 1 to n words that ends in ``words`` to out. ``ring`` has the running CRCs of the
    last n starts before, the oldest first; the ring after the last word is returned."""
    keep = n - 1
    for word in words:
        step = b" " + word
        ring = [crc32(step, state) for state in ring[max(0, len(ring) - keep) :]]
        ring.append(crc32(word))
        out += ring
    return ring


def features(raw: bytes, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them) of each piece of a text."""
    ring: list[int] = []
    for words in _pieces(raw):
        out: list[int] = []
        ring = scan(words, n, ring, out)
        yield len(words), np.array(out, np.uint32) % np.uint32(buckets)


def counts(texts: DataFrame, n: int = 3, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket; what the tasks hand on and the driver gets has ``buckets`` rows at most."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in common.small(batches):
            for raw in batch["text"].cast(pa.binary()).to_pylist():
                for _, got in features(raw or b"", n, buckets):
                    total += np.bincount(got, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], schema=schema)

    found = common.map_arrow(texts.select(F.col(text_col).cast("string").alias("text")).where("text is not null"), run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, total in found.groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = total
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares in target and raw, by bucket."""
    n, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (all_raw + n)) / float((s + 1) * (all_target + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """floor(1000 x) of a Gumbel draw x that seed and id fix."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_features", "weight", "score")]])
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        own = shared.value
        for batch in common.small(batches):
            rows = []
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                words = found = weight = 0
                for w, got in features(raw or b"", n, len(own)):
                    words, found, weight = words + w, found + len(got), weight + int(own[got].sum())
                rows.append((doc, words, found, weight, None if doc is None else weight + noise(doc, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def draw(weighed: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """weighed with the rank, from 1, of the rows drawn: of those with enough words and a score the given share with the
    highest scores, ties to the smaller doc_id; null for all others."""
    # a number for each row, fixed by writing it, keeps even equal rows in an order and in ranges
    rows = common.materialize(weighed.withColumns({"__down": -F.col("score"), "__row": F.monotonically_increasing_id()}), "weighed")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    size = rows.where(may).count() * percent // 100
    ranked = cc.dense(rows.where(may), ["__down", "doc_id", "__row"], "__at")
    place = F.when(F.col("__at") < size, F.col("__at") + 1).cast("long").alias("rank")
    rest = rows.where(~F.coalesce(may, F.lit(False))).withColumn("__at", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(*weighed.columns, place)


def resample(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = BUCKETS, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; target has the texts (``text``) whose
    distribution is aimed at. ``where("rank is not null")`` is the sample."""
    gain = gains(counts(docs, n, buckets, text_col), counts(target, n, buckets))
    return draw(weigh(docs, gain, n, seed, id_col, text_col), percent, least_words)
