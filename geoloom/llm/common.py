"""Shared pieces of the text operators: scratch tables, bounded broadcasts, word hashing."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20

_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes hashed and characters classified at once; a longer single text is still taken whole.
CHUNK_BYTES = 1 << 20
CHUNK_CHARS = 1 << 18
#: What the JVM hands to a Python worker at once, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a local one serves a single JVM; on a cluster
    that is an error."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return got.rstrip("/") if got else "file:///tmp/checkpoints/geoloom"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most ``limit`` rows of ``most_bytes`` in all (counted, 16 bytes a column and
    the lengths of its strings), else df itself for a shuffle join."""
    size = F.lit(16 * len(df.columns))
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{c}`"), F.lit(0))
    got = df.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return F.broadcast(df) if got["n"] <= limit and (got["b"] or 0) <= most_bytes else df


def cols(names: list[str]) -> list:
    """Columns by their names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def plain(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names with dots can't go through Arrow functions."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded size, after each of which the worker's free memory goes back to the system:
    a worker lives through many stages, beside others."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"[^0-9-]", "", conf.get(key)) or 0)
        if now <= 0 or now > most:
            conf.set(key, most)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(lean, schema)


def trim() -> None:
    """Returns memory that Arrow and the allocator hold in reserve."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def holdout(doc_id) -> "F.Column":
    """True where crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, base in enumerate((_B, _BINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(texts: list, most: int = CHUNK_BYTES):
    """Consecutive slices of texts of about ``most`` bytes in all (one text at least)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def small(batches, rows: int = 1000):
    """Arrow batches cut to so many rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hash_words(texts: list[bytes], separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of UTF-8 texts, A-Z lowered, cut at the separator bytes.

    Returns (hash, index of the first word of each text plus the total, first byte, end byte); bytes count
    from the start of the joined texts, in which one blank follows each text."""
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    gap = separators[buf]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return h, np.searchsorted(starts, offsets), starts, ends


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_B)) | np.uint64(1)


def shingle(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words: len(h) - k + 1 of them, or one for a shorter non-empty sequence."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return mix(np.array([np.sum(h * _FACTORS[:n], dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = h[: n - k + 1] * _FACTORS[0]
    for j in range(1, k):
        out = out + h[j : n - k + 1 + j] * _FACTORS[j]
    return mix(out)


def _cut(text: bytes, separators: np.ndarray):
    """Pieces of a long text of about CHUNK_BYTES, cut at separators."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        while end < len(text):
            gap = np.flatnonzero(separators[np.frombuffer(text, np.uint8, min(4096, len(text) - end), end)])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end += 4096
        yield text[at:end]
        at = end


def shingle_sets(texts, k: int, separators: np.ndarray = _SPACE):
    """Yields the sorted distinct shingle hashes of each text of an Arrow array or list, in order. Arrow's bytes are used
    as they are, a slice at a time, so that no more than a slice is held as Python objects."""
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        if isinstance(part, pa.Array):
            part = part.cast(pa.binary()).to_pylist()
        raw = [(t.encode() if isinstance(t, str) else t) if t else b"" for t in part]
        for _, own in chunks(raw):
            if len(own[0]) > 4 * CHUNK_BYTES:
                yield np.unique(shingle(np.concatenate([hash_words([x], separators)[0] for x in _cut(own[0], separators)]), k))
                own = own[1:]
            if not own:
                continue
            h, first, _, _ = hash_words(own, separators)
            for i in range(len(own)):
                yield np.unique(shingle(h[first[i] : first[i + 1]], k))
