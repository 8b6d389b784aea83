"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters counts as one blank; n-grams of 1 to 3 characters are
hashed into a fixed number of buckets. Training counts n-grams per language over labelled rows, at most about
``max_rows`` of them, drawn by a hash of the row's id; the smoothed log-probability matrix (buckets x languages,
4 bytes each) is broadcast and batches of whole texts are scored as sparse bucket lists in numpy.

Texts that are null or hold no letter get ``und`` and score 0. Ties go to the language first in order. Without
training rows every text is ``und``. Repeated rows are scored each; other columns of the input are dropped. Rows with a
null id are scored, never learned from, and not held out.

Texts are taken apart into pieces of bounded size, a long one into several, whose counts and scores add up: memory
doesn't grow with a text beyond the text itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, folding

BUCKETS = 1 << 16
#: Labelled rows that a fit reads, about.
MAX_ROWS = 20_000
#: Languages at most: their columns are broadcast.
MAX_LANGUAGES = 512
UND = "und"


def _hashed(c: np.ndarray, before: np.ndarray, far: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the n-grams of 1 to 3 symbols that end at each symbol, from the symbols one and two before it."""
    shift = np.uint32(32 - (buckets - 1).bit_length())
    one = c * np.uint32(2654435761)
    two = one + before * np.uint32(2246822519)
    three = two + far * np.uint32(3266489917)
    out = np.empty((len(c), 3), np.uint32)
    for k, (h, salt) in enumerate(((one, 1), (two, 0x9E3779B9), (three, 0x85EBCA6B))):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(salt)
        out[:, k] = ((h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)) >> shift
    return out.reshape(-1)


def hashed_ngrams(texts: list, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and where each text's begin (plus the end)."""
    cps, starts = folding.code_points(texts)
    c = folding.lower_letters()[cps].astype(np.uint32)
    letter = c > 0
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before  # a letter, or the first of a run of others
    at = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    c = c[keep]
    first = at[starts]
    pad = np.concatenate([np.zeros(2, np.uint32), c])
    far = pad[:-2].copy()
    far[first[:-1][first[:-1] < len(c)]] = 0  # not the text before
    return _hashed(c, pad[1:-1], far, buckets), first * 3


def _long(text: str, buckets: int):
    """Buckets of the n-grams of one text, in pieces; the last two symbols and whether the last character is a letter are
    carried on."""
    letter_before, last = False, np.zeros(2, np.uint32)
    for k in range(0, len(text), common.CHUNK_CHARS):
        piece = text[k : k + common.CHUNK_CHARS] + (" " if k + common.CHUNK_CHARS >= len(text) else "")
        c = folding.lower_letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint32)
        letter = c > 0
        keep = letter | np.concatenate([[letter_before], letter[:-1]])
        letter_before, c = bool(letter[-1]), c[keep]
        pad = np.concatenate([last, c])
        yield _hashed(c, pad[1:-1], pad[:-2], buckets)
        last = pad[-2:]


def grams_of(texts: list, buckets: int):
    """Yields (first text, n-gram buckets, where each text's begin plus the end) of consecutive texts; of a long text
    several times, a piece at a time."""
    for at, part in common.chunks([t or "" for t in texts], common.CHUNK_CHARS):
        if len(part[0]) > 2 * common.CHUNK_CHARS:
            for grams in _long(part[0], buckets):
                yield at, grams, np.array([0, len(grams)])
            at, part = at + 1, part[1:]
        if part:
            yield at, *hashed_ngrams(part, buckets)


def _count(buckets: int):
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in common.small(batches):
            langs = batch["lang"].to_pylist()
            for at, grams, first in grams_of(batch["text"].to_pylist(), buckets):
                for i in range(len(first) - 1):
                    own = total.setdefault(langs[at + i], np.zeros(buckets, np.int64))
                    np.add.at(own, grams[first[i] : first[i + 1]], 1)
        yield pa.RecordBatch.from_pylist([{"lang": k, "counts": v.tobytes()} for k, v in total.items()], schema)

    return run


def _sum(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch["lang"].to_pylist(), batch["counts"].to_pylist()):
            got = np.frombuffer(raw, np.int64)
            total[lang] = total[lang] + got if lang in total else got
    yield pa.RecordBatch.from_pylist([{"lang": k, "counts": v.tobytes()} for k, v in total.items()], pa.schema([("lang", pa.string()), ("counts", pa.binary())]))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages in order, float32 matrix buckets x languages) from the columns doc_id, text, lang of rows."""
    rows = rows.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    n = rows.select("lang").count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    named = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()  # before tasks hold a count for each
    if named > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; so many may be broadcast")
    counted = common.map_arrow(common.map_arrow(rows, _count(buckets), "lang string, counts binary").repartition("lang"), _sum, "lang string, counts binary")
    got = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in counted.collect()}  # a row a language
    langs = sorted(k for k, v in got.items() if v.sum())
    if not langs:
        return [], np.zeros((buckets, 0), np.float32)
    counts = np.stack([got[k] for k in langs], 1) + alpha
    return langs, np.ascontiguousarray(np.log(counts / counts.sum(0)), np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score (the posterior of lang_pred under equal priors) for doc_id, text of docs."""
    langs, matrix = model
    buckets = len(matrix)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    names = np.array([*langs, UND], dtype=object)

    def run(batches):
        m = shared.value
        for batch in common.small(batches):
            texts = batch["text"].to_pylist()
            sums, seen = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool)
            for at, grams, first in grams_of(texts, buckets) if langs else ():
                full = np.flatnonzero(np.diff(first))
                if len(full):
                    sums[at + full] += np.add.reduceat(m[grams], first[full], axis=0, dtype=np.float64)
                    seen[at + full] = True
            best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            if langs:
                p = np.exp(sums - sums.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                top = p.argmax(1)
                best[seen], score[seen] = top[seen], p[seen, top[seen]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names[best], pa.string()), pa.array(score)], schema=schema)

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the labelled rows of docs that aren't held out."""
    model = fit(docs.where(~common.holdout(F.col("doc_id"))), max_rows)
    return predict(docs, model).select("doc_id", F.coalesce(common.holdout(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
