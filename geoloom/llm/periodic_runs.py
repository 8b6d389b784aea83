"""Periodic runs of words: maximal stretches that repeat a shorter one, found by Lyndon words, and texts without them.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends. Every
run has a root that is the longest Lyndon word at one of its first q starts, under one of two orders of the words: any
order and its reverse. A stack scanned right to left gives these words: suffixes leave it while the new suffix is smaller,
and what is on top then is the end of the longest Lyndon word. So each start proposes two periods, 2n in all.

Suffixes are compared word by word at first and, where these agree, by the longest common extension (LCE): a gallop and a
binary search over rolling hashes modulo 2^61 - 1, which are only computed for texts that need them. A proposed period is
extended both ways by LCE too. Whether the words of a run are identical, and whether it ends where it is said to, is then
verified on the words themselves; if a hash ever misled, the text is done again with words compared one by one. No suffix
array is built.

Words are what stands between blanks (space, tab, line feed, vertical tab, form feed, carriage return), as they are. A
text takes about 50 times its bytes in a worker while it is scanned, one text at a time; it is never cut, as a run may span
all of it. Nulls, empty texts and texts of blanks have no words, no runs and an empty collapsed text. Rows are texts each
for itself, whether or not ids repeat or are null; an empty table gives an empty one. Other columns aren't looked at.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words compared one by one before hashes are.
NEAR = 8
_PRIME = (1 << 61) - 1
#: Base of the rolling hash: an odd constant with well spread bits.
_BASE = 0x9E3779B97F4A7C15 % _PRIME
BLANKS = r"[\x20\x09-\x0D]+"


class Words:
    """Words as numbers, and the common extensions of pairs of places."""

    def __init__(self, words: list, exact: bool = False):
        number: dict = {}
        self.ids = [number.setdefault(w, len(number)) for w in words]
        self.n, self.distinct, self.exact = len(words), len(number), exact
        self._sums: list[int] = []
        self._powers: list[int] = []

    def _same(self, i: int, j: int, length: int) -> bool:
        if self.exact:
            return self.ids[i : i + length] == self.ids[j : j + length]
        if not self._sums:
            self._sums = list(accumulate(self.ids, lambda h, x: (h * _BASE + x + 1) % _PRIME, initial=0))
            self._powers = list(accumulate(range(self.n), lambda p, _: p * _BASE % _PRIME, initial=1))
        s, p = self._sums, self._powers[length]
        return (s[i + length] - s[i] * p) % _PRIME == (s[j + length] - s[j] * p) % _PRIME

    def forward(self, i: int, j: int) -> int:
        """How many words from i on are those from j on (i < j)."""
        x, most = self.ids, self.n - j
        for got in range(min(NEAR, most)):
            if x[i + got] != x[j + got]:
                return got
        if most <= NEAR:
            return most
        return self._longest(most, lambda length: self._same(i, j, length))

    def back(self, i: int, j: int) -> int:
        """How many words before i are those before j (i < j)."""
        x = self.ids
        for got in range(min(NEAR, i)):
            if x[i - 1 - got] != x[j - 1 - got]:
                return got
        if i <= NEAR:
            return i
        return self._longest(i, lambda length: self._same(i - length, j - length, length))

    @staticmethod
    def _longest(most: int, same) -> int:
        """The greatest length up to ``most`` that ``same`` holds for; it holds for NEAR and all shorter ones."""
        low, high = NEAR, 2 * NEAR
        while high <= most and same(high):
            low, high = high, 2 * high
        high = min(high, most + 1)  # the first length that is known or bound to differ
        while high - low > 1:
            middle = (low + high) // 2
            if same(middle):
                low = middle
            else:
                high = middle
        return low


def lyndon_ends(words: Words, reverse: bool = False) -> list[int]:
    """For each start the end of the longest Lyndon word there, by the order of the words' numbers or its reverse: the
    next start whose suffix is smaller."""
    n = words.n
    x = [words.distinct - v for v in words.ids] if reverse else words.ids[:]
    x.append(-1)  # the end of the text is smaller than any word
    forward, ends, stack = words.forward, [n] * n, [n]
    for i in range(n - 1, -1, -1):
        own, j = x[i], stack[-1]
        while True:
            a, b = own, x[j]
            if a == b:
                a, b = x[i + 1], x[j + 1]
                if a == b:
                    same = forward(i, j)
                    a, b = x[i + same], x[j + same]
            if a >= b:  # they can't be equal: one of the suffixes ends before the other
                break
            stack.pop()
            j = stack[-1]
        ends[i] = j
        stack.append(i)
    return ends


def _runs(words: Words, least_words: int, least_periods: int) -> set[tuple[int, int, int]]:
    x, n, found = words.ids, words.n, set()
    for reverse in (False, True):
        last: dict[int, tuple[int, int]] = {}  # of each period the run found last
        for i, j in enumerate(lyndon_ends(words, reverse)):
            q = j - i
            # a run of three periods has a root whose next occurrence is whole
            if j + q > n or x[i] != x[j] or x[j - 1] != x[j + q - 1]:
                continue
            known = last.get(q)
            if known and i + 2 * q <= known[1]:
                continue
            same = words.forward(i, j)
            if same < q:
                continue
            start, end = i - words.back(i, j), j + same
            last[q] = (start, end)
            if end - start >= max(least_words, least_periods * q):
                found.add((start, end - start, q))
    return found


def _holds(x: list[int], run: tuple[int, int, int]) -> bool:
    start, length, q = run
    end = start + length
    return x[start : end - q] == x[start + q : end] and (start == 0 or x[start - 1] != x[start + q - 1]) and (end == len(x) or x[end] != x[end - q])


def runs_of(words: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least so many words and periods (three or more), by start and period."""
    if least_periods < 3:
        raise ValueError("runs of three periods or more are found")
    if len(words) < max(least_words, least_periods):
        return []
    numbers = Words(words)
    found = _runs(numbers, least_words, least_periods)
    if not all(_holds(numbers.ids, run) for run in found):
        found = _runs(Words(words, exact=True), least_words, least_periods)
    return sorted((s, length, q) for s, length, q in found)


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that some run contains after its first period."""
    out, at = [], 0
    for start, end in sorted((s + q, s + length) for s, length, q in runs):
        if end > at:
            out += words[at : max(at, start)]
            at = end
    return out + words[at:]


def find(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period) and collapsed, the kept words joined by one blank, of each text."""
    place = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("runs", place), ("collapsed", pa.string())])

    def run(batches):
        for batch in common.small(batches):
            ids, found, texts = batch["doc_id"], [], []
            for raw in batch["text"].cast(pa.binary()).to_pylist():
                words = (raw or b"").split()
                own = runs_of(words, least_words, least_periods)
                found.append([dict(zip(("start", "length", "period"), r)) for r in own])
                texts.append(b" ".join(collapse(words, own) if own else words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, place), pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties go to the smaller start, then period."""
    def order(a: Column, b: Column) -> Column:
        mine, other = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(mine > other, -1).when(mine < other, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)

    return F.get(F.array_sort(runs, order), F.lit(0))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run, and hashes of all runs and of the
    collapsed text."""
    top = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, a tenth of which (by the CRC of their ids) repeats words from some place on: word i >= a is
    word a + (i - a) % p. Texts that change have one blank between words; rows with a null id never change."""
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = rows.withColumns({"g": F.floor(h / 10), "w": F.when(h % 10 == 0, words)}).withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a")
    chosen = chosen.select("doc_id", "text", "w", "n", "g", a).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    i = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    source = F.transform(i, lambda k: F.get("w", F.when(k < F.col("a"), k).otherwise(F.col("a") + (k - F.col("a")) % F.col("p")).cast("int")))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))
