"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded texts.

Folding lower-cases, maps look-alike letters of other scripts, accented and full-width forms to Latin, digits and
symbols that stand for letters to those letters, drops combining marks and invisible characters, and turns everything
else that isn't a letter into a blank. A run of three or more of one Latin letter is read both as one and as two of it,
and the reading that scores higher counts. Entries are word
beginnings and whole words; their weights are log odds learned from labelled rows (about ``max_rows`` of them at
most, drawn by a hash of the id, which bounds the entries too: each occurs in several of these rows). A phrase of a hit and the word before or after it that labelled rows show only in
harmless texts is an exception, as are phrases that the caller gives; a hit inside an exception doesn't count.

The score is a logistic function of the summed weight of hits, of that weight a word (the length normalisation) and
of whether there is a hit, fitted on the same rows. Null and empty texts have no hits. Without labelled rows of both
classes every score is 0. Rows with a null id are scored, never learned from, and not held out. Repeated rows are scored each; other columns of the input are dropped.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, folding

#: Labelled rows that a fit reads, about.
MAX_ROWS = 20_000
STEMS = range(4, 9)
_CHUNK = 1 << 18

# Letters that look like Latin ones, and digits and symbols that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ɑ": "a", "ı": "i", "ł": "l", "ⅼ": "l", "օ": "o", "ո": "n", "ս": "u",
}
#: Folded form of characters that fold to nothing.
GONE = 0xFFFF
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SYMBOLS = {"@": "a", "$": "s", "!": "i"}


@functools.cache
def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """(folded letter or blank, letter that a symbol stands for or 0) of each code point."""
    letters = folding.lower_letters()
    table = np.where(letters > 0, letters, 32).astype(np.uint32)
    for c in range(0xC0, 0x2000):  # accented letters without their accents, where these come apart
        s = unicodedata.normalize("NFKD", chr(c)).lower()
        base = [x for x in s if not unicodedata.combining(x)]
        if table[c] != 32 and len(base) == 1 and len(s) > 1 and base[0].isalpha():
            table[c] = ord(base[0])
    for c in [*range(0x300, 0x20F1), *range(0xFE00, 0xFE30), 0xAD, 0xFEFF, *range(0xE0000, 0xE01F0)]:
        if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf"):
            table[c] = GONE
    for c in [*range(0x1D400, 0x1D800), *range(0xFF01, 0xFF5F), *range(0x2100, 0x2190), *range(0x24B6, 0x24EA)]:
        s = unicodedata.normalize("NFKC", chr(c)).lower()
        if len(s) == 1 and s.isalnum():
            table[c] = ord(DIGITS.get(s, s))
    for a, b in {**HOMOGLYPHS, **DIGITS}.items():
        table[ord(a)] = ord(b)
        table[ord(a.upper())] = ord(b) if len(a.upper()) == 1 else table[ord(a.upper())]
    symbol = np.zeros(folding.TOP, np.uint32)
    for a, b in SYMBOLS.items():
        symbol[ord(a)] = ord(b)
    return table, symbol


def fold(texts: list) -> list[str]:
    """Each text folded: letters and blanks, between two blanks."""
    cps, starts = folding.code_points(texts)
    table, symbol = fold_table()
    out, there = table[cps], None
    gone = out == GONE
    if gone.any():
        there = np.zeros(len(out) + 1, np.int64)
        np.cumsum(~gone, out=there[1:])
        cps, out, starts = cps[~gone], out[~gone], there[starts]
    stands = symbol[cps]
    at = np.flatnonzero(stands)[::-1]
    if len(at):
        letter = out != 32
        hold = np.append(letter, False)
        for _ in range(3):  # a run of up to three symbols before a letter
            for_letter = at[hold[at + 1]]
            hold[for_letter] = True
        now = at[hold[at]]
        out[now] = stands[now]
    whole = out.tobytes().decode("utf-32-le", "replace")
    return [" " + whole[a : b - 1] + " " for a, b in zip(starts[:-1], starts[1:])]


_RUN = re.compile(r"([a-z])\1{2,}")


def readings(folded: str) -> list[str]:
    """The text, or with runs of three or more of one letter the text with one and with two of it."""
    return [_RUN.sub(r"\1", folded), _RUN.sub(r"\1\1", folded)] if _RUN.search(folded) else [folded]


def _parts(texts: list):
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > _CHUNK:
            yield texts[at:i]
            at, size = i, 0
        size += len(t or "") + 1
    if at < len(texts):
        yield texts[at:]


def _features(batches):
    """Numbers of toxic and other texts that hold each word beginning and word."""
    seen = (Counter(), Counter())
    for batch in common.small(batches):
        labels = iter(batch["toxic"].to_pylist())
        for part in _parts(batch["text"].to_pylist()):
            for own in ({w for x in readings(t) for w in x.split()} for t in fold(part)):
                got = {" " + w + " " for w in own}
                for n in STEMS:
                    got.update([" " + w[:n] for w in own if len(w) >= n])
                seen[next(labels)].update(got)
        for c in seen:
            if len(c) > 2_000_000:  # hand on what is counted so far; the sums come later
                break
        else:
            continue
        yield _counted(seen)
        seen[0].clear()
        seen[1].clear()
    yield _counted(seen)


def _counted(seen) -> pa.RecordBatch:
    keys = list(seen[0].keys() | seen[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["entry", "toxic", "other"])


class Lexicon:
    """Entries (blank + beginning, or blank + word + blank) with weights, exceptions (phrases of words), and the
    logistic weights of a score."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset(), logit: tuple = (0.0, 0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.logit = weights, exceptions, logit
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.logit, None

    def __setstate__(self, state):
        self.weights, self.exceptions, self.logit, self._automaton = state

    def hits(self, folded: str):
        """(start of the word, weight) of each word with entries, the heaviest of them; exceptions not taken out."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for k, w in self.weights.items():
                self._automaton.add_word(k, (len(k), k[-1] == " ", w))
            if self.weights:
                self._automaton.make_automaton()
        best: dict[int, float] = {}
        for end, (n, whole, w) in self._automaton.iter(folded) if self.weights else ():
            start = end - n + 2
            if best.get(start, 0.0) < w:
                best[start] = w
        return best

    def phrases(self, folded: str, start: int) -> tuple[str, str]:
        """The phrases of the word at start with the word before and the word after."""
        end = folded.index(" ", start)
        word = folded[start:end]
        before = folded[max(0, start - 64) : start].split()
        after = folded[end : end + 64].split()
        return (before[-1] if before else "") + " " + word, word + " " + (after[0] if after else "")

    def measure(self, folded: str) -> tuple[float, float, float]:
        return max(self._measure(x) for x in readings(folded))

    def _measure(self, folded: str) -> tuple[float, float, float]:
        total = 0.0
        for start, w in self.hits(folded).items():
            if not self.exceptions or not any(p in self.exceptions for p in self.phrases(folded, start)):
                total += w
        return (math.log1p(total), math.log1p(100.0 * total / (folded.count(" ") + 1)), 1.0) if total else (0.0, 0.0, 0.0)

    def score(self, folded: str) -> float:
        if not self.weights:
            return 0.0
        x = self.measure(folded)
        z = self.logit[0] + sum(a * b for a, b in zip(self.logit[1:], x))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _contexts(lexicon: Lexicon):
    def run(batches):
        seen = (Counter(), Counter())
        for batch in common.small(batches):
            labels = iter(batch["toxic"].to_pylist())
            for part in _parts(batch["text"].to_pylist()):
                for t in fold(part):
                    seen[next(labels)].update({p for x in readings(t) for start in lexicon.hits(x) for p in lexicon.phrases(x, start)})
        yield _counted(seen)

    return run


def _measured(lexicon: Lexicon):
    def run(batches):
        for batch in common.small(batches):
            x = [lexicon.measure(t) for part in _parts(batch["text"].to_pylist()) for t in fold(part)]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[k] for v in x], pa.float64()) for k in range(3)), batch["toxic"]], ["a", "b", "c", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS, exceptions: frozenset[str] = frozenset(), least: int = 5, min_odds: float = 1.5) -> Lexicon:
    """A lexicon from the columns doc_id, text, toxic (0 or 1) of rows."""
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    n = rows.select("toxic").count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    rows = common.materialize(rows, "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, exceptions)
    summed = common.map_arrow(rows.select("text", "toxic"), _features, "entry string, toxic bigint, other bigint").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    odds = F.log((F.col("t") + 0.1) / (pos + 0.2)) - F.log((F.col("o") + 0.1) / (neg + 0.2))
    picked = summed.where(F.col("t") >= least).withColumn("w", odds).where((F.col("w") >= min_odds) & (2 * F.col("t") >= F.col("o")))
    top = {r["entry"]: (r["w"], r["t"]) for r in picked.collect()}  # as bounded as the labelled rows
    weights = {}
    for k in sorted(top, key=lambda k: (len(k), k)):  # what a shorter entry covers as well adds nothing
        word = k.strip()
        if not any(" " + word[:n] in weights and weights[" " + word[:n]] >= top[k][0] - 0.7 for n in STEMS if n < len(word) or k[-1] == " " and n <= len(word)):
            weights[k] = top[k][0]
    lexicon = Lexicon(weights, exceptions)
    seen = common.map_arrow(rows.select("text", "toxic"), _contexts(lexicon), "entry string, toxic bigint, other bigint").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    learned = seen.where("o >= 3 and t = 0").collect()
    lexicon = Lexicon(weights, exceptions | {r["entry"] for r in learned})
    x = common.map_arrow(rows.select("text", "toxic"), _measured(lexicon), "a double, b double, c double, toxic int").groupBy(F.round("a", 1).alias("a"), F.round("b", 1).alias("b"), "c", "toxic").count().collect()
    data, label, times = np.array([(r["a"], r["b"], r["c"]) for r in x]), np.array([r["toxic"] for r in x], float), np.array([r["count"] for r in x])
    lexicon.logit = _logistic(np.repeat(data, times, 0), np.repeat(label, times))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score for doc_id, text of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        own = shared.value
        for batch in common.small(batches):
            got = [own.score(t) for part in _parts(batch["text"].to_pylist()) for t in fold(part)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(got, pa.float64())], ["doc_id", "score"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, score double")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled documents that aren't held out; labels repeated for a document: the largest."""
    own = labels.where(~common.holdout(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, MAX_ROWS / max(1, own.count()))))
    return docs.select("doc_id", "text").join(common.bounded(own), "doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    lexicon = fit(labelled(docs, labels))
    return score(docs, lexicon).select("doc_id", F.coalesce(common.holdout(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_below(docs: DataFrame, lexicon: Lexicon, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index(text_col)
    rows = common.plain(docs)

    def run(batches):
        own = shared.value
        for batch in common.small(batches):
            texts = batch.column(at).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([own.score(t) < threshold for part in _parts(texts) for t in fold(part)], pa.bool_()))

    return common.map_arrow(rows, run, rows.schema).toDF(*docs.columns)
