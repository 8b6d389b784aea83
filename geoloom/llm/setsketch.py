"""Near duplicates by SetSketch: exponentially spaced truncated minima, banded, compared by likelihood, then verified.

A document is the set of its distinct k-word shingles. Each of its registers keeps the smallest of exponential variables
that hashes draw for the shingles, rounded down on a scale of powers of BASE and truncated to 16 bits. Registers of a union
are the greater of both, so that sketches merge (a long text's is merged from pieces), and two documents agree in a
register with a probability close to their similarity. Seven registers are a band; documents that share a band's value
meet. With 73 bands a pair of similarity 0.8 never meets once in 3 * 10^7 pairs, one of 0.2 meets once in a thousand.

How many registers of a pair are greater, smaller and equal gives, with the known sizes of the sets, a likelihood of each
similarity. A pair is dropped before any text is read only where the threshold is e^20 times less likely than the best
estimate, or where the sizes rule it out. All others are verified on the whole sets, so that links are exact.

A band value that many documents share would name all pairs of them. These are never emitted: each value first proposes
a star around its best-connected member; verified links are merged into components. After that a value only concerns
members of different components: these are dealt into blocks by a hash, and pairs of blocks compare the sketches of such
members where they are. A first round, over some of the bands, hands on no more of the likely pairs than join its members
(a forest, the likeliest pairs first), which are verified and merged. The next one names the documents that still have a
likely partner in another component, and the first band that both share. Only there these bring their shingles along in the
last round, shortened to 32 bits each, so that pairs are counted out where they meet; what they share can only be overstated by
that. Links found are again handed on as a forest and verified on whole sets like all others.

Copies (equal sets) are one class throughout and represented by their smallest id. Nulls and empty texts have an empty set
and no links; fewer than k words are one shingle. Rows with a null id are left out. Repeated ids count as one document,
whose text is the smallest. An empty table gives an empty one. Other columns of the input aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ngram_jaccard

REGISTERS, BAND = 512, 7
BANDS = REGISTERS // BAND
#: Scale of the registers: powers of BASE, from rate RATE on; 16 bits then last for sets of any size.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Natural logarithm of how much less likely the threshold may be before a pair is dropped.
SLACK = 20.0
#: Equal registers below which a pair of the threshold's similarity lies less than once in 10^12 times.
SIGMAS = 7.2
#: Bands of the first round; of the pairs at the threshold it meets 97 in 100.
FIRST_BANDS = 16
#: Shingles hashed at once, and members of a band value that meet in one task.
CHUNK, BLOCK = 1 << 16, 2048

_SEED = common.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR = (_SEED[:REGISTERS] >> np.uint64(32)).astype(np.uint32)
_TIMES = (_SEED[REGISTERS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set (the tokens from its start on) and register the smallest 32-bit hash of its tokens."""
    x = (common.mix(tokens) >> np.uint64(32)).astype(np.uint32)
    hashed, out = np.empty_like(x), np.empty((len(starts), REGISTERS), np.uint32)
    for i in range(REGISTERS):
        np.bitwise_xor(x, _XOR[i], out=hashed)
        np.multiply(hashed, _TIMES[i], out=hashed)
        out[:, i] = np.minimum.reduceat(hashed, starts)
    return out


def registers(smallest: np.ndarray) -> np.ndarray:
    """Minima as registers: 1 minus the logarithm of the exponential variable, rounded down and truncated."""
    variable = -np.log1p(-(smallest + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variable) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of sets, one sketch a row."""
    return sketches.max(0)


def sketch_sets(sets):
    """The registers of each token set (not empty) of an iterable, in order; large sets are merged from pieces."""
    held, size = [], 0
    for tokens in sets:
        if len(tokens) > CHUNK:
            if held:
                yield from _sketched(held)
            yield merge(np.vstack([_sketched([tokens[at : at + CHUNK]]) for at in range(0, len(tokens), CHUNK)]))
            held, size = [], 0
            continue
        held.append(tokens)
        size += len(tokens)
        if size >= CHUNK:
            yield from _sketched(held)
            held, size = [], 0
    if held:
        yield from _sketched(held)


def _sketched(sets: list) -> np.ndarray:
    return registers(minima(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])))


def cardinality(sketch: np.ndarray) -> float:
    """About how many tokens a sketched set has."""
    return REGISTERS * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.sum(BASE ** -sketch.astype(float)))


def band_values(sketches: np.ndarray) -> np.ndarray:
    """BANDS 64-bit values of each sketch; band and registers both go into them."""
    parts = sketches[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
    factors = common.mix(np.arange(1, BAND + 1, dtype=np.uint64)) | np.uint64(1)
    return common.mix((parts * factors).sum(2, dtype=np.uint64) + common.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1000)))


def _log_likelihood(j, u, v, more, less, same):
    """Of similarities j, where a share u of both sizes is the first set's; from the counts of registers that are greater
    in the first set, smaller, equal."""
    share = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = share(u - v * j), share(v - u * j)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))


def estimate(na, nb, more, less) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest similarity, its log-likelihood) of pairs of sets of known sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    same = REGISTERS - more - less
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one summit
        one, two = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = _log_likelihood(one, u, v, more, less, same) >= _log_likelihood(two, u, v, more, less, same)
        low, high = np.where(left, low, one), np.where(left, two, high)
    best = (low + high) / 2
    return best, _log_likelihood(best, u, v, more, less, same)


def may_link(na, nb, more, less, percent: int) -> np.ndarray:
    """Pairs that neither sizes nor registers rule out."""
    na, nb, more, less = (np.asarray(x, float) for x in (na, nb, more, less))
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    best, top = estimate(na, nb, more, less)
    u, v = na / (na + nb), nb / (na + nb)
    at = _log_likelihood(np.full(len(u), percent / 100), u, v, more, less, REGISTERS - more - less)
    return fits & ((best >= percent / 100) | (top - at <= SLACK))


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def sketch(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n (size of the shingle set), h1, h2 (equal for equal sets), sketch (null where n is 0) of doc_id, text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for batch in common.small(batches):
            kept = []

            def sets(texts=batch["text"], kept=kept):
                for tokens in common.shingle_sets(texts, k):
                    kept.append((len(tokens), *ngram_jaccard._identity(tokens)))
                    if len(tokens):
                        yield tokens

            drawn = [s.tobytes() for s in sketch_sets(sets())]
            each = iter(drawn)
            rows = [(doc, *own, next(each) if own[0] else None) for doc, own in zip(batch["doc_id"].to_pylist(), kept)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)

    return common.map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch binary")


def _banded(sketches: DataFrame) -> DataFrame:
    """(band, value, doc_id, n), a row for each band."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = band_values(_unpack(batch["sketch"])).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n"], pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * BANDS, pa.int32()), pa.array(values.ravel()))], ["doc_id", "n", "values"])

    return common.map_arrow(sketches, run, "doc_id bigint, n bigint, values array<bigint>").select(F.posexplode("values").alias("band", "value"), "doc_id", "n")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the likelihood of their sketches leaves."""
    one, two = (sketches.select(*[F.col(c).alias(x) for c, x in (("doc_id", s), ("n", "n" + s), ("sketch", "s" + s))]) for s in "ab")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _unpack(batch["sa"]), _unpack(batch["sb"])
                keep = may_link(batch["na"].to_numpy(), batch["nb"].to_numpy(), (a > b).sum(1), (a < b).sum(1), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return common.map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb"), run, "a bigint, b bigint")


def _likely_within(rows: list, percent: int, first_band: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal registers) of a group's members that may link: of different components, in both of two blocks or all in
    one; with first_band those that share no earlier band."""
    size, part, block = (np.array([r[c] for r in rows]) for c in ("n", "c", "block"))
    low, high = block.min(), block.max()
    two = np.flatnonzero(block == high)
    sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint16).reshape(-1, REGISTERS)
    share = percent / 100
    least = REGISTERS * share - SIGMAS * np.sqrt(REGISTERS * share * (1 - share))
    left, right, equal = [], [], []
    for i in np.flatnonzero(block == low):
        j = two[(part[two] != part[i]) & (100 * np.minimum(size[two], size[i]) >= percent * np.maximum(size[two], size[i]))]
        if low == high:
            j = j[j > i]
        if len(j):
            same = (sketches[j] == sketches[i]).sum(1)
            j, same = j[same >= least], same[same >= least]
            left.append(np.full(len(j), i))
            right.append(j)
            equal.append(same)
    a, b, same = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right, equal))
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 4096):
        i, j = a[at : at + 4096], b[at : at + 4096]
        x, y = sketches[i], sketches[j]
        keep[at : at + 4096] = may_link(size[i], size[j], (x > y).sum(1), (x < y).sum(1), percent)
        if first_band:
            shared = (x[:, : BANDS * BAND] == y[:, : BANDS * BAND]).reshape(-1, BANDS, BAND).all(2)
            keep[at : at + 4096] &= shared.argmax(1) == rows[0]["band"]
    return a[keep], b[keep], same[keep]


def _forest(rows: list, pairs, holds) -> list[tuple[int, int]]:
    """The pairs (i, j), in order, that hold and join members of components that no pair before has joined."""
    top: dict = {}

    def root(c):
        while top.get(c, c) != c:
            c = top[c]
        return c

    out = []
    for i, j in pairs:
        one, other = root(rows[i]["c"]), root(rows[j]["c"])
        if one != other and holds(i, j):
            top[one] = other
            x, y = rows[i]["doc_id"], rows[j]["doc_id"]
            out.append((min(x, y), max(x, y)))
    return out


def _joining(rows: list, percent: int) -> list[tuple[int, int]]:
    """A forest of likely pairs, the likeliest first."""
    a, b, same = _likely_within(rows, percent, False)
    order = np.argsort(-same, kind="stable")
    return _forest(rows, zip(a[order].tolist(), b[order].tolist()), lambda i, j: True)


def _hopeful(rows: list, percent: int) -> list[tuple[int, int]]:
    """The members that have a likely partner, each as a pair with itself."""
    a, b, _ = _likely_within(rows, percent, True)
    return [(rows[i]["doc_id"],) * 2 for i in np.unique(np.concatenate([a, b])).tolist()]


def _meeting(rows: list, percent: int) -> list[tuple[int, int]]:
    """(value, member) of the hopeful members; pairs meet in the same value again."""
    return [(rows[0]["value"], i) for i, _ in _hopeful(rows, percent)]


def _counted(rows: list, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs that share enough, by their shortened shingles."""
    a, b, same = _likely_within(rows, percent, True)
    short: dict[int, np.ndarray] = {}

    def links(i: int, j: int) -> bool:
        for k in (i, j):
            if k not in short:
                short[k] = np.unique(np.frombuffer(rows[k]["tokens"], np.uint32))
        na, nb = rows[i]["n"], rows[j]["n"]
        both = len(np.intersect1d(short[i], short[j], assume_unique=True)) + (na - len(short[i])) + (nb - len(short[j]))
        return 100 * both >= percent * (na + nb - both)

    order = np.argsort(-same, kind="stable")
    return _forest(rows, zip(a[order].tolist(), b[order].tolist()), links)


def _within(dealt: DataFrame, percent: int, compare) -> DataFrame:
    """Distinct pairs (a, b) that ``compare`` finds in the groups (value, low, high); these lie together and are read one
    by one."""
    rows = dealt.repartition("value", "low", "high").sortWithinPartitions("value", "low", "high")

    def run(batches):
        group, held = None, []
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                key = (r["value"], r["low"], r["high"])
                if key != group:
                    found += compare(held, percent) if len(held) > 1 else []
                    group, held = key, []
                held.append(r)
            yield _pairs(found)
        yield _pairs(compare(held, percent) if len(held) > 1 else [])

    return common.map_arrow(rows, run, "a bigint, b bigint").distinct()


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(p[x]) for p in found], pa.int64()) for x in (0, 1)], ["a", "b"])


def _single(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text with each id once."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return common.materialize(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "single")


def components_of(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links lead to) and kept (whether that is its own) of each
    document; percent is the Jaccard threshold, met or exceeded."""
    docs = _single(docs, id_col, text_col)
    read = common.materialize(sketch(docs, k), "read")
    own = read.select("doc_id", "n", "h1", "h2")
    classes = common.materialize(own.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = common.bounded(classes.select(F.col("rep").alias("doc_id")))
    links = _links(docs, read.select("doc_id", "n", "sketch"), reps, k, percent)
    found = ngram_jaccard.components(links)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = own.join(named, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _links(docs: DataFrame, sketches: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified pairs (a, b) that connect the components of all links between the documents of reps."""
    flat = _banded(sketches.join(reps, "doc_id", "left_semi"))  # read twice: cheaper than writing it
    sizes = flat.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")  # a value belongs to one band
    members = common.materialize(flat.join(sizes, "value"), "members")
    degree = members.groupBy("doc_id").agg(F.sum("m").alias("degree"))
    star = F.max(F.struct("degree", (-F.col("doc_id")).alias("id"), "n")).alias("s")
    lead = members.join(degree, "doc_id").groupBy("value").agg(star).select("value", (-F.col("s.id")).alias("lead"), F.col("s.n").alias("lead_n"))
    lead = common.materialize(lead, "leads")
    tried = members.join(lead, "value").where((F.col("doc_id") != F.col("lead")) & (F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent))
    tried = common.materialize(tried.select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct(), "stars")
    sketches = common.materialize(_needed(sketches, members, tried), "sketches")
    links = common.materialize(ngram_jaccard._verified(common.materialize(_likely(tried, sketches, percent), "likely"), docs, k, percent), "links")
    rows = _open(members.where(F.col("band") < FIRST_BANDS), lead, links)
    likely = _within(_dealt(rows, sketches), percent, _joining).join(tried, ["a", "b"], "left_anti")
    links = common.materialize(links.unionByName(ngram_jaccard._verified(common.materialize(likely, "likely"), docs, k, percent)), "links")
    rows = _open(members, lead, links)
    hopeful = common.materialize(_within(_dealt(rows, sketches), percent, _meeting).toDF("value", "doc_id"), "hopeful")
    few = common.bounded(hopeful.select("doc_id").distinct())
    tokens = common.materialize(_shortened(docs.join(few, "doc_id", "left_semi"), k), "tokens")
    met = rows.join(common.bounded(hopeful), ["value", "doc_id"], "left_semi")
    found = _within(_dealt(met, sketches.join(few, "doc_id", "left_semi").join(tokens, "doc_id")), percent, _counted)
    return links.unionByName(ngram_jaccard._verified(common.materialize(found, "found"), docs, k, percent))


def _needed(sketches: DataFrame, members: DataFrame, tried: DataFrame) -> DataFrame:
    """The sketches that any comparison reads: of the pairs tried and of the values that more than two members share. Whole
    sketches travel once for this, later only these."""
    asked = tried.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.where("m > 2").select("doc_id"))
    return sketches.join(asked.distinct(), "doc_id", "left_semi")


def _shortened(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tokens: the shingles of doc_id, text as 32-bit numbers."""

    def run(batches):
        for batch in common.small(batches):
            sets = [(u >> np.uint64(32)).astype(np.uint32).tobytes() for u in common.shingle_sets(batch["text"], k)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.binary())], ["doc_id", "tokens"])

    return common.map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, tokens binary")


def _open(members: DataFrame, lead: DataFrame, links: DataFrame) -> DataFrame:
    """(band, value, doc_id, c) of the members, but for its leader, of each value that has several components."""
    found = ngram_jaccard.components(links).withColumnRenamed("node", "doc_id")
    rows = members.where("m > 2").join(lead.select("value", F.col("lead").alias("doc_id")), ["value", "doc_id"], "left_anti")
    rows = common.materialize(rows.join(found, "doc_id", "left").select("band", "value", "doc_id", F.coalesce("component", "doc_id").alias("c")), "open")
    apart = rows.groupBy("value").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("value")
    return rows.join(apart, "value", "left_semi")


def _dealt(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """rows with what their documents carry, in blocks of about BLOCK members of a value, once for each pair of blocks (low,
    high) that theirs is in: two members meet in one of these groups, none of which grows with the value."""
    sizes = rows.groupBy("value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "value").join(carried, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
