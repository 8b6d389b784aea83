"""Exact n-gram Jaccard self-join with token-combination prefixes.

A document is the set of its distinct k-word shingles. Tokens (shingles) get one global order, rare first, from
document counts kept in a fixed number of hash buckets. For a threshold p% a document of n tokens can miss at most
tau = n - ceil(p n / 100) of them in any partner. Its prefix is extended until losing tau tokens still leaves a
signature whole: rare tokens are indexed singly; frequent tokens are dealt by hash into classes, and a class with c
tokens in the prefix yields its pairs of tokens and survives c - 1 losses. Two linked documents therefore always
share a signature, which is sparse even where every single token is frequent. Candidates are verified on whole sets.

Each signature of a document carries the most tokens that a partner can share if this is the first signature they
share: those from the token on, or the frequent ones. This bounds the similarity of a pair before any set is read.

The shared signatures of a group of m near copies name m(m-1)/2 pairs; for components these are not emitted. Each
signature first proposes a star (the member with the fewest tokens of its own against the others); verified links are
merged into components. After that a signature only concerns members that its best member of another component could
still link with by the bound; pairs of these in different components are bounded again and verified. No link that
would change a component is lost.

Copies (equal sets) are one class throughout and represented by their smallest id.

Nulls and empty texts have an empty set and no links. Rows with a null id are left out. Repeated ids count as one
document, whose text is the smallest. Other columns of the input aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash buckets of the document counts (bytes broadcast), at least and at most; in between there is one for every 64
#: tokens, so that rare tokens stay apart in larger corpora. Fewer only make the prefixes less selective.
BUCKETS, MOST_BUCKETS = 1 << 22, 1 << 25
#: Members of a signature that meet in one task.
BLOCK = 512
SLICES = 64
HISTOGRAM = 64


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _identity(u: np.ndarray) -> tuple[int, int]:
    a, b = common.mix(u + np.uint64(0x9E3779B97F4A7C15)), common.mix(u ^ np.uint64(0xD1B54A32D192ED03))
    return int(np.sum(a, dtype=np.uint64).view(np.int64)), int(np.sum(b, dtype=np.uint64).view(np.int64))


def _read_sets(k: int, buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total = None
        for batch in common.small(batches):
            rows = []
            total = np.zeros(buckets, np.uint32) if total is None else total
            for doc, u in zip(batch["doc_id"].to_pylist(), common.shingle_sets(batch["text"], k)):
                rows.append((doc, len(u), *_identity(u), None, None))
                # the tokens of a text are distinct, but not their buckets
                np.add.at(total, (u & np.uint64(buckets - 1)).astype(np.int64), np.uint32(1))
            yield _arrow(rows, schema)
        if total is not None:
            step = buckets // SLICES
            yield _arrow([(None, None, None, None, i, zstandard.compress(total[i * step : (i + 1) * step].tobytes(), 1)) for i in range(SLICES)], schema)

    return run


def _sum_slices(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
            got = np.frombuffer(zstandard.decompress(raw), np.uint32).astype(np.uint64)
            sums[i] = sums[i] + got if i in sums else got
    schema = pa.schema([("slice", pa.int32()), ("level", pa.binary()), ("total", pa.int64())])
    yield _arrow([(i, np.minimum(255, np.ceil(4 * np.log2(v + 1.0))).astype(np.uint8).tobytes(), int(v.sum())) for i, v in sums.items()], schema)


def signatures(u: np.ndarray, level: np.ndarray, frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a token set and what a partner can share at most from each on; level has the count class of each
    token, classes from ``frequent`` on are frequent."""
    n = len(u)
    if n == 0:
        return u, np.zeros(0, np.int32)
    tau = n - -(-percent * n // 100)
    order = np.lexsort((u, level))
    u, level = u[order], level[order]
    rare = int(np.searchsorted(level, frequent))
    left = np.arange(n, n - min(rare, tau + 1), -1, dtype=np.int32)
    if rare > tau:
        return common.mix(u[: tau + 1]), left
    out, lefts = [common.mix(u[:rare])], [left]
    # the number of classes depends on the size; a document also serves the next number that a larger partner may have
    largest = n * 100 // percent
    for groups in {_groups(n, percent), _groups(largest, percent)}:
        rest = u[rare:]
        cls = (common.mix(rest ^ np.uint64(groups)) >> np.uint64(20)) % np.uint64(groups)
        seen = np.zeros(groups, np.int64)
        lost, end = rare, 0  # losses that the prefix survives
        for c in cls.astype(np.int64).tolist():
            if lost > tau:
                break
            seen[c] += 1
            lost += seen[c] > 1
            end += 1
        for c in np.flatnonzero(seen > 1):
            own = np.sort(rest[:end][cls[:end] == c])
            i, j = np.triu_indices(len(own), 1)
            out.append(common.mix(own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j] + np.uint64(groups)))
            lefts.append(np.full(len(i), n - rare, np.int32))
    got, at = np.unique(np.concatenate(out), return_index=True)
    return got, np.concatenate(lefts)[at]


def _groups(n: int, percent: int) -> int:
    return 1 << max(0, int(n * (100 - percent) // 800).bit_length() - 1)


def _read_signatures(k: int, buckets: int, percent: int, shared, frequent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("histogram", pa.binary()), ("signature", pa.list_(pa.int64())), ("rest", pa.list_(pa.int32()))])

    def run(batches):
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in common.small(batches):
            ids, sizes, hist, sigs, rests, ends = [], [], [], [], [], [0]
            for doc, u in zip(batch["doc_id"].to_pylist(), common.shingle_sets(batch["text"], k)):
                if not len(u):
                    continue
                got, left = signatures(u, levels[(u & np.uint64(buckets - 1)).astype(np.int64)], frequent, percent)
                ids.append(doc)
                sizes.append(len(u))
                hist.append(_histogram(u))
                sigs.append(got.view(np.int64))
                rests.append(left)
                ends.append(ends[-1] + len(got))
            values = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
            left = pa.array(np.concatenate(rests) if rests else np.zeros(0, np.int32))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hist, pa.binary()), pa.ListArray.from_arrays(at, values), pa.ListArray.from_arrays(at, left)], schema=schema)

    return run


def _histogram(u: np.ndarray) -> bytes:
    return np.minimum(65535, np.bincount((u >> np.uint64(58)).astype(np.int64), minlength=HISTOGRAM)).astype(np.uint16).tobytes()


def _bound(percent: int):
    """Keeps the pairs whose histograms allow the overlap that a link needs."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, HISTOGRAM).astype(np.int64) for c in ("ha", "hb"))
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            most = np.where(np.maximum(a.max(1), b.max(1)) == 65535, np.minimum(na, nb), np.minimum(a, b).sum(1))
            keep = 100 * most >= percent * (na + nb - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _read_full(k: int):
    def run(batches):
        for batch in common.small(batches):
            sets = list(common.shingle_sets(batch["text"], k))
            ends = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "tokens"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; docs has doc_id, text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(common.bounded(ids), "doc_id", "left_semi")
    sets = common.materialize(common.map_arrow(texts, _read_full(k), "doc_id bigint, tokens array<bigint>"), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).cast("long").alias("both"))
    return shared.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): smallest node of each component, by large-star and small-star
    steps, which never gather a node's neighbours; ends when no edge changes."""
    e = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialize(large.where("u <> v"), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = common.materialize(small.where("u <> v").distinct(), "cc")
        if small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("component"))
        e = small


def components_of(docs: DataFrame, k: int = 5, percent: int = 80, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; percent is the Jaccard threshold, met or exceeded. ``unique``
    says that no id repeats, which is else checked."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    if not unique and not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = common.materialize(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "single")
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(BUCKETS, 1 << int(size // (6 * 64)).bit_length()))
    read = common.materialize(common.map_arrow(docs, _read_sets(k, buckets), "doc_id bigint, n bigint, h1 bigint, h2 bigint, slice int, counts binary"), "read")
    own = read.where("slice is null").select("doc_id", "n", "h1", "h2")
    summed = common.map_arrow(read.where("slice is not null").select("slice", "counts").repartition("slice"), _sum_slices, "slice int, level binary, total bigint").collect()  # SLICES rows, one byte a bucket
    by = {r["slice"]: r for r in summed}
    empty = bytes(buckets // SLICES)
    shared = spark.sparkContext.broadcast(b"".join(by[i]["level"] if i in by else empty for i in range(SLICES)))
    mean = sum(r["total"] for r in summed) / buckets
    frequent = int(np.ceil(4 * np.log2(8 * mean + 64)))

    classes = common.materialize(own.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    drawn = common.map_arrow(docs, _read_signatures(k, buckets, percent, shared, frequent), "doc_id bigint, n bigint, histogram binary, signature array<bigint>, rest array<int>")
    drawn = common.materialize(drawn.join(common.bounded(classes.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi"), "signatures")
    flat = drawn.select("doc_id", F.col("n").cast("int").alias("n"), F.explode(F.arrays_zip("signature", "rest")).alias("s")).select("s.signature", "doc_id", "n", "s.rest")
    star = F.min(F.struct((F.col("n") - F.col("rest")).alias("own"), "n", "doc_id", "rest")).alias("p")
    best = flat.groupBy("signature").agg(F.count("*").alias("m"), star).where("m > 1").select("signature", "p")
    members = common.materialize(flat.join(best, "signature"), "members")  # of signatures with two documents at least
    tried = members.where((F.col("doc_id") != F.col("p.doc_id")) & _may_link("n", "rest", "p.n", "p.rest", percent))
    tried = common.materialize(tried.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct(), "stars")
    links = common.materialize(_verified(_possible(tried, drawn, percent), docs, k, percent), "links")
    found = components(links)

    at = members.select("signature", "doc_id", "n", "rest").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    at = common.materialize(at.join(_open(at, percent), ["signature", "c"]).where(F.least("rest", "most") * 100 >= (F.col("n") + F.col("own")) * percent).drop("own", "most"), "open")
    at = _dealt(at)
    one, two = (at.select("signature", "low", "high", *[F.col(c).alias(c + x) for c in ("doc_id", "n", "rest", "c", "block")]) for x in "ab")
    apart = (F.col("low") == F.col("high")) | (F.col("blocka") != F.col("blockb"))  # each pair of members meets once
    pairs = one.join(two, ["signature", "low", "high"]).where(apart & (F.col("doc_ida") < F.col("doc_idb")) & (F.col("ca") != F.col("cb")) & _may_link("na", "resta", "nb", "restb", percent))
    rest = pairs.select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = common.materialize(_possible(rest, drawn, percent), "rest")
    more = common.materialize(_verified(rest, docs, k, percent), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _dealt(at: DataFrame) -> DataFrame:
    """The members of each signature dealt into blocks of about BLOCK by a hash of their id, once for each pair of blocks
    (low, high) that theirs is in: two members meet in one of these groups, none of which grows with the signature."""
    sizes = at.groupBy("signature").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    rows = at.join(common.bounded(common.materialize(sizes, "sizes")), "signature", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one row of each group of linked rows stays: that of the smallest
    id (null comes last), of rows with the same id that whose text has the smallest hash. Rows without words stay all.
    Rows are compared each for itself, whether or not their ids repeat."""
    rows = common.plain(docs)
    own, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    if rows.groupBy(own).count().where(f"count > 1 or {own} is null").isEmpty():
        found = components_of(rows, k, percent, id_col=own, text_col=text, unique=True)
        gone = common.materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__row")), "gone")
        rows = rows.withColumn("__row", F.col(own).cast("long"))
    else:
        # a number for each row, fixed by writing it
        rows = common.materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
        found = common.materialize(components_of(rows, k, percent, id_col="__row", text_col=text, unique=True).where("n_shingles > 0"), "found")
        order = F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("id"), F.xxhash64(text).alias("hash"), F.col("__row").alias("row"))
        each = found.join(rows.select(F.col("__row").alias("doc_id"), order.alias("o")), "doc_id")
        first = each.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.row").alias("doc_id"))
        gone = common.materialize(found.join(first, "doc_id", "left_anti").select(F.col("doc_id").alias("__row")), "gone")
    return rows.join(common.bounded(gone), "__row", "left_anti").drop("__row").toDF(*docs.columns)


def _may_link(na: str, resta: str, nb: str, restb: str, percent: int):
    """Whether a pair whose first shared signature this is can be similar enough."""
    most = F.least(resta, restb)
    return most * 100 >= (F.col(na) + F.col(nb) - most) * percent


def _open(at: DataFrame, percent: int) -> DataFrame:
    """For each signature and component c in it: the fewest own tokens (own) and the most others (most) that a member of
    another component has."""
    each = at.groupBy("signature", "c").agg(F.min(F.col("n") - F.col("rest")).alias("own"), F.max("rest").alias("most"))
    top = each.groupBy("signature").agg(F.min(F.struct("own", "c")).alias("t"), F.max("most").alias("most"), F.count("*").alias("m")).where("m > 1")
    both = each.select("signature", "c", "own").join(top, "signature")
    second = both.where("c <> t.c").groupBy("signature").agg(F.min("own").alias("own2"))
    return both.join(second, "signature").select("signature", "c", F.when(F.col("c") == F.col("t.c"), F.col("own2")).otherwise(F.col("t.own")).alias("own"), "most")


def _possible(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and histograms don't rule out."""
    one = drawn.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("histogram").alias("ha"))
    two = drawn.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("histogram").alias("hb"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return common.map_arrow(both.select("a", "b", "na", "nb", "ha", "hb"), _bound(percent), "a bigint, b bigint")
