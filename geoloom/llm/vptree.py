"""Nearest neighbours by inner product: vantage-point trees per shard.

Adding the coordinate sqrt(M^2 - |x|^2), M the largest norm, to the rows and scaling queries to the norm M turns the
largest inner product into the smallest Euclidean distance. Pivots, rows drawn by a hash of their id, cut space into
cells; a cell with many rows is dealt into several shards by a hash of the id. Each shard's rows form one tree, in the
task that searches it, and the queries stream past it.

A search has two rounds. Each query first meets the shards of its own cell, which bounds the distance of its k-th
neighbour; then it goes to those other cells only that the triangle inequality doesn't rule out: a cell whose ball or
whose side of the border lies beyond that distance has nothing to add. Inside a tree a subtree on the far side of a
vantage point's sphere is left out when factor * |d - radius| exceeds it. ``factor`` 1 is exact, larger factors prune
more, in trees and among cells. Bounds are widened by what rounding may take, so that factor 1 stays exact on ties.

Scores are inner products of the original vectors in double precision; the order is by score, then by smaller id. Of
equal vectors the k + 1 smallest ids are kept, as no more can be among k results: a vector that a third of all rows
have doesn't make a large shard. Vectors that are null, zero or hold null or non-finite components take no part;
vectors of several lengths raise an error. Rows with a null id are left out; of rows with the same id the one with the
smallest vector, in Spark's order of arrays, counts. No usable row or query gives no result. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAF = 64
SHARD_ROWS = 8192
#: Pivots at most; their vectors are held by every task.
MAX_PIVOTS = 2048
_QUERIES = 256
_ROUNDING = 2.0**-52


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


class Space:
    """The lifted space of a table: scale, largest norm, pivots, and each cell's ball and number of shards."""

    def __init__(self, scale: float, norm: float, pivots: np.ndarray):
        self.scale, self.norm = scale, norm
        self.pivots = self.lift(pivots)
        self.radius = np.full(len(pivots), -1.0)  # no row yet
        self.shards = np.ones(len(pivots), np.int64)
        self.first = np.arange(len(pivots))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale / self.norm
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))])

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries as points of the space: of norm 1."""
        q = q / np.abs(q).max(1, keepdims=True)
        return np.column_stack([q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros(len(q))])

    @property
    def slack(self) -> float:
        """What rounding may add to a squared distance of points of norm 1."""
        return 64 * (self.pivots.shape[1] + 8) * _ROUNDING

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Distances of points to all pivots; errors stay below sqrt(slack)."""
        return np.sqrt(np.maximum(0.0, (points * points).sum(1)[:, None] - 2 * (points @ self.pivots.T) + (self.pivots**2).sum(1)))


class Tree:
    """A vantage-point tree over rows; leaves are runs of at most LEAF rows."""

    def __init__(self, space: Space, vectors: np.ndarray, ids: np.ndarray):
        rng = np.random.default_rng(7)
        x = space.lift(vectors)
        order = np.arange(len(x))
        self.nodes: list[tuple] = []  # (vantage point, radius, inside, outside) or (first, end)
        self.root = self._build(x, order, 0, len(order), rng)
        self.space, self.points, self.vectors, self.ids = space, x[order], vectors[order], ids[order]

    def _build(self, x, order, a, b, rng) -> int:
        at = len(self.nodes)
        self.nodes.append((a, b))
        if b - a > LEAF:
            own = x[order[a:b]]
            # of a few vantage points, the one whose distances spread most
            spread = [(np.sqrt(((own - own[i]) ** 2).sum(1)), i) for i in rng.choice(b - a, 5, replace=False)]
            dist, i = max(spread, key=lambda s: s[0].std())
            by = np.argsort(dist, kind="stable")
            half = (b - a) // 2
            radius = float(dist[by[half]])
            order[a:b] = order[a:b][by]
            inside = self._build(x, order, a, a + half, rng)
            outside = self._build(x, order, a + half, b, rng)
            self.nodes[at] = (own[i].copy(), radius, inside, outside)
        return at

    def search(self, qid: np.ndarray, queries: np.ndarray, near: np.ndarray, k: int, factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of up to k rows for each query, best first; near: squared distances of the k-th neighbours so
        far (infinite if unknown), beyond which rows may be missing. A query's own id is left out."""
        q, slack = self.space.aim(queries), self.space.slack
        near = near.copy()
        score = np.full((len(q), k), -np.inf)
        ids = np.full((len(q), k), np.iinfo(np.int64).max)
        stack = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            node, own, gap = stack.pop()
            own = own[(factor * gap) ** 2 <= near[own] + slack]
            if not len(own):
                continue
            entry = self.nodes[node]
            if len(entry) == 2:
                a, b = entry
                far = 2.0 - 2.0 * (q[own] @ self.points[a:b].T)  # both have norm 1
                i, j = np.nonzero((far <= near[own][:, None] + slack) & (self.ids[a:b] != qid[own][:, None]))
                if not len(i):
                    continue
                exact = (self.vectors[a:b][j] * queries[own[i]]).sum(1)
                got, back = np.unique(i, return_inverse=True)
                own = own[got]
                every = np.concatenate([score[own].ravel(), exact])
                names = np.concatenate([ids[own].ravel(), self.ids[a:b][j]])
                row = np.concatenate([np.repeat(np.arange(len(own)), k), back])
                order = np.lexsort((names, -every, row))
                row = row[order]
                rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(own)))[row]
                top = rank < k
                score[own[row[top]], rank[top]] = every[order][top]
                ids[own[row[top]], rank[top]] = names[order][top]
                full = own[ids[own, k - 1] < np.iinfo(np.int64).max]
                near[full] = np.minimum(near[full], reach(self.space, queries[full], score[full, k - 1]))
                continue
            vantage, radius, inside, outside = entry
            gap = np.sqrt(((q[own] - vantage) ** 2).sum(1)) - radius
            within = gap < 0
            none = np.zeros(len(own))
            # the far sides wait below the near sides, so that these are searched first
            stack.append((outside, own[within], -gap[within]))
            stack.append((inside, own[~within], gap[~within]))
            stack.append((inside, own[within], none[within]))
            stack.append((outside, own[~within], none[~within]))
        return [(s[m < np.iinfo(np.int64).max], m[m < np.iinfo(np.int64).max]) for s, m in zip(score, ids)]


def reach(space: Space, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Squared distance at which a row has a score."""
    top = np.abs(queries).max(1)
    norm = np.sqrt(((queries / top[:, None]) ** 2).sum(1))
    return np.maximum(0.0, 2.0 - 2.0 * (score / top / norm / space.scale / space.norm))


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(shared):
    """cell and dist of each row, and shard of its cell."""

    def run(batches):
        space: Space = shared.value
        for batch in common.small(batches):
            if batch.num_rows:
                d = space.distances(space.lift(_vectors(batch["vec"])))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "vec", "cell", "dist"])

    return run


def _targets(shared, factor: float, home: bool):
    """(shard, near) of the shards that each query (id, vec, near) is to meet: those of its own cell, or the others that
    may hold something nearer than ``near``."""

    def run(batches):
        space: Space = shared.value
        for batch in common.small(batches):
            if not batch.num_rows:
                continue
            d = space.distances(space.aim(_vectors(batch["vec"])))
            near = batch["near"].to_numpy(zero_copy_only=False)
            full = space.radius >= 0
            own = np.where(full, d, np.inf).argmin(1)
            if home:
                want = np.zeros(d.shape, bool)
                want[np.arange(len(d)), own] = True
            else:
                err = 2 * np.sqrt(space.slack)
                gap = np.maximum(d - space.radius, (d - d.min(1)[:, None]) / 2) - err
                want = full & ((factor * np.maximum(0.0, gap)) ** 2 <= near[:, None] + space.slack)
                want[np.arange(len(d)), own] = False
            i, c = np.nonzero(want)
            times = space.shards[c]
            i, first = np.repeat(i, times), np.repeat(space.first[c], times)
            shard = first + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(i)), batch["vec"].take(pa.array(i)), pa.array(shard.astype(np.int32)), pa.array(near[i])], ["id", "vec", "shard", "near"])

    return run


def _search(shared, k: int, factor: float):
    """Rows come by shard, first the shard's own, then its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        space: Space = shared.value
        now, held, tree = -1, [], None
        for batch in common.small(batches):
            if not batch.num_rows:
                continue
            shard, asks = batch["shard"].to_numpy(), batch["asks"].to_numpy()
            ids, vecs, near = batch["id"].to_numpy(), _vectors(batch["vec"]), batch["near"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks) != 0)) + 1
            for part in np.split(np.arange(len(shard)), edges):
                if shard[part[0]] != now:
                    now, held, tree = shard[part[0]], [], None
                if not asks[part[0]]:
                    held.append((vecs[part], ids[part]))
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    tree = Tree(space, np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held]))
                    held = []
                for at in range(0, len(part), _QUERIES):
                    own = part[at : at + _QUERIES]
                    got = tree.search(ids[own], vecs[own], near[own], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[own], [len(m) for _, m in got])), pa.array(np.concatenate([m for _, m in got])), pa.array(np.concatenate([s for s, _ in got]))], schema=schema)

    return run


def _bounded(shared):
    """near of each query (id, vec, last: score of its k-th neighbour so far, null if it has fewer)."""

    def run(batches):
        space: Space = shared.value
        for batch in common.small(batches):
            if batch.num_rows:
                last = batch["last"].to_numpy(zero_copy_only=False).astype(float)
                near = np.where(np.isnan(last), np.inf, reach(space, _vectors(batch["vec"]), np.where(np.isnan(last), 0.0, last)))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], pa.array(near)], ["id", "vec", "near"])

    return run


_QUERY = "id bigint, vec array<double>, near double"


def search(rows: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query found, the query's own id left out."""
    base = usable(rows, id_col, vec_col)
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    size = base.agg(F.count("*").alias("n"), F.max(top).alias("top"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
    if size["n"] and size["lo"] != size["hi"]:
        raise ValueError(f"vectors have {size['lo']} to {size['hi']} components")
    spark, schema = rows.sparkSession, "query_id bigint, rank int, vec_id bigint, score double"
    asked = common.materialize(usable(queries, id_col, vec_col), "asked")
    if not size["n"] or asked.isEmpty():
        return spark.createDataFrame([], schema)
    scale = float(size["top"])
    norm = base.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))).alias("m")).first()["m"] ** 0.5 * (1 + 1e-12)
    drawn = base.orderBy(F.xxhash64("id"), "id").limit(min(MAX_PIVOTS, -(-size["n"] // shard_rows))).collect()  # a bounded sample
    space = Space(scale, norm, np.unique(np.array([r["vec"] for r in drawn], float), axis=0))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    base = base.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    placed = common.map_arrow(base, _assign(spark.sparkContext.broadcast(space)), "id bigint, vec array<double>, cell int, dist double")
    placed = common.materialize(placed, "placed")
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect():  # a row a pivot
        space.shards[r["cell"]], space.radius[r["cell"]] = -(-r["n"] // shard_rows), r["r"]
    space.first = np.cumsum(space.shards) - space.shards
    shared = spark.sparkContext.broadcast(space)
    cells = spark.createDataFrame([(int(c), int(f), int(s)) for c, (f, s) in enumerate(zip(space.first, space.shards))], "cell int, first int, shards int")
    own = placed.join(F.broadcast(cells), "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("shards"))).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "vec", F.lit(0.0).alias("near"))

    def met(questions: DataFrame, home: bool) -> DataFrame:
        out = common.map_arrow(questions, _targets(shared, factor, home), "id bigint, vec array<double>, shard int, near double").select("shard", F.lit(1).alias("asks"), "id", "vec", "near")
        both = own.unionByName(out).repartition(max(1, min(int(space.shards.sum()), int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard").sortWithinPartitions("shard", "asks")
        return common.map_arrow(both, _search(shared, k, factor), "query_id bigint, vec_id bigint, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    found = common.materialize(best(met(asked.withColumn("near", F.lit(float("inf"))), True)), "found")
    if (space.radius >= 0).sum() > 1:
        last = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("last"))
        bound = common.map_arrow(asked.join(last, "id", "left"), _bounded(shared), _QUERY)
        found = best(found.drop("rank").unionByName(met(bound, False)))
    return found.select("query_id", "rank", "vec_id", "score")
