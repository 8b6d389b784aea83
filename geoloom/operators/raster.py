"""Isochrone areas: frontier segments, raster cells, dilation, marching squares, rings and their nesting, by joins. Rings are
followed inside blocks of the grid, each a small group, and their parts are put together by pointer jumping; no group holds
an area."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import components as cc

#: Cells of the area of a single answer, which one task draws; frames have no such bound.
MAX_CELLS = 4_000_000
#: Side of a block that rings are followed in, on the half-cell lattice.
RING_BLOCK = 128
#: Segments that one group follows, in many blocks; cells of a task, and the side of their tiles.
GROUP_ROWS, TASK_CELLS, TILE_SIDE = 100_000, 250_000, 64


def frontier(reached: DataFrame, edges: DataFrame, cutoffs: list | DataFrame) -> DataFrame:
    """(req, cutoff, src, dst, full, fraction): the edges and beginnings of edges that lie within each cutoff; reached has
    req, node, cost and edges src, dst, w. cutoffs are those of all requests, or a frame (req, cutoff)."""
    at = reached.select("req", F.col("node").alias("src"), F.col("cost").alias("cu"))
    to = reached.select("req", F.col("node").alias("dst"), F.col("cost").alias("cv"))
    steps = at.join(edges.select("src", "dst", "w"), "src").join(to, ["req", "dst"], "left")
    steps = steps.join(cutoffs, "req") if isinstance(cutoffs, DataFrame) else steps.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    steps = steps.where("cu <= cutoff")
    full = (F.col("cu") + F.col("w") <= F.col("cutoff")) & (F.col("cv") <= F.col("cutoff"))
    part = (F.col("cutoff") - F.col("cu")).cast("double") / F.col("w")
    out = steps.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("fraction", F.when(F.col("full"), 1.0).when(F.col("w") > 0, part).otherwise(0.0))
    return out.where("fraction > 0").select("req", "cutoff", "src", "dst", "full", "fraction")


def cells(segments: DataFrame, cell: float | int, keys: list[str]) -> DataFrame:
    """Distinct cells (keys, gx, gy) that segments (ax, ay, bx, by from a grid's origin) touch at half-cell steps."""
    segments = cc.cut(segments, "segments")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steps = F.floor(F.greatest(F.abs(dx), F.abs(dy)) / cell * 2).cast("int") + 1
    out = segments.withColumn("__n", steps).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    share = F.col("__i") / F.col("__n")
    gx, gy = F.floor((F.col("ax") + dx * share) / cell + 0.5).cast("int"), F.floor((F.col("ay") + dy * share) / cell + 0.5).cast("int")
    return _together(out.select(*keys, gx.alias("gx"), gy.alias("gy")), keys, -(-segments.count() * 8 // TASK_CELLS)).distinct().select(*keys, "gx", "gy")


def _tile(c: str) -> Column:
    return F.floor(F.col(c) / TILE_SIDE).cast("int")


def _together(rows: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Cells (keys, gx, gy) with their tile (tx, ty), those of a tile in one task; tasks don't grow with the input."""
    rows = rows.withColumns({"tx": _tile("gx"), "ty": _tile("gy")})
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys, "tx", "ty")


def _spread(marked: DataFrame, keys: list[str], moves: list[tuple]) -> DataFrame:
    """(keys, tx, ty, gx, gy, m) of cells moved by each of moves (i, j, m), dealt by the tile that they come to: cells at the
    edges of a tile go to its neighbours as well, so that what is moved needs no further shuffle."""
    marked = cc.cut(marked, "marked")
    tasks = max(-(-marked.count() // TASK_CELLS), marked.sparkSession.sparkContext.defaultParallelism)
    ends = lambda c, k: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / TILE_SIDE).cast("int") for d in sorted({m[k] for m in moves})]))
    dealt = marked.withColumn("tx", F.explode(ends("gx", 0))).withColumn("ty", F.explode(ends("gy", 1))).repartition(tasks, *keys, "tx", "ty")
    moved = dealt.withColumn("__d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(m).alias("m")) for i, j, m in moves])))
    moved = moved.select(*keys, "tx", "ty", (F.col("gx") + F.col("__d.i")).alias("gx"), (F.col("gy") + F.col("__d.j")).alias("gy"), F.col("__d.m").alias("m"))
    return moved.where((_tile("gx") == F.col("tx")) & (_tile("gy") == F.col("ty")))


def dilate(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and their eight neighbours."""
    moved = _spread(marked, keys, [(i, j, 0) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return moved.select(*keys, "tx", "ty", "gx", "gy").distinct().select(*keys, "gx", "gy")


# Sides that the contour joins for each pattern of a block's corners (top left 1, top right 2, bottom right
# 4, bottom left 8); L, T, R, B are the middles of the block's sides.
CASES = {1: "LT", 2: "TR", 3: "LR", 4: "RB", 5: "LT RB", 6: "TB", 7: "BL", 8: "BL", 9: "TB", 10: "TR BL", 11: "RB", 12: "LR", 13: "TR", 14: "LT"}
SIDES = {"L": (0, 1), "T": (1, 2), "R": (2, 1), "B": (1, 0)}


def marching_segments(marked: DataFrame, keys: list[str], table: list[tuple] | None = None) -> DataFrame:
    """Contour segments (keys, vx1, vy1, vx2, vy2 on the half-cell lattice) around the marked cells, in the order of CASES
    or of a table (code, x1, y1, x2, y2). A block has its lower left corner at a cell's middle; y grows upward."""
    moved = _spread(marked, keys, [(0, -1, 1), (-1, -1, 2), (-1, 0, 4), (0, 0, 8)])
    codes = moved.groupBy(*keys, "tx", "ty", "gx", "gy").agg(F.sum("m").alias("code")).where("code < 15").select(*keys, F.col("gx").alias("x"), F.col("gy").alias("y"), "code")
    rows = table or [(code, *SIDES[s[0]], *SIDES[s[1]]) for code, text in CASES.items() for s in text.split()]
    table = marked.sparkSession.createDataFrame(rows, "code long, x1 int, y1 int, x2 int, y2 int")
    return codes.join(F.broadcast(table), "code").select(*keys, *[(F.col(a) * 2 + F.col(f"{a}{i}")).cast("int").alias(f"v{a}{i}") for i in (1, 2) for a in ("x", "y")])


def chain(segments: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of undirected segments in which every point has an even number of ends."""
    at: dict[tuple, list[int]] = {}
    for k, (a, b, c, d) in enumerate(segments):
        at.setdefault((a, b), []).append(k)
        at.setdefault((c, d), []).append(k)
    used, rings = [False] * len(segments), []
    for k in range(len(segments)):
        if used[k]:
            continue
        a, b, c, d = segments[k]
        ring, here, used[k] = [(a, b)], (c, d), True
        while here != ring[0]:
            ring.append(here)
            following = next((j for j in at[here] if not used[j]), None)
            if following is None:
                break
            used[following] = True
            p, q = segments[following][:2], segments[following][2:]
            here = q if p == here else p
        rings.append([*ring, ring[0]])
    return rings


def ring_area(ring) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) / 2


def contains(ring, point) -> bool:
    x, y = point
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def simplify(points: list, tolerance: float) -> list:
    """Douglas-Peucker without recursion; the ends stay."""
    if len(points) < 3:
        return points
    keep = {0, len(points) - 1}
    stack = [(0, len(points) - 1)]
    p = np.array(points, float)
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        rel = p[a + 1 : b] - p[a]
        square = d @ d
        t = np.clip(rel @ d / square, 0, 1) if square else np.zeros(len(rel))
        far = np.sqrt(((rel - t[:, None] * d) ** 2).sum(1))
        i = int(far.argmax())
        if far[i] > tolerance:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return [points[i] for i in sorted(keep)]


def polygons(rings: list) -> list[list]:
    """Polygons (outer ring, holes): rings by area, nested by parity; a hole belongs to the smallest ring around it."""
    rings = sorted((r for r in rings if len(r) >= 4), key=lambda r: (-abs(ring_area(r)), r))
    out, depth = [], []
    for i, r in enumerate(rings):
        around = [j for j in range(i) if contains(rings[j], r[0])]
        depth.append((len(around), around[-1] if around else -1))
    index = {}
    for i, r in enumerate(rings):
        if depth[i][0] % 2 == 0:
            index[i] = len(out)
            out.append([r])
        else:
            outer = depth[i][1]
            if outer in index:
                out[index[outer]].append(r)
    return out


def _directed() -> list[tuple]:
    """(code, x1, y1, x2, y2): the segments of CASES with the marked side on their left."""
    corners = {1: (0, 2), 2: (2, 2), 4: (2, 0), 8: (0, 0)}
    rows = []
    for code, text in CASES.items():
        for pair in text.split():
            (x1, y1), (x2, y2) = SIDES[pair[0]], SIDES[pair[1]]
            # the corner beside the segment's middle, to its left: the one it cuts off, or one of a straight segment's two
            left = {bit: (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for bit, (x, y) in corners.items()}
            near = min(corners, key=lambda bit: ((corners[bit][0] - (x1 + x2) / 2) ** 2 + (corners[bit][1] - (y1 + y2) / 2) ** 2, bit))
            rows.append((code, x1, y1, x2, y2) if (left[near] > 0) == bool(code & near) else (code, x2, y2, x1, y1))
    return rows


def contours(marked: DataFrame, keys: list[str]) -> DataFrame:
    """The segments of ``marching_segments``, each with the marked cells on its left: exactly one leaves every point that
    one comes to."""
    return marching_segments(marked, keys, _directed())


def rings(contour: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rx, ry, pos, x, y, x2, y2) of directed contour segments: the ring, named by its smallest point, and the place
    of each segment's first point in it, from 0 at that point."""
    near = [F.floor(F.col(c) / RING_BLOCK).cast("int") for c in ("vx1", "vy1")]
    fields = ", ".join(f"`{k}` {dict(contour.dtypes)[k]}" for k in keys)
    contour = cc.cut(contour, "contour")
    portions = max(1, -(-contour.count() // GROUP_ROWS))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        """The parts of many blocks, each followed by itself."""
        block = pdf.groupby([*keys, "bx", "by"], sort=False).ngroup().to_numpy(np.int64)
        x, y, x2, y2 = (pdf[c].to_numpy(np.int64) for c in ("vx1", "vy1", "vx2", "vy2"))
        order = np.lexsort((y, x, block))
        block, x, y, x2, y2 = (v[order] for v in (block, x, y, x2, y2))
        (left, across), (low, wide) = ((m := min(u.min(), v.min()), max(u.max(), v.max()) - m + 1) for u, v in ((x, x2), (y, y2)))
        named = lambda u, v: (block * across + (u - left)) * wide + (v - low)  # noqa: E731  in the order of the segments
        own, to = named(x, y), named(x2, y2)
        at = np.minimum(np.searchsorted(own, to), len(own) - 1)
        ahead = np.where(own[at] == to, at, -1)
        # parts begin where nothing in the block leads; what is left then are rings inside it
        begins = np.setdiff1d(np.arange(len(own)), ahead)
        ahead, head, idx = ahead.tolist(), [-1] * len(own), [0] * len(own)
        for first in [*begins.tolist(), *range(len(own))]:
            k, pos = first, 0
            while k >= 0 and head[k] < 0:
                head[k], idx[k] = first, pos
                k, pos = ahead[k], pos + 1
        parts = pd.DataFrame({"px": x[head], "py": y[head], "idx": idx, "x": x, "y": y, "x2": x2, "y2": y2})
        return pd.concat([parts, pdf[keys].iloc[order].reset_index(drop=True)], axis=1)

    parts = contour.withColumns({"bx": near[0], "by": near[1]}).withColumn("portion", F.pmod(F.xxhash64(*keys, "bx", "by"), F.lit(portions)))
    parts = parts.groupBy("portion").applyInPandas(follow, f"{fields}, px int, py int, idx int, x int, y int, x2 int, y2 int")
    parts = cc.cut(parts, "parts")
    # a part's last segment leads to the beginning of the next one, which is itself where the ring lies in one block
    part = [*keys, "px", "py"]
    ends = parts.groupBy(*part).agg(F.max(F.struct("idx", "x2", "y2")).alias("e")).select(*part, F.col("e.x2").alias("nx"), F.col("e.y2").alias("ny"), (F.col("e.idx") + 1).alias("n"))
    whole = ends.where("px = nx and py = ny").select(*part, F.col("px").alias("rx"), F.col("py").alias("ry"), F.lit(0).alias("before"))
    placed = whole.unionByName(_joined_parts(cc.cut(ends.where("px <> nx or py <> ny"), "ends"), keys))
    out = parts.join(placed, part).withColumn("pos", F.col("before") + F.col("idx"))
    # parts start at the smallest point of a ring inside one block; of others it may lie inside a part
    least = out.groupBy(*keys, "rx", "ry").agg(F.min(F.struct("x", "y", "pos")).alias("l"), F.count("*").alias("n"))
    out = out.join(least, [*keys, "rx", "ry"])
    return out.select(*keys, F.col("l.x").alias("rx"), F.col("l.y").alias("ry"), F.pmod(F.col("pos") - F.col("l.pos"), F.col("n")).cast("int").alias("pos"), "x", "y", "x2", "y2")


def _joined_parts(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, px, py, rx, ry, before): the ring of each part, by its smallest part, and the points before the part, from
    parts (px, py) of n points that lead to (nx, ny), by pointer jumping."""
    most = ends.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    rounds, part = math.ceil(math.log2(most)) if most > 1 else 0, [*keys, "px", "py"]
    jump = lambda df, *kept: df.select(*keys, F.col("px").alias("nx"), F.col("py").alias("ny"), *[F.col(a).alias(b) for a, b in kept])
    # the smallest part of each ring: of 2, 4, 8 ... parts ahead
    state = ends.select(*part, "nx", "ny", F.struct("px", "py").alias("least"))
    for _ in range(rounds):
        ahead = jump(state, ("nx", "mx"), ("ny", "my"), ("least", "other"))
        state = cc.cut(state.join(ahead, [*keys, "nx", "ny"]).select(*part, F.col("mx").alias("nx"), F.col("my").alias("ny"), F.least("least", "other").alias("least")), "least")
    # cut before that part, the points up to the ring's end: again of 2, 4, 8 ... parts
    state = ends.join(state.select(*part, "least"), part).withColumn("last", (F.col("nx") == F.col("least.px")) & (F.col("ny") == F.col("least.py")))
    for _ in range(rounds):
        ahead = jump(state, ("nx", "mx"), ("ny", "my"), ("n", "more"), ("last", "ended"))
        go = lambda a, b: F.when(F.col("last"), F.col(a)).otherwise(F.col(b)).alias(a)
        sums = F.when(F.col("last"), F.col("n")).otherwise(F.col("n") + F.col("more")).alias("n")
        state = cc.cut(state.join(ahead, [*keys, "nx", "ny"]).select(*part, go("nx", "mx"), go("ny", "my"), sums, "least", (F.col("last") | F.col("ended")).alias("last")), "ranks")
    size = state.groupBy(*keys, "least").agg(F.max("n").alias("size"))
    return state.join(size, [*keys, "least"]).select(*part, F.col("least.px").alias("rx"), F.col("least.py").alias("ry"), (F.col("size") - F.col("n")).cast("int").alias("before"))


def nesting(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rx, ry, n, area2, ox, oy) of ``rings``: their points, twice their signed area (holes are negative) and the
    outer ring that they belong to. A hole looks to its left along the half-cell row of its first crossing: the nearest
    crossing there is of its outer ring, or of another hole with the same one."""
    ring = [*keys, "rx", "ry"]
    sizes = points.groupBy(*ring).agg(F.count("*").alias("n"), F.sum((F.col("x") * F.col("y2") - F.col("x2") * F.col("y")).cast("bigint")).alias("area2"))
    sizes = cc.cut(sizes, "sizes")
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    # in twice the lattice's units: where a segment is in the middle of the row
    crossings = points.where("y <> y2").withColumn("row", F.explode(F.sequence(low, high - 1))).select(*ring, "row", (F.col("x") + F.col("x2")).alias("at"))
    row = Window.partitionBy(*keys, "row").orderBy("at")
    left = crossings.withColumns({"lx": F.lag("rx").over(row), "ly": F.lag("ry").over(row)})
    first = left.join(sizes.where("area2 < 0").select(*ring), ring, "left_semi").groupBy(*ring).agg(F.min(F.struct("at", "row", "lx", "ly")).alias("f"))
    state = first.select(*ring, F.col("f.lx").alias("ox"), F.col("f.ly").alias("oy"))
    outer = sizes.where("area2 > 0").select(*ring, F.col("rx").alias("ox"), F.col("ry").alias("oy"))
    state = cc.cut(outer.unionByName(state), "outer")
    while True:  # holes point at holes until all point at outer rings
        ahead = state.select(*keys, F.col("rx").alias("ox"), F.col("ry").alias("oy"), F.col("ox").alias("mx"), F.col("oy").alias("my"))
        after = cc.cut(state.join(ahead, [*keys, "ox", "oy"]).select(*ring, F.col("mx").alias("ox"), F.col("my").alias("oy"), ((F.col("ox") != F.col("mx")) | (F.col("oy") != F.col("my"))).alias("moved")), "outer")
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            return sizes.join(state, ring)


def areas(marked: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """(keys, polygons: array of polygons of rings of (x, y), the outer ring first) around marked cells. Rings are simplified
    one by one; those with fewer than four points then go, and holes of an outer ring with it."""
    points = cc.cut(rings(contours(marked, keys), keys), "rings")
    own = cc.cut(nesting(points, keys), "nesting")

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def simplified(lines: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in simplify([(p["x"], p["y"]) for p in line], tolerance)] for line in lines])

    line = points.groupBy(*keys, "rx", "ry").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("l"))
    line = line.withColumn("l", F.concat("l", F.slice("l", 1, 1))).select(*keys, "rx", "ry", simplified(F.transform("l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("ring"))
    line = line.where(F.size("ring") >= 4).join(own, [*keys, "rx", "ry"])
    polygon = line.groupBy(*keys, "ox", "oy").agg(F.array_sort(F.collect_list(F.struct((F.col("area2") < 0).alias("hole"), "rx", "ry", "ring"))).alias("p"))
    polygon = polygon.where(~F.get("p", F.lit(0))["hole"]).select(*keys, "ox", "oy", F.transform("p", lambda r: r["ring"]).alias("polygon"))
    return polygon.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ox", "oy", "polygon"))).alias("l")).select(*keys, F.transform("l", lambda p: p["polygon"]).alias("polygons"))
