"""Density clustering, declaratively: a point is core if at least min_points points lie within eps (itself included);
clusters are the components of core points within eps of each other, numbered from 0 by their smallest core index; other
points near a core join the smallest such cluster, the rest is noise (-1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components as cc
from . import joins
from .features import UserError

#: Pairs of points that two boxes may have for all of them to be looked at, and cells of a side of a block of cells.
FEW, BLOCK = 4096, 64


def _around(cells: DataFrame, reach: list[tuple[int, int]]) -> DataFrame:
    """Rows with columns cx, cy, once for each cell at the given offsets."""
    near = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i, j in reach])
    return cells.withColumn("__o", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("__o.i"), "cy": F.col("cy") + F.col("__o.j")}).drop("__o")


def _close(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """Pairs of rows (with x, y and xb, yb) in one cell that lie within eps."""
    dx, dy = F.col("x") - F.col("xb"), F.col("y") - F.col("yb")
    return left.join(right, ["cx", "cy"]).where(dx * dx + dy * dy <= eps * eps)


def _boxes(points: DataFrame, level: int, side: float) -> DataFrame:
    """The boxes of the given level that points (x, y, cx, cy, cell) lie in: a cell's sides are halved level times."""
    at = lambda c: F.floor((F.col(c) - F.col("c" + c) * side) / side * 2**level).alias("k" + c)
    bounds = [f(c).alias(c + n) for c in "xy" for f, n in ((F.min, "0"), (F.max, "1"))]
    return points.select("x", "y", "cx", "cy", "cell", at("x"), at("y")).groupBy("cx", "cy", "cell", "kx", "ky").agg(F.count("*").alias("n"), *bounds)


def _gap(a: str, b: str) -> Column:
    """The square of the least distance between points of two boxes."""
    least = [F.greatest(F.lit(0.0), F.col(f"{a}.{c}0") - F.col(f"{b}.{c}1"), F.col(f"{b}.{c}0") - F.col(f"{a}.{c}1")) for c in "xy"]
    return least[0] * least[0] + least[1] * least[1]


def _reach(a: str, b: str) -> Column:
    """The square of the greatest one."""
    most = [F.greatest(F.col(f"{a}.{c}1") - F.col(f"{b}.{c}0"), F.col(f"{b}.{c}1") - F.col(f"{a}.{c}0")) for c in "xy"]
    return most[0] * most[0] + most[1] * most[1]


def linked(core: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs of neighbouring cells (a, acx, acy, b, bcx, bcy) of which some two points (x, y, cx, cy, cell) lie within eps.
    Pairs of boxes all beyond eps are dropped, pairs all within it are settled, pairs with few points are looked at; the
    boxes of the rest are halved, until none is left. Pairs of points are only formed between boxes with few."""
    boxes = cc.cut(_boxes(core, 0, side), "boxes")
    whole = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    half = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    one = _around(boxes.select("cx", "cy", F.struct(*boxes.columns).alias("a")), half)
    pairs = one.join(boxes.select("cx", "cy", F.struct(*boxes.columns).alias("b")), ["cx", "cy"]).select("a", "b")
    ends = [F.col(f"{s}.{c}").alias(n) for s in "ab" for c, n in (("cell", s), ("cx", s + "cx"), ("cy", s + "cy"))]
    level, found = 0, []
    while True:
        pairs = cc.cut(pairs.where(_gap("a", "b") <= eps * eps).withColumns({"near": _reach("a", "b") <= eps * eps, "few": F.col("a.n") * F.col("b.n") <= FEW}), "pairs")
        sure = pairs.where("near").select(*ends).distinct()
        open_ = pairs.where("not near").join(sure.select("a", "b").toDF("u", "v"), (F.col("a.cell") == F.col("u")) & (F.col("b.cell") == F.col("v")), "left_anti")
        asked = open_.where("few")
        points = core.join(asked.select(F.explode(F.array("a.cell", "b.cell")).alias("cell")).distinct(), "cell", "left_semi")
        at = [F.floor((F.col(c) - F.col("c" + c) * side) / side * 2**level).alias("k" + c) for c in "xy"]
        points = points.select("cell", *at, "x", "y")
        on = lambda s: [F.col(f"{s}.{c}") == F.col(f"{s}{c}") for c in ("cell", "kx", "ky")]
        both = asked.join(points.toDF("acell", "akx", "aky", "ax", "ay"), on("a")).join(points.toDF("bcell", "bkx", "bky", "bx", "by"), on("b"))
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        found.append(cc.cut(both.where(dx * dx + dy * dy <= eps * eps).select(*ends).unionByName(sure).distinct(), "linked"))
        done = found[-1].select(F.col("a").alias("u"), F.col("b").alias("v"))
        rest = open_.where("not few")
        if rest.isEmpty():
            break
        rest = cc.cut(rest.join(done, (F.col("a.cell") == F.col("u")) & (F.col("b.cell") == F.col("v")), "left_anti").select("a", "b"), "rest")
        level += 1
        inner = cc.cut(_boxes(core.join(rest.select(F.explode(F.array("a.cell", "b.cell")).alias("cell")).distinct(), "cell", "left_semi"), level, side), "boxes")
        inside = lambda s: [F.col(f"{s}.cell") == F.col(f"{s}2.cell"), *[F.col(f"{s}.{k}") == F.shiftright(F.col(f"{s}2.{k}"), 1) for k in ("kx", "ky")]]
        pairs = rest.join(whole(inner, "a2"), inside("a")).join(whole(inner, "b2"), inside("b")).select(F.col("a2").alias("a"), F.col("b2").alias("b"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of cells by their links: first inside blocks of cells, each a small group, then between blocks."""
    block = lambda s: F.struct(*[F.floor(F.col(f"{s}{c}") / BLOCK).alias(c) for c in ("cx", "cy")])
    links = cc.cut(links.select("a", "b", block("a").alias("block"), (block("a") == block("b")).alias("inner")), "links")

    def join_up(own: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        for a, b in zip(own["a"].tolist(), own["b"].tolist()):
            a, b = sorted((root(a), root(b)))
            top[b] = a
        return pd.DataFrame({"node": list(top), "part": [root(x) for x in list(top)]})

    parts = cc.cut(links.where("inner").groupBy("block").applyInPandas(join_up, "node bigint, part bigint"), "parts")
    outer = links.where("not inner").select("a", "b")
    for c in ("a", "b"):
        outer = outer.join(parts.select(F.col("node").alias(c), F.col("part").alias("p" + c)), c, "left").withColumn(c, F.coalesce("p" + c, c)).drop("p" + c)
    outer = cc.cut(outer.distinct(), "outer")
    if outer.isEmpty():
        return parts.select("node", F.col("part").alias("component"))
    joined = cc.components(outer)
    inner = parts.join(joined.select(F.col("node").alias("part"), "component"), "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    return inner.unionByName(joined.join(parts.select("node"), "node", "left_anti"))


def labels(points: DataFrame, eps_m: float, min_points: int) -> DataFrame:
    """points (id, lon, lat) with x, y and cluster; ids give the input order.

    Cells have a side of eps / sqrt(2), so that all points of a cell are neighbours: in a cell with min_points points all
    are core, and its core points belong to one cluster, without any pair of them being formed. Only points of sparser
    cells count their neighbours, and cells, not points, are linked, by boxes inside them (``linked``)."""
    if not eps_m > 0 or min_points < 1:
        raise UserError("eps_m must be positive and min_points at least 1")
    side = eps_m / 2**0.5 * (1 - 1e-9)
    placed = joins.planar(points)
    rows = cc.cut(placed.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")), "placed")
    sizes = rows.groupBy("cx", "cy").agg((F.count("*") >= min_points).alias("dense"))
    rows = cc.cut(rows.join(sizes, ["cx", "cy"]), "sized")
    every = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    other = rows.select("cx", "cy", F.col("x").alias("xb"), F.col("y").alias("yb"))
    counted = _close(_around(rows.where("not dense").select("id", "x", "y", "cx", "cy"), every), other, eps_m).groupBy("id").agg(F.count("*").alias("n"))
    sparse = rows.where("not dense").join(counted.where(F.col("n") >= min_points).select("id", F.lit(True).alias("core")), "id", "left")
    rows = cc.cut(rows.where("dense").withColumn("core", F.lit(True)).unionByName(sparse).select("id", "x", "y", "cx", "cy", F.coalesce("core", F.lit(False)).alias("core")), "cores")
    core = rows.where("core")
    # a cell stands for its core points by their smallest id
    cells = core.groupBy("cx", "cy").agg(F.min("id").alias("cell"))
    named = cc.cut(core.join(cells, ["cx", "cy"]).select("id", "x", "y", "cx", "cy", "cell"), "named")
    found = cc.cut(_components(linked(named, eps_m, side)), "found")
    own = named.where("id = cell").select("cell").join(found.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("component", "cell").alias("least"))
    own = cc.cut(own, "least")
    own = own.join(cc.dense(own.where("cell = least").select("least"), ["least"], "cluster"), "least").select("cell", "cluster")
    core = cc.cut(named.join(own, "cell").select("id", "x", "y", "cx", "cy", "cluster"), "clusters")
    rest = _around(rows.where("not core").select("id", "x", "y", "cx", "cy"), every)
    border = _close(rest, core.select("cx", "cy", F.col("x").alias("xb"), F.col("y").alias("yb"), "cluster"), eps_m).groupBy("id").agg(F.min("cluster").alias("cluster"))
    out = placed.join(core.select("id", "cluster").unionByName(border), "id", "left")
    return out.withColumn("cluster", F.coalesce("cluster", F.lit(-1)).cast("int"))


def summary(labelled: DataFrame) -> DataFrame:
    """Per cluster: count, mean position, box."""
    return labelled.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def totals(labelled: DataFrame) -> DataFrame:
    """One row: feature_count, cluster_count, noise_count."""
    return labelled.agg(F.count("*").alias("feature_count"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("cluster_count"), F.count_if(F.col("cluster") < 0).alias("noise_count"))
