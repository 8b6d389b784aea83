"""Frames of routing requests: parsed, snapped, searched and drawn by joins and grouped searches over a network's blocks.
No graph is gathered and no request is answered by itself."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import measure
from geoloom.operators import components as cc
from geoloom.operators import joins, overlay, raster

RADIUS_M, MAX_CUTOFFS = 500.0, 8
_PARAMS = "struct<`from`:array<double>,`to`:array<double>,origin:array<double>,cost:string,cutoffs:array<double>,from_level:double,to_level:double,level:double,snap_radius_m:double,cell_size_m:double>"


def _point(c: Column) -> Column:
    """Whether c is [lon, lat] in degrees."""
    return F.coalesce((F.size(c) == 2) & (F.abs(F.get(c, F.lit(0))) <= 180) & (F.abs(F.get(c, F.lit(1))) <= 90), F.lit(False))


def parsed(requests: DataFrame, points: list[str], levels: list[str]) -> DataFrame:
    """requests (req, params: JSON text) with p, the parameters and their defaults, and error, null where they are right."""
    p = F.from_json("params", _PARAMS)
    rows = requests.select(F.col("req").cast("bigint").alias("req"), p.alias("p"))
    rows = rows.withColumn("p", F.col("p").withField("cost", F.coalesce(F.nullif(F.col("p.cost"), F.lit("")), F.lit("time"))).withField("radius", F.when(F.col("p.snap_radius_m") > 0, F.col("p.snap_radius_m")).otherwise(RADIUS_M)))
    for c in levels:
        rows = rows.withColumn("p", F.col("p").withField(c, F.coalesce(F.col(f"p.{c}"), F.lit(0.0))))
    wrong = F.when(F.col("p").isNull(), "parameters must be an object")
    for c in points:
        wrong = wrong.when(~_point(F.col(f"p.`{c}`")), f"{c} must be [lon, lat] in degrees")
    wrong = wrong.when(~F.col("p.cost").isin("time", "distance"), "cost must be time or distance")
    for c in levels:
        wrong = wrong.when(F.abs(F.col(f"p.{c}")) > 32767, f"{c} is out of range")
    return rows.withColumn("error", wrong)


def snapped(rows: DataFrame, nodes: DataFrame, point: str, level: str, name: str) -> DataFrame:
    """rows (req, p) with the nearest node (name) on the level and its distance (name_m), null where none is near."""
    asked = rows.select(F.col("req").alias("qid"), F.get(F.col(f"p.`{point}`"), F.lit(0)).alias("lon"), F.get(F.col(f"p.`{point}`"), F.lit(1)).alias("lat"), F.col(f"p.{level}").cast("smallint").alias("level"))
    most = rows.agg(F.max("p.radius").alias("r")).first()["r"] or RADIUS_M
    near = joins.nearest(asked, nodes.select(F.col("node").alias("pid"), "lon", "lat", F.col("level").cast("smallint").alias("level")), most)
    near = near.select(F.col("qid").alias("req"), F.col("pid").alias(name), F.col("dist_m").alias(name + "_m"))
    return rows.join(near, "req", "left").withColumn(name, F.when(F.col(name + "_m") <= F.col("p.radius"), F.col(name)))


def _weighted(net, cost: str) -> DataFrame:
    return net.edges.select("src", "dst", F.col("time_s" if cost == "time" else "length_m").alias("w"))


def _answers(rows: DataFrame, found: DataFrame, none: str) -> DataFrame:
    """(req, result) with the errors of rows (req, error), the collections found (req, features) or else the error none."""
    wrong = F.to_json(F.struct(F.coalesce("error", F.lit(none)).alias("error")))
    right = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("features")))
    return rows.select("req", "error").join(found, "req", "left").select("req", F.when(F.col("features").isNotNull(), right).otherwise(wrong).alias("result"))


def _feature(kind: str, coordinates: Column, **properties: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"))


def shortest_paths(net, requests: DataFrame) -> DataFrame:
    """(req, result) of requests for shortest paths: a feature collection or an error, as JSON text."""
    rows = parsed(requests, ["from", "to"], ["from_level", "to_level"])
    good = cc.cut(rows.where("error is null"), "asked")
    good = cc.cut(snapped(snapped(good, net.nodes, "from", "from_level", "src"), net.nodes, "to", "to_level", "dst"), "snapped")
    rows = rows.join(good.where("src is null or dst is null").select("req", F.lit("no node of the network is near the point").alias("far")), "req", "left").withColumn("error", F.coalesce("error", "far"))
    places = net.nodes.select("node", F.array("lon", "lat").alias("at"), "level")
    out = None
    for cost in [r[0] for r in good.select("p.cost").distinct().collect()]:  # two at most
        own = good.where((F.col("p.cost") == cost) & F.col("src").isNotNull() & F.col("dst").isNotNull())
        found = cc.cut(overlay.paths(net.overlay(cost), own.select("req", "src", "dst")), "paths")
        steps = found.select("req", F.explode(F.when(F.size("nodes") > 1, F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("src"), F.get("nodes", i + 1).alias("dst"))))).alias("s")).select("req", "s.*")
        least = net.edges.groupBy("src", "dst").agg(F.min(F.struct(F.col("time_s" if cost == "time" else "length_m").alias("w"), "length_m", "time_s")).alias("e"))
        sums = steps.join(least, ["src", "dst"]).groupBy("req").agg(F.sum("e.length_m").alias("length"), F.sum("e.time_s").alias("time"))
        line = found.select("req", F.posexplode("nodes").alias("i", "node")).join(places, "node").groupBy("req").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("l"), F.array_sort(F.collect_set("level")).alias("levels"))
        whole = line.join(sums, "req", "left").join(own.select("req", "src_m", "dst_m"), "req")
        shown = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 1)
        feature = _feature("LineString", F.transform("l", lambda x: x["at"]), length_m=shown("length"), duration_s=shown("time"), cost=F.lit(cost), levels_visited=F.col("levels"), snap_from_m=shown("src_m"), snap_to_m=shown("dst_m"))
        part = whole.select("req", F.array(feature).alias("features"))
        out = part if out is None else out.unionByName(part)
    return _answers(rows, out, "the two points aren't connected") if out is not None else rows.select("req", F.to_json(F.struct("error")).alias("result"))


def isochrones(net, requests: DataFrame) -> DataFrame:
    """(req, result) of requests for reachable areas: a feature collection, largest cutoff first, or an error."""
    rows = parsed(requests, ["origin"], ["level"])
    count = F.coalesce(F.size("p.cutoffs"), F.lit(0))
    rows = rows.withColumn("error", F.coalesce("error", F.when(~count.between(1, MAX_CUTOFFS) | ~F.forall("p.cutoffs", lambda c: F.coalesce(c > 0, F.lit(False))), f"1 to {MAX_CUTOFFS} positive cutoffs are needed")))
    good = cc.cut(snapped(rows.where("error is null"), net.nodes, "origin", "level", "node"), "snapped")
    rows = rows.join(good.where("node is null").select("req", F.lit("no node of the network is near the point").alias("far")), "req", "left").withColumn("error", F.coalesce("error", "far"))
    good, out = good.where("node is not null"), None
    for cost in [r[0] for r in good.select("p.cost").distinct().collect()]:  # two at most
        own = good.where(F.col("p.cost") == cost)
        edges, cutoffs = _weighted(net, cost), own.select("req", F.explode(F.array_distinct("p.cutoffs")).alias("cutoff"))
        limits = own.select("req", F.array_max("p.cutoffs").alias("most"))
        reached = cc.cut(overlay.rounds(own.select("req", "node", F.lit(0.0).alias("cost")), overlay.with_blocks(edges, overlay.BLOCK_NODES), limits=limits), "reached")
        counts = reached.join(cutoffs, "req").where("cost <= cutoff").groupBy("req", "cutoff").agg(F.count("*").alias("reached"))
        shapes = _areas(net, own, raster.frontier(reached, edges, cutoffs))
        feature = _feature("MultiPolygon", F.col("shape"), cutoff=F.col("cutoff"), cost=F.lit(cost), reached_nodes=F.col("reached"))
        part = shapes.join(counts, ["req", "cutoff"]).groupBy("req").agg(F.sort_array(F.collect_list(F.struct("cutoff", feature.alias("f"))), False).alias("l"))
        part = part.select("req", F.transform("l", lambda x: x["f"]).alias("features"))
        out = part if out is None else out.unionByName(part)
    return _answers(rows, out, "nothing can be reached within the cutoffs") if out is not None else rows.select("req", F.to_json(F.struct("error")).alias("result"))


def _areas(net, asked: DataFrame, frontier: DataFrame) -> DataFrame:
    """(req, cutoff, shape: MultiPolygon coordinates) around frontier's edges: cells, dilation, contours."""
    at = lambda node, x, y: net.nodes.select(F.col("node").alias(node), F.col("lon").alias(x), F.col("lat").alias(y))
    segments = frontier.join(at("src", "x1", "y1"), "src").join(at("dst", "x2", "y2"), "dst")
    segments = segments.withColumns({"x2": F.col("x1") + (F.col("x2") - F.col("x1")) * F.least(F.lit(1.0), "fraction"), "y2": F.col("y1") + (F.col("y2") - F.col("y1")) * F.least(F.lit(1.0), "fraction")})
    segments = cc.cut(segments.select("req", "cutoff", "x1", "y1", "x2", "y2"), "reach")
    box = segments.groupBy("req", "cutoff").agg(*[f(F.least(c + "1", c + "2") if f is F.min else F.greatest(c + "1", c + "2")).alias(n + c) for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    lon_m = F.greatest(F.lit(1.0), measure.LON_M * F.cos(F.radians((F.col("miny") + F.col("maxy")) / 2)))
    grid = box.join(asked.select("req", F.col("p.cell_size_m").alias("size")), "req").withColumn("lon_m", lon_m)
    usual = F.greatest(F.greatest((F.col("maxx") - F.col("minx")) * F.col("lon_m"), (F.col("maxy") - F.col("miny")) * measure.LAT_M) / 128, F.lit(5.0))
    cell = F.when(F.col("size") > 0, F.col("size")).otherwise(usual)
    grid = cc.cut(grid.select("req", "cutoff", "minx", "miny", (cell / F.col("lon_m")).alias("cw"), (cell / measure.LAT_M).alias("ch")), "grid")
    keys = ["req", "cutoff"]
    inside = segments.join(grid, keys).select(*keys, *[((F.col(c + i) - F.col("min" + c)) / F.col(s)).alias(n + c) for c, s in (("x", "cw"), ("y", "ch")) for i, n in (("1", "a"), ("2", "b"))])
    marked = raster.dilate(raster.cells(inside, 1.0, keys), keys)
    shapes = raster.areas(marked, keys).join(grid, keys)
    place = lambda v: F.array(F.col("minx") + v["x"] / 2 * F.col("cw"), F.col("miny") + v["y"] / 2 * F.col("ch"))
    return shapes.where(F.size("polygons") > 0).select(*keys, F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, place))).alias("shape"))


