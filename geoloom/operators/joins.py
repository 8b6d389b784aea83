"""Spatial joins as equi-joins on grid cells with exact residuals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import measure


def _cells_around(x: Column, y: Column) -> Column:
    """The 3 x 3 cells around a cell."""
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.struct((x + i).alias("cx"), (y + j).alias("cy")))))


def planar(points: DataFrame) -> DataFrame:
    """points with x, y in metres around their mean position."""
    mean = points.agg(F.avg("lon").alias("__clon"), F.avg("lat").alias("__clat"))
    mx, my = measure.meters_per_degree(F.col("__clat"))
    out = points.crossJoin(F.broadcast(mean))
    return out.withColumns({"x": (F.col("lon") - F.col("__clon")) * mx, "y": (F.col("lat") - F.col("__clat")) * my}).drop("__clon", "__clat")


def eps_join(points: DataFrame, eps: float) -> DataFrame:
    """(a, b) of all points (id, x, y) within eps of each other, both ways and each with itself."""
    cell = lambda c: F.floor(F.col(c) / eps)
    left = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    right = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(_cells_around(cell("x"), cell("y"))).alias("c")).select("b", "bx", "by", "c.cx", "c.cy")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return left.join(right, ["cx", "cy"]).where(dx * dx + dy * dy <= eps * eps).select("a", "b")


def _most_lat(rows: DataFrame, radius_m: float) -> float:
    """The latitude furthest from the equator that a radius around the rows (lat) reaches."""
    top = rows.agg(F.max(F.abs("lat")).alias("lat")).first()["lat"]
    return (top or 0.0) + radius_m / 110_000.0


def _degree_cells(radius_m: float, most_lat: float) -> tuple[float, float]:
    """Cell sizes in degrees that a radius never leaves by more than one cell at latitudes up to most_lat. The poles
    themselves lie beside all longitudes and get cells of a hundredth of a degree's length there."""
    return radius_m / (110_000.0 * max(0.01, math.cos(math.radians(min(89.0, most_lat))))), radius_m / 110_000.0


def nearest(queries: DataFrame, points: DataFrame, radius_m: float, k: int = 1, most_lat: float | None = None) -> DataFrame:
    """(qid, rank, pid, dist_m) of the k points (pid, lon, lat) nearest to each query (qid, lon, lat) within the radius;
    where both sides have a column level, on the same level only. Distances count to the millimetre; ties go to the
    smaller pid. most_lat is the latitude furthest from the equator, read from the queries if it isn't given."""
    w, h = _degree_cells(radius_m, _most_lat(queries, radius_m) if most_lat is None else most_lat)
    level = ["level"] if "level" in queries.columns and "level" in points.columns else []
    cx, cy = F.floor(F.col("lon") / w), F.floor(F.col("lat") / h)
    left = queries.select("qid", F.col("lon").alias("qlon"), F.col("lat").alias("qlat"), F.explode(_cells_around(cx, cy)).alias("c"), *level).select("qid", "qlon", "qlat", "c.cx", "c.cy", *level)
    right = points.select("pid", "lon", "lat", cx.alias("cx"), cy.alias("cy"), *level)
    dist = F.round(measure.haversine(F.col("qlon"), F.col("qlat"), F.col("lon"), F.col("lat")), 3)
    near = left.join(right, ["cx", "cy", *level]).withColumn("dist_m", dist).where(F.col("dist_m") <= radius_m)
    if k == 1:
        one = near.groupBy("qid").agg(F.min(F.struct("dist_m", "pid")).alias("n"))
        return one.select("qid", F.lit(1).alias("rank"), "n.pid", "n.dist_m")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist_m", "pid"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "pid", "dist_m")


def nearby_segments(queries: DataFrame, segments: DataFrame, radius_m: float, k: int = 5, most_lat: float | None = None) -> DataFrame:
    """(qid, rank, sid, x, y, fraction, dist_m) of the k segments (sid, ax, ay, bx, by) nearest to each query (qid, lon,
    lat) within the radius, with the nearest point of each; where queries have a column level and segments alevel and
    blevel, only segments with both ends on that level. Ties go to the smaller sid."""
    place = place_of(queries)
    asked = queries.select(*place).distinct().select(F.struct(*place).alias("qid"), *place)
    near = place_segments(asked, segments, radius_m, k, most_lat).select("qid.*", "rank", "sid", "x", "y", "fraction", "dist_m")
    return queries.select("qid", *place).join(near, place).select("qid", "rank", "sid", "x", "y", "fraction", "dist_m")


def place_of(points: DataFrame) -> list[str]:
    """The columns that say where points are."""
    return ["lon", "lat", *(["level"] if "level" in points.columns else [])]


def place_segments(queries: DataFrame, segments: DataFrame, radius_m: float, k: int = 5, most_lat: float | None = None) -> DataFrame:
    """``nearby_segments`` of queries at different places: where many share one, its cell would be a task of all of them."""
    w, h = _degree_cells(radius_m, _most_lat(queries, radius_m) if most_lat is None else most_lat)
    if "level" in queries.columns and "alevel" in segments.columns:
        segments = segments.where("alevel = blevel").withColumnRenamed("alevel", "level")
        level = ["level"]
    else:
        level = []
    span = lambda a, b, size, pad: F.sequence(F.floor(F.least(a, b) / size) - pad, F.floor(F.greatest(a, b) / size) + pad)
    covered = segments.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx"), w, 1))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"), h, 1)))
    left = queries.withColumns({"cx": F.floor(F.col("lon") / w), "cy": F.floor(F.col("lat") / h)})
    x, y, t = measure.project_on_segment(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    near = left.join(covered, ["cx", "cy", *level]).withColumns({"x": x, "y": y, "fraction": t})
    near = near.withColumn("dist_m", F.round(measure.haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")), 3)).where(F.col("dist_m") <= radius_m)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist_m", "sid"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "sid", "x", "y", "fraction", "dist_m")
