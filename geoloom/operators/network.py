"""Routable networks from line features, declaratively."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import measure, props

from . import components as cc


@dataclass(frozen=True)
class NetworkOptions:
    speed_kmh: float = 5.0
    speed_field: str | None = None
    oneway_field: str | None = None
    level_field: str = "level"
    level_from_field: str = "level_from"
    level_to_field: str = "level_to"
    duration_field: str = "duration_s"


def _prop(name: str | None) -> Column:
    return F.get(F.map_values(F.map_filter("props", lambda k, v: k == name)), F.lit(0)) if name else F.lit(None).cast("string")


def edges_of(lines: DataFrame, options: NetworkOptions = NetworkOptions()) -> DataFrame:
    """Directed edges (feature, part, pos, reverse, fx, fy, flevel, tx, ty, tlevel in micro-degrees, flon, flat, tlon,
    tlat, length_m, speed, duration_s) of line features (feature, props map of JSON texts, parts: array of arrays of
    (x, y)). A line with numeric levels at both ends is one connector with a fixed duration."""
    speed = F.coalesce(F.when(props.prop_float(_prop(options.speed_field)) > 0, props.prop_float(_prop(options.speed_field))), F.lit(options.speed_kmh if options.speed_kmh > 0 else 5.0)) / 3.6
    lf, lt = props.prop_float(_prop(options.level_from_field)), props.prop_float(_prop(options.level_to_field))
    rows = lines.select(
        "feature",
        speed.alias("speed"),
        F.coalesce(props.prop_float(_prop(options.level_field)).cast("smallint"), F.lit(0).cast("smallint")).alias("level"),
        F.when(lf.isNotNull() & lt.isNotNull(), lf.cast("smallint")).alias("lf"),
        F.when(lf.isNotNull() & lt.isNotNull(), lt.cast("smallint")).alias("lt"),
        F.coalesce(props.prop_float(_prop(options.duration_field)), F.lit(0.0)).alias("duration"),
        (props.prop_bool(_prop(options.oneway_field)) if options.oneway_field else F.lit(False)).alias("oneway"),
        F.posexplode("parts").alias("part", "points"),
    )
    pairs = F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    step = lambda s: measure.haversine(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
    joint = rows.where(F.col("lf").isNotNull() & (F.size("points") >= 2)).select(
        "feature", "part", F.lit(0).alias("pos"), "oneway", "speed", F.element_at("points", 1).alias("a"), F.element_at("points", -1).alias("b"), F.col("lf").alias("flevel"), F.col("lt").alias("tlevel"),
        F.aggregate(pairs, F.lit(0.0), lambda t, s: t + step(s)).alias("length_m"), "duration",
    )
    joint = joint.withColumn("duration_s", F.when((F.col("length_m") == 0) & (F.col("duration") == 0), 30.0).otherwise(F.col("duration"))).drop("duration")
    plain = rows.where(F.col("lf").isNull()).select("feature", "part", "oneway", "speed", "level", F.posexplode(pairs).alias("pos", "s"))
    plain = plain.select("feature", "part", "pos", "oneway", "speed", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("level").alias("flevel"), F.col("level").alias("tlevel"), step(F.col("s")).alias("length_m"), F.lit(0.0).alias("duration_s"))
    both = joint.unionByName(plain)
    ends = {"fx": measure.quantize(F.col("a.x")), "fy": measure.quantize(F.col("a.y")), "tx": measure.quantize(F.col("b.x")), "ty": measure.quantize(F.col("b.y")), "flon": F.col("a.x"), "flat": F.col("a.y"), "tlon": F.col("b.x"), "tlat": F.col("b.y")}
    both = both.withColumns(ends).drop("a", "b").where("fx <> tx or fy <> ty or flevel <> tlevel")
    swap = {"fx": "tx", "fy": "ty", "flon": "tlon", "flat": "tlat", "flevel": "tlevel"}
    back = both.where("not oneway").withColumnsRenamed({**{a: f"__{b}" for a, b in swap.items()}, **{b: f"__{a}" for a, b in swap.items()}})
    back = back.withColumnsRenamed({f"__{c}": c for pair in swap.items() for c in pair}).withColumn("reverse", F.lit(True))
    out = both.withColumn("reverse", F.lit(False)).unionByName(back).drop("oneway")
    return out.select("feature", "part", "pos", "reverse", "fx", "fy", "flevel", "tx", "ty", "tlevel", "flon", "flat", "tlon", "tlat", "length_m", "speed", "duration_s")


def nodes_of(edges: DataFrame) -> DataFrame:
    """Nodes (qx, qy, level, lon, lat): one for each micro-degree place and level, with the position seen first."""
    order = F.struct("feature", "part", "pos", F.col("reverse").cast("int"))
    f = edges.select(F.col("fx").alias("qx"), F.col("fy").alias("qy"), F.col("flevel").alias("level"), F.struct(order.alias("o"), F.lit(0).alias("e")).alias("seen"), F.col("flon").alias("lon"), F.col("flat").alias("lat"))
    t = edges.select(F.col("tx").alias("qx"), F.col("ty").alias("qy"), F.col("tlevel").alias("level"), F.struct(order.alias("o"), F.lit(1).alias("e")).alias("seen"), F.col("tlon").alias("lon"), F.col("tlat").alias("lat"))
    first = F.min_by(F.struct("lon", "lat"), "seen")
    return f.unionByName(t).groupBy("qx", "qy", "level").agg(first.alias("p")).select("qx", "qy", "level", "p.lon", "p.lat")


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with dense ids by place and level."""
    return cc.dense(nodes, ["qx", "qy", "level"], "node")


def travel_seconds(duration: Column, length: Column, speed: Column) -> Column:
    return F.when(duration > 0, duration).otherwise(length / speed)


def linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src, dst node ids and time_s."""
    a = nodes.select(F.col("qx").alias("fx"), F.col("qy").alias("fy"), F.col("level").alias("flevel"), F.col("node").alias("src"))
    b = nodes.select(F.col("qx").alias("tx"), F.col("qy").alias("ty"), F.col("level").alias("tlevel"), F.col("node").alias("dst"))
    return edges.join(a, ["fx", "fy", "flevel"]).join(b, ["tx", "ty", "tlevel"]).withColumn("time_s", travel_seconds(F.col("duration_s"), F.col("length_m"), F.col("speed")))


def undirected(edges: DataFrame) -> DataFrame:
    """Each two-way segment of a feature once (from the smaller end), one-way ones as they are; all columns kept."""
    start, end = F.struct("fx", "fy", "flevel"), F.struct("tx", "ty", "tlevel")
    back = edges.select("feature", F.col("tx").alias("fx"), F.col("ty").alias("fy"), F.col("tlevel").alias("flevel"), F.col("fx").alias("tx"), F.col("fy").alias("ty"), F.col("flevel").alias("tlevel")).distinct()
    keys = ["feature", "fx", "fy", "flevel", "tx", "ty", "tlevel"]
    return edges.where(start < end).unionByName(edges.where(start > end).join(back, keys, "left_anti"))


def stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, max_speed, box."""
    n = nodes.agg(F.count("*").alias("node_count"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    return edges.agg(F.count("*").alias("edge_count"), F.max("speed").alias("max_speed")).crossJoin(F.broadcast(n))
