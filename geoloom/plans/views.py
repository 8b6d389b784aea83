"""Geometry layers derived from the driver's tables, in whole micro-degrees so that all engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(rows: DataFrame, key: str, name: str, kind) -> DataFrame:
    k, h = F.col("fid"), F.col("fid") % 40
    rows = rows.select(F.col(key).cast("bigint").alias("fid"), F.col(name).alias("name"), kind.alias("kind"))
    far = k % 10 == 0
    mx = F.when(far, 116000000 + (k * k * 7919 + k * 104729) % 1000003).otherwise(116000000 + (h * h * 7919 + h * 104729) % 1000003 + (k * k * 31 + k * 17) % 2003 * 4 - 4004)
    my = F.when(far, 39500000 + (k * k * 6007 + k * 15485) % 1000033).otherwise(39500000 + (h * h * 6007 + h * 15485) % 1000033 + (k * k * 13 + k * 29) % 1999 * 4 - 3996)
    return rows.withColumns({"mx": mx, "my": my}).withColumns({"lon": F.col("mx") / 1e6, "lat": F.col("my") / 1e6})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, name, kind, mx, my, lon, lat from customer."""
    return _place(table(spark, sf_dir, "customer"), "c_custkey", "c_name", F.col("c_mktsegment"))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from supplier."""
    return _place(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", F.col("s_nationkey").cast("string"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points as a feature frame (idx, fid, name, kind, corners, props)."""
    p = points(spark, sf_dir)
    props = F.create_map(F.lit("name"), F.concat(F.lit('"'), "name", F.lit('"')), F.lit("fid"), F.col("fid").cast("string"), F.lit("scattered"), (F.col("fid") % 10 == 0).cast("string"))
    return p.select(F.col("fid").alias("idx"), F.col("fid").cast("string").alias("fid"), "name", "kind", "mx", "my", "lon", "lat", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"), props.alias("props"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, mx, my, level of a lattice from part."""
    k = F.col("p_partkey").cast("bigint")
    return table(spark, sf_dir, "part").select(k.alias("node"), (116000000 + k % WIDTH * 1000).alias("mx"), (39900000 + F.floor(k / WIDTH) * 1000).alias("my"), F.lit(0).cast("smallint").alias("level"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w of the lattice, both ways: to the right and up."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"), (100 + F.col("p_size") * 10).cast("bigint").alias("w"))
    right = part.where(F.col("k") % WIDTH < WIDTH - 1).select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst"), "w")
    up = part.select(F.col("k").alias("src"), (F.col("k") + WIDTH).alias("dst"), "w")
    one = right.unionByName(up).join(part.select(F.col("k").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, seq (from 0), ts, mx, my, lon, lat from events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), "ts", (116010000 + F.sum((F.col("event_id") * 31 % 7 - 3) * 100).over(run)).alias("mx"), (39903000 + F.sum((F.col("event_id") * 17 % 5 - 2) * 100).over(run)).alias("my"))
    return e.withColumns({"lon": F.col("mx") / 1e6, "lat": F.col("my") / 1e6})


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, props, parts (one line) and corners of each track with two points at least."""
    t = tracks(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("ps"), F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"))
    line = F.transform("ps", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    props = F.map_filter(F.create_map(F.lit("oneway"), F.when(F.col("user_id") % 5 == 0, '"yes"'), F.lit("level"), (F.col("user_id") % 3).cast("string"), F.lit("speed"), F.when(F.col("user_id") % 2 == 0, F.lit("50"))), lambda k, v: v.isNotNull())
    return t.where(F.size("ps") > 1).select(F.col("user_id").alias("feature"), props.alias("props"), F.array(line).alias("parts"), "xmin", "ymin", "xmax", "ymax")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected lattice segments: sid, src, dst, mx1, my1, mx2, my2, ax, ay, bx, by; sid = src * 2, plus 1 if upward."""
    n = nodes(spark, sf_dir)
    e = edges(spark, sf_dir).where("src < dst")
    a = n.select(F.col("node").alias("src"), F.col("mx").alias("mx1"), F.col("my").alias("my1"))
    b = n.select(F.col("node").alias("dst"), F.col("mx").alias("mx2"), F.col("my").alias("my2"))
    out = e.join(a, "src").join(b, "dst").withColumn("sid", F.col("src") * 2 + (F.col("dst") - F.col("src") > 1).cast("bigint"))
    return out.withColumns({"ax": F.col("mx1") / 1e6, "ay": F.col("my1") / 1e6, "bx": F.col("mx2") / 1e6, "by": F.col("my2") / 1e6})
