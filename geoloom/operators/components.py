"""Connected components over edge frames, and the scratch tables that loops cut their lineage with."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share, deleted when the session's JVM ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or "file:///tmp/checkpoints/geoloom"  # a single JVM
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df into the folder that driver and executors share and reads it back."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with dense numbers from 0 by the order of the keys: rows are sorted in ranges, and each range's first number is
    the sum of the counts before it (a row a range)."""
    kept = df.columns
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    rows = cut(rows, "ordered")
    counts = rows.groupBy(F.shiftright("__m", 33).alias("part")).count().orderBy("part").collect()
    first, start = 0, []
    for r in counts:
        start.append((r["part"], first))
        first += r["count"]
    starts = df.sparkSession.createDataFrame(start, "__p bigint, __first bigint")
    within = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__p", F.shiftright("__m", 33)).join(F.broadcast(starts), "__p").withColumn(name, F.col("__first") + within).select(*kept, name)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) connect each node with. Labels fall to the smallest
    neighbouring label and then jump along labels, so that long chains take few rounds."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = cut(both, "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("l", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        after = lower.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("further", "low")).alias("now"))
        after = cut(after, "labels")
        changed = not after.where("now < label").isEmpty()
        labels = after.select("node", F.col("now").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
