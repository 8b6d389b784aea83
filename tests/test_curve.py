"""Storage along the curve: the same rows, and few of them read for a box."""

import random

from pyspark.sql import functions as F

from geoloom.operators import curve, features


def scanned(df):
    """Rows that the file scan gives, after row groups and pages that can't match are left out."""
    df.collect()
    plan, stack = None, [df._jdf.queryExecution().executedPlan()]
    while stack:
        at = stack.pop()
        if at.nodeName().startswith("Scan"):
            plan = at
        stack += [at.children().apply(i) for i in range(at.children().size())]
        if at.nodeName() == "AdaptiveSparkPlan":
            stack.append(at.executedPlan())
    return plan.metrics().apply("numOutputRows").value()


def test_order_keeps_neighbours_together(spark):
    at = [(x - 180.0 + 0.01, y - 90.0 + 0.01) for x in range(0, 360, 45) for y in range(0, 180, 45)]
    got = [r["m"] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "i int, x double, y double").select("i", curve.morton(F.col("x"), F.col("y")).alias("m")).orderBy("i").collect()]

    def by_hand(x, y):
        a, b = (int((v + most) / (2 * most) * (1 << curve.BITS)) for v, most in ((x, 180.0), (y, 90.0)))
        return sum((a >> k & 1) << 2 * k | (b >> k & 1) << 2 * k + 1 for k in range(curve.BITS))

    assert got == [by_hand(*p) for p in at] and len(set(got)) == len(got)
    odd = spark.createDataFrame([(None, 1.0), (999.0, -999.0)], "x double, y double").select(curve.morton(F.col("x"), F.col("y"))).collect()
    assert all(r[0] >= 0 for r in odd)


def test_a_box_reads_little(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "store")
    rows = spark.range(200_000).select(F.col("id").alias("idx"), (F.rand(1) * 40).alias("x"), (F.rand(2) * 30).alias("y"), F.when(F.rand(3) < 0.001, 5.0).otherwise(0.0001).alias("w"))
    rows = rows.select("idx", F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("w")).alias("ymax"), F.lit("p" * 50).alias("pad")).cache()
    curve.write(rows, path, 8)
    assert curve.read(spark, path).count() == 200_000
    for _ in range(4):
        x, y = rng.random() * 38, rng.random() * 28
        box = (x, y, x + 0.5, y + 0.5)
        got = curve.read(spark, path, box)
        assert scanned(got) < 20_000
        assert sorted(r["idx"] for r in got.collect()) == sorted(r["idx"] for r in features.bbox_filter(rows, *box).collect())
    rows.unpersist()
