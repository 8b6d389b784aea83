"""Rings by pointer jumping and their nesting by rows, against rings followed one by one and tests of points."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import raster


def followed(cells):
    """Rings of directed contour segments around cells, each from its smallest point."""
    code = {}
    for gx, gy in cells:
        for i, j, bit in ((0, -1, 1), (-1, -1, 2), (-1, 0, 4), (0, 0, 8)):
            code[gx + i, gy + j] = code.get((gx + i, gy + j), 0) + bit
    ahead = {}
    for (x, y), c in code.items():
        for pair in raster.CASES.get(c, "").split():
            a, b = ((2 * x + raster.SIDES[s][0], 2 * y + raster.SIDES[s][1]) for s in pair)
            # the cell to the left of the way from a to b
            dx, dy = b[0] - a[0], b[1] - a[1]
            left = ((a[0] + b[0] - dy) / 2, (a[1] + b[1] + dx) / 2) if dx and dy else (a[0] - dy / 2, a[1] + dx / 2)
            a, b = (a, b) if (left[0] / 2, left[1] / 2) in cells else (b, a)
            assert a not in ahead
            ahead[a] = b
    rings, seen = {}, set()
    for first in sorted(ahead):
        if first not in seen:
            ring, at = [], first
            while at not in seen:
                seen.add(at)
                ring.append(at)
                at = ahead[at]
            rings[first] = ring
    return rings


def shapes(seed):
    rng = random.Random(seed)
    solid = {(x, y) for x in range(30) for y in range(30)}
    for _ in range(25):
        x, y, r = rng.randrange(1, 28), rng.randrange(1, 28), rng.choice([1, 2, 4])
        solid -= {(a, b) for a in range(x, min(29, x + r)) for b in range(y, min(29, y + r))}
    target = {(x, y) for x in range(-40, -10) for y in range(30) if max(abs(x + 25), abs(y - 15)) % 4 < 2}  # rings in rings
    noise = {(rng.randrange(40, 60), rng.randrange(20)) for _ in range(150)}
    return solid | target | noise


@pytest.mark.parametrize("block", [128, 7])
def test_rings(spark, monkeypatch, block):
    monkeypatch.setattr(raster, "RING_BLOCK", block)
    marked = {k: shapes(k) for k in range(3)} | {3: {(0, 0)}}
    df = spark.createDataFrame([(k, x, y) for k, cells in marked.items() for x, y in cells], "req long, gx int, gy int")
    points = raster.rings(raster.contours(df, ["req"]), ["req"]).cache()
    got = {}
    for r in points.orderBy("req", "rx", "ry", "pos").collect():
        got.setdefault((r["req"], r["rx"], r["ry"]), []).append((r["pos"], (r["x"], r["y"])))
    want = {(k, *first): list(enumerate(ring)) for k, cells in marked.items() for first, ring in followed(cells).items()}
    assert got == want
    area = {k: round(2 * raster.ring_area([p for _, p in ring] + [ring[0][1]])) for k, ring in want.items()}
    nest = {(r["req"], r["rx"], r["ry"]): r for r in raster.nesting(points, ["req"]).collect()}
    assert {k: (r["n"], r["area2"]) for k, r in nest.items()} == {k: (len(want[k]), area[k]) for k in want}
    for key, r in nest.items():
        outer = (key[1], key[2])
        if area[key] < 0:
            around = [k for k in want if k[0] == key[0] and area[k] > 0 and raster.contains([p for _, p in want[k]] + [want[k][0][1]], (key[1] + 0.01, key[2] + 0.013))]
            outer = min(around, key=lambda k: area[k])[1:]
        assert (r["ox"], r["oy"]) == outer, key
    polygons = {r["req"]: r["polygons"] for r in raster.areas(df, ["req"], 0.0).collect()}
    for k, cells in marked.items():
        found = sum(raster.ring_area([(p["x"], p["y"]) for p in ring]) for polygon in polygons[k] for ring in polygon)
        assert 2 * found == sum(a for key, a in area.items() if key[0] == k)
        assert all(raster.ring_area([(p["x"], p["y"]) for p in polygon[0]]) > 0 for polygon in polygons[k])
    points.unpersist()


def test_many_holes_in_a_row(spark):
    """Holes that look at holes: 300 side by side find the ring around them all."""
    cells = [(x, y) for x in range(601) for y in range(3) if not (x % 2 and y == 1)]
    points = raster.rings(raster.contours(spark.createDataFrame([(1, *c) for c in cells], "req long, gx int, gy int"), ["req"]), ["req"])
    got = raster.nesting(points, ["req"]).groupBy("ox", "oy").agg(F.count("*").alias("n")).collect()
    assert len(got) == 1 and got[0]["n"] == 301


def test_tasks_and_groups_follow_the_rows(spark, monkeypatch):
    """Many small areas share a group of rings; cells are dealt into as many tasks as they need."""
    from geoloom.operators import raster

    rows = [(r, x, y) for r in range(60) for x in range(-70, -58 + r % 3) for y in range(60, 67) if (x, y) != (-64, 63)]
    marked = spark.createDataFrame(rows, "req long, gx int, gy int")
    by_hand = {(r, x + i, y + j) for r, x, y in rows for i in (-1, 0, 1) for j in (-1, 0, 1)}
    monkeypatch.setattr(raster, "TASK_CELLS", 200)
    wide = raster.dilate(marked, ["req"])
    assert wide.rdd.getNumPartitions() >= len(rows) // 200 and wide.count() == len(by_hand) and {tuple(r) for r in wide.collect()} == by_hand
    got = []
    for most in (100, 1 << 20):
        monkeypatch.setattr(raster, "GROUP_ROWS", most)
        got.append({tuple(r) for r in raster.rings(raster.contours(marked, ["req"]), ["req"]).collect()})
    assert got[0] == got[1] and len({r[:3] for r in got[0]}) == 120
