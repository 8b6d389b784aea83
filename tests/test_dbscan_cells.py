"""Links between cells by boxes, against all pairs of points; crowded cells without pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from geoloom.operators import dbscan


def test_links_by_boxes(spark, monkeypatch):
    """The same links whatever the number of pairs that are looked at."""
    rng = random.Random(5)
    side, eps = 1.0, 1.414
    points = [(i, *p) for i, p in enumerate((rng.choice([rng.random() * 8, rng.gauss(3, 0.3)]), rng.choice([rng.random() * 8, rng.gauss(4, 0.2)])) for _ in range(500))]
    points += [(500 + i, 6.99, 6.99) for i in range(30)] + [(600 + i, 8.0, 8.0) for i in range(30)]
    cell = {}
    for i, x, y in points:
        cell.setdefault((int(x // side), int(y // side)), []).append((i, x, y))
    want = set()
    for (cx, cy), own in cell.items():
        for i in range(-2, 3):
            for j in range(-2, 3):
                other = cell.get((cx + i, cy + j), [])
                if (i, j) > (0, 0) and any((x - u) ** 2 + (y - v) ** 2 <= eps * eps for _, x, y in own for _, u, v in other):
                    want.add((min(own)[0], min(other)[0]))
    rows = spark.createDataFrame([(i, x, y, cx, cy, min(own)[0]) for (cx, cy), own in cell.items() for i, x, y in own], "id long, x double, y double, cx long, cy long, cell long")
    for few in (4096, 9, 1):
        monkeypatch.setattr(dbscan, "FEW", few)
        assert {(r["a"], r["b"]) for r in dbscan.linked(rows, eps, side).collect()} == want


@pytest.mark.parametrize("block", [64, 2])
def test_components_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(dbscan, "BLOCK", block)
    rng = random.Random(2)
    at = {n: (n % 12, n // 12) for n in range(144)}
    links = [(a, b) for a in at for b in (a + 1, a + 12) if b < 144 and rng.random() < 0.55]
    label = dict(zip(at, at))
    for _ in at:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    rows = spark.createDataFrame([(a, *at[a], b, *at[b]) for a, b in links], "a long, acx long, acy long, b long, bcx long, bcy long")
    assert {r["node"]: r["component"] for r in dbscan._components(rows).collect()} == {n: label[n] for link in links for n in link}


def test_crowded_cells_form_no_pairs(spark):
    """Two crowds of 40,000 points in neighbouring cells: 1.6 * 10^9 pairs, none of them formed."""
    rng = np.random.default_rng(1)
    n = 40_000
    lon, lat = np.concatenate([rng.uniform(0, 0.0002, n), rng.uniform(0.0005, 0.0007, n), [0.01]]), np.concatenate([rng.uniform(0, 0.0002, 2 * n), [0.01]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2 * n + 1), "lon": lon, "lat": lat}))
    got = dbscan.labels(df, 50.0, 5).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == {0: 2 * n, -1: 1}
    apart = dbscan.labels(df, 20.0, 5).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in apart} == {0: n, 1: n, -1: 1}
