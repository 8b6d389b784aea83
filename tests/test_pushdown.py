"""Filters reach the files: what a read asks SQLite for, and the rows that come back."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry
from geoloom.plans.engine import Engine, Layer
from geoloom.sources import sqlite_sources


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiles") / "a.mbtiles")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata(name TEXT, value TEXT)")
        db.execute("CREATE TABLE tiles(zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
        db.execute("CREATE UNIQUE INDEX tile_index ON tiles(zoom_level, tile_column, tile_row)")
        db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", [(z, x, y, b"%d/%d/%d" % (z, x, y)) for z in range(7) for x in range(1 << z) for y in range(1 << z)])
    return path


def asked(path, filters, kind=sqlite_sources._MbtilesReader):
    """(rows that the tasks fetch, filters that are left to Spark) of a reader."""
    reader = kind({"path": path})
    left = list(reader.pushFilters(filters))
    return [r for p in reader.partitions() for r in reader.read(p)], left


def test_one_tile_is_one_row(spark, store):
    from pyspark.sql.datasource import EqualTo, IsNotNull

    own = [EqualTo((c,), v) for c, v in (("zoom_level", 6), ("tile_column", 52), ("tile_row", 11))]
    rows, left = asked(store, [*own, IsNotNull(("zoom_level",))])
    assert rows == [(6, 52, 11, b"6/52/11")] and [type(f) for f in left] == [IsNotNull]
    with sqlite3.connect(store) as db:
        reader = sqlite_sources._MbtilesReader({"path": store})
        list(reader.pushFilters(own))
        plan = db.execute("EXPLAIN QUERY PLAN " + reader.query("tile_data", reader.partitions()[0])[0], reader.values).fetchall()
    assert "tile_index" in str(plan) and "SCAN" not in str(plan)


@pytest.mark.parametrize("where,count", [("zoom_level = 3", 64), ("zoom_level >= 5 and tile_column < 2", 2 * 32 + 2 * 64), ("zoom_level in (0, 2)", 17), ("tile_data = X'302F302F30'", 1), ("zoom_level = 9", 0), ("zoom_level = 1 or tile_row = 63", 4 + 64), ("zoom_level = 6 and tile_column = 1 and tile_row = 63", 1)])
def test_filters_give_the_same_rows(spark, store, where, count):
    assert sqlite_sources.read_mbtiles(spark, store).where(where).count() == count


def test_ranges_of_a_zoom_are_small(store, monkeypatch):
    from pyspark.sql.datasource import EqualTo

    monkeypatch.setattr(sqlite_sources, "ROWS_PER_TASK", 100)
    reader = sqlite_sources._MbtilesReader({"path": store})
    assert len(reader.partitions()) == 55
    list(reader.pushFilters([EqualTo(("zoom_level",), 2)]))
    assert len(reader.partitions()) == 1


def test_engine_tile(spark, store):
    e = Engine(spark)
    e.add(Layer("stored", None, store=sqlite_sources.read_mbtiles(spark, store), maxzoom=6))
    assert e.tile("stored", 6, 52, 24) == b"6/52/39" and e.tile("stored", 5, 3, 1) == b"5/3/30"


@pytest.mark.parametrize("srs", [4326, 3857])
def test_box_by_the_r_tree(spark, tmp_path, srs):
    path = str(tmp_path / "a.gpkg")
    place = (lambda x, y: (x, y)) if srs == 4326 else sqlite_sources._metres
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_contents(table_name TEXT PRIMARY KEY, data_type TEXT)")
        db.execute("CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT, srs_id INTEGER)")
        db.execute("CREATE TABLE spots(fid INTEGER PRIMARY KEY, geom BLOB)")
        db.execute("INSERT INTO gpkg_contents VALUES ('spots', 'features')")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('spots', 'geom', ?)", (srs,))
        at = {i: place(i % 20 - 10.0, i // 20 - 10.0) for i in range(400)}
        db.executemany("INSERT INTO spots VALUES (?, ?)", [(i, b"GP\0\x01" + struct.pack("<i", srs) + geometry.write_wkb("Point", [[[p]]])) for i, p in at.items()])
    box = (-1.5, 2.5, 3.5, 4.5)
    rows = lambda: sorted(r["idx"] for r in sqlite_sources.read_gpkg(spark, path, box=box).collect())
    want = [i for i in at if -1.5 <= i % 20 - 10 <= 3.5 and 2.5 <= i // 20 - 10 <= 4.5]
    assert rows() == want  # without a tree
    with sqlite3.connect(path) as db:
        db.execute("CREATE VIRTUAL TABLE rtree_spots_geom USING rtree(id, minx, maxx, miny, maxy)")
        db.executemany("INSERT INTO rtree_spots_geom VALUES (?, ?, ?, ?, ?)", [(i, x, x, y, y) for i, (x, y) in at.items()])
    assert rows() == want
    reader = sqlite_sources._GpkgReader({"path": path, "box": ",".join(map(str, box))})
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == len(want)
    assert sqlite_sources.read_gpkg(spark, path).where(F.col("idx") == 7).count() == 1
