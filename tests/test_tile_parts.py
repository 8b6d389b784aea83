"""Parts of tiles merge to the same layer as all features at once."""

import gzip
import random

from geoloom.operators import tiles
from pyspark.sql import functions as F


def test_parts_merge():
    rng = random.Random(1)
    rows = [(i, {k: rng.choice([True, 1.5, "a", "b", 7]) for k in rng.sample("uvwxyz", rng.randrange(4))}, (1, [[(rng.randrange(4096), rng.randrange(4096))]])) for i in range(60)]
    whole = tiles.decode(tiles.encode_layer("l", rows))["l"]
    merged = tiles.Part()
    for at in range(0, 60, 7):
        part = tiles.Part()
        for fid, props, (kind, parts) in rows[at : at + 7]:
            part.add(fid, list(props), [tiles._value(v) for v in props.values()], kind, tiles._commands(kind, parts))
        merged.merge(tiles.Part(list(part.keys), list(part.values), part.features))
    assert tiles.decode(merged.layer("l"))["l"] == whole
    assert [f["properties"] for f in whole] == [r[1] for r in rows]
    assert merged.layer("l") == tiles.encode_layer("l", rows)


def test_crowded_tile_is_built_in_parts(spark, monkeypatch):
    """The same bytes whatever the size of the parts."""
    rows = spark.range(3000).select("id", (F.col("id") * 7919 % 3000).alias("idx")).select("idx", F.col("idx").cast("string").alias("fid"), F.concat(F.lit("n"), F.col("idx") % 11).alias("name"), F.when(F.col("idx") % 3 > 0, F.col("idx") / 2).alias("half"), (F.col("idx") * 0.0001).alias("lon"), F.lit(0.5).alias("lat"))
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))).alias("coords"))
    rows = rows.withColumn("geom", geom).withColumns({"xmin": F.col("lon"), "xmax": F.col("lon"), "ymin": F.col("lat"), "ymax": F.col("lat")})
    keyed = tiles.tile_features(rows, 0, 9)
    want = {(r["z"], r["x"], r["y"]): (r["n"], bytes(r["tile"])) for r in tiles.build(keyed, "l", ["name", "half"]).collect()}
    monkeypatch.setattr(tiles, "PART_FEATURES", 100)
    assert {(r["z"], r["x"], r["y"]): (r["n"], bytes(r["tile"])) for r in tiles.build(keyed, "l", ["name", "half"]).collect()} == want
    got = tiles.decode(want[0, 0, 0][1])["l"]
    assert [f["id"] for f in got] == list(range(3000)) and got[4]["properties"] == {"name": "n4", "half": 2.0} and got[3]["properties"] == {"name": "n3"}


def test_bytes_are_those_of_all_features_at_once(spark, monkeypatch):
    """Parts with keys and values that others share or have alone; no task makes a part of more than its features."""
    monkeypatch.setattr(tiles, "PART_FEATURES", 7)
    monkeypatch.setattr(tiles, "ZIP_BYTES", 64)
    rng = random.Random(2)
    own = [{k: rng.choice(["a", "b", str(i), None]) for k in "uvw"} for i in range(90)]
    rows = [(i, str(i) if i % 4 else f"f{i}", ("Point", [[[(0.01 * i, 0.5)]]]), *p.values(), 0.01 * i, 0.5, 0.01 * i, 0.5) for i, p in enumerate(own)]
    frame = spark.createDataFrame(rows, "idx bigint, fid string, geom struct<type:string,coords:array<array<array<struct<x:double,y:double>>>>>, u string, v string, w string, xmin double, ymin double, xmax double, ymax double")
    built = tiles.build(tiles.tile_features(frame, 0, 0), "l", list("uvw")).collect()
    assert len(built) == 1 and built[0]["n"] == 90
    whole = [(i if i % 4 else None, p, tiles.cut("Point", [[[(0.01 * i, 0.5)]]], 0, 0, 0)) for i, p in enumerate(own)]
    tile = bytes(built[0]["tile"])
    assert gzip.decompress(tile) == tiles.encode_layer("l", whole)
    decoded = [(f["id"], f["properties"]) for f in tiles.decode(tile)["l"]]
    assert list(tiles.properties(tile, "l")) == decoded == list(tiles.properties(gzip.decompress(tile), "l"))
    assert not list(tiles.properties(tile, "other"))


def test_parts_hold_few_features(spark):
    """A crowded tile's parts are small, and its unzipped bytes are never held whole."""
    assert tiles.PART_FEATURES <= 1 << 14
    held = []
    zipped = tiles._Zipped()
    for _ in range(100):
        zipped.add(b"x" * 100_000)
        held.append(len(zipped.held))
    assert max(held) < tiles.ZIP_BYTES and gzip.decompress(zipped.end()) == b"x" * 10_000_000


def test_pieces_of_a_tile_stay_together(spark, monkeypatch):
    """Whatever adaptive execution does, a tile is one row."""
    monkeypatch.setattr(tiles, "PART_FEATURES", 20)
    rows = spark.range(400).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("fid"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 0.4 - 80).alias("lon"), F.lit(0.5).alias("lat"))
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))).alias("coords"))
    rows = rows.withColumn("geom", geom).withColumns({"xmin": F.col("lon"), "xmax": F.col("lon"), "ymin": F.col("lat"), "ymax": F.col("lat")})
    keyed = tiles.tile_features(rows, 0, 3)
    want = {(r["z"], r["x"], r["y"]): r["n"] for r in tiles.tile_counts(keyed).collect()}
    built = tiles.build(keyed, "l", ["name"]).collect()
    assert len(built) == len(want) and {(r["z"], r["x"], r["y"]): r["n"] for r in built} == want
    assert all(len(list(tiles.properties(bytes(r["tile"]), "l"))) == r["n"] for r in built)
