"""Sources, tiles, networks, algorithms and tools on small fixtures with known answers."""

import json
import math
import random
import sqlite3
import struct

import pytest

from geoloom.functions import geometry
from geoloom.operators import cache, dbscan, features, mapmatch, network, raster, search, tiles
from geoloom.operators.features import UserError
from geoloom.plans import documents, networks
from geoloom.plans.engine import Engine, Layer
from geoloom.sources import config, geojson, jdbc, sqlite_sources


def collection(*rows):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", **({"id": i} if i is not None else {}), "properties": p, "geometry": g} for i, p, g in rows]})


def point(x, y):
    return {"type": "Point", "coordinates": [x, y]}


def line(*ps):
    return {"type": "LineString", "coordinates": [list(p) for p in ps]}


def frame(spark, text):
    return geojson.features_of(spark.createDataFrame([(text,)], "value string")).cache()


TWO = collection((1, {"name": "beijing"}, point(116.39, 39.91)), (2, {"name": "shanghai"}, point(121.47, 31.23)))
THREE = collection((None, {"name": "beijing", "pop": 21893095.0}, point(116.39, 39.91)), (None, {"name": "line"}, line((116.0, 39.5), (117.0, 40.5))), (None, {"name": "nyc"}, point(-74.0, 40.7)), (None, {"name": "none"}, None))
STEPS = (0.0, 0.001, 0.002)
GRID = [(None, {"name": "h"}, line(*[(x, y) for x in STEPS])) for y in STEPS] + [(None, {"name": "v"}, line(*[(x, y) for y in STEPS])) for x in STEPS]
ANNEX = [
    *GRID,
    (None, {"level_from": 0, "level_to": 1, "duration_s": 20}, line((0.002, 0), (0.003, 0))),
    (None, {"level": 1}, line((0.003, 0), (0.003, 0.001))),
    (None, {"level": 2}, line((0.003, 0), (0.003, 0.001))),
    (None, {"level_from": 1, "level_to": 2, "duration_s": 25}, line((0.003, 0), (0.003, 0))),
]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.add(Layer("cities", frame(spark, TWO), "Cities"))
    e.add(Layer("three", frame(spark, THREE)))
    e.add(Layer("ways", frame(spark, collection(*ANNEX))))
    e.config.networks = [config.NetworkConfig("walk", "ways"), config.NetworkConfig("none", "cities")]
    return e


def test_items(engine):
    assert [f["id"] for f in engine.items("cities", [115, 39, 118, 41])["features"]] == [1]
    one = engine.items("cities", limit=1)
    assert one["numberMatched"] == 2 and one["numberReturned"] == 1 and one["links"]
    assert engine.item("cities", "1")["properties"] == {"name": "beijing"}
    assert engine.item("cities", "999") is None
    assert engine.items("three", [115, 39, 118, 41])["numberMatched"] == 2
    assert engine.items("three", limit=1, offset=2)["numberReturned"] == 1
    for bad in (dict(bbox=[1, 2, 3]), dict(limit=-2), dict(offset=-1), dict(bbox=[3, 0, 1, 1]), dict(bbox=[0, 0, math.nan, 1])):
        with pytest.raises(UserError):
            engine.items("cities", **bad)
    with pytest.raises(UserError):
        engine.items("nope")


def test_layer_metadata(engine):
    info = engine.layers["three"].info().first()
    assert (info["west"], info["east"], info["n"]) == (-74.0, 117.0, 3)
    assert info["fields"] == {"name": "String", "pop": "Number"}
    assert {r["name"] for r in engine.catalog().collect()} == {"cities", "three", "ways"}
    assert engine.collection("cities")["title"] == "Cities"
    doc = json.loads(documents.tilejson(engine.layers["cities"].info()).first()["document"])
    assert doc["tilejson"] == "3.0.0" and doc["maxzoom"] == 22 and doc["center"][2] == 11
    assert "559082264.0287177563" in documents.wmts(engine.spark, engine.layers["cities"].info())


def test_tiles(engine):
    got = tiles.decode(engine.tile("three", 6, 52, 24))["three"]
    names = {f["properties"]["name"] for f in got}
    assert "beijing" in names and "nyc" not in names
    assert next(f for f in got if f["properties"]["name"] == "beijing")["properties"]["pop"] == 21893095.0
    assert engine.tile("three", 6, 28, 36) is None and engine.tile("cities", 6, 0, 0) is None
    with pytest.raises(UserError):
        engine.tile("cities", 2, 9, 1)
    rows = {(r["z"], r["x"], r["y"]): r for r in engine.pyramid("cities", 6, 6).collect()}
    own = tiles.decode(bytes(rows[6, 52, 24]["tile"]))["cities"]
    assert [(f["id"], f["properties"]) for f in own] == [(1, {"name": "beijing"})]


def test_tile_geometry():
    square = [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]]]
    kind, rings = tiles.cut("Polygon", square, 0, 0, 0)
    back = tiles.decode(tiles.encode_layer("a", [(7, {"b": True, "n": 2.5}, (kind, rings))]))["a"][0]
    assert back["id"] == 7 and back["type"] == 3 and back["properties"] == {"b": True, "n": 2.5}
    assert back["geometry"][0][0] == back["geometry"][0][-1]
    assert tiles.clip_line([(-9000, 0), (9000, 0)]) == [[(-4096.0, 0.0), (8191.0, 0.0)]]
    assert tiles.cut("LineString", [[[(0, 0), (0, 0)]]], 0, 0, 0) is None
    assert tiles.etag(b"") == '"cbf29ce484222325"'


def test_network_counts(spark):
    lines = frame(spark, collection(*GRID)).selectExpr("idx as feature", "props", "geom.coords[0] as parts")
    net = networks.Network("n", lines)
    assert net.nodes.count() == 9 and net.edges.count() == 24
    own = net.local()
    a, b = own.snap((0, 0), 0, 10)[0], own.snap((0.002, 0.002), 0, 10)[0]
    best = own.graph.search([(a, 0.0)], target=b)
    assert len(own.graph.path(best, b)) == 4
    ew, ns = search.great_circle(0, 0, 0.002, 0), search.great_circle(0, 0, 0, 0.002)
    assert abs(best[b][0] - ew - ns) < 1
    assert network.undirected(net.edges).count() == 12
    near = __import__("geoloom.operators.joins", fromlist=["x"]).nearby_segments(spark.createDataFrame([(1, 0.0005, 0.00002)], "qid long, lon double, lat double"), net.segments(), 50.0, 3).orderBy("rank").first()
    assert near["dist_m"] <= 5 and 0 < near["fraction"] < 1


def test_oneway(spark):
    one = frame(spark, collection((None, {"oneway": "yes"}, line((0, 0), (0.001, 0))))).selectExpr("idx as feature", "props", "geom.coords[0] as parts")
    net = networks.Network("n", one, network.NetworkOptions(speed_kmh=50, oneway_field="oneway"))
    assert net.edges.count() == 1
    own = net.local()
    a, b = own.snap((0, 0), 0, 1)[0], own.snap((0.001, 0), 0, 1)[0]
    assert b in own.graph.search([(a, 0.0)]) and a not in own.graph.search([(b, 0.0)])


def test_levels(spark):
    rows = [(None, {"level": 1}, line((0, 0), (0.001, 0))), (None, {"level": 2}, line((0, 0), (0.001, 0))), (None, {"level_from": 1, "level_to": 2, "duration_s": 30}, line((0, 0), (0, 0)))]
    net = networks.Network("n", frame(spark, collection(*rows)).selectExpr("idx as feature", "props", "geom.coords[0] as parts"))
    net = net.local()
    a, b = net.snap((0.001, 0), 1, 1)[0], net.snap((0.001, 0), 2, 1)[0]
    walk = search.great_circle(0, 0, 0.001, 0) / (5 / 3.6)
    assert a != b and abs(net.graph.search([(a, 0.0)], weight=net.weights["time"])[b][0] - 2 * walk - 30) < 1


def test_shortest_path(engine):
    out = engine.run("shortest_path", {"network": "walk", "from": [0, 0], "to": [0.002, 0.002], "cost": "distance"})["features"][0]
    assert 400 <= out["properties"]["length_m"] <= 480 and len(out["geometry"]["coordinates"]) == 5
    out = engine.run("shortest_path", {"network": "walk", "from": [0, 0], "to": [0.003, 0.001], "to_level": 2})["features"][0]["properties"]
    assert out["levels_visited"] == [0, 1, 2] and out["duration_s"] >= 45
    same = engine.run("shortest_path", {"network": "walk", "from": [0, 0], "to": [0, 0]})["features"][0]
    assert same["properties"]["length_m"] == 0 and len(same["geometry"]["coordinates"]) == 1
    for bad in ({"network": "nope", "from": [0, 0], "to": [0, 0]}, {"network": "walk", "from": [10, 10], "to": [0, 0]}, {"network": "walk", "from": [0, 0], "to": [0, 0], "cost": "beauty"}, {"network": "walk", "from": [0, 0]}, {"network": "none", "from": [0, 0], "to": [0, 0]}, {"network": "walk", "from": [0, 200], "to": [0, 0]}):
        with pytest.raises(UserError):
            engine.run("shortest_path", bad)


def inside(shape, p):
    return any(raster.contains(poly[0], p) and not any(raster.contains(h, p) for h in poly[1:]) for poly in shape)


def test_isochrone(engine):
    out = engine.run("isochrone", {"network": "walk", "origin": [0.001, 0.001], "cutoffs": [60]})["features"]
    assert len(out) == 1
    shape = out[0]["geometry"]["coordinates"]
    assert inside(shape, (0.001, 0.001)) and not inside(shape, (0.002, 0.002))
    assert all(ring[0] == ring[-1] for poly in shape for ring in poly)
    out = engine.run("isochrone", {"network": "walk", "origin": [0.001, 0.001], "cutoffs": [60, 300]})["features"]
    assert [f["properties"]["cutoff"] for f in out] == [300, 60]
    for bad in ([], [1] * 9, [-1]):
        with pytest.raises(UserError):
            engine.run("isochrone", {"network": "walk", "origin": [0.001, 0.001], "cutoffs": bad})
    with pytest.raises(UserError):
        engine.run("isochrone", {"network": "walk", "origin": [0.001, 0.001], "cutoffs": [300], "cell_size_m": 0.001})


TRACE = [(0.00005, 0.00006), (0.0005, -0.00005), (0.001, 0.00007), (0.0015, -0.00006), (0.002, 0.00005), (0.00206, 0.0005), (0.00195, 0.001), (0.00205, 0.0015), (0.002, 0.00195)]


def test_map_match(engine):
    out = engine.run("map_match", {"network": "walk", "trace": [list(p) for p in TRACE], "search_radius_m": 40})
    route = out["features"][0]["properties"]
    assert route["role"] == "matched_route"
    with pytest.raises(UserError):  # no way on that level
        engine.run("map_match", {"network": "walk", "trace": [list(p) for p in TRACE], "level": 7})
    close = engine.run("map_match", {"network": "walk", "trace": [list(p) for p in TRACE], "search_radius_m": 0.001})
    assert close["features"][0]["properties"]["points_matched"] == 4  # those that lie on a street
    assert route["points_matched"] == 9 and 380 <= route["length_m"] <= 500
    assert all(p["distance_m"] <= 10 for p in out["points"])
    for bad in ([[10, 10], [10.001, 10]], [[0, 0]]):
        with pytest.raises(UserError):
            engine.run("map_match", {"network": "walk", "trace": bad})


CLUSTER = [(0, 0), (0.0001, 0), (0, 0.0001), (0.0001, 0.0001), (0.01, 0.01), (0.0101, 0.01), (0.01, 0.0101), (0.005, -0.005)]


def test_dbscan(spark, engine):
    if "spots" not in engine.layers:
        engine.add(Layer("spots", frame(spark, collection(*[(None, {"name": f"p{i}"}, point(*p)) for i, p in enumerate(CLUSTER)]))))
    out = engine.run("dbscan", {"collection": "spots", "eps_m": 50, "min_points": 3})
    assert (out["cluster_count"], out["noise_count"], len(out["features"])) == (2, 1, 8)
    assert [c["count"] for c in out["clusters"]] == [4, 3]
    assert engine.run("dbscan", {"collection": "spots", "eps_m": 50, "min_points": 3, "include_points": False})["features"] == []
    for bad in ({"eps_m": 0, "min_points": 3}, {"eps_m": 50, "min_points": 0}):
        with pytest.raises(UserError):
            engine.run("dbscan", {"collection": "spots", **bad})


def test_dbscan_sequential_model(spark):
    rng = random.Random(3)
    points = [(i, rng.random() * 0.004, rng.random() * 0.004) for i in range(120)]
    got = {r["id"]: (r["x"], r["y"], r["cluster"]) for r in dbscan.labels(spark.createDataFrame(points, "id long, lon double, lat double"), 40.0, 4).collect()}
    near = {i: [j for j in got if (got[i][0] - got[j][0]) ** 2 + (got[i][1] - got[j][1]) ** 2 <= 1600.0] for i in got}
    want, clusters = {}, 0
    for i in sorted(got):
        if i in want and want[i] >= 0 or len(near[i]) < 4:
            continue
        want[i] = clusters
        todo = list(near[i])
        while todo:
            j = todo.pop()
            if want.get(j, -1) >= 0:
                continue
            want[j] = clusters
            if len(near[j]) >= 4:
                todo += near[j]
        clusters += 1
    assert {i: v[2] for i, v in got.items()} == {i: want.get(i, -1) for i in got}


def test_search_against_relaxation(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30), rng.randrange(1, 50)) for _ in range(90)], "src long, dst long, w long").cache()
    graph = search.Graph.collect(edges, "w", 30)
    a = {(r["req"], r["node"], r["cost"]) for r in search.reach(spark.createDataFrame([(0, [(3, 0), (5, 7)]), (1, [(9, 2)])], "req long, seeds array<struct<node:long,cost:long>>"), graph).collect()}
    seeds = spark.createDataFrame([(0, 3, 0), (0, 5, 7), (1, 9, 2), (1, 9, 5)], "req long, node long, cost long")
    for sizes in ({}, {"block_nodes": 4}, {"block_nodes": 11, "block_requests": 1}):
        assert {(r["req"], r["node"], r["cost"]) for r in search.relax(seeds, edges, **sizes).collect()} == a


def test_viterbi_exhaustive(spark):
    rng = random.Random(9)
    e, t = [], []
    for trace in range(6):
        for step in range(4):
            e += [(trace, step, s, -rng.randrange(30)) for s in range(3)]
            t += [(trace, step, a, b, -rng.randrange(30)) for a in range(3) for b in range(3) if step and rng.random() < 0.9]
    got = {r["trace"]: r["score"] for r in mapmatch.viterbi(spark.createDataFrame(e, "trace long, step int, state long, e long"), spark.createDataFrame(t, "trace long, step int, state_from long, state_to long, t long")).collect()}
    em, tr = {x[:3]: x[3] for x in e}, {x[:4]: x[4] for x in t}
    for trace in range(6):
        totals = [em[trace, 0, p[0]] + sum(tr[trace, i, p[i - 1], p[i]] + em[trace, i, p[i]] for i in range(1, 4)) for p in __import__("itertools").product(range(3), repeat=4) if all((trace, i, p[i - 1], p[i]) in tr for i in range(1, 4))]
        assert got.get(trace) == max(totals, default=None)


def gpb(x, y, srs=4326):
    return b"GP\0\x01" + struct.pack("<i", srs) + geometry.write_wkb("Point", [[[(x, y)]]])


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_contents(table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        db.execute("CREATE TABLE cities(fid INTEGER PRIMARY KEY, name TEXT, pop INTEGER, geom BLOB)")
        db.execute("INSERT INTO gpkg_contents(table_name, data_type, srs_id) VALUES ('cities', 'features', 4326)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('cities', 'geom', 'POINT', 4326, 0, 0)")
        db.executemany("INSERT INTO cities VALUES (?, ?, ?, ?)", [(1, "beijing", 21893095, gpb(116.39, 39.91)), (2, "shanghai", 24870895, gpb(121.47, 31.23)), (3, "none", None, None)])
    rows = {r["fid"]: r for r in sqlite_sources.read_gpkg(spark, path).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["props"]["name"] == '"beijing"' and rows["1"]["xmin"] == 116.39
    with pytest.raises(UserError):
        sqlite_sources.read_gpkg(spark, path, "nope")
    for bad in (b"XX\0\x01aaaaaaa", b"GP", b"GP\0\x21" + b"0" * 30):
        with pytest.raises(ValueError):
            geometry.parse_gpb(bad)


def test_wkb_round_trip():
    for kind, coords in [("Point", [[[(1.0, 2.0)]]]), ("LineString", [[[(1.0, 2.0), (3.0, 4.0)]]]), ("Polygon", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]), ("MultiPoint", [[[(1.0, 2.0), (3.0, 4.0)]]]), ("MultiLineString", [[[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0), (7.0, 8.0)]]]), ("MultiPolygon", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]])]:
        assert geometry.read_wkb(geometry.write_wkb(kind, coords)) == (kind, coords)


def test_mbtiles(spark, tmp_path):
    path = str(tmp_path / "a.mbtiles")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata(name TEXT, value TEXT)")
        db.execute("CREATE TABLE tiles(zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [("name", "t"), ("format", "png"), ("minzoom", "0"), ("maxzoom", "2"), ("bounds", "-10,-10,10,10")])
        db.execute("INSERT INTO tiles VALUES (1, 0, 0, ?)", (b"PNGDATA",))
    e = Engine(spark, config.Config(sources=[config.SourceConfig("t", "mbtiles", path)]))
    assert e.tile("t", 1, 0, 1) == b"PNGDATA" and e.tile("t", 1, 1, 1) is None
    assert e.layers["t"].info().first()["west"] == -10.0
    with sqlite3.connect(path) as db:
        db.execute("UPDATE metadata SET value = 'tiff' WHERE name = 'format'")
    with pytest.raises(UserError):
        sqlite_sources.mbtiles_metadata(path)


def test_geojson_forms(spark):
    assert frame(spark, json.dumps(point(1, 2))).first()["fid"] == "0"
    assert frame(spark, json.dumps({"type": "Feature", "id": "a b", "properties": None, "geometry": point(1, 2)})).first()["fid"] == "a b"
    poly = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 3], [0, 0]]]]}
    r = frame(spark, json.dumps(poly)).first()
    assert (r["xmax"], r["ymax"], r["geom"]["type"]) == (2.0, 3.0, "MultiPolygon")


def test_jdbc_statement():
    sql = jdbc.statement("places", "geom", 3857, "gid", ["name", "gid"], bbox=(1, 2, 3, 4), fid="o'k")
    assert '"public"."places"' in sql and "o''k" in sql and sql.count('"gid"') == 2 and "ST_MakeEnvelope(1.0, 2.0, 3.0, 4.0, 4326)" in sql
    with pytest.raises(UserError):
        jdbc.statement("places", "geom", 3857, None, [], fid="1")


def test_jdbc_pages_and_tiles():
    page = jdbc.statement("s.places", "geom", 4326, "gid", ["name"], limit=20, offset=40)
    assert page.endswith('FROM "s"."places" WHERE "geom" IS NOT NULL ORDER BY "gid" LIMIT 20 OFFSET 40')
    assert jdbc.statement("places", "geom", 4326, None, [], limit=0).endswith("LIMIT 10 OFFSET 0") and "ORDER BY" not in jdbc.statement("places", "geom", 4326, None, [], limit=5)
    assert jdbc.count_statement("places", "geom", 3857, (1, 2, 3, 4)).count("ST_Transform") == 1
    tile = jdbc.tile_statement("o'k", "places", "geom", 4326, "gid", ["name"], 6, 52, 24)
    assert "'o''k', 4096, 'geom', 'gid'" in tile and "ST_TileEnvelope(6, 52, 24, margin => 0.03125)" in tile and 't."gid", t."name"' in tile
    assert "ST_Transform(t." not in jdbc.tile_statement("a", "places", "geom", 3857, None, [], 0, 0, 0)


def test_jdbc_introspection():
    asked = []

    def rows(sql):
        asked.append(sql)
        if "geometry_columns" in sql:
            return [{"srid": 3857}]
        if "information_schema" in sql:
            return [{"column_name": "gid", "udt_name": "int4"}, {"column_name": "name", "udt_name": "text"}]
        if "indisprimary" in sql:
            return [{"name": "gid"}]
        if "ST_EstimatedExtent" in sql:
            return [{"west": 1.0, "south": 2.0, "east": 3.0, "north": 4.0}]
        return [{"n": 7, "tile": b"x"}]

    t = jdbc.Table(None, "", "s.places", rows=rows)
    assert (t.srid, t.fields, t.id_column, t.bounds) == (3857, ["gid", "name"], "gid", (1.0, 2.0, 3.0, 4.0))
    assert t.count() == 7 and t.tile("places", 0, 0, 0) == b"x" and any("3857" in q for q in asked if "Estimated" in q)

    def fails(sql):
        if "information_schema" in sql:
            return []
        raise RuntimeError("no such relation")

    t = jdbc.Table(None, "", "places", rows=fails)
    assert (t.srid, t.fields, t.id_column, t.bounds) == (4326, [], None, jdbc.WORLD)


def test_tile_delivery(engine):
    status, headers, body = engine.tile_response("three", 6, 52, 24, "pbf", "gzip, br")
    assert status == 200 and headers["Content-Encoding"] == "gzip" and headers["Content-Type"].endswith("vector-tile") and body[:2] == b"\x1f\x8b"
    assert engine.tile_response("three", 6, 52, 24, "mvt", "gzip", headers["ETag"]) == (304, {}, b"")
    plain = engine.tile_response("three", 6, 52, 24, "PBF")
    assert plain[0] == 200 and "Content-Encoding" not in plain[1] and tiles.decode(plain[2]) == tiles.decode(body) and plain[1]["Content-Length"] == str(len(plain[2]))
    assert engine.tile_response("three", 6, 52, 24, "png")[0] == 400 and engine.tile_response("three", 2, 9, 1, "pbf")[0] == 400
    assert engine.tile_response("nope", 6, 52, 24, "pbf")[0] == 404 and engine.tile_response("cities", 6, 0, 0, "pbf")[0] == 204
    assert tiles.etag(b"") == '"cbf29ce484222325"' and tiles.etag(b"a") == '"af63dc4c8601ec8c"'
    assert tiles.delivered(b"\x1f\x8bxx", "image/png")[0] == 500
    w, s, e, n = tiles.margin_box(1, 0, 1)
    assert w == s == -tiles.BEYOND and 0 < e < 40 and 0 < n < 30


def test_tile_store(spark, engine, tmp_path):
    path = str(tmp_path / "store")
    engine.store_tiles("cities", 4, 6, path)
    engine.store_tiles("three", 5, 5, path)
    engine.store_tiles("cities", 6, 6, path)  # replaces one zoom
    got = {(r["z"], r["x"], r["y"]): bytes(r["tile"]) for r in tiles.read_store(spark, path, "cities").collect()}
    want = {(r["z"], r["x"], r["y"]): bytes(r["tile"]) for r in engine.pyramid("cities", 4, 6).collect()}
    assert got == want and {z for z, _, _ in got} == {4, 5, 6} and tiles.read_store(spark, path, "three").count() > 0
    assert tiles.decode(engine.tile("cities", 6, 52, 24)) == tiles.decode(want[6, 52, 24])


def test_disk_cache(tmp_path):
    import os

    now = [1000.0]
    disk = cache.Disk(str(tmp_path / "c"), ttl=60, max_bytes=100, clock=lambda: now[0])
    for n in range(6):
        disk.set(f"layer/6/{n}/2", b"x" * 30)
        os.utime(disk._path(f"layer/6/{n}/2"), (900 + n, 990 + n))
    assert disk.get("layer/6/3/2") == b"x" * 30 and disk.get("layer/6/9/9") is None
    disk.set("../evil", b"1")
    disk.set("a/../b", b"1")
    disk.set("a b", b"1")
    assert disk.get("../evil") is None and len(disk.entries()) == 6
    assert disk.sweep() == 3 and [n for n in range(6) if disk.get(f"layer/6/{n}/2")] == [3, 4, 5]  # 90 bytes stay
    left = tmp_path / "c" / ".tmp-dead"
    left.write_bytes(b"half")
    os.utime(left, (0, 0))
    now[0] = 1054.5
    assert disk.get("layer/6/3/2") is None and not os.path.exists(disk._path("layer/6/3/2"))  # 61.5 seconds old
    now[0] = 1e6
    assert disk.sweep() == 3 and disk.entries() == []
    both = cache.Tiered(cache.Lru(10), disk)
    disk.ttl = 0
    disk.set("k", b"v")
    assert both.get("k") == b"v" and both.upper.get("k") == b"v"


def test_documents(engine):
    import xml.etree.ElementTree as tree

    assert len(documents.CONFORMANCE["conformsTo"]) == 3
    status, health = engine.health()
    assert status == 200 and health["status"] == "ok" and set(health["sources"]) == set(engine.layers)
    own = {x["name"]: x for x in engine.catalog_document()["layers"]}
    assert own["cities"]["title"] == "Cities" and own["cities"]["tiles"].endswith("/tiles/cities/{z}/{x}/{y}.pbf") and own["cities"]["items"].endswith("/collections/cities/items")
    doc = tree.fromstring(engine.wmts())
    space = {"w": "http://www.opengis.net/wmts/1.0", "o": "http://www.opengis.net/ows/1.1"}
    assert doc.find("o:ServiceIdentification/o:ServiceType", space).text == "OGC WMTS" and doc.find(".//w:WellKnownScaleSet", space).text.endswith("GoogleMapsCompatible")
    assert len(doc.findall(".//w:TileMatrix", space)) == 23
    address = {x.find("o:Identifier", space).text: x.find("w:ResourceURL", space).get("template") for x in doc.findall(".//w:Layer", space)}
    assert address["cities"] == "/wmts/1.0.0/cities/default/GoogleMapsCompatible/{TileMatrix}/{TileRow}/{TileCol}.pbf"
    assert engine.describe("map_match")["parameters"]["required"] == ["network", "trace"]
    with pytest.raises(UserError):
        engine.describe("nope")


def test_keys():
    may = lambda headers={}, query={}, path="/tiles": documents.allowed(["k1", "k2"], path, headers, query)
    assert may({"Authorization": "Bearer k2"}) and may({"x-api-key": "k1"}) and may({}, {"api_key": "k1"}) and may(path="/health")
    assert not may() and not may({"Authorization": "Bearer k3"}) and not may({"Authorization": "Bearer k3"}, {"api_key": "k1"}) and not may({}, {"api_key": ""})
    assert documents.allowed([], "/tiles", {}, {})


def test_rpc_text(engine):
    assert engine.rpc_text("{", "POST")[1]["error"]["code"] == -32700 and engine.rpc_text("[]")[1]["error"]["code"] == -32700
    assert engine.rpc_text("{}", "GET") == (405, None) and engine.rpc_text('{"jsonrpc": "2.0", "method": "x"}') == (202, None)
    asks = lambda v: engine.rpc({"id": 1, "method": "initialize", "params": {"protocolVersion": v}})["result"]["protocolVersion"]
    assert asks("2024-11-05") == "2024-11-05" and asks("1999-01-01") == "2025-06-18"


def test_frames_of_paths(spark, engine):
    asks = [{"from": [0, 0], "to": [0.002, 0.002], "cost": "distance"}, {"from": [10, 10], "to": [0, 0]}, {"from": [0, 0], "to": [0.003, 0.001], "to_level": 2}, {"from": [0, 0], "to": [0, 0]}, {"from": [0, 0], "to": [0, 0], "cost": "beauty"}, {"from": [0, 0]}]
    rows = spark.createDataFrame([(n, json.dumps(a)) for n, a in enumerate(asks)] + [(6, "nonsense"), (7, None)], "req long, params string")
    got = {r["req"]: json.loads(r["result"]) for r in engine.run_frame("shortest_path", "walk", rows).collect()}
    for n in (0, 2, 3):
        a, b = got[n]["features"][0], engine.run("shortest_path", {"network": "walk", **asks[n]})["features"][0]
        assert a["properties"]["levels_visited"] == b["properties"]["levels_visited"] and a["properties"]["cost"] == b["properties"]["cost"]
        for c in ("length_m", "duration_s"):
            assert a["properties"][c] == pytest.approx(b["properties"][c], abs=0.2)
        line, other = a["geometry"]["coordinates"], b["geometry"]["coordinates"]
        assert len(line) == len(other) and line[0] == other[0] and line[-1] == other[-1]
    assert all("error" in got[n] for n in (1, 4, 5, 6, 7)) and len(got) == 8
    with pytest.raises(UserError):
        engine.run_frame("dbscan", "walk", rows)


def test_frames_of_areas(spark, engine, monkeypatch):
    asks = [{"origin": [0.001, 0.001], "cutoffs": [60, 300]}, {"origin": [0.001, 0.001], "cutoffs": [150], "cost": "distance"}, {"origin": [0.001, 0.001], "cutoffs": []}, {"origin": [9, 9], "cutoffs": [60]}]
    rows = spark.createDataFrame([(n, json.dumps(a)) for n, a in enumerate(asks)], "req long, params string")
    got = {r["req"]: json.loads(r["result"]) for r in engine.run_frame("isochrone", "walk", rows).collect()}
    area = lambda f: sum(abs(raster.ring_area(p[0])) - sum(abs(raster.ring_area(h)) for h in p[1:]) for p in f["geometry"]["coordinates"])
    for n in (0, 1):
        want = engine.run("isochrone", {"network": "walk", **asks[n]})["features"]
        assert [f["properties"] for f in got[n]["features"]] == [f["properties"] for f in want]
        for a, b in zip(got[n]["features"], want):
            assert area(a) == pytest.approx(area(b), rel=0.03)
            assert inside(a["geometry"]["coordinates"], (0.001, 0.001))
    assert "error" in got[2] and "error" in got[3]
    # a network that is too large to be gathered is asked in the same way
    net = engine.network("walk")
    monkeypatch.setattr(search, "MAX_EDGES", 1)
    net.__dict__.pop("small", None)
    assert engine.run("isochrone", {"network": "walk", **asks[1]})["features"][0]["properties"] == got[1]["features"][0]["properties"]
    with pytest.raises(UserError):
        engine.run("isochrone", {"network": "walk", **asks[3]})
    net.__dict__.pop("small", None)


def test_close_and_empty_sources(spark, tmp_path):
    path = tmp_path / "none.geojson"
    path.write_text(collection((1, {}, None)))
    with pytest.raises(UserError):
        Engine(spark, config.Config(sources=[config.SourceConfig("none", "geojson", str(path))]))
    e = Engine(spark)
    e.add(Layer("two", frame(spark, TWO)))
    assert spark.sql("SELECT * FROM layer_two").count() == 2
    e.close()
    assert not e.layers and not spark.catalog.tableExists("layer_two")


def test_database_layers_page_in_the_database(spark):
    class Fake:
        def count(self, bbox):
            return 7

        def page(self, limit, offset, bbox):
            assert (limit, offset, bbox) == (2, 4, (0.0, 0.0, 180.0, 90.0))
            return frame(spark, TWO)

        def tile(self, name, z, x, y):
            return b"from the database"

    e = Engine(spark)
    e.add(Layer("pg", frame(spark, TWO), table=Fake()))
    got = e.items("pg", [0.0, 0.0, 180.0, 90.0], 2, 4)
    assert got["numberMatched"] == 7 and got["numberReturned"] == 2 and got["links"] and e.tile("pg", 0, 0, 0) == b"from the database"


def test_tilejson_of_stored_tiles(spark):
    row = [("photos", "", 0, 5, 0.0, 0.0, 1.0, 1.0, {}, "jpg"), ("shapes", "", 0, None, 0.0, 0.0, 1.0, 1.0, {}, "mvt")]
    layers = spark.createDataFrame(row, "name string, title string, minzoom int, maxzoom int, west double, south double, east double, north double, fields map<string,string>, format string")
    got = {r["name"]: json.loads(r["document"])["tiles"][0] for r in documents.tilejson(layers, "http://x").collect()}
    assert got == {"photos": "http://x/tiles/photos/{z}/{x}/{y}.jpg", "shapes": "http://x/tiles/shapes/{z}/{x}/{y}.pbf"}


def test_step_scores_by_hand(spark):
    """A trace along one street: emissions by squared distance, transitions by the detour, the best candidates win."""
    seg = spark.createDataFrame([(1, 0.0, 0.0, 0.01, 0.0, 0, 1, 1113.2), (2, 0.0, 0.0004, 0.01, 0.0004, 2, 3, 1113.2)], "sid long, ax double, ay double, bx double, by double, src long, dst long, length_m double")
    edges = spark.createDataFrame([(0, 1, 1113.2), (1, 0, 1113.2), (2, 3, 1113.2), (3, 2, 1113.2)], "src long, dst long, w double")
    # the middle point lies nearer to the other street, but a jump there and back costs more than its distance
    pts = spark.createDataFrame([(0, 0, 0.001, 0.00005), (0, 1, 0.002, 0.00022), (0, 2, 0.003, 0.00005)], "trace long, seq long, lon double, lat double")
    got = mapmatch.match(pts, seg, edges, 50.0, 15.0, 30.0).first()
    assert [s["sid"] for s in got["snapped"]] == [1, 1, 1] and got["points_matched"] == 3
    assert got["length_m"] == pytest.approx(222.4, abs=0.5)


def test_failed_network_stays_failed(engine):
    for _ in range(2):
        with pytest.raises(UserError):
            engine.network("none")
    assert isinstance(engine._networks["none"], UserError)


def test_dense_numbers(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = network.cc.dense(df, ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i) for i in range(1000)]
    assert network.cc.dense(df.where("false"), ["k"], "n").count() == 0


def test_many_parts_and_positions_have_own_segments(spark):
    parts = [[(k * 0.01, 0.0), (k * 0.01, 0.001)] for k in range(12)]
    rows = [(0, {}, [[{"x": x, "y": y} for x, y in p] for p in parts]), (1, {}, [[{"x": 1 + n * 0.0001, "y": 0.0} for n in range(300)]])]
    lines = spark.createDataFrame(rows, "feature long, props map<string,string>, parts array<array<struct<x:double,y:double>>>")
    got = networks.Network("n", lines).segments().collect()
    assert len(got) == 12 + 299 == len({r["sid"] for r in got}) and {r["feature"] for r in got} == {0, 1}


def test_levels_in_joins(spark):
    from geoloom.operators import joins

    q = spark.createDataFrame([(1, 0.0, 60.0, 0), (2, 0.0, 60.0, 2)], "qid long, lon double, lat double, level int")
    p = spark.createDataFrame([(10, 0.0, 60.0, 1), (11, 0.0002, 60.0, 0), (12, 0.0001, 60.0002, 2)], "pid long, lon double, lat double, level int")
    assert {(r["qid"], r["pid"]) for r in joins.nearest(q, p, 50.0).collect()} == {(1, 11), (2, 12)}
    s = spark.createDataFrame([(20, -0.001, 60.0, 0.001, 60.0, 1, 1), (21, -0.001, 60.0001, 0.001, 60.0001, 0, 0), (22, -0.001, 60.0, 0.001, 60.0, 0, 2)], "sid long, ax double, ay double, bx double, by double, alevel int, blevel int")
    assert {(r["qid"], r["sid"]) for r in joins.nearby_segments(q, s, 50.0).collect()} == {(1, 21)}
    # neighbours near the pole aren't lost
    q = spark.createDataFrame([(1, 10.0, 88.0)], "qid long, lon double, lat double")
    p = spark.createDataFrame([(10, 10.02, 88.0)], "pid long, lon double, lat double")
    assert joins.nearest(q, p, 100.0).count() == 1


@pytest.mark.parametrize("cost", ["time", "distance"])
def test_guided_search_matches_the_plain_one(engine, cost):
    net = engine.network("walk")
    rng = random.Random(4)
    net = net.local()
    for src in range(net.graph.n):
        plain = net.graph.search([(src, 0.0)], weight=net.weights[cost])
        for dst in range(net.graph.n):
            got = net.graph.astar(src, dst, net.lon, net.lat, net.rates[cost], net.weights[cost])
            assert (dst in plain) == (dst in got)
            if dst in plain:
                assert got[dst][0] == pytest.approx(plain[dst][0], abs=1e-9)
                assert sum(net.weights[cost][list(net.graph.edge).index(e)] for e in net.graph.path(got, dst)) == pytest.approx(plain[dst][0], abs=1e-9)
    n = 40
    place = lambda k: (k % n * 0.001, k // n * 0.001)
    pairs = [(k, j) for k in range(n * n) for j in ((k + 1) if k % n < n - 1 else -1, k + n) if 0 <= j < n * n]
    pairs += [(j, k) for k, j in pairs]
    import numpy as np

    lon, lat = np.array([place(k) for k in range(n * n)]).T
    src, dst = np.array(pairs).T
    w = search.great_circle(lon[src], lat[src], lon[dst], lat[dst]) * np.array([1 + rng.random() * 0.2 for _ in pairs])
    graph = search.Graph(src, dst, w)
    a, b = 20 * n + 20, 22 * n + 25
    plain, guided = graph.search([(a, 0.0)], target=b), graph.astar(a, b, lon, lat, graph.rate(lon, lat))
    assert guided[b][0] == pytest.approx(plain[b][0]) and len(guided) < len(plain) / 2


def test_config():
    good = config.load("server: {port: 9090}\ncache: {ttl: 2m}\nsources:\n- {name: a, type: geojson, path: x}\n- {name: b, type: postgis, dsn: d, table: t}\n")
    assert good.port == 9090 and good.cache_ttl_s == 120 and good.host == "0.0.0.0"
    one = "sources: [{name: a, type: geojson, path: x}"
    for bad in ("{}", f"{one}, {{name: a, type: geojson, path: y}}]", "sources: [{name: a, type: shapefile, path: x}]", "sources: [{name: a, type: postgis, dsn: d}]", "sources: [{name: a/b, type: geojson, path: x}]", "sources: [{name: a, type: geojson, path: x, min_zoom: 10, max_zoom: 2}]"):
        with pytest.raises(UserError):
            config.load(bad)


def test_caches():
    now = [0.0]
    lru = cache.Lru(2, 10, lambda: now[0])
    lru.set("a", 1), lru.set("b", 2), lru.get("a"), lru.set("c", 3)
    assert lru.get("b") is None and lru.get("a") == 1 and len(lru) == 2
    now[0] = 11
    assert lru.get("a") is None and cache.Lru(0).get("a") is None
    low, high = cache.Lru(9), cache.Lru(9)
    low.set("k", 5)
    tiered = cache.Tiered(high, low)
    assert tiered.get("k") == 5 and high.get("k") == 5


def test_sweep(spark):
    rows = spark.createDataFrame([(f"k{i}", 524288, i) for i in range(3)], "key string, size long, mtime long")
    assert [r["key"] for r in cache.sweep(rows, 10, 0, 1 << 20).collect()] == ["k2"]
    assert cache.sweep(rows, 10, 9, 0).count() == 2


def test_tools(engine):
    names = {t["name"] for t in engine.rpc({"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert {"list_layers", "query_features", "algo_dbscan"} <= names
    call = lambda name, **a: engine.rpc({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert call("query_features", layer="cities", limit=1)["structuredContent"]["numberMatched"] == 2
    assert call("get_feature", layer="cities", id="9")["isError"] and call("nope")["isError"]
    assert call("server_status")["structuredContent"]["ok"]
    assert engine.rpc({"method": "ping"}) is None
    assert engine.rpc({"id": 1, "method": "x"})["error"]["code"] == -32601
    assert engine.rpc({"id": 1, "method": "tools/call"})["error"]["code"] == -32602


def test_limits_and_empty(spark):
    rows = frame(spark, TWO)
    assert features.page(rows.where("false")).count() == 0
    assert features.extent(rows.where("false")).first()["n"] == 0


def test_rings():
    ring = raster.chain([(0, 0, 2, 0), (2, 2, 0, 2), (2, 0, 2, 2), (0, 2, 0, 0)])
    assert len(ring) == 1 and ring[0][0] == ring[0][-1] and abs(raster.ring_area(ring[0])) == 4
    outer = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]
    hole = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    assert raster.polygons([hole, outer]) == [[outer, hole]]


def test_streams(spark, tmp_path):
    from geoloom.streaming import tracks

    path = str(tmp_path / "in")
    spark.sql("SELECT 1L AS trace, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int),0) AS ts, 116.4D AS lon, 39.9D AS lat FROM range(12)").write.parquet(path)
    stream = spark.readStream.schema("trace long, ts timestamp, lon double, lat double").parquet(path)
    q = tracks.tile_activity(stream, 8).writeStream.format("memory").queryName("tiles").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("tiles").collect()) == [2, 5, 5]
