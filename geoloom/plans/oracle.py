"""SQL of the queries for DuckDB."""

from __future__ import annotations

import math

from geoloom.functions import measure, mercator

from .documents import SCALE_0
from .queries import BOX, CUTOFFS, EPS_M, MIN_POINTS

E, R, LAT = mercator.EDGE, mercator.R, mercator.MAX_LAT
D = f"{2 * measure.EARTH_M!r}::DOUBLE"
RAD = math.pi / 180.0


def _points(key: str, name: str, kind: str, table: str) -> str:
    far_x, far_y = "116000000 + (k*k*7919 + k*104729) % 1000003", "39500000 + (k*k*6007 + k*15485) % 1000033"
    h = "(k % 40)"
    hub_x = f"116000000 + ({h}*{h}*7919 + {h}*104729) % 1000003 + (k*k*31 + k*17) % 2003 * 4 - 4004"
    hub_y = f"39500000 + ({h}*{h}*6007 + {h}*15485) % 1000033 + (k*k*13 + k*29) % 1999 * 4 - 3996"
    inner = f"SELECT k, name, kind, CASE WHEN k % 10 = 0 THEN {far_x} ELSE {hub_x} END AS mx, CASE WHEN k % 10 = 0 THEN {far_y} ELSE {hub_y} END AS my FROM (SELECT CAST({key} AS BIGINT) AS k, {name} AS name, {kind} AS kind FROM {table})"
    return f"SELECT k AS fid, name, kind, mx, my, mx / 1e6::DOUBLE AS lon, my / 1e6::DOUBLE AS lat FROM ({inner})"


VIEWS = {
    "p": _points("c_custkey", "c_name", "c_mktsegment", "customer"),
    "qp": _points("s_suppkey", "s_name", "CAST(s_nationkey AS VARCHAR)", "supplier"),
    "n": "SELECT CAST(p_partkey AS BIGINT) AS node, 116000000 + p_partkey % 50 * 1000 AS mx, 39900000 + p_partkey // 50 * 1000 AS my FROM part",
    "one_way": "SELECT k AS src, k + 1 AS dst, w FROM (SELECT p_partkey AS k, CAST(100 + p_size * 10 AS BIGINT) AS w FROM part) WHERE k % 50 < 49 AND k + 1 IN (SELECT p_partkey FROM part) UNION ALL SELECT p_partkey, p_partkey + 50, CAST(100 + p_size * 10 AS BIGINT) FROM part WHERE p_partkey + 50 IN (SELECT p_partkey FROM part)",
    "e": "SELECT src, dst, w FROM one_way UNION ALL SELECT dst, src, w FROM one_way",
    "t": "SELECT *, mx / 1e6::DOUBLE AS lon, my / 1e6::DOUBLE AS lat FROM (SELECT user_id, row_number() OVER w - 1 AS seq, CAST(116010000 + sum((event_id * 31 % 7 - 3) * 100) OVER w AS BIGINT) AS mx, CAST(39903000 + sum((event_id * 17 % 5 - 2) * 100) OVER w AS BIGINT) AS my FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
    "l": "SELECT user_id AS feature, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM t GROUP BY user_id HAVING count(*) > 1",
    "s": "SELECT src * 2 + CASE WHEN dst - src > 1 THEN 1 ELSE 0 END AS sid, src, dst, a.mx AS mx1, a.my AS my1, b.mx AS mx2, b.my AS my2, a.mx / 1e6::DOUBLE AS ax, a.my / 1e6::DOUBLE AS ay, b.mx / 1e6::DOUBLE AS bx, b.my / 1e6::DOUBLE AS by_ FROM one_way JOIN n a ON a.node = src JOIN n b ON b.node = dst",
}
_NEEDS = {"e": ["one_way"], "l": ["t"], "s": ["one_way", "n"]}


def _with(names: str, extra: str = "", recursive: bool = False) -> str:
    order: list[str] = []

    def add(v):
        for x in _NEEDS.get(v, []):
            add(x)
        if v not in order:
            order.append(v)

    for v in names.split():
        add(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} "


def hav(x1: str, y1: str, x2: str, y2: str) -> str:
    a = f"pow(sin(({y2} - {y1}) * {RAD!r}::DOUBLE / 2), 2) + cos({y1} * {RAD!r}::DOUBLE) * cos({y2} * {RAD!r}::DOUBLE) * pow(sin(({x2} - {x1}) * {RAD!r}::DOUBLE / 2), 2)"
    return f"({D} * asin(least(1.0::DOUBLE, sqrt({a}))))"


def _inverse(x: str, y: str) -> tuple[str, str]:
    return f"({x}) / {E!r}::DOUBLE * 180", f"atan(sinh(({y}) / {R!r}::DOUBLE)) * 180 / pi()"


def _tile(lon: str, lat: str, z: str) -> tuple[str, str]:
    n = f"CAST(1::BIGINT << {z} AS DOUBLE)"
    return f"({lon} + 180) / 360 * {n}", f"(1 - asinh(tan({lat} * {RAD!r}::DOUBLE)) / pi()) / 2 * {n}"


def _clamp(v: str, z: str) -> str:
    return f"least(greatest(CAST(floor({v}) AS BIGINT), 0), (1::BIGINT << {z}) - 1)"


_tx, _ty = _tile("lon", "lat", "z")
_ASSIGN = f"SELECT fid, z, {_clamp(_tx, 'z')} AS x, {_clamp(_ty, 'z')} AS y FROM p, (VALUES (4), (8), (12)) AS zs(z)"
_fx0, _fy1 = _tile("xmin", "ymin", "z")
_fx1, _fy0 = _tile("xmax", "ymax", "z")
_KEYED = f"""keyed AS (SELECT z, x, unnest(generate_series(y0, y1)) AS y, feature FROM (SELECT z, unnest(generate_series(x0, x1)) AS x, y0, y1, feature FROM (
    SELECT z, feature, {_clamp(f'ceil({_fx0} - 1.1::DOUBLE)', 'z')} AS x0, {_clamp(f'{_fx1} + 0.1::DOUBLE', 'z')} AS x1, {_clamp(f'ceil({_fy0} - 1.1::DOUBLE)', 'z')} AS y0, {_clamp(f'{_fy1} + 0.1::DOUBLE', 'z')} AS y1
    FROM l, (SELECT CAST(unnest(generate_series(8, 15)) AS INTEGER) AS z))))"""

_PLANAR = f"""placed AS (SELECT fid, lon, lat, (lon - cx) * greatest(1, 111320::DOUBLE * cos(cy * {RAD!r}::DOUBLE)) AS x, (lat - cy) * 111132::DOUBLE AS y FROM p, (SELECT avg(lon) AS cx, avg(lat) AS cy FROM p)),
    pairs AS (SELECT a.fid AS a, b.fid AS b FROM (SELECT *, floor(x / {EPS_M}) AS gx FROM placed) a JOIN (SELECT *, floor(x / {EPS_M}) + unnest([-1, 0, 1]) AS gx FROM placed) b USING (gx) WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS_M * EPS_M}::DOUBLE)"""
_DBSCAN = f"""{_PLANAR},
    core AS (SELECT a AS fid FROM pairs GROUP BY a HAVING count(*) >= {MIN_POINTS}),
    cc AS (SELECT a, b FROM pairs WHERE a IN (SELECT fid FROM core) AND b IN (SELECT fid FROM core)),
    lab(node, label) USING KEY (node) AS (
        SELECT fid AS node, fid AS label FROM core
        UNION SELECT cc.b AS node, min(lab.label) AS label FROM lab JOIN cc ON cc.a = lab.node JOIN recurring.lab AS old ON old.node = cc.b WHERE lab.label < old.label GROUP BY cc.b),
    num AS (SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab),
    labelled AS (SELECT placed.fid, lon, lat, CAST(coalesce(own.cluster, near.cluster, -1) AS INTEGER) AS cluster FROM placed LEFT JOIN num own ON own.node = placed.fid
        LEFT JOIN (SELECT a, min(cluster) AS cluster FROM pairs JOIN num ON node = b GROUP BY a) near ON near.a = placed.fid)"""

_EDGES = f"""raw AS (SELECT user_id AS feature, seq AS pos, CAST(user_id % 3 AS INTEGER) AS level, CASE WHEN user_id % 2 = 0 THEN 50::DOUBLE ELSE 5::DOUBLE END / 3.6::DOUBLE AS speed, user_id % 5 = 0 AS oneway,
        mx AS fx, my AS fy, lon AS flon, lat AS flat, lead(mx) OVER w AS tx, lead(my) OVER w AS ty, lead(lon) OVER w AS tlon, lead(lat) OVER w AS tlat FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
    fwd AS (SELECT *, {hav('flon', 'flat', 'tlon', 'tlat')} AS length_m FROM raw WHERE tx IS NOT NULL AND (fx <> tx OR fy <> ty)),
    edges AS (SELECT feature, CAST(pos AS INTEGER) AS pos, false AS reverse, fx, fy, tx, ty, flon, flat, tlon, tlat, level, length_m, speed FROM fwd
        UNION ALL SELECT feature, CAST(pos AS INTEGER), true, tx, ty, fx, fy, tlon, tlat, flon, flat, level, length_m, speed FROM fwd WHERE NOT oneway)"""
_NODES = f"""{_EDGES}, ends AS (SELECT fx AS qx, fy AS qy, level, flon AS lon, flat AS lat FROM edges UNION ALL SELECT tx, ty, level, tlon, tlat FROM edges),
    nodes AS (SELECT qx, qy, level, any_value(lon) AS lon, any_value(lat) AS lat FROM ends GROUP BY qx, qy, level)"""


def _sssp(seeds: str, edges: str = "e", cutoff: str = "") -> str:
    """best(req, node, cost) by rounds, kept by key."""
    return f"""seeds AS ({seeds}), best(req, node, cost) USING KEY (req, node) AS (SELECT req, node, min(cost) AS cost FROM seeds GROUP BY req, node
        UNION SELECT s.req, s.node, s.cost FROM (SELECT best.req, {edges}.dst AS node, min(best.cost + {edges}.w) AS cost FROM best JOIN {edges} ON {edges}.src = best.node GROUP BY best.req, {edges}.dst) s
        LEFT JOIN recurring.best AS old ON old.req = s.req AND old.node = s.node WHERE (old.cost IS NULL OR s.cost < old.cost) {cutoff})"""


_NEAR = f"""near AS (SELECT t.user_id * 1000000 + t.seq AS qid, node, round({hav('t.lon', 't.lat', 'n.mx / 1e6::DOUBLE', 'n.my / 1e6::DOUBLE')}, 3) AS d FROM t JOIN n ON n.mx BETWEEN t.mx - 1000 AND t.mx + 1000 AND n.my BETWEEN t.my - 1000 AND t.my + 1000),
    nearest AS (SELECT * FROM near WHERE d <= 60 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, node) = 1)"""
_CONTOUR = """, blocks AS (SELECT req, cutoff, gx + i AS x, gy + j AS y, sum(b) AS code FROM wide, (VALUES (0, -1, 1), (-1, -1, 2), (-1, 0, 4), (0, 0, 8)) AS c(i, j, b) GROUP BY req, cutoff, gx + i, gy + j HAVING sum(b) < 15),
        cases(code, x1, y1, x2, y2) AS (VALUES (1, 0, 1, 1, 2), (14, 0, 1, 1, 2), (2, 1, 2, 2, 1), (13, 1, 2, 2, 1), (3, 0, 1, 2, 1), (12, 0, 1, 2, 1), (4, 2, 1, 1, 0), (11, 2, 1, 1, 0), (5, 0, 1, 1, 2), (5, 2, 1, 1, 0), (6, 1, 2, 1, 0), (9, 1, 2, 1, 0), (7, 1, 0, 0, 1), (8, 1, 0, 0, 1), (10, 1, 2, 2, 1), (10, 1, 0, 0, 1))"""
# segments with the marked cell to their left, points as one number, and each point's ring by its smallest point
_RINGS = """, seg AS (SELECT req, cutoff, x * 2 + x1 AS ax, y * 2 + y1 AS ay, x * 2 + x2 AS bx, y * 2 + y2 AS by_ FROM blocks JOIN cases USING (code)),
        sided AS (SELECT *, CASE WHEN ax <> bx AND ay <> by_ THEN (ax + bx - by_ + ay) // 2 ELSE ax - (by_ - ay) // 2 END AS cx, CASE WHEN ax <> bx AND ay <> by_ THEN (ay + by_ + bx - ax) // 2 ELSE ay + (bx - ax) // 2 END AS cy FROM seg),
        ends AS (SELECT s.req, s.cutoff, CASE WHEN w.gx IS NULL THEN bx ELSE ax END AS x1, CASE WHEN w.gx IS NULL THEN by_ ELSE ay END AS y1, CASE WHEN w.gx IS NULL THEN ax ELSE bx END AS x2, CASE WHEN w.gx IS NULL THEN ay ELSE by_ END AS y2
                 FROM sided s LEFT JOIN wide w ON w.req = s.req AND w.cutoff = s.cutoff AND w.gx * 2 = s.cx AND w.gy * 2 = s.cy),
        directed AS (SELECT *, CAST((x1 + 1000) * 1000000 + y1 + 1000 AS BIGINT) AS p1, CAST((x2 + 1000) * 1000000 + y2 + 1000 AS BIGINT) AS p2 FROM ends),
        lab(req, cutoff, p1, label) USING KEY (req, cutoff, p1) AS (SELECT req, cutoff, p1, p1 AS label FROM directed
            UNION SELECT d.req, d.cutoff, d.p2, min(l.label) FROM lab l JOIN directed d ON d.req = l.req AND d.cutoff = l.cutoff AND d.p1 = l.p1 JOIN recurring.lab AS old ON old.req = d.req AND old.cutoff = d.cutoff AND old.p1 = d.p2 WHERE l.label < old.label GROUP BY d.req, d.cutoff, d.p2)"""
_LATTICE = """em AS (SELECT user_id AS trace, t.seq AS step, node AS state, -(abs(t.mx - n.mx) + abs(t.my - n.my)) AS e, n.mx AS nx, n.my AS ny, t.mx, t.my FROM t JOIN n ON abs(t.mx - n.mx) <= 1500 AND abs(t.my - n.my) <= 1500),
        best(trace, step, state, score, nx, ny, mx, my) AS (SELECT trace, step, state, e, nx, ny, mx, my FROM em WHERE step = 0
            UNION ALL SELECT b.trace, b.step, b.state, max(a.score - abs(abs(b.nx - a.nx) + abs(b.ny - a.ny) - abs(b.mx - a.mx) - abs(b.my - a.my)) + b.e), any_value(b.nx), any_value(b.ny), any_value(b.mx), any_value(b.my) FROM best a JOIN em b ON b.trace = a.trace AND b.step = a.step + 1 GROUP BY b.trace, b.step, b.state),
        ends AS (SELECT trace, max(step) AS step FROM em GROUP BY trace)"""
_REACH = _sssp("SELECT CAST(s_suppkey AS BIGINT) AS req, CAST(s_suppkey * 7817 % (SELECT count(*) FROM part) AS BIGINT) AS node, 0::BIGINT AS cost FROM supplier", cutoff=f"AND s.cost <= {max(CUTOFFS)}")
_CUTS = f"(SELECT CAST(unnest([{', '.join(map(str, CUTOFFS))}]) AS INTEGER) AS cutoff)"
_FRONTIER = f"""{_REACH}, steps AS (SELECT a.req, cutoff, e.src, e.dst, a.cost + e.w <= cutoff AND coalesce(b.cost <= cutoff, false) AS "full", CAST(cutoff - a.cost AS DOUBLE) / e.w AS part
        FROM best a JOIN e ON e.src = a.node LEFT JOIN best b ON b.req = a.req AND b.node = e.dst CROSS JOIN {_CUTS} WHERE a.cost <= cutoff),
    frontier AS (SELECT req, cutoff, src, dst, "full", CASE WHEN "full" THEN 1::DOUBLE ELSE part END AS fraction FROM steps WHERE "full" OR part > 0)"""
_CELLS = f"""{_FRONTIER}, segs AS (SELECT req, cutoff, (a.mx - 116000000) / 100::DOUBLE AS ax, (a.my - 39900000) / 100::DOUBLE AS ay, (b.mx - 116000000) / 100::DOUBLE AS bx, (b.my - 39900000) / 100::DOUBLE AS by_
        FROM frontier JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE "full"),
    stepped AS (SELECT *, CAST(floor(greatest(abs(bx - ax), abs(by_ - ay)) / 4 * 2) AS INTEGER) + 1 AS k FROM segs),
    each AS (SELECT *, unnest(generate_series(0, k)) AS i FROM stepped),
    cells AS (SELECT DISTINCT req, cutoff, CAST(floor((ax + (bx - ax) * (i / k::DOUBLE)) / 4 + 0.5::DOUBLE) AS INTEGER) AS gx, CAST(floor((ay + (by_ - ay) * (i / k::DOUBLE)) / 4 + 0.5::DOUBLE) AS INTEGER) AS gy FROM each)"""
_DILATED = f"""{_CELLS}, wide AS (SELECT DISTINCT req, cutoff, gx + i AS gx, gy + j AS gy FROM cells, (VALUES (-1), (0), (1)) AS a(i), (VALUES (-1), (0), (1)) AS b(j))"""

_CATALOG = """layers AS (SELECT 'points' AS name, 'Points' AS title, 14 AS maxzoom, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS n FROM p
    UNION ALL SELECT 'queries', '', NULL, min(lon), min(lat), max(lon), max(lat), count(*) FROM qp UNION ALL SELECT 'tracks', 'Tracks', 16, min(xmin), min(ymin), max(xmax), max(ymax), count(*) FROM l)"""

_box = f"lon <= {BOX[2]}::DOUBLE AND lon >= {BOX[0]}::DOUBLE AND lat <= {BOX[3]}::DOUBLE AND lat >= {BOX[1]}::DOUBLE"
_mlon, _mlat = _inverse("mx / 10.0::DOUBLE", "(my - 39000000) * 5.0::DOUBLE")
_w, _s = _inverse("minx", "miny")
_e, _n = _inverse("maxx", "maxy")
_scale = "greatest(1, 111320::DOUBLE * cos(lat * pi() / 180))"


def _projected(lon: str, lat: str) -> str:
    mx = f"greatest(1, 111320::DOUBLE * cos({lat} * pi() / 180))"
    return f"CASE WHEN pow((bx - ax) * {mx}, 2) + pow((by_ - ay) * 111132, 2) > 0 THEN least(1, greatest(0, (({lon} - ax) * {mx} * (bx - ax) * {mx} + ({lat} - ay) * 111132 * (by_ - ay) * 111132) / (pow((bx - ax) * {mx}, 2) + pow((by_ - ay) * 111132, 2)))) ELSE 0 END"


SQL: dict[str, str] = {
    "bbox_filter": _with("p") + f"SELECT CAST(fid AS VARCHAR) AS fid, lon, lat FROM p WHERE {_box}",
    "curve_box": _with("p") + f"SELECT CAST(fid AS VARCHAR) AS fid, lon, lat FROM p WHERE {_box}",
    "items_page": _with("p", f"m AS (SELECT * FROM p WHERE {_box}), pg AS (SELECT * FROM m ORDER BY fid LIMIT 25 OFFSET 10)")
    + "SELECT fid AS idx, CAST(fid AS VARCHAR) AS fid, name, (SELECT count(*) FROM m) AS number_matched, (SELECT count(*) FROM pg) AS number_returned, (SELECT count(*) FROM m) > 10 + (SELECT count(*) FROM pg) AS has_next FROM pg",
    "feature_by_id": _with("p") + "SELECT CAST(fid AS VARCHAR) AS fid, name, kind, lon, lat FROM p WHERE fid = 42",
    "project_fields": _with("p") + "SELECT CAST(fid AS VARCHAR) AS fid, name, kind FROM p",
    "page_limits": "WITH r AS (SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 700 - 2000 END AS INTEGER) AS requested FROM part) SELECT p_partkey, requested, CAST(CASE WHEN requested IS NULL THEN 100 WHEN requested >= 1 THEN least(requested, 10000) END AS INTEGER) AS http_limit, CAST(CASE WHEN requested IS NULL THEN 10 WHEN requested >= 1 THEN least(requested, 1000) END AS INTEGER) AS tool_limit FROM r",
    "layer_extent": _with("p") + "SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS n FROM p",
    "field_kinds": """WITH v AS (SELECT c_custkey AS k, 'name' AS key, 'String' AS kind FROM customer UNION ALL SELECT c_custkey, 'rank', CASE WHEN c_custkey % 3 = 0 THEN 'String' ELSE 'Number' END FROM customer
        UNION ALL SELECT c_custkey, 'open', CASE WHEN c_custkey % 2 = 0 THEN 'Boolean' ELSE 'Number' END FROM customer UNION ALL SELECT c_custkey, 'late', 'Number' FROM customer WHERE c_custkey >= 10)
        SELECT key, arg_min(kind, k) AS kind FROM v GROUP BY key""",
    "catalog_layers": _with("p qp l", _CATALOG) + "SELECT name, title, n, west, south, east, north, true AS serves_tiles, true AS serves_features FROM layers",
    "tilejson": _with("p qp l", _CATALOG) + "SELECT name, 0 AS minzoom, coalesce(maxzoom, 22) AS maxzoom, round((west + east) / 2, 6) AS center_lon, round((south + north) / 2, 6) AS center_lat, CAST(least(greatest(coalesce(maxzoom, 22) // 2, 0), 14) AS INTEGER) AS center_zoom FROM layers",
    "wmts_matrix": f"SELECT CAST(z AS INTEGER) AS z, printf('%.10f', {SCALE_0!r}::DOUBLE / pow(2, z)) AS scale_denominator, 1::BIGINT << z AS size FROM range(23) AS r(z)",
    "join_layer_catalog": "SELECT c.n_name AS table_name, c.n_regionkey AS kind, CAST(CASE WHEN c.n_nationkey % 2 = 0 THEN 4326 ELSE 3857 END AS INTEGER) AS srs_id, g.n FROM nation c JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) g ON g.s_nationkey = c.n_nationkey",
    "mercator_fwd": _with("p") + f"SELECT fid, round(lon * {E!r}::DOUBLE / 180, 3) AS x, round(ln(tan((lat + 90) * pi() / 360)) * {R!r}::DOUBLE, 3) AS y FROM p",
    "mercator_inv": _with("p") + f"SELECT fid, round({_mlon}, 6) AS lon, round({_mlat}, 6) AS lat FROM p",
    "tile_assign": _with("p") + _ASSIGN,
    "tile_bounds": _with("p", f"a AS (SELECT DISTINCT z, x, y FROM ({_ASSIGN})), b AS (SELECT z, x, y, x * size - {E!r}::DOUBLE AS minx, {E!r}::DOUBLE - y * size - size AS miny, x * size - {E!r}::DOUBLE + size AS maxx, {E!r}::DOUBLE - y * size AS maxy FROM (SELECT *, {2 * E!r}::DOUBLE / (1::BIGINT << z) AS size FROM a))")
    + f"SELECT z, x, y, round(minx, 3) AS minx, round(miny, 3) AS miny, round(maxx, 3) AS maxx, round(maxy, 3) AS maxy, round({_w}, 6) AS west, round({_s}, 6) AS south, round({_e}, 6) AS east, round({_n}, 6) AS north FROM b",
    "tile_valid": "WITH r AS (SELECT p_partkey AS id, CAST(p_size % 28 - 1 AS INTEGER) AS z, p_partkey * 7919 % 40000 - 3 AS x, p_partkey * 104729 % 50000 - 3 AS y FROM part) SELECT id, z, x, y, z BETWEEN 0 AND 24 AND x >= 0 AND y >= 0 AND x < pow(2, z) AND y < pow(2, z) AS valid FROM r",
    "tile_zoom_filter": "WITH r AS (SELECT p_partkey AS id, CAST(p_size % 28 - 1 AS INTEGER) AS z, p_partkey * 7919 % 40000 - 3 AS x, p_partkey * 104729 % 50000 - 3 AS y FROM part) SELECT * FROM r WHERE z BETWEEN 4 AND 9",
    "tile_flip_lookup": "SELECT 9 AS z, a.x, a.y, s.p_name AS tile_data FROM (SELECT DISTINCT c_custkey % 512 AS x, CASE WHEN c_custkey % 2 = 0 THEN 511 - c_custkey % 512 * 31 % 512 ELSE c_custkey * 17 % 512 END AS y FROM customer) a JOIN part s ON s.p_partkey % 512 = a.x AND s.p_partkey * 31 % 512 = 511 - a.y",
    "tile_features": _with("l", _KEYED) + "SELECT z, x, y, feature AS fid FROM keyed",
    "tile_counts": _with("l", _KEYED) + "SELECT z, x, y, count(*) AS n FROM keyed GROUP BY z, x, y",
    "tile_build": _with("p", "pl AS (SELECT fid AS feature, lon AS xmin, lat AS ymin, lon AS xmax, lat AS ymax FROM p), " + _KEYED.replace("FROM l,", "FROM pl,").replace("generate_series(8, 15)", "generate_series(6, 10)"))
    + "SELECT z, x, y, CAST(count(*) AS INTEGER) AS n FROM keyed GROUP BY z, x, y",
    "tile_contents": _with("p", "pl AS (SELECT fid AS feature, lon AS xmin, lat AS ymin, lon AS xmax, lat AS ymax FROM p), " + _KEYED.replace("FROM l,", "FROM pl,").replace("generate_series(8, 15)", "generate_series(6, 10)"))
    + "SELECT z, x, y, sha256(string_agg(p.fid || ':' || p.name || chr(10), '' ORDER BY p.fid)) AS content FROM keyed JOIN p ON p.fid = keyed.feature GROUP BY z, x, y",
    "haversine": _with("p qp") + f"SELECT p.fid, qp.fid AS sid, round({hav('p.lon', 'p.lat', 'qp.lon', 'qp.lat')}, 1) AS dist_m FROM p JOIN qp ON p.fid % 10 = qp.fid",
    "meters_per_degree": _with("p") + "SELECT fid, round(greatest(1, 111320::DOUBLE * cos((lat * 2 - 10) * pi() / 180)), 3) AS lon_m, 111132::DOUBLE AS lat_m FROM p",
    "project_on_segment": _with("s t", f"b AS (SELECT *, {_projected('lon', 'lat')} AS f FROM s JOIN t ON s.sid % 50 = t.user_id)") + "SELECT sid, user_id, seq, round(ax + (bx - ax) * f, 6) AS x, round(ay + (by_ - ay) * f, 6) AS y, round(CAST(f AS DOUBLE), 6) AS fraction FROM b",
    "bbox_center": _with("l") + "SELECT feature AS fid, round((xmin + xmax) / 2, 6) AS lon, round((ymin + ymax) / 2, 6) AS lat FROM l",
    "bbox_parse": """WITH r AS (SELECT c_custkey AS k, CAST(c_custkey % 360 - 180 AS DOUBLE) AS w, CAST(c_custkey % 180 - 90 AS DOUBLE) AS s, CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS e, CAST(c_custkey * 11 % 180 - 90 AS DOUBLE) AS n FROM customer),
        v AS (SELECT *, k % 9 NOT IN (0, 1, 3) AND w <= e AND s <= n AS ok FROM r)
        SELECT k AS fid, ok OR k % 9 = 3 AS valid, CASE WHEN ok THEN w END AS west, CASE WHEN ok THEN s END AS south, CASE WHEN ok THEN e END AS east, CASE WHEN ok THEN n END AS north FROM v""",
    "grid_bin": _with("p", "x AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM p), b AS (SELECT fid, least(greatest(CAST(trunc((lon - w) / (e - w) * 64) AS INTEGER), 0), 63) AS gx, least(greatest(CAST(trunc((lat - s) / (n - s) * 64) AS INTEGER), 0), 63) AS gy FROM p, x)")
    + "SELECT CAST(fid AS VARCHAR) AS fid, gx AS x0, gy AS y0, gx AS x1, gy AS y1 FROM b",
    "eps_join": _with("p", _PLANAR) + "SELECT a AS fid, count(*) AS n, min(b) AS first, CAST(sum(b) AS BIGINT) AS total FROM pairs GROUP BY a",
    "dbscan_labels": _with("p", _DBSCAN, True) + "SELECT fid, cluster FROM labelled",
    "dbscan_summary": _with("p", _DBSCAN, True) + "SELECT cluster, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM labelled WHERE cluster >= 0 GROUP BY cluster",
    "dbscan_totals": _with("p", _DBSCAN, True) + "SELECT count(*) AS feature_count, count(DISTINCT cluster) FILTER (cluster >= 0) AS cluster_count, count(*) FILTER (cluster < 0) AS noise_count FROM labelled",
    "network_edges": _with("t", _EDGES) + "SELECT feature, pos, reverse, fx, fy, tx, ty, level, round(length_m, 1) AS length_m, round(speed, 6) AS speed, round(length_m / speed, 1) AS time_s FROM edges",
    "network_nodes": _with("t", _NODES) + "SELECT row_number() OVER (ORDER BY qx, qy, level) - 1 AS node, qx, qy, level, lon, lat FROM nodes",
    "network_stats": _with("t", _NODES) + "SELECT (SELECT count(*) FROM nodes) AS node_count, count(*) AS edge_count, round(max(speed), 6) AS max_speed, (SELECT min(lon) FROM nodes) AS west, (SELECT min(lat) FROM nodes) AS south, (SELECT max(lon) FROM nodes) AS east, (SELECT max(lat) FROM nodes) AS north FROM edges",
    "segments_undirected": _with("t", _EDGES) + "SELECT feature, pos, reverse, fx, fy, tx, ty FROM edges e WHERE (fx, fy) < (tx, ty) OR NOT EXISTS (SELECT 1 FROM edges r WHERE r.feature = e.feature AND r.level = e.level AND r.fx = e.tx AND r.fy = e.ty AND r.tx = e.fx AND r.ty = e.fy)",
    "props_extract": """WITH r AS (SELECT event_id AS k, json_extract_string(props, '$.k') AS raw FROM events)
        SELECT k AS event_id, CASE WHEN k % 4 = 3 THEN CAST(raw AS DOUBLE) END AS as_float,
            coalesce(CASE k % 4 WHEN 0 THEN raw IN ('1', '-1') WHEN 1 THEN k % 3 = 0 WHEN 2 THEN k % 3 = 0 ELSE CAST(raw AS DOUBLE) <> 0 END, false) AS as_bool,
            coalesce(CASE k % 4 WHEN 0 THEN raw WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END WHEN 2 THEN CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END ELSE raw END, '') AS as_string,
            CASE WHEN k % 4 = 3 AND raw IS NOT NULL THEN 'Number' WHEN k % 4 = 1 THEN 'Boolean' ELSE 'String' END AS kind FROM r""",
    "nearest_node": _with("t n", _NEAR) + "SELECT qid, node, round(d, 1) AS dist_m FROM nearest",
    "nearby_edges": _with("t s", f"c AS (SELECT t.user_id * 1000000 + t.seq AS qid, t.lon, t.lat, s.*, {_projected('t.lon', 't.lat')} AS f FROM t JOIN s ON t.mx BETWEEN mx1 - 1000 AND mx2 + 1000 AND t.my BETWEEN my1 - 1000 AND my2 + 1000), near AS (SELECT qid, sid, round({hav('lon', 'lat', '(ax + (bx - ax) * f)', '(ay + (by_ - ay) * f)')}, 3) AS d FROM c)")
    + "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, sid) AS INTEGER) AS rank, sid, round(d, 1) AS dist_m FROM near WHERE d <= 50 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, sid) <= 5",
    "sssp": _with("e", _sssp("SELECT 0::BIGINT AS req, 0::BIGINT AS node, 0::BIGINT AS cost"), True) + "SELECT node, cost FROM best",
    "sssp_relax": _with("e", _sssp("SELECT 0::BIGINT AS req, 0::BIGINT AS node, 0::BIGINT AS cost"), True) + "SELECT node, cost FROM best",
    "sssp_seeded": _with("e", _sssp("SELECT 0::BIGINT AS req, CAST(node AS BIGINT) AS node, CAST(cost AS BIGINT) AS cost FROM (VALUES (0, 500), (120, 0), (199, 250)) AS v(node, cost)"), True) + "SELECT node, cost FROM best",
    "shortest_path": _with("e", _sssp("SELECT CAST(s_suppkey AS BIGINT) AS req, CAST(s_suppkey * 7813 % (SELECT count(*) FROM part) AS BIGINT) AS node, 0::BIGINT AS cost FROM supplier"), True)
    + "SELECT req, cost, CAST(req * 7813 % (SELECT count(*) FROM part) AS BIGINT) AS src, node AS dst FROM best WHERE node = req * 7837 % (SELECT count(*) FROM part)",
    "path_lengths": _with("e", _sssp("SELECT CAST(s_suppkey AS BIGINT) AS req, CAST(s_suppkey * 7813 % (SELECT count(*) FROM part) AS BIGINT) AS node, 0::BIGINT AS cost FROM supplier"), True)
    + "SELECT req, cost FROM best WHERE node = req * 7837 % (SELECT count(*) FROM part) AND node <> req * 7813 % (SELECT count(*) FROM part)",
    "isochrone_reach": _with("e", _REACH, True) + f"SELECT req, cutoff, count(*) AS reached FROM best CROSS JOIN {_CUTS} WHERE cost <= cutoff GROUP BY req, cutoff",
    "isochrone_frontier": _with("e", _FRONTIER, True) + 'SELECT req, cutoff, src, dst, "full", round(fraction, 6) AS fraction FROM frontier',
    "raster_cells": _with("n e", _CELLS, True) + "SELECT req, cutoff, gx, gy FROM cells",
    "raster_dilate": _with("n e", _DILATED, True) + "SELECT req, cutoff, gx, gy FROM wide",
    "marching_segments": _with("n e", _DILATED + _CONTOUR, True)
    + "SELECT req, cutoff, CAST(x * 2 + x1 AS INTEGER) AS vx1, CAST(y * 2 + y1 AS INTEGER) AS vy1, CAST(x * 2 + x2 AS INTEGER) AS vx2, CAST(y * 2 + y2 AS INTEGER) AS vy2 FROM blocks JOIN cases USING (code)",
    "contour_rings": _with("n e", _DILATED + _CONTOUR + _RINGS + """,
        sizes AS (SELECT req, cutoff, label, count(*) AS n, CAST(sum(x1 * y2 - x2 * y1) AS BIGINT) AS area2 FROM directed JOIN lab USING (req, cutoff, p1) GROUP BY req, cutoff, label),
        edges AS (SELECT d.*, label, area2 FROM directed d JOIN lab USING (req, cutoff, p1) JOIN sizes USING (req, cutoff, label) WHERE area2 > 0),
        around AS (SELECT h.req, h.cutoff, h.label, e.label AS outer_, any_value(e.area2) AS a FROM (SELECT *, label // 1000000 - 1000 + 0.01::DOUBLE AS px, label % 1000000 - 1000 + 0.013::DOUBLE AS py FROM sizes WHERE area2 < 0) h
                   JOIN edges e ON e.req = h.req AND e.cutoff = h.cutoff AND (e.y1 > h.py) <> (e.y2 > h.py) AND h.px < (e.x2 - e.x1) * (h.py - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY h.req, h.cutoff, h.label, e.label HAVING count(*) % 2 = 1),
        owner AS (SELECT req, cutoff, label, arg_min(outer_, a) AS o FROM around GROUP BY req, cutoff, label)""", True)
    + "SELECT req, cutoff, CAST(label // 1000000 - 1000 AS INTEGER) AS rx, CAST(label % 1000000 - 1000 AS INTEGER) AS ry, n, area2, CAST(coalesce(o, label) // 1000000 - 1000 AS INTEGER) AS ox, CAST(coalesce(o, label) % 1000000 - 1000 AS INTEGER) AS oy FROM sizes LEFT JOIN owner USING (req, cutoff, label)",
    "ring_points": _with("n e", _DILATED + _CONTOUR + _RINGS + """,
        walk(req, cutoff, label, pos, p) AS (SELECT DISTINCT req, cutoff, label, 0, label FROM lab
            UNION ALL SELECT w.req, w.cutoff, w.label, w.pos + 1, d.p2 FROM walk w JOIN directed d ON d.req = w.req AND d.cutoff = w.cutoff AND d.p1 = w.p AND d.p2 <> w.label)""", True)
    + "SELECT req, cutoff, CAST(label // 1000000 - 1000 AS INTEGER) AS rx, CAST(label % 1000000 - 1000 AS INTEGER) AS ry, CAST(sum(pos * ((p // 1000000 - 1000) * 1000 + p % 1000000 - 1000)) AS BIGINT) AS ranked FROM walk GROUP BY req, cutoff, label",
    "track_steps": _with("t", f"b AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq))") + f"SELECT user_id AS trace, seq, round({hav('plon', 'plat', 'lon', 'lat')}, 1) AS step_m FROM b",
    "viterbi": _with("t n", _LATTICE, True)
    + "SELECT trace, CAST(score AS BIGINT) AS score, state FROM best JOIN ends USING (trace, step) QUALIFY row_number() OVER (PARTITION BY trace ORDER BY score DESC, state) = 1",
    "od_costs": _with("t n e", _NEAR + ", pairs AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM nearest a JOIN nearest b ON b.qid = a.qid + 1 AND a.node <> b.node), "
        + _sssp("SELECT DISTINCT src AS req, src AS node, 0::BIGINT AS cost FROM pairs", cutoff="AND s.cost <= 1500"), True)
    + "SELECT src, dst, cost FROM pairs JOIN best ON best.req = src AND best.node = dst",
    "viterbi_states": _with("t n", _LATTICE + """,
        path(trace, step, state, score, nx, ny, mx, my) AS (SELECT trace, step, state, score, nx, ny, mx, my FROM best JOIN ends USING (trace, step) QUALIFY row_number() OVER (PARTITION BY trace ORDER BY score DESC, state) = 1
            UNION ALL SELECT a.trace, a.step, min(a.state), arg_min(a.score, a.state), arg_min(a.nx, a.state), arg_min(a.ny, a.state), any_value(a.mx), any_value(a.my) FROM path b JOIN best a ON a.trace = b.trace AND a.step = b.step - 1
                AND a.score - abs(abs(b.nx - a.nx) + abs(b.ny - a.ny) - abs(b.mx - a.mx) - abs(b.my - a.my)) - abs(b.mx - b.nx) - abs(b.my - b.ny) = b.score GROUP BY a.trace, a.step)""", True)
    + "SELECT trace, CAST(step AS INTEGER) AS step, state FROM path",
    "ring_area": _with("t", "q AS (SELECT user_id, seq, mx - 116010000 AS x, my - 39903000 AS y, count(*) OVER (PARTITION BY user_id) AS m FROM t)") + "SELECT a.user_id AS fid, CAST(sum(a.x * b.y - b.x * a.y) AS DOUBLE) / 2 AS area FROM q a JOIN q b ON b.user_id = a.user_id AND b.seq = (a.seq + 1) % a.m WHERE a.m > 1 GROUP BY a.user_id",
    "safe_key": "SELECT c_custkey AS fid, CASE c_custkey % 5 WHEN 0 THEN '../' || c_name WHEN 1 THEN 'tiles/' || c_custkey || '/52/24' WHEN 2 THEN 'a/../' || c_custkey WHEN 3 THEN c_custkey || ' x' ELSE 'a.b-' || c_custkey END AS key, c_custkey % 5 IN (1, 4) AS safe FROM customer",
    "scan_geojson": _with("p") + "SELECT CAST(fid AS VARCHAR) AS fid, 'Point' AS type, lon, lat, name, fid % 10 = 0 AS scattered FROM p",
    "parse_gpb": _with("p") + "SELECT fid, fid % 11 <> 0 AS ok, CASE WHEN fid % 11 <> 0 THEN 4326 END AS srs, CASE WHEN fid % 11 <> 0 AND fid % 7 <> 0 THEN lon END AS lon, CASE WHEN fid % 11 <> 0 AND fid % 7 <> 0 THEN lat END AS lat FROM p",
    "cache_sweep": """WITH e AS (SELECT 'points/' || (o_orderkey % 15) || '/' || o_orderkey AS key, 1000 + o_orderkey * 31 % 5000 AS size, o_orderkey * 7919 % 100000 AS mtime FROM orders),
        a AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY mtime DESC, key DESC) AS kept FROM e WHERE 100000 - mtime <= 90000)
        SELECT key, size FROM a WHERE total <= 12000000 OR kept <= 10800000""",
}
