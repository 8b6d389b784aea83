"""Networks with their local graphs, and the routing algorithms over them."""

from __future__ import annotations

import json
import math
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import measure
from geoloom.operators import mapmatch, network, overlay, raster, search
from geoloom.operators import components as cc
from geoloom.operators.features import UserError

from . import frames

MAX_CUTOFFS, MAX_POINTS = 8, 10_000


class Local:
    """What searches need of a network, in arrays: it can be broadcast."""

    def __init__(self, graph: search.Graph, lon: np.ndarray, lat: np.ndarray, level: np.ndarray):
        self.graph, self.lon, self.lat, self.level = graph, lon, lat, level
        self.weights = {"distance": graph.weight, "time": graph.extra["time_s"][graph.edge]}
        self.rates = {cost: graph.rate(lon, lat, w) for cost, w in self.weights.items()}

    def snap(self, point: tuple[float, float], level: int, radius_m: float) -> tuple[int, float]:
        """(node, metres) of the nearest node on a level; ties go to the smaller node."""
        d = np.where(self.level == level, search.great_circle(self.lon, self.lat, *point), np.inf)
        best = int(np.argmin(np.round(d, 3)))
        if not d[best] <= radius_m:
            raise UserError("no node of the network is near the point")
        return best, float(d[best])

    def place(self, node: int) -> list[float]:
        return [float(self.lon[node]), float(self.lat[node])]


class Network:
    """Nodes and edges of a line layer (feature, props, parts), and what searches need of them: overlays for frames of
    requests, and for single answers over networks that are small enough a graph in arrays."""

    def __init__(self, name: str, lines: DataFrame, options: network.NetworkOptions = network.NetworkOptions()):
        self.name, self._segments, self._local, self._overlays = name, None, None, {}
        edges = cc.cut(network.edges_of(lines, options), "edges")
        if edges.isEmpty():
            raise UserError(f"network {name} has no edges")
        self.nodes = cc.cut(network.numbered(network.nodes_of(edges)), "nodes")
        self.edges = cc.cut(network.linked(edges, self.nodes), "linked")

    @cached_property
    def small(self) -> bool:
        return self.edges.count() <= search.MAX_EDGES

    def local(self) -> Local:
        if self._local is None:
            order = ["feature", "part", "pos", "reverse"]
            graph = search.Graph.collect(self.edges, "length_m", self.nodes.count(), order, ["time_s", "feature", "tlon", "tlat"])
            rows = self.nodes.orderBy("node").select("lon", "lat", "level").toPandas()  # as bounded as the graph
            self._local = Local(graph, *(rows[c].to_numpy() for c in ("lon", "lat", "level")))
        return self._local

    def overlay(self, cost: str) -> overlay.Overlay:
        if cost not in self._overlays:
            self._overlays[cost] = overlay.build(self.edges.select("src", "dst", F.col("time_s" if cost == "time" else "length_m").alias("w")))
        return self._overlays[cost]

    def segments(self) -> DataFrame:
        """Undirected segments for matching, numbered densely: sid, src, dst, ends with their levels, length_m, feature."""
        one = network.undirected(self.edges)
        one = one.select("feature", "part", "pos", "reverse", "src", "dst", F.col("flon").alias("ax"), F.col("flat").alias("ay"), F.col("tlon").alias("bx"), F.col("tlat").alias("by"), F.col("flevel").alias("alevel"), F.col("tlevel").alias("blevel"), "length_m")
        if self._segments is None:
            self._segments = cc.cut(cc.dense(one, ["feature", "part", "pos", "reverse"], "sid"), "segments")
        return self._segments


def _point(value, name: str) -> tuple[float, float]:
    if not (isinstance(value, (list, tuple)) and len(value) == 2 and all(isinstance(v, (int, float)) for v in value) and abs(value[0]) <= 180 and abs(value[1]) <= 90):
        raise UserError(f"{name} must be [lon, lat] in degrees")
    return float(value[0]), float(value[1])


def _cost(params: dict) -> str:
    cost = params.get("cost") or "time"
    if cost not in ("time", "distance"):
        raise UserError("cost must be time or distance")
    return cost


def _level(params: dict, name: str) -> int:
    level = int(params.get(name) or 0)
    if not -32768 <= level <= 32767:
        raise UserError(f"{name} is out of range")
    return level


def run_frame(net: Network, name: str, requests: DataFrame) -> DataFrame:
    """(req, result) for a frame of requests (req, params: JSON text), answered together (``frames``). Traces and points
    have frames of their own, mapmatch.match and dbscan.labels."""
    if name not in ("shortest_path", "isochrone"):
        raise UserError(f"{name} takes frames of its own")
    return (frames.shortest_paths if name == "shortest_path" else frames.isochrones)(net, requests)


def _single(net: Network, name: str, params: dict) -> dict:
    """One answer of a network that is too large to be gathered."""
    rows = net.nodes.sparkSession.createDataFrame([(0, json.dumps(params))], "req bigint, params string")
    out = json.loads(run_frame(net, name, rows).first()["result"])
    if "error" in out:
        raise UserError(out["error"])
    return out


def shortest_path(net: Network, params: dict) -> dict:
    if not net.small:
        return _single(net, "shortest_path", params)
    net = net.local()
    start, end, cost = _point(params.get("from"), "from"), _point(params.get("to"), "to"), _cost(params)
    radius = params.get("snap_radius_m") or 0
    radius = radius if radius > 0 else 500.0
    src, d1 = net.snap(start, _level(params, "from_level"), radius)
    dst, d2 = net.snap(end, _level(params, "to_level"), radius)
    best = net.graph.astar(src, dst, net.lon, net.lat, net.rates[cost], net.weights[cost])
    if dst not in best:
        raise UserError("the two points aren't connected")
    edges = net.graph.path(best, dst)
    nodes = [src, *(int(net.graph.dst_of[e]) for e in edges)]
    lengths = {int(e): w for e, w in zip(net.graph.edge, net.graph.weight)}
    return {
        "type": "FeatureCollection",
        "features": [
            {
                "type": "Feature",
                "geometry": {"type": "LineString", "coordinates": [net.place(n) for n in nodes]},
                "properties": {
                    "length_m": round(sum(lengths[e] for e in edges), 1), "duration_s": round(float(sum(net.graph.extra["time_s"][e] for e in edges)), 1), "cost": cost,
                    "levels_visited": sorted({int(net.level[n]) for n in nodes}), "snap_from_m": round(d1, 1), "snap_to_m": round(d2, 1),
                },
            }
        ],
    }


def isochrone(net: Network, params: dict) -> dict:
    if not net.small:
        return _single(net, "isochrone", params)
    net = net.local()
    origin, cost, cutoffs = _point(params.get("origin"), "origin"), _cost(params), params.get("cutoffs") or []
    if not 1 <= len(cutoffs) <= MAX_CUTOFFS or not all(isinstance(c, (int, float)) and c > 0 for c in cutoffs):
        raise UserError(f"1 to {MAX_CUTOFFS} positive cutoffs are needed")
    radius = params.get("snap_radius_m") or 0
    src, _ = net.snap(origin, _level(params, "level"), radius if radius > 0 else 500.0)
    g, weights = net.graph, net.weights[cost]
    best = g.search([(src, 0.0)], max(cutoffs), weight=weights)
    features = []
    for cutoff in sorted(cutoffs, reverse=True):
        segs, reached = [], 0
        for node, (cu, _) in best.items():
            if cu > cutoff:
                continue
            reached += 1
            for k in range(g.first[node], g.first[node + 1]):
                to, w = int(g.dst[k]), float(weights[k])
                a, b = net.place(node), net.place(to)
                if cu + w <= cutoff and best.get(to, (math.inf,))[0] <= cutoff:
                    segs.append((a, b))
                elif w > 0 and (f := (cutoff - cu) / w) > 0:
                    segs.append((a, [a[0] + (b[0] - a[0]) * min(1.0, f), a[1] + (b[1] - a[1]) * min(1.0, f)]))
        shape = _area(segs, params.get("cell_size_m")) if segs else []
        if shape:
            features.append({"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": shape}, "properties": {"cutoff": cutoff, "cost": cost, "reached_nodes": reached}})
    if not features:
        raise UserError("nothing can be reached within the cutoffs")
    return {"type": "FeatureCollection", "features": features}


def _area(segments: list, cell_m: float | None) -> list:
    """MultiPolygon coordinates around segments: raster, dilation, contour."""
    p = np.array(segments, float).reshape(-1, 2)
    (minx, miny), (maxx, maxy) = p.min(0), p.max(0)
    lon_m = max(1.0, measure.LON_M * math.cos(math.radians((miny + maxy) / 2)))
    cell = cell_m if cell_m and cell_m > 0 else max(max((maxx - minx) * lon_m, (maxy - miny) * measure.LAT_M) / 128, 5.0)
    cw, ch = cell / lon_m, cell / measure.LAT_M
    nx, ny = int((maxx - minx) / cw) + 5, int((maxy - miny) / ch) + 5
    if nx * ny > raster.MAX_CELLS:
        raise UserError(f"the area would have {nx * ny} cells; up to {raster.MAX_CELLS} are allowed: use larger cells")
    grid = np.zeros((nx, ny), bool)
    for a, b in segments:
        steps = int(max(abs(b[0] - a[0]) / cw, abs(b[1] - a[1]) / ch) * 2) + 1
        t = np.linspace(0.0, 1.0, steps + 1)
        gx = np.rint((a[0] + (b[0] - a[0]) * t - minx) / cw + 2).astype(int)
        gy = np.rint((a[1] + (b[1] - a[1]) * t - miny) / ch + 2).astype(int)
        grid[np.clip(gx, 0, nx - 1), np.clip(gy, 0, ny - 1)] = True
    wide = np.zeros_like(grid)
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            wide[max(0, i) : nx + min(0, i), max(0, j) : ny + min(0, j)] |= grid[max(0, -i) : nx + min(0, -i), max(0, -j) : ny + min(0, -j)]
    padded = np.pad(wide, 1)
    code = padded[:-1, 1:] * 1 + padded[1:, 1:] * 2 + padded[1:, :-1] * 4 + padded[:-1, :-1] * 8
    rows = []
    for x, y in zip(*np.nonzero((code > 0) & (code < 15))):
        for s in raster.CASES[int(code[x, y])].split():
            (x1, y1), (x2, y2) = raster.SIDES[s[0]], raster.SIDES[s[1]]
            rows.append((int(2 * x + x1), int(2 * y + y1), int(2 * x + x2), int(2 * y + y2)))
    rings = [raster.simplify(r, 1.0) for r in raster.chain(rows)]
    place = lambda v: [minx + (v[0] / 2 - 3) * cw, miny + (v[1] / 2 - 3) * ch]  # noqa: E731  one cell of padding, two of margin
    return [[[place(v) for v in ring] for ring in polygon] for polygon in raster.polygons(rings)]


def map_match(net: Network, params: dict) -> dict:
    trace = params.get("trace") or []
    if not 2 <= len(trace) <= MAX_POINTS:
        raise UserError(f"a trace needs 2 to {MAX_POINTS} points")
    points = [_point(p, "trace") for p in trace]
    number = lambda name, default: v if (v := float(params.get(name) or 0)) > 0 else default
    spark, level = net.nodes.sparkSession, _level(params, "level")
    rows = spark.createDataFrame([(0, i, x, y, level) for i, (x, y) in enumerate(points)], "trace bigint, seq bigint, lon double, lat double, level int")
    segments = net.segments()
    edges = net.edges.select("src", "dst", F.col("length_m").alias("w"))
    got = mapmatch.match(rows, segments, edges, number("search_radius_m", mapmatch.RADIUS_M), number("sigma_m", mapmatch.SIGMA), number("beta_m", mapmatch.BETA)).first()
    if got is None:
        raise UserError("fewer than two points of the trace are near the network")
    owner = dict(segments.where(F.col("sid").isin([s["sid"] for s in got["snapped"]])).select("sid", "feature").collect())
    return {
        "type": "FeatureCollection",
        "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[p["x"], p["y"]] for p in got["geometry"]]}, "properties": {"role": "matched_route", "length_m": got["length_m"], "points_total": got["points_total"], "points_matched": got["points_matched"], "points_unmatched": got["points_unmatched"]}}],
        "points": [{"index": s["seq"], "input": list(points[s["seq"]]), "snapped": [s["x"], s["y"]], "distance_m": s["distance_m"], "feature": {"id": owner[s["sid"]]}} for s in got["snapped"]],
    }
