"""Hidden-Markov map matching without a graph or a trace in one place.

Candidates of a point are the segments near it, by an equi-join on cells. The ways between the ends of neighbouring points'
candidates are looked up in an origin-destination table: each pair of nodes once, searched in blocks of the network no
further than its pairs ask for. The lattices of all traces are solved by products of step matrices (``lattice``). Steps of
the chosen sequence that broke (no way within the limit) are searched again without a limit and cut only where the network
doesn't connect them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import measure

from . import components as cc
from . import joins, lattice, overlay
from .features import UserError

RADIUS_M, SIGMA, BETA, CANDIDATES = 50.0, 15.0, 30.0, 5
#: Loss of a step to a candidate that no way within the limit leads to.
BREAK = -1000.0
#: Metres of a way that a step may take: so many times the straight distance, and so many more.
DETOUR, SLACK_M = 10.0, 2000.0


def track_steps(points: DataFrame) -> DataFrame:
    """points (trace, seq, lon, lat) with step_m, the great-circle metres from the point before; null on the first."""
    w = Window.partitionBy("trace").orderBy("seq")
    return points.withColumn("step_m", measure.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")))


def viterbi(emissions: DataFrame, transitions: DataFrame) -> DataFrame:
    """(trace, score, state): the best total of a state sequence per trace and its last state; see ``lattice.best``."""
    return lattice.best(emissions, transitions)


def od_table(pairs: DataFrame, edges: DataFrame, block_nodes: int = overlay.BLOCK_NODES) -> tuple[DataFrame, DataFrame]:
    """Costs of the distinct pairs (src, dst, most) of nodes over ``with_blocks`` edges, each source searched until its
    targets are settled or its greatest ``most`` is passed: (src, dst, cost) of the pairs within it, and what was reached,
    (req, node, cost, before), for ``ways``. Pairs that aren't connected within it have no row."""
    wanted = cc.cut(pairs.groupBy("src").agg(F.max("most").alias("most"), F.collect_set("dst").alias("targets")), "wanted")
    seeds = wanted.select(F.col("src").alias("req"), F.col("src").alias("node"), F.lit(0.0).alias("cost"))
    reached = overlay.rounds(seeds, edges, block_nodes, portion_of=512, limits=wanted.withColumnRenamed("src", "req"))
    costs = reached.join(wanted.select(F.col("src").alias("req"), F.explode("targets").alias("node")), ["req", "node"])
    return costs.select(F.col("req").alias("src"), F.col("node").alias("dst"), "cost"), reached


def ways(pairs: DataFrame, reached: DataFrame, portions: int = 0) -> DataFrame:
    """(src, dst, nodes) of the pairs: the nodes of their ways after src, from what ``od_table`` reached."""
    portions = portions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = lambda c: F.pmod(F.xxhash64(c), F.lit(portions)).alias("portion")

    def run(wanted: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        before = {(r, n): b for r, n, b in zip(found["req"].tolist(), found["node"].tolist(), found["before"].astype("Int64").tolist())}
        out = []
        for src, dst in zip(wanted["src"].tolist(), wanted["dst"].tolist()):
            nodes, at = [], dst
            while at != src:
                nodes.append(at)
                at = before[src, at]
            out.append((src, dst, nodes[::-1]))
        return pd.DataFrame(out, columns=["src", "dst", "nodes"])

    asked = pairs.select("src", "dst").distinct().select("src", "dst", key("src"))
    rows = reached.join(asked.select(F.col("src").alias("req")).distinct(), "req", "left_semi").select("req", "node", "before", key("req"))
    return asked.groupBy("portion").cogroup(rows.groupBy("portion")).applyInPandas(run, "src bigint, dst bigint, nodes array<bigint>")


def candidates(points: DataFrame, segments: DataFrame, radius_m: float, k: int) -> DataFrame:
    """(trace, step, seq, lon, lat, state, sid, x, y, fraction, dist_m, src, dst, len) of the points with a candidate; their
    steps count from 0, and state is the candidate's rank."""
    place = joins.place_of(points)
    asked = points.select(*place).distinct().select(F.struct(*place).alias("qid"), *place)  # a place of many points once
    near = joins.place_segments(asked, segments, radius_m, k).join(segments.select("sid", "src", "dst", F.col("length_m").alias("len")), "sid")
    near = cc.cut(near.select("qid.*", F.col("rank").cast("bigint").alias("state"), "sid", "x", "y", "fraction", "dist_m", "src", "dst", "len"), "near")
    met = cc.cut(points.select("trace", "seq", *place).join(near.select(*place).distinct(), place, "left_semi"), "met")
    steps = cc.cut(cc.dense(met.select("trace", "seq").distinct(), ["trace", "seq"], "n"), "steps")
    steps = steps.join(steps.groupBy("trace").agg(F.min("n").alias("first"), F.count("*").alias("matched")), "trace").where("matched > 1")
    steps = steps.select("trace", "seq", (F.col("n") - F.col("first")).cast("int").alias("step"))
    return met.join(steps, ["trace", "seq"]).join(near, place).drop("level")


#: Of a candidate: its place, the ends of its segment (0 and 1) and the metres to them.
_KEPT = ["state", "sid", "lon", "lat", "n0", "n1", "m0", "m1"]
_COMBINATIONS = [(i, j) for i in (0, 1) for j in (0, 1)]


def _steps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(trace, step, straight, most, and the kept columns of the candidates before, p, and in each step, c)."""
    def ends(rows, step, prefix):
        rows = rows.withColumns({"n0": F.col("src"), "n1": F.col("dst"), "m0": F.col("fraction") * F.col("len"), "m1": (1 - F.col("fraction")) * F.col("len")})
        return rows.select("trace", step.alias("step"), *[F.col(c).alias(prefix + c) for c in _KEPT])

    both = ends(first, F.col("step") + 1, "p").join(ends(second, F.col("step"), "c"), ["trace", "step"])
    straight = measure.haversine(F.col("plon"), F.col("plat"), F.col("clon"), F.col("clat"))
    return both.withColumn("straight", straight).withColumn("most", DETOUR * F.col("straight") + SLACK_M).drop("plon", "plat", "clon", "clat")


def _segment_pairs(steps: DataFrame) -> DataFrame:
    """(psid, csid, a, b, i, j, most): the nodes between which ways of each pair of different segments lead, once."""
    ends = [F.first(c).alias(c) for c in ("pn0", "pn1", "cn0", "cn1")]
    pairs = steps.where("psid <> csid").groupBy("psid", "csid").agg(F.max("most").alias("most"), *ends)
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"pn{i}").alias("a"), F.col(f"cn{j}").alias("b")) for i, j in _COMBINATIONS])
    return pairs.withColumn("e", F.explode(each)).select("psid", "csid", "e.a", "e.b", "e.i", "e.j", "most")


def match_steps(points: DataFrame, segments: DataFrame, edges: DataFrame, radius_m: float = RADIUS_M, sigma: float = SIGMA, beta: float = BETA, k: int = CANDIDATES, block_nodes: int = overlay.BLOCK_NODES) -> DataFrame:
    """(trace, step, seq, sid, x, y, fraction, distance_m, metres, nodes) of the matched points of traces (trace, seq, lon,
    lat, perhaps level): the chosen place on segments (sid, ax, ay, bx, by, src, dst, length_m, perhaps alevel, blevel: then
    both ends must be on the trace's level), and the metres and nodes of the way from the point before over edges (src, dst,
    w in metres); metres are null on the first point, nodes where both lie on one segment or nothing connects them. Traces
    of which fewer than two points have a candidate give no row. No trace is gathered anywhere."""
    if not (radius_m > 0 and sigma > 0 and beta > 0):
        raise UserError("radius_m, sigma and beta must be positive")
    found = cc.cut(candidates(points, segments, radius_m, k), "candidates")
    steps = _steps(found, found)
    pairs = cc.cut(_segment_pairs(steps), "pairs")
    costs, reached = od_table(pairs.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "most"), overlay.with_blocks(edges, block_nodes), block_nodes)
    between = pairs.join(costs.select(F.col("src").alias("a"), F.col("dst").alias("b"), "cost"), ["a", "b"], "left")
    cost = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("cost"))
    between = between.groupBy("psid", "csid").agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), cost)).alias(f"b{i}{j}") for i, j in _COMBINATIONS])
    routed = steps.join(cc.cut(between, "between"), ["psid", "csid"], "left")

    def way(i: int, j: int) -> Column:
        ok = F.col(f"pm{i}") + F.col(f"b{i}{j}") <= F.col("most")
        return F.when(ok, F.struct((F.col(f"pm{i}") + F.col(f"b{i}{j}") + F.col(f"cm{j}")).alias("metres"), F.col(f"pn{i}").alias("a"), F.col(f"cn{j}").alias("b")))

    # of one segment its two ends are nodes 0 and 1 on either side: the stretch between the places
    along = F.when(F.col("psid") == F.col("csid"), F.abs(F.col("pm0") - F.col("cm0")))
    moves = routed.select("trace", "step", F.col("pstate").alias("state_from"), F.col("cstate").alias("state_to"), "straight", along.alias("along"), F.least(*[way(i, j) for i, j in _COMBINATIONS]).alias("w"))
    moves = moves.withColumn("metres", F.coalesce("along", "w.metres"))
    lost = F.when(F.count("metres").over(Window.partitionBy("trace", "step", "state_to")) == 0, BREAK)  # dealt by trace and step already
    moves = cc.cut(moves.withColumn("t", F.coalesce(-F.abs(F.col("metres") - F.col("straight")) / beta, lost)), "moves")
    emissions = found.select("trace", "step", "state", (-0.5 * (F.col("dist_m") / sigma) ** 2).alias("e"))
    chosen = lattice.sequence(emissions, moves.where("t is not null").select("trace", "step", "state_from", "state_to", "t"))
    return _routed(cc.cut(found.join(chosen, ["trace", "step", "state"]), "chosen"), moves, edges, reached)


def _routed(line: DataFrame, moves: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """line with the metres and nodes of the way into each step; broken steps are searched without a limit."""
    taken = line.select("trace", (F.col("step") + 1).alias("step"), F.col("state").alias("state_from")).join(line.select("trace", "step", F.col("state").alias("state_to")), ["trace", "step"])
    taken = cc.cut(taken.join(moves, ["trace", "step", "state_from", "state_to"]).select("trace", "step", "along", "w", "metres"), "taken")
    known = taken.where("along is null and w is not null").select("trace", "step", "metres", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    apart = cc.cut(known.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "apart")
    opened = ways(apart, reached).select(F.col("src").alias("a"), F.col("dst").alias("b"), "nodes")
    known = known.join(opened, ["a", "b"], "left").select("trace", "step", "metres", F.concat(F.array("a"), F.coalesce("nodes", F.array().cast("array<bigint>"))).alias("nodes"))
    broken = cc.cut(taken.where("metres is null").select("trace", "step"), "broken")
    if not broken.isEmpty():
        before = line.withColumn("step", F.col("step") + 1).join(broken, ["trace", "step"], "left_semi").withColumn("step", F.col("step") - 1)
        steps = cc.cut(_steps(before, line.join(broken, ["trace", "step"], "left_semi")), "again")
        ends = cc.cut(_segment_pairs(steps).select("a", "b").distinct(), "ends")
        ids = cc.cut(cc.dense(ends, ["a", "b"], "req"), "requests")
        far = cc.cut(overlay.paths(overlay.build(edges), ids.select("req", F.col("a").alias("src"), F.col("b").alias("dst"))).join(ids, "req"), "far")
        each = F.array(*[F.struct(F.col(f"pn{i}").alias("a"), F.col(f"cn{j}").alias("b"), (F.col(f"pm{i}") + F.col(f"cm{j}")).alias("own")) for i, j in _COMBINATIONS])
        far = steps.select("trace", "step", F.explode(each).alias("e")).select("trace", "step", "e.*").join(far, ["a", "b"]).withColumn("metres", F.col("own") + F.col("cost"))
        far = far.groupBy("trace", "step").agg(F.min(F.struct("metres", "a", "b", "nodes")).alias("w")).select("trace", "step", "w.metres", "w.nodes")
        known = known.unionByName(far)
    same = taken.where("along is not null").select("trace", "step", F.lit(None).cast("double").alias("metres"), F.lit(None).cast("array<bigint>").alias("nodes"))
    last = line.select("trace", (F.col("step") + 1).alias("step"), F.col("x").alias("px"), F.col("y").alias("py"))
    out = line.join(known.unionByName(same), ["trace", "step"], "left").join(last, ["trace", "step"], "left")
    straight = measure.haversine(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    return out.select("trace", "step", "seq", "sid", "x", "y", "fraction", F.round("dist_m", 1).alias("distance_m"), F.when(F.col("px").isNotNull(), F.coalesce("metres", straight)).alias("metres"), "nodes")


def match(points: DataFrame, segments: DataFrame, edges: DataFrame, radius_m: float = RADIUS_M, sigma: float = SIGMA, beta: float = BETA, k: int = CANDIDATES, block_nodes: int = overlay.BLOCK_NODES) -> DataFrame:
    """(trace, length_m, points_total, points_matched, points_unmatched, snapped: array of (seq, sid, x, y, fraction,
    distance_m), geometry: array of (x, y)): the steps of ``match_steps`` as one row a trace."""
    steps = cc.cut(match_steps(points, segments, edges, radius_m, sigma, beta, k, block_nodes), "matched")
    places = segments.select(F.col("src").alias("node"), F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("at")).unionByName(segments.select(F.col("dst").alias("node"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("at")))
    places = places.groupBy("node").agg(F.min("at").alias("at"))
    corners = steps.select("trace", "step", F.posexplode("nodes").alias("i", "node")).join(places, "node").select("trace", "step", "i", "at")
    own = steps.select("trace", "step", F.lit(1 << 30).alias("i"), F.struct("x", "y").alias("at"))
    line = corners.unionByName(own).groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("step", "i", "at"))).alias("l"))
    at = F.transform("l", lambda v: v["at"])
    line = line.select("trace", at.alias("l")).select("trace", F.filter("l", lambda v, i: (i == 0) | (v != F.get("l", i - 1))).alias("geometry"))
    snapped = F.array_sort(F.collect_list(F.struct("seq", "sid", "x", "y", "fraction", "distance_m"))).alias("snapped")
    found = steps.groupBy("trace").agg(F.round(F.sum("metres"), 1).alias("length_m"), F.count("*").cast("int").alias("points_matched"), snapped)
    total = points.groupBy("trace").agg(F.count("*").cast("int").alias("points_total"))
    out = found.join(total, "trace").join(line, "trace").withColumn("points_unmatched", F.col("points_total") - F.col("points_matched"))
    return out.select("trace", "length_m", "points_total", "points_matched", "points_unmatched", "snapped", "geometry")
