"""Lattices by matrix products against plain Viterbi, and map matching through them against a matcher by hand."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import joins, lattice, mapmatch, overlay


def viterbi_by_hand(e, t):
    """(score, states) of one trace from {step: {state: e}} and {step: {(a, b): t}}; ties take the smaller state."""
    if sorted(e) != list(range(len(e))):
        return None
    best, backs = dict(e[0]), []
    for step in range(1, len(e)):
        back = {}
        for (a, b), w in t.get(step, {}).items():
            if a in best and b in e[step]:
                back[b] = min(back.get(b, (math.inf, 0)), (-(best[a] + w + e[step][b]), a))
        best = {b: -v for b, (v, _) in back.items()}
        backs.append({b: a for b, (_, a) in back.items()})
    if not best:
        return None
    states = [min((-v, s) for s, v in best.items())[1]]
    for back in reversed(backs):
        states.append(back[states[-1]])
    return max(best.values()), states[::-1]


@pytest.mark.parametrize("piece,fan", [(1024, 64), (3, 2), (1, 3)])
def test_sequences(spark, monkeypatch, piece, fan):
    monkeypatch.setattr(lattice, "PIECE", piece)
    monkeypatch.setattr(lattice, "FAN", fan)
    rng = random.Random(4)
    e, t, want = [], [], {}
    for trace in range(30):
        steps = rng.choice([1, 2, 3, 9, 40])
        es = {i: {s * 7: -rng.randrange(9) for s in rng.sample(range(5), rng.randrange(1, 4))} for i in range(steps)}
        ts = {i: {(a, b): -rng.randrange(9) for a in es[i - 1] for b in es[i] if rng.random() < (0.95 if trace % 5 else 0.6)} for i in range(1, steps)}
        if trace == 7 and steps > 2:
            del es[1]
        want[trace] = viterbi_by_hand(es, ts)
        e += [(trace, i, s, w) for i, own in es.items() for s, w in own.items()]
        t += [(trace, i, a, b, w) for i, own in ts.items() for (a, b), w in own.items()]
    em = spark.createDataFrame(e, "trace long, step int, state long, e long")
    tr = spark.createDataFrame(t, "trace long, step int, state_from long, state_to long, t long")
    assert {r["trace"]: (r["score"], r["state"]) for r in lattice.best(em, tr).collect()} == {k: (v[0], v[1][-1]) for k, v in want.items() if v}
    got = {}
    for r in lattice.sequence(em, tr).orderBy("trace", "step").collect():
        got.setdefault(r["trace"], []).append(r["state"])
    assert got == {k: v[1] for k, v in want.items() if v} and None in want.values()
    assert lattice.sequence(em.where("false"), tr).count() == 0


SEGMENT = "sid long, ax double, ay double, bx double, by double, src long, dst long, length_m double"


def costs_by_hand(near, source):
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        cost, node = heapq.heappop(heap)
        if cost == best[node]:
            for to, w in near[node]:
                if cost + w < best.get(to, math.inf):
                    best[to] = cost + w
                    heapq.heappush(heap, (cost + w, to))
    return best


def grid(size):
    """Streets of about 111 m both ways, some missing."""
    rng = random.Random(6)
    node = {(x, y): y * size + x for x in range(size) for y in range(size)}
    segments = []
    for (x, y), a in node.items():
        for u, v in ((x + 1, y), (x, y + 1)):
            if (u, v) in node and rng.random() < 0.85:
                segments.append((len(segments), x * 0.001, y * 0.001, u * 0.001, v * 0.001, a, node[u, v], 111.2 + rng.randrange(5)))
    return segments


def match_by_hand(points, segments, near, radius=50.0, sigma=15.0, beta=30.0):
    """(length, segments) of a trace by searches over the whole network; the grid lies at the equator."""
    metre = 111194.926644559
    dist = lambda p, q: metre * math.hypot(p[0] - q[0], p[1] - q[1])
    rows = []
    for p in points:
        found = []
        for sid, ax, ay, bx, by, a, b, m in segments:
            f = min(1.0, max(0.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            place = (ax + f * (bx - ax), ay + f * (by - ay))
            if (d := dist(p, place)) <= radius:
                found.append((round(d, 3), sid, place, [(a, f * m), (b, (1 - f) * m)], f, m))
        if found:
            rows.append((p, sorted(found)[:5]))
    known = {}

    def route(c, d, limit=math.inf):
        if c[1] == d[1]:
            return abs(c[4] - d[4]) * c[5]
        ways = []
        for a, left in c[3]:
            if a not in known:
                known[a] = costs_by_hand(near, a)
            ways += [left + known[a][b] + rest for b, rest in d[3] if left + known[a].get(b, math.inf) <= limit]
        return min(ways, default=math.inf)

    score, backs = [-0.5 * (c[0] / sigma) ** 2 for c in rows[0][1]], []
    for (p, cs), (q, ds) in zip(rows, rows[1:]):
        straight = dist(p, q)
        following, back = [], []
        for d in ds:
            totals = [s - abs(r - straight) / beta if (r := route(c, d, 10 * straight + 2000)) < math.inf else -math.inf for s, c in zip(score, cs)]
            if max(totals) == -math.inf:
                totals = [s + mapmatch.BREAK for s in score]
            back.append(totals.index(max(totals)))
            following.append(max(totals) - 0.5 * (d[0] / sigma) ** 2)
        score = following
        backs.append(back)
    at = [score.index(max(score))]
    for back in reversed(backs):
        at.append(back[at[-1]])
    chosen = [cs[k] for (_, cs), k in zip(rows, reversed(at))]
    length = sum(r if c[1] != d[1] and (r := route(c, d)) < math.inf else dist(c[2], d[2]) for c, d in zip(chosen, chosen[1:]))
    return length, [c[1] for c in chosen]


@pytest.mark.parametrize("block_nodes", [4096, 20])
def test_match_by_hand(spark, block_nodes):
    segments = grid(9)
    near = {n: [] for n in range(81)}
    for _, _, _, _, _, a, b, m in segments:
        near[a].append((b, m))
        near[b].append((a, m))
    rng = random.Random(1)
    traces = {}
    for trace in range(8):
        x, y = rng.random() * 0.006, rng.random() * 0.006
        traces[trace] = [(x := x + rng.gauss(0.0003, 0.0003), y := y + rng.gauss(0.0002, 0.0003)) for _ in range(15)]
    pts = spark.createDataFrame([(t, i, *p) for t, ps in traces.items() for i, p in enumerate(ps)], "trace long, seq long, lon double, lat double")
    edges = spark.createDataFrame([(a, b, w) for a, own in near.items() for b, w in own], "src long, dst long, w double")
    got = {r["trace"]: r for r in mapmatch.match(pts, spark.createDataFrame(segments, SEGMENT), edges, block_nodes=block_nodes).collect()}
    for trace, points in traces.items():
        length, sids = match_by_hand(points, segments, near)
        assert [s["sid"] for s in got[trace]["snapped"]] == sids
        assert got[trace]["length_m"] == pytest.approx(length, abs=0.2)
        line = [(p["x"], p["y"]) for p in got[trace]["geometry"]]
        assert sum(111194.926644559 * math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(line, line[1:])) == pytest.approx(length, rel=0.05, abs=5)


def test_broken_step_follows_the_network_without_a_limit(spark):
    """Two streets that only a way of 140 km joins; a third isn't joined at all."""
    segments = [(1, 0.0, 0.0, 0.001, 0.0, 0, 1, 111.2), (2, 0.002, 0.0, 0.003, 0.0, 2, 3, 111.2), (3, 0.001, 0.0, 0.001, 0.6, 1, 4, 70_000.0), (4, 0.001, 0.6, 0.002, 0.0, 4, 2, 70_000.0), (5, 0.005, 0.0, 0.006, 0.0, 8, 9, 111.2)]
    edges = [(s[5], s[6], s[7]) for s in segments] + [(s[6], s[5], s[7]) for s in segments]
    pts = [(0, 0, 0.0005, 0.0), (0, 1, 0.0025, 0.0), (0, 2, 0.0055, 0.0)]
    got = mapmatch.match(spark.createDataFrame(pts, "trace long, seq long, lon double, lat double"), spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(edges, "src long, dst long, w double"), k=1, block_nodes=2).first()
    assert [s["sid"] for s in got["snapped"]] == [1, 2, 5]
    assert got["length_m"] == pytest.approx(140_000 + 111.2 + 333.6, abs=1)
    assert [(p["x"], p["y"]) for p in got["geometry"]] == [(0.0005, 0.0), (0.001, 0.0), (0.001, 0.6), (0.002, 0.0), (0.0025, 0.0), (0.0055, 0.0)]


def test_od_table(spark):
    rng = random.Random(3)
    edges = [(a, b, float(rng.randrange(1, 9))) for a in range(60) for b in (a + 1, a + 7, a - 1) if 0 <= b < 60]
    near = {n: [(b, w) for a, b, w in edges if a == n] for n in range(60)}
    pairs = [(rng.randrange(60), rng.randrange(60), float(rng.choice([5, 20, 100]))) for _ in range(80)]
    table, reached = mapmatch.od_table(spark.createDataFrame(pairs, "src long, dst long, most double"), overlay.with_blocks(spark.createDataFrame(edges, "src long, dst long, w double"), 11), 11)
    most = {}
    for s, _, m in pairs:
        most[s] = max(m, most.get(s, 0))
    want = {(s, d): c for s, d, _ in pairs if (c := costs_by_hand(near, s)[d]) <= most[s]}
    got = {(r["src"], r["dst"]): r["cost"] for r in table.collect()}
    assert got == want
    found = {(r["src"], r["dst"]): r["nodes"] for r in mapmatch.ways(table, reached, 3).collect()}
    weight = {(a, b): w for a, b, w in edges}
    for (s, d), nodes in found.items():
        assert sum(weight[x] for x in zip([s, *nodes], nodes)) == want[s, d] and [s, *nodes][-1] == d


def test_short_traces_are_solved_together(spark):
    """One task takes many short traces, and finds what the piece-wise kernel finds: ties, gaps and dead ends included."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    for _ in range(60):
        e = pd.DataFrame([(tr * 7, s, q * 3, -int(rng.integers(4))) for tr in range(5) for s in range(1 + tr) if rng.random() > 0.05 for q in rng.permutation(5)[: rng.integers(1, 4)]], columns=["trace", "step", "state", "e"])
        t = pd.DataFrame([(tr * 7, s, a * 3, b * 3, -int(rng.integers(3))) for tr in range(5) for s in range(1 + tr) for a in range(5) for b in range(5) if rng.random() < 0.6], columns=["trace", "step", "state_from", "state_to", "t"])
        want = []
        for trace in sorted(set(e["trace"])):
            steps = lattice._into(e[e["trace"] == trace], t[t["trace"] == trace])
            found = lattice._followed(steps, {lattice.START: 0}) if [s for s, _ in steps] == list(range(len(steps))) else []
            want += [(trace, *f) for f in found]
        trace, step, state, _, back, at = lattice._forward(e, t)
        got = []
        while len(at):
            got += [(int(trace[i]), int(step[i]), int(state[i])) for i in at]
            at = back[at][back[at] >= 0]
        assert sorted(got) == sorted(want)


def test_a_place_is_asked_once(spark, monkeypatch):
    """Points that share a place are joined with segments once, whatever their traces; no two of a level are mixed."""
    asked, plain = [], joins.place_segments
    monkeypatch.setattr(joins, "place_segments", lambda q, *a, **k: asked.append(q.count()) or plain(q, *a, **k))
    edge = [(1, 116.0, 39.9, 116.001, 39.9, 0, 1, 85.0, 0, 0), (2, 116.001, 39.9, 116.002, 39.9, 1, 2, 85.0, 0, 0), (3, 116.0, 39.9, 116.001, 39.9, 3, 4, 85.0, 1, 1)]
    segments = spark.createDataFrame(edge, "sid long, ax double, ay double, bx double, by double, src long, dst long, length_m double, alevel smallint, blevel smallint")
    edges = segments.selectExpr("src", "dst", "length_m as w").union(segments.selectExpr("dst", "src", "length_m as w"))
    xs = [116.0002, 116.0008, 116.0014, 116.0008]
    pts = spark.createDataFrame([(t, i, x, 39.90005, 1 if t == 7 else 0) for t in range(30) for i, x in enumerate(xs)], "trace long, seq long, lon double, lat double, level smallint")
    got = mapmatch.match_steps(pts, segments, edges).groupBy("trace").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("sid")).alias("sids")).collect()
    assert {r["trace"]: (r["n"], r["sids"]) for r in got} == {t: (4, [3]) if t == 7 else (4, [1, 2]) for t in range(30)}
    near = joins.nearby_segments(pts.select((F.col("trace") * 10 + F.col("seq")).alias("qid"), "lon", "lat"), segments.drop("alevel", "blevel"), 50.0)
    assert near.where("qid % 10 = 1").select("rank", "sid").distinct().count() == 3 and near.where("qid % 10 = 1").count() == 90
    assert asked == [6, 3]  # 120 points before
