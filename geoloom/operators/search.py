"""Shortest paths: a local kernel over a broadcast network for tables of requests, and an iterative relational form for
networks too large for that."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import measure

from . import overlay
from .features import UserError

#: Edges of a network that may be broadcast (about 40 bytes each).
MAX_EDGES = 4_000_000
#: Nodes of a block, and requests of a portion, in ``relax``.
BLOCK_NODES, BLOCK_REQUESTS = 20_000, 256


def great_circle(lon1, lat1, lon2, lat2):
    """Metres between positions in degrees; arrays or numbers."""
    x1, y1, x2, y2 = (np.radians(v) for v in (lon1, lat1, lon2, lat2))
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * measure.EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


class Graph:
    """Adjacency in arrays: edges of node i are first[i] to first[i + 1]; edge numbers follow the input's order."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int | None = None, extra: dict | None = None):
        self.n = int(n if n is not None else max(src.max(initial=-1), dst.max(initial=-1)) + 1)
        order = np.lexsort((np.arange(len(src)), src))
        self.edge = order
        self.dst, self.weight = dst[order], weight[order]
        self.first = np.searchsorted(src[order], np.arange(self.n + 1))
        self.src_of, self.dst_of = src, dst
        self.extra = extra or {}

    @classmethod
    def collect(cls, edges: DataFrame, weight: str = "w", n: int | None = None, order: list[str] | None = None, extra: list[str] = ()) -> "Graph":
        """Brings a network of bounded size to the driver."""
        size = edges.count()
        if size > MAX_EDGES:
            raise UserError(f"the network has {size} edges; up to {MAX_EDGES} can be broadcast: use relax()")
        pdf = edges.select("src", "dst", F.col(weight).alias("__w"), *extra, *[c for c in (order or []) if c not in ("src", "dst", *extra)]).toPandas()
        pdf = pdf.sort_values([*(order or []), "src", "dst", "__w"], kind="stable").reset_index(drop=True)
        return cls(pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64), pdf["__w"].to_numpy(), n, {c: pdf[c].to_numpy() for c in extra})

    def search(self, seeds, cutoff: float = float("inf"), target: int = -1, weight: np.ndarray | None = None, targets: set[int] | None = None):
        """Costs and predecessor edges of the nodes reached from seeds [(node, cost)]: {node: (cost, edge)}. Ties settle
        by node, then by edge. With targets the search ends once all of them are settled; their costs and paths are final."""
        weights = self.weight if weight is None else weight
        best: dict[int, tuple] = {}
        heap = []
        for node, cost in seeds:
            if cost <= cutoff and (node not in best or cost < best[node][0]):
                best[node] = (cost, -1)
                heapq.heappush(heap, (cost, node))
        done, open_ = set(), set(targets) if targets is not None else None
        while heap:
            cost, node = heapq.heappop(heap)
            if node in done or cost > best[node][0]:
                continue
            done.add(node)
            if node == target:
                break
            if open_ is not None:
                open_.discard(node)
                if not open_:
                    break
            for k in range(self.first[node], self.first[node + 1]):
                to, total = int(self.dst[k]), cost + weights[k]
                if total <= cutoff and to not in done and (to not in best or total < best[to][0]):
                    best[to] = (total, int(self.edge[k]))
                    heapq.heappush(heap, (total, to))
        return best

    def rate(self, lon: np.ndarray, lat: np.ndarray, weight: np.ndarray | None = None) -> float:
        """The smallest cost of an edge for each metre between its ends, over edges whose ends lie apart; positions are the
        nodes'. Every path costs at least its ends' distance times this rate, connectors with a fixed time included."""
        weights = self.weight if weight is None else weight
        src = np.repeat(np.arange(self.n), np.diff(self.first))
        apart = great_circle(lon[src], lat[src], lon[self.dst], lat[self.dst])
        own = apart > 1e-6
        return float((np.asarray(weights, float)[own] / apart[own]).min(initial=np.inf)) * (1 - 1e-9) if own.any() else 0.0

    def astar(self, src: int, target: int, lon: np.ndarray, lat: np.ndarray, rate: float, weight: np.ndarray | None = None):
        """Like ``search`` from src until target is settled, guided by the distance to target times ``rate``: costs and
        paths to the target are those of the plain search, with fewer nodes settled."""
        weights = self.weight if weight is None else weight
        best, done, left = {src: (0.0, -1)}, set(), {}

        def rest(node: int) -> float:
            if node not in left:
                left[node] = rate * float(great_circle(lon[node], lat[node], lon[target], lat[target]))
            return left[node]

        heap = [(rest(src), 0.0, src)]
        while heap:
            _, cost, node = heapq.heappop(heap)
            if node in done or cost > best[node][0]:
                continue
            done.add(node)
            if node == target:
                break
            for k in range(self.first[node], self.first[node + 1]):
                to, total = int(self.dst[k]), cost + weights[k]
                if to not in done and (to not in best or total < best[to][0]):
                    best[to] = (total, int(self.edge[k]))
                    heapq.heappush(heap, (total + rest(to), total, to))
        return {n: best[n] for n in done}

    def path(self, best: dict, target: int) -> list[int]:
        """Edge numbers from a seed to target."""
        out = []
        while best[target][1] >= 0:
            out.append(best[target][1])
            target = int(self.src_of[out[-1]])
        return out[::-1]


def reach(requests: DataFrame, graph: Graph, cutoff: float = float("inf"), cost_type: str = "bigint") -> DataFrame:
    """(req, node, cost) of all nodes within the cutoff for requests (req, seeds: array of (node, cost))."""
    shared = requests.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        for pdf in batches:
            for req, seeds in zip(pdf["req"], pdf["seeds"]):
                got = shared.value.search([(int(s["node"]), s["cost"]) for s in seeds], cutoff)
                yield pd.DataFrame({"req": req, "node": list(got), "cost": [c for c, _ in got.values()]})

    return requests.select("req", "seeds").mapInPandas(run, f"req bigint, node bigint, cost {cost_type}")


def shortest(requests: DataFrame, graph: Graph, cost_type: str = "bigint") -> DataFrame:
    """(req, cost, nodes) for requests (req, src, dst); no row where dst can't be reached."""
    shared = requests.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        g = shared.value
        for pdf in batches:
            out = []
            for req, src, dst in zip(pdf["req"], pdf["src"], pdf["dst"]):
                got = g.search([(int(src), 0)], target=int(dst))
                if int(dst) in got:
                    edges = g.path(got, int(dst))
                    out.append((req, got[int(dst)][0], [int(src), *(int(g.dst_of[e]) for e in edges)]))
            yield pd.DataFrame(out, columns=["req", "cost", "nodes"])

    return requests.select("req", "src", "dst").mapInPandas(run, f"req bigint, cost {cost_type}, nodes array<bigint>")


def relax(seeds: DataFrame, edges: DataFrame, block_nodes: int = BLOCK_NODES, block_requests: int = BLOCK_REQUESTS) -> DataFrame:
    """(req, node, cost) from seeds (req, node, cost) over edges (src, dst, w), for networks of any size.

    Nodes are dealt into blocks by ranges of their ids (numbered by place, blocks are regions), and costs go up from the
    seeds' blocks to wider ones and down again (``overlay``): the rounds count the levels of blocks, not the blocks that
    paths cross, and no task holds more than a block and a portion of the requests."""
    return overlay.costs(overlay.build(edges, block_nodes, portion_of=block_requests), seeds)
