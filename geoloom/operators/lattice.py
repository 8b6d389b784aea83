"""Best state sequences of hidden-Markov lattices of any length, by products of step matrices in the (max, +) semiring.

A trace is cut into pieces of steps. A piece's matrix has the best total from each state before it to each of its last
states; products of matrices are associative, so pieces are multiplied in a tree of groups of FAN, each a task of its own.
A second pass goes back down: every group learns the totals it starts with and the state it has to end in, finds both for
its members, and at last each piece follows its own back-pointers. No group holds more than a piece, or FAN matrices.

Ties take the smaller state. A state that no transition reaches ends there; a trace whose steps can't all be passed, or in
which a step is missing, has no sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as cc

#: Steps of a piece, and matrices multiplied by one task.
PIECE, FAN = 1024, 64
#: Transitions of the short traces (of one piece) that one task solves together, about.
TOGETHER = 400_000
#: The state before a trace, and both states in the one row of a matrix that no way passes.
START, NONE = -1, -2


def _into(emissions: pd.DataFrame, transitions: pd.DataFrame) -> list[tuple[int, dict[int, list]]]:
    """(step, {state: [(state before, weight)]}) of a piece's steps in order; a trace's first step comes from START."""
    e: dict[int, dict] = {}
    for step, state, w in zip(emissions["step"].tolist(), emissions["state"].tolist(), emissions["e"].tolist()):
        e.setdefault(step, {})[state] = w
    moves: dict[int, dict[int, list]] = {s: {} for s in e}
    for state, w in e.get(0, {}).items():
        moves[0][state] = [(START, w)]
    for step, a, b, w in zip(*(transitions[c].tolist() for c in ("step", "state_from", "state_to", "t"))):
        if b in e.get(step, ()):
            moves[step].setdefault(b, []).append((a, w + e[step][b]))
    return sorted(moves.items())


def _rows(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["trace", "piece", "i", "j", "w"])


def _multiplied(trace: int, piece: int, steps: list[dict[int, list]]) -> list[tuple]:
    """Rows of the product of steps {state: [(state before, weight)]}."""
    total: dict[int, dict] | None = None  # state: {state before all of them: total}
    for step in steps:
        after: dict[int, dict] = {}
        for b, ways in step.items():
            best: dict = {}
            for a, w in ways:
                for i, t in ({a: 0} if total is None else total.get(a, {})).items():
                    if i not in best or t + w > best[i]:
                        best[i] = t + w
            if best:
                after[b] = best
        total = after
    return [(trace, piece, i, j, w) for j, row in (total or {}).items() for i, w in row.items()] or [(trace, piece, NONE, NONE, 0)]


def _matrices(emissions: DataFrame, transitions: DataFrame, totals: str) -> DataFrame:
    """(trace, piece, i, j, w) of each piece."""

    def run(key, e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        steps = _into(e, t)
        whole = [s for s, _ in steps] == list(range(key[1] * PIECE, key[1] * PIECE + len(steps)))
        return _rows(_multiplied(*key, [m for _, m in steps] if whole else [{}]) if steps else [])

    return _by_piece(emissions, transitions).applyInPandas(run, f"trace bigint, piece bigint, i bigint, j bigint, w {totals}")


def _by_piece(emissions: DataFrame, transitions: DataFrame):
    piece = F.floor(F.col("step") / PIECE).alias("piece")
    e = emissions.select("trace", piece, "step", "state", "e").groupBy("trace", "piece")
    return e.cogroup(transitions.select("trace", piece, "step", "state_from", "state_to", "t").groupBy("trace", "piece"))


def _steps(parts: pd.DataFrame) -> list[tuple[int, dict[int, list]]]:
    """(piece, {state: [(state before, weight)]}) of matrices in order."""
    steps: dict[int, dict[int, list]] = {}
    for p, i, j, w in zip(*(parts[c].tolist() for c in ("piece", "i", "j", "w"))):
        own = steps.setdefault(p, {})
        if i != NONE:
            own.setdefault(j, []).append((i, w))
    return sorted(steps.items())


def _levels(first: DataFrame, pieces: int, totals: str) -> list[DataFrame]:
    """The matrices of pieces, of groups of them, and so on up to one for each trace."""

    def run(key, parts: pd.DataFrame) -> pd.DataFrame:
        steps = _steps(parts)
        whole = [p for p, _ in steps] == list(range(key[1] * FAN, key[1] * FAN + len(steps)))
        return _rows(_multiplied(*key, [m for _, m in steps] if whole else [{}]))

    levels = [cc.cut(first, "matrices")]
    while pieces > 1:
        up = levels[-1].groupBy("trace", F.floor(F.col("piece") / FAN).alias("up")).applyInPandas(run, f"trace bigint, piece bigint, i bigint, j bigint, w {totals}")
        levels.append(cc.cut(up, "matrices"))
        pieces = -(-pieces // FAN)
    return levels


def _pieces(emissions: DataFrame) -> int:
    last = emissions.agg(F.max("step").alias("s")).first()["s"]
    return 0 if last is None else last // PIECE + 1


def _kind(emissions: DataFrame) -> str:
    return "bigint" if dict(emissions.dtypes)["e"] in ("bigint", "int") else "double"


def _best(top: DataFrame) -> DataFrame:
    found = top.where(F.col("i") == START)
    return found.groupBy("trace").agg(F.max(F.struct("w", (-F.col("j")).alias("j"))).alias("b")).select("trace", F.col("b.w").alias("score"), (-F.col("b.j")).alias("state"))


def _forward(e: pd.DataFrame, t: pd.DataFrame):
    """(trace codes, steps, states, totals, place of the best state before or -1, whether reached) of the states of whole
    traces, in order of step, trace and state, and the places of the states in which the traces with a sequence end."""
    e = e.drop_duplicates(["trace", "step", "state"], keep="last")
    traces, code = np.unique(e["trace"].to_numpy(), return_inverse=True)
    states, rank = np.unique(e["state"].to_numpy(), return_inverse=True)
    step = e["step"].to_numpy().astype(np.int64)
    key = lambda s, c, r: (s * len(traces) + c) * len(states) + r
    order = np.argsort(own := key(step, code, rank))
    own, step, code, rank, gain = own[order], step[order], code[order], rank[order], e["e"].to_numpy()[order]

    def found(all_, values):
        at = np.minimum(np.searchsorted(all_, values), len(all_) - 1)
        return at, all_[at] == values

    tc, ok = found(traces, t["trace"].to_numpy())
    fr, known = found(states, t["state_from"].to_numpy())
    to, both = found(states, t["state_to"].to_numpy())
    ts = t["step"].to_numpy().astype(np.int64)
    a, before = found(own, key(ts - 1, tc, fr))
    b, after = found(own, key(ts, tc, to))
    keep = ok & known & both & before & after & (ts > 0)
    a, b, w = a[keep], b[keep], t["t"].to_numpy()[keep]
    by = np.lexsort((a, b))  # smaller states come first
    a, b, w = a[by], b[by], w[by]
    w = w + gain[b]
    total, back, reached = gain.copy(), np.full(len(own), -1), step == 0
    last = int(step.max())
    bounds = np.searchsorted(step[b], np.arange(last + 2))
    for s in range(1, last + 1):
        i, j, v = a[bounds[s] : bounds[s + 1]], b[bounds[s] : bounds[s + 1]], w[bounds[s] : bounds[s + 1]]
        open_ = reached[i]
        i, j, v = i[open_], j[open_], v[open_]
        if len(i):
            v = total[i] + v
            first = np.flatnonzero(np.diff(j, prepend=-1))
            top = np.maximum.reduceat(v, first)
            best = np.flatnonzero(v == np.repeat(top, np.diff(first, append=len(j))))
            best = best[np.diff(j[best], prepend=-1) != 0]  # of equal ways the first
            total[j[best]], back[j[best]], reached[j[best]] = v[best], i[best], True
    # steps without a gap, and the end among the states of the last one
    ends = np.zeros(len(traces), np.int64)
    np.maximum.at(ends, code, step)
    steps = np.bincount(code[np.flatnonzero(np.diff(step * len(traces) + code, prepend=-1))], minlength=len(traces))
    at = np.flatnonzero(reached & (step == ends[code]) & (steps == ends + 1)[code])
    at = at[np.lexsort((rank[at], -total[at], code[at]))]
    at = at[np.diff(code[at], prepend=-1) != 0]
    return traces[code], step, states[rank], total, back, at


def _together(emissions: DataFrame, transitions: DataFrame, run, schema: str) -> DataFrame:
    """What run makes of the emissions and transitions of many whole traces at once."""
    portions = max(-(-transitions.count() // TOGETHER), 1)
    portion = F.pmod(F.xxhash64(F.col("trace").cast("bigint")), F.lit(portions)).alias("portion")
    e = emissions.select(portion, "trace", "step", "state", "e").groupBy("portion")
    t = transitions.select(portion, "trace", "step", "state_from", "state_to", "t").groupBy("portion")
    return e.cogroup(t).applyInPandas(lambda e, t: run(*_forward(e, t)) if len(e) else run(*[np.zeros(0, np.int64)] * 6), schema)


def best(emissions: DataFrame, transitions: DataFrame) -> DataFrame:
    """(trace, score, state): the best total of a state sequence per trace and its last state, from emissions (trace,
    step, state, e) and transitions (trace, step, state_from, state_to, t) into each step; steps count from 0."""
    emissions, transitions = cc.cut(emissions, "emissions"), cc.cut(transitions, "transitions")
    totals, pieces = _kind(emissions), _pieces(emissions)
    if pieces <= 1:  # all traces are short: no matrices are needed

        def ends(trace, step, state, total, back, at) -> pd.DataFrame:
            return pd.DataFrame({"trace": trace[at], "score": total[at], "state": state[at]})

        return _together(emissions, transitions, ends, f"trace bigint, score {totals}, state bigint")
    return _best(_levels(_matrices(emissions, transitions, totals), pieces, totals)[-1])


def _followed(moves: list[tuple[int, dict[int, list]]], at: dict, here: int | None = None) -> list[tuple[int, int]]:
    """(step, state) of the best way through steps from totals at, the last step first; here is the state to end in."""
    backs = []
    for _, m in moves:
        back = {b: min((-(at[a] + w), a) for a, w in ways if a in at) for b, ways in m.items() if any(a in at for a, _ in ways)}
        at = {b: -v for b, (v, _) in back.items()}
        backs.append({b: a for b, (_, a) in back.items()})
    if not at:
        return []
    here, out = min((-v, s) for s, v in at.items())[1] if here is None else here, []
    for (step, _), back in zip(reversed(moves), reversed(backs)):
        out.append((step, here))
        here = back[here]
    return out


def sequence(emissions: DataFrame, transitions: DataFrame) -> DataFrame:
    """(trace, step, state) of the best sequence of each trace."""
    emissions, transitions = cc.cut(emissions, "emissions"), cc.cut(transitions, "transitions")
    totals, pieces, shape = _kind(emissions), _pieces(emissions), "trace bigint, step int, state bigint"
    if pieces <= 1:  # all traces are short: no matrices are needed

        def follow_all(trace, step, state, total, back, at) -> pd.DataFrame:
            taken = []
            while len(at):
                taken.append(at)
                at = back[at]
                at = at[at >= 0]
            taken = np.concatenate([np.zeros(0, np.int64), *taken])
            return pd.DataFrame({"trace": trace[taken], "step": step[taken], "state": state[taken]})

        return _together(emissions, transitions, follow_all, shape)
    levels = _levels(_matrices(emissions, transitions, totals), pieces, totals)
    end = _best(levels[-1])
    # what each piece starts with: totals of states before it (ends false), and the state it ends in (ends true)
    zero = F.lit(0).cast(totals)
    known = end.select("trace", F.lit(0).cast("bigint").alias("piece"), F.lit(START).cast("bigint").alias("state"), zero.alias("w"), F.lit(False).alias("ends"))
    known = known.unionByName(end.select("trace", F.lit(0).cast("bigint").alias("piece"), "state", zero.alias("w"), F.lit(True).alias("ends")))

    def down(key, parts: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(start):
            steps = _steps(parts)
            at = [dict(start.loc[~start["ends"], ["state", "w"]].itertuples(index=False, name=None))]
            for _, m in steps:
                at.append({b: max(at[-1][a] + w for a, w in ways if a in at[-1]) for b, ways in m.items() if any(a in at[-1] for a, _ in ways)})
            end = int(start.loc[start["ends"], "state"].iloc[0])
            for (p, m), before in zip(reversed(steps), reversed(at[:-1])):
                out += [(key[0], p, s, w, False) for s, w in before.items()] + [(key[0], p, end, 0, True)]
                end = min((-(before[a] + w), a) for a, w in m[end] if a in before)[1]
        return pd.DataFrame(out, columns=["trace", "piece", "state", "w", "ends"])

    for level in reversed(levels[:-1]):
        parents = known.withColumnRenamed("piece", "up").groupBy("trace", "up")
        found = level.groupBy("trace", F.floor(F.col("piece") / FAN).alias("up")).cogroup(parents).applyInPandas(down, f"trace bigint, piece bigint, state bigint, w {totals}, ends boolean")
        known = cc.cut(found, "known")

    def follow(key, e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        own = e["step"] < 0  # what the piece starts with and ends in, see below
        start, found = e[own], []
        if len(start):
            at = dict(start.loc[start["step"] == -1, ["state", "e"]].itertuples(index=False, name=None))
            found = _followed(_into(e[~own], t), at, int(start.loc[start["step"] == -2, "state"].iloc[0]))
        return pd.DataFrame([(key[0], *f) for f in found], columns=["trace", "step", "state"])

    piece = F.floor(F.col("step") / PIECE).alias("piece")
    told = known.select("trace", "piece", F.when(F.col("ends"), -2).otherwise(-1).alias("step"), "state", F.col("w").alias("e"))
    rows = emissions.select("trace", piece, F.col("step").cast("int"), F.col("state").cast("bigint"), F.col("e").cast(totals)).unionByName(told)
    moves = transitions.select("trace", piece, "step", "state_from", "state_to", "t").groupBy("trace", "piece")
    return rows.groupBy("trace", "piece").cogroup(moves).applyInPandas(follow, shape)
