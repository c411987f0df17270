"""Visit orders and smooth trajectories, one mission a group (G5-G7). After the selection (O1) a mission has tens of waypoints; visit
orders and splines hold the waypoints of one mission."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import measures, missions


#: Points that are ordered together where a caller leaves ``stretch`` as it is; the registered queries order missions whole.
STRETCH = 400


#: Distances that a task holds at a time, when it orders missions of equal size together.
HELD = 400_000


def _visits(p: np.ndarray) -> np.ndarray:
    """For each set of points (set, point, axis) an open path from point 0: nearest neighbours, then the best reversal or move of
    up to three points, all of them weighed at once, until none shortens the path. Distances are whole millimetres, so the path gets
    shorter each time."""
    d = np.rint(np.sqrt(((p[:, :, None] - p[:, None]) ** 2).sum(axis=3)) * 1000) / 1000
    many, n = p.shape[:2]
    every = np.arange(many)
    free, out = np.ones((many, n), bool), np.zeros((many, n), np.int64)
    free[:, 0] = False
    for k in range(1, n):
        out[:, k] = np.where(free, d[every, out[:, k - 1]], np.inf).argmin(axis=1)
        free[every, out[:, k]] = False
    if n <= 2:
        return out
    at, todo = np.arange(n), every
    below = np.tril_indices(n - 1, -1)
    while len(todo):
        order, one = out[todo], np.arange(len(todo))
        # row and column n stand for the open end, at no distance
        w = np.zeros((len(todo), n + 1, n + 1))
        w[:, :n, :n] = d[todo[:, None, None], order[:, :, None], order[:, None, :]]
        step = w[:, at, at + 1]  # from each place to the next
        turn = w[:, : n - 1, 1:n] + w[:, 1:n, 2:] - step[:, : n - 1, None] - step[:, None, 1:]
        turn[:, below[0], below[1]] = 0
        k = turn.reshape(len(todo), -1).argmin(axis=1)
        gain = turn.reshape(len(todo), -1)[one, k]
        best, turned = np.where(gain < -1e-9, gain, -1e-9), gain < -1e-9
        changed, a, b, c = turned.copy(), 1 + k // (n - 1), 1 + k % (n - 1), np.zeros(len(todo), np.int64)
        for more in range(min(3, n - 1)):
            x = np.arange(1, n - more)
            y = x + more
            closed = w[:, x - 1, y + 1] - step[:, x - 1] - step[:, y]
            put = closed[:, :, None] + w[:, :n][:, :, x].transpose(0, 2, 1) + w[:, y][:, :, 1:] - step[:, None, :]
            put[:, (at[None, :] >= x[:, None] - 1) & (at[None, :] <= y[:, None])] = 0
            k = put.reshape(len(todo), -1).argmin(axis=1)
            gain = put.reshape(len(todo), -1)[one, k]
            on = gain < best
            best, turned, changed = np.where(on, gain, best), turned & ~on, changed | on
            a, b, c = np.where(on, x[k // n], a), np.where(on, y[k // n], b), np.where(on, k % n, c)
        # the new order of the places: a stretch turned round, or put behind place c
        inner = (at >= a[:, None]) & (at <= b[:, None])
        turns = np.where(inner, (a + b)[:, None] - at, at).astype(float)
        moves = np.where(inner, c[:, None] + (at - a[:, None] + 1) / (n + 1), at)
        place = np.argsort(np.where(turned[:, None], turns, moves), axis=1, kind="stable")
        out[todo[changed]] = np.take_along_axis(order, place, axis=1)[changed]
        todo = todo[changed]
    return out


def _visit(p: np.ndarray) -> list[int]:
    return _visits(p[None])[0].tolist()


def _visit_long(p: np.ndarray) -> np.ndarray:
    """``_visits`` of one set of which all distances would be more than HELD: the same reversals and moves, weighed over the distances of
    some points at a time."""
    n = len(p)

    def far(some: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.rint(np.sqrt(((some[:, None] - to[None]) ** 2).sum(axis=2)) * 1000) / 1000

    free, order = np.ones(n, bool), np.zeros(n, np.int64)
    free[0] = False
    for k in range(1, n):
        order[k] = np.where(free, far(p[order[k - 1], None], p)[0], np.inf).argmin()
        free[order[k]] = False
    at, rows = np.arange(n), max(1, HELD // (n + 1))
    while True:
        q = p[order]
        step = np.append(np.rint(np.sqrt(((q[:-1] - q[1:]) ** 2).sum(axis=1)) * 1000) / 1000, 0.0)
        tries = min(3, n - 1)
        least, where = np.full(1 + tries, np.inf), np.zeros((1 + tries, 2), np.int64)
        for lo in range(0, n, rows):
            # row and column n stand for the open end, at no distance
            w = np.zeros((min(rows + 3, n + 1 - lo), n + 1))
            w[: min(len(w), n - lo), :n] = far(q[lo : lo + len(w)], q)
            some = np.arange(lo, min(lo + rows, n - 1))
            if len(some):
                turn = w[some - lo, 1:n] + w[some - lo + 1, 2:] - step[some, None] - step[None, 1:]
                turn[at[None, : n - 1] < some[:, None]] = 0
                k = int(turn.argmin())
                if turn.flat[k] < least[0]:
                    least[0], where[0] = turn.flat[k], (some[k // (n - 1)], k % (n - 1))
            for more in range(tries):
                x = np.arange(max(1, lo), min(lo + rows, n - more))
                if not len(x):
                    continue
                y = x + more
                ends = np.where(y + 1 < n, np.rint(np.sqrt(((q[x - 1] - q[np.minimum(y + 1, n - 1)]) ** 2).sum(axis=1)) * 1000) / 1000, 0.0)
                closed = ends - step[x - 1] - step[y]
                put = closed[:, None] + w[x - lo, :n] + w[y - lo, 1:] - step[None, :]
                put[(at[None, :] >= x[:, None] - 1) & (at[None, :] <= y[:, None])] = 0
                k = int(put.argmin())
                if put.flat[k] < least[1 + more]:
                    least[1 + more], where[1 + more] = put.flat[k], (x[k // n], k % n)
        kind, best = -1, -1e-9
        for k, gain in enumerate(least):
            if gain < best:
                kind, best = k, gain
        if kind < 0:
            return order
        if kind == 0:
            a, b = 1 + where[0]
            order[a : b + 1] = order[a : b + 1][::-1].copy()
        else:
            (a, c), b = where[kind], where[kind][0] + kind - 1
            place = np.where((at >= a) & (at <= b), c + (at - a + 1) / (n + 1), at)
            order = order[np.argsort(place, kind="stable")]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where the groups begin, of rows in order that mark a group's first row by ``_first``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
        if len(begins) and (held or begins[-1] > 0):
            rows = pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
            if rows.num_rows:
                yield rows, np.flatnonzero(rows.column("_first").to_numpy())
            held = [batch.slice(begins[-1])]
        else:
            held.append(batch)
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield rows, np.flatnonzero(rows.column("_first").to_numpy())


def _in_order(rows: DataFrame, every: int | None = None) -> DataFrame:
    """The rows, each mission in one partition by seq, its first row, and of ``every`` so many one, marked."""
    place = F.row_number().over(Window.partitionBy("mission_id").orderBy("seq")) - 1
    rows = rows.withColumn("_place", place).withColumn("_first", F.col("_place") % every == 0 if every else F.col("_place") == 0)
    return rows.repartition("mission_id").sortWithinPartitions("mission_id", "_place")


def _coordinates(rows: pa.Table, columns: str = "enu") -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy().astype(float) for c in columns])


def route_missions(points: DataFrame, stretch: int | None = STRETCH) -> DataFrame:
    """Adds visit, the place of each point in its mission's path. The path starts at the first point by seq, is open, and
    no reversal of a part and no move of up to three points shortens it. Missions of equal size are ordered together; of a long
    one, the distances of some points at a time are held, and the path is the same.

    With a ``stretch`` of None that holds for missions of any size. Else a mission of more points is cut into stretches of so
    many by seq, each a path of that kind from its own first point, flown one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole(batches):
            p, sizes = _coordinates(rows), np.diff(np.append(begins, rows.num_rows))
            order = np.empty(rows.num_rows, np.int64)
            for n in np.unique(sizes):
                of, most = begins[sizes == n], HELD // int(n + 1) ** 2
                for k in of if not most else ():
                    order[k : k + n] = k + _visit_long(p[k : k + n])
                for k in range(0, len(of), most) if most else ():
                    at = of[k : k + most, None] + np.arange(n)
                    order[at] = of[k : k + most, None] + _visits(p[at])
            out = rows.take(pa.array(order))
            yield from out.drop_columns(["_first", "_place"]).append_column("visit", rows.column("_place").cast(pa.int64())).to_batches()

    schema = ", ".join(f"`{c}` {t}" for c, t in points.dtypes) + ", visit long"
    return _in_order(points, stretch).mapInArrow(run, schema)


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (x, y), y with one column a coordinate."""
    h, n = np.diff(x)[:, None], len(x)
    bend = np.zeros_like(y)
    if n > 2:
        right = 6 * (np.diff(y[1:], axis=0) / h[1:] - np.diff(y[:-1], axis=0) / h[:-1])
        mid = 2 * (h[1:] + h[:-1])
        for k in range(1, n - 2):
            w = h[k] / mid[k - 1]
            mid[k] -= w * h[k]
            right[k] -= w * right[k - 1]
        for k in range(n - 3, -1, -1):
            bend[k + 1] = (right[k] - h[k + 1] * bend[k + 2]) / mid[k]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b, w = (x[k + 1] - at)[:, None], (at - x[k])[:, None], h[k]
    return bend[k] * a**3 / (6 * w) + bend[k + 1] * b**3 / (6 * w) + (y[k] / w - bend[k] * w / 6) * a + (y[k + 1] / w - bend[k + 1] * w / 6) * b


def fit_trajectories(waypoints: DataFrame, samples: int = 600) -> DataFrame:
    """(mission_id, s_idx, tau, e, n, u): a natural cubic spline over chord-length knots, sampled at equal steps of the
    time tau that start and end at rest. A mission at one place gives one sample; two places give a straight line."""
    kind = dict(waypoints.dtypes)["mission_id"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        knot, at = rows["knot"].to_numpy(float), rows[["e", "n", "u"]].to_numpy(float)
        keep = np.r_[True, np.any(np.diff(at, axis=0) != 0, axis=1) & (np.diff(knot) > 1e-12)]
        knot, at = knot[keep], at[keep]
        tau = np.arange(samples) / max(1, samples - 1) if len(at) > 1 else np.zeros(1)
        path = _spline(knot, at, knot[0] + (knot[-1] - knot[0]) * 0.5 * (1 - np.cos(np.pi * tau))) if len(at) > 1 else at
        return pd.DataFrame({"mission_id": rows["mission_id"].iloc[0], "s_idx": np.arange(len(tau)), "tau": tau, "e": path[:, 0], "n": path[:, 1], "u": path[:, 2]})

    rows = missions.arc_length_knots(waypoints).select("mission_id", "seq", "knot", "e", "n", "u")
    return rows.groupBy("mission_id").applyInPandas(one, f"mission_id {kind}, s_idx long, tau double, e double, n double, u double")


def time_scale(trajectories: DataFrame, samples: int = 600, cruise: float = 5.0, speed: float = 15.0, accel: float = 5.0, jerk: float = 10.0) -> DataFrame:
    """(mission_id, length, duration): seconds for which the largest finite differences keep within the limits. At k
    times the duration they are 1/k, 1/k^2 and 1/k^3 of what they were, so one rescaling by 1.05 k is enough."""
    rows = trajectories.withColumnRenamed("s_idx", "seq")
    top = measures.trajectory_summary(rows, 1.0 / (samples - 1))  # as if flown in one second
    full = missions.tour_length(rows).select("mission_id", "length").join(top, "mission_id")
    first = F.greatest(F.col("length") / max(cruise, 0.1), F.lit(1.0))
    over = F.greatest(F.col("max_speed") / first / speed, F.sqrt(F.col("max_accel") / accel) / first, F.cbrt(F.col("max_jerk") / jerk) / first)
    return full.select("mission_id", "length", F.when(over > 1, first * over * 1.05).otherwise(first).alias("duration"))


def _splines(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``_spline`` of many sets of equally many knots: x (set, knot), y (set, knot, axis), at (set, sample)."""
    h, n, one = np.diff(x, axis=1)[:, :, None], x.shape[1], np.arange(len(x))[:, None]
    bend = np.zeros_like(y)
    if n > 2:
        right = 6 * (np.diff(y[:, 1:], axis=1) / h[:, 1:] - np.diff(y[:, :-1], axis=1) / h[:, :-1])
        mid = 2 * (h[:, 1:] + h[:, :-1])
        for k in range(1, n - 2):
            w = h[:, k] / mid[:, k - 1]
            mid[:, k] -= w * h[:, k]
            right[:, k] -= w * right[:, k - 1]
        for k in range(n - 3, -1, -1):
            bend[:, k + 1] = (right[:, k] - h[:, k + 1] * bend[:, k + 2]) / mid[:, k]
    k = np.stack([np.clip(np.searchsorted(a, b, "right") - 1, 0, n - 2) for a, b in zip(x, at, strict=True)])
    a, b, w = (x[one, k + 1] - at)[:, :, None], (at - x[one, k])[:, :, None], h[one, k]
    return bend[one, k] * a**3 / (6 * w) + bend[one, k + 1] * b**3 / (6 * w) + (y[one, k] / w - bend[one, k] * w / 6) * a + (y[one, k + 1] / w - bend[one, k + 1] * w / 6) * b


def _slopes(path: np.ndarray, dt: float) -> np.ndarray:
    """``measures.finite_differences`` along axis 1."""
    out = np.empty_like(path)
    out[:, 1:-1] = (path[:, 2:] - path[:, :-2]) / (2 * dt)
    out[:, 0] = (-3 * path[:, 0] + 4 * path[:, 1] - path[:, 2]) / (2 * dt)
    out[:, -1] = (3 * path[:, -1] - 4 * path[:, -2] + path[:, -3]) / (2 * dt)
    return out


def scaled_durations(waypoints: DataFrame, samples: int = 600, cruise: float = 5.0, speed: float = 15.0, accel: float = 5.0, jerk: float = 10.0) -> DataFrame:
    """``time_scale`` of ``fit_trajectories``, with no row for a sample: the samples of some missions at a time are held by the
    task that fits them."""
    if samples < 3:
        raise ValueError("a trajectory has three samples or more")
    kind = dict(waypoints.dtypes)["mission_id"]
    ease = 0.5 * (1 - np.cos(np.pi * np.arange(samples) / (samples - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole(batches):
            knot, at = rows.column("knot").to_numpy().astype(float), _coordinates(rows)
            keep = np.r_[True, np.any(np.diff(at, axis=0) != 0, axis=1) & (np.diff(knot) > 1e-12)]
            keep[begins] = True
            group = np.cumsum(rows.column("_first").to_numpy())[keep] - 1
            knot, at = knot[keep], at[keep]
            starts, sizes = np.searchsorted(group, np.arange(len(begins))), np.bincount(group, minlength=len(begins))
            length, top = np.zeros(len(begins)), np.zeros((3, len(begins)))
            for n in np.unique(sizes[sizes > 1]):
                whole = np.flatnonzero(sizes == n)
                most = max(1, HELD // max(samples, int(n)))
                for k in range(0, len(whole), most):
                    some = whole[k : k + most]
                    of = starts[some, None] + np.arange(n)
                    x = knot[of]
                    path = _splines(x, at[of], x[:, :1] + (x[:, -1:] - x[:, :1]) * ease)
                    length[some] = np.sqrt((np.diff(path, axis=1) ** 2).sum(axis=2)).sum(axis=1)
                    for order in range(3):
                        path = _slopes(path, 1.0 / (samples - 1))
                        top[order, some] = np.sqrt((path**2).sum(axis=2)).max(axis=1)
            first = np.maximum(length / max(cruise, 0.1), 1.0)
            over = np.maximum(np.maximum(top[0] / first / speed, np.sqrt(top[1] / accel) / first), np.cbrt(top[2] / jerk) / first)
            yield from pa.table({"mission_id": rows.column("mission_id").take(pa.array(begins)), "length": length, "duration": np.where(over > 1, first * over * 1.05, first)}).to_batches()

    rows = missions.arc_length_knots(waypoints).select("mission_id", "seq", "knot", "e", "n", "u")
    return _in_order(rows).mapInArrow(run, f"mission_id {kind}, length double, duration double")
