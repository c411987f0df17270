"""Routes against all orders, splines against their defining conditions, durations against the limits, close-ups."""

from __future__ import annotations

import itertools

import numpy as np

from siteview.operators import measures, rays, routes


def _length(p):
    return float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum())


def test_routes_are_near_the_best_order(spark):
    rng = np.random.default_rng(6)
    sets = {m: rng.uniform(-50, 50, (n, 3)) for m, n in ((1, 7), (2, 6), (3, 2), (4, 1))} | {5: np.zeros((4, 3))}
    points = spark.createDataFrame([(m, k, *map(float, x)) for m, p in sets.items() for k, x in enumerate(p)], "mission_id int, seq int, e double, n double, u double")
    got = {}
    for r in routes.route_missions(points).orderBy("mission_id", "visit").collect():
        got.setdefault(r.mission_id, []).append(r.seq)
    for m, p in sets.items():
        assert sorted(got[m]) == list(range(len(p))) and got[m][0] == 0
        best = min(_length(p[[0, *o]]) for o in itertools.permutations(range(1, len(p)))) if len(p) > 1 else 0.0
        assert _length(p[got[m]]) <= best * 1.1 + 0.01
    assert routes.route_missions(points.limit(0)).count() == 0


def test_splines_and_durations(spark):
    rng = np.random.default_rng(8)
    x = np.array([0.0, 0.2, 0.5, 0.6, 1.0])
    y = rng.normal(size=(5, 3))
    assert np.allclose(routes._spline(x, y, x), y)
    step = 1e-4
    bend = lambda t: (routes._spline(x, y, t + step) - 2 * routes._spline(x, y, t) + routes._spline(x, y, t - step)) / step**2
    assert np.abs(bend(np.array([2 * step, 1 - 2 * step]))).max() < 0.5
    for k in x[1:-1]:
        a, b = bend(np.array([k - 2 * step])), bend(np.array([k + 2 * step]))
        assert np.abs(a - b).max() < 1e-2 * max(1, np.abs(a).max())
    rows = [(1, k, *map(float, rng.uniform(-60, 60, 3)), 5.0) for k in range(6)] + [(2, 0, 1.0, 2.0, 3.0, 5.0), (3, 0, 0.0, 0.0, 5.0, 5.0), (3, 1, 30.0, 0.0, 5.0, 5.0), (3, 2, 30.0, 0.0, 5.0, 5.0)]
    waypoints = spark.createDataFrame(rows, "mission_id int, seq int, e double, n double, u double, speed double")
    smooth = routes.fit_trajectories(waypoints).cache()
    line = [r for r in smooth.where("mission_id = 3").orderBy("s_idx").collect()]
    assert len(line) == 600 and (line[0].e, line[-1].e) == (0.0, 30.0) and max(abs(r.n) for r in line) < 1e-9
    assert [(r.e, r.n, r.u) for r in smooth.where("mission_id = 2").collect()] == [(1.0, 2.0, 3.0)]
    times = {r.mission_id: r for r in routes.time_scale(smooth).collect()}
    assert times.keys() == {1, 2, 3} and times[2].duration == 1.0 and abs(times[3].length - 30) < 1e-6
    for m in (1, 3):
        part = smooth.where(f"mission_id = {m}").withColumnRenamed("s_idx", "seq")
        summary = measures.trajectory_summary(part, times[m].duration / 599)
        assert measures.within_limits(summary, 15.0, 5.0, 10.0).count() == 1


def test_closeups_take_the_first_clear_position(spark):
    wall = [(1, i, 24, k) for i in range(18, 31) for k in range(8)]
    occupied = spark.createDataFrame(wall, "site_id int, i int, j int, k int")
    frontier = spark.createDataFrame([(1, 24, 24, 4), (2, 5, 5, 5)], "site_id int, i int, j int, k int")
    got = {r.site_id: r for r in rays.generate_closeups(frontier, occupied).collect()}
    # along the wall (azimuth 0) cells block the view of the first candidates; the empty site is clear at once
    assert got[1].resolved and got[1].candidate_rank > 0 and abs(got[1].cn - 1.0) > 2
    assert got[2].resolved and got[2].candidate_rank == 0
    boxed = spark.createDataFrame([(1, i, j, k) for i in range(20, 29) for j in range(20, 29) for k in range(0, 9)], "site_id int, i int, j int, k int")
    none = rays.generate_closeups(frontier.where("site_id = 1"), boxed).first()
    assert not none.resolved and none.ce is None
