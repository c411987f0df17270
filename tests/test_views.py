"""Closed forms and brute force for coverage, generators, measures and files; every query's SQL is tested in test_survey."""

from __future__ import annotations

import json
import math

import numpy as np

from siteview.operators import coverage, generators, measures
from siteview.plans import queries as Q
from siteview.sources import driver_tables as T
from siteview.sources import files


def test_plans_match_brute_force(spark):
    rng = np.random.default_rng(3)
    see = {(s, p): {int(c) for c in rng.integers(0, 40, 9)} for s in (1, 2) for p in range(8)}
    surface = spark.createDataFrame([(s, c, 0, 0) for s in (1, 2, 3) for c in range(40)], "site_id int, i int, j int, k int")
    visible = spark.createDataFrame([(s, p, c, 0, 0) for (s, p), cs in see.items() for c in cs] + [(1, 0, 99, 0, 0)], "site_id int, pose_id long, i int, j int, k int")
    poses = spark.createDataFrame([(s, p, p) for s in (1, 2) for p in range(8)], "site_id int, pose_id long, seq long")
    want = []
    for s in (1, 2):
        seen, k = set(), 0
        while len(seen) < 0.7 * 40:
            gain, p = max(((len(see[s, p] - seen), -p) for p in range(8)))
            if gain <= 0:
                break
            seen |= see[s, -p]
            want.append((s, k, -p, gain, len(seen) / 40))
            k += 1
    assert sorted(map(tuple, coverage.nbv_plan(poses, surface, visible, 0.7).collect())) == want
    mown = []
    for s in (1, 2):
        seen = set()
        for p in range(8):
            gain = len(see[s, p] - seen)
            seen |= see[s, p]
            mown.append((s, p, p, gain, len(seen) / 40))
            if len(seen) >= 0.6 * 40:
                break
    assert sorted(map(tuple, coverage.lawnmower_plan(poses, surface, visible, 0.6).collect())) == mown
    assert {r.site_id: r.coverage for r in coverage.coverage(surface, visible).collect()}[3] == 0
    assert coverage.nbv_plan(poses, surface.where("false"), visible).count() == 0
    sites = spark.range(1, 4).selectExpr("CAST(id AS INT) AS site_id")
    assert {r.recall for r in coverage.occlusion_recall(surface, surface.where("false"), sites).collect()} == {1.0}


def test_generators(spark):
    sites = spark.range(1).selectExpr("1 AS site_id", "20D AS height", "38D AS radius")
    rows = generators.survey_poses(sites).collect()
    assert len(rows) == 17 and {r.u for r in rows} == {80.0, 48.0}
    assert all(math.isclose(math.hypot(r.e, r.n), 41.8) for r in rows if r.kind == "oblique")
    cams = generators.survey_camera(spark.sql("SELECT 640 AS width, 480 AS height UNION ALL SELECT 60, 1")).collect()
    assert {(c.width, c.height) for c in cams} == {(120, 90), (60, 2)}
    tau = [r.tau for r in generators.ease_samples(sites, 5).collect()]
    assert np.allclose(tau, [0, 0.146447, 0.5, 0.853553, 1])
    normals = coverage.outward_normal(spark.sql("SELECT 3D AS e, 4D AS n, 1D AS u, 0D AS ce, 0D AS cn, 0D AS cu, 20D AS height UNION ALL SELECT 0D, 0D, 20D, 0D, 0D, 0D, 20D")).collect()
    assert [(r.nx, r.ny, r.nz) for r in normals] == [(0.6, 0.8, 0.0), (0.0, 0.0, 1.0)]


def test_measures(spark):
    samples = spark.range(9).selectExpr("1 AS mission_id", "id AS seq", "id * id * 1D AS e", "0D AS n", "2D AS u")
    r = measures.trajectory_summary(samples, 1.0).first()
    assert (r.max_speed, r.max_accel, r.max_jerk, r.duration) == (16, 2, 0, 8)
    assert np.allclose([x.ve for x in measures.finite_differences(samples, {"e": "ve"}, 1.0, "mission_id").orderBy("seq").collect()], np.gradient(np.arange(9.0) ** 2, edge_order=2))
    legs = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 30.0, 5.0), (1, 1, 1, 40.0, 0.0, 30.0, 5.0), (2, 1, 0, 0.0, 40.0, 30.0, 5.0)], "mission_id long, site_id int, seq int, e double, n double, u double, speed double")
    block = spark.createDataFrame([(1, 34, 24, 15)], "site_id int, i int, j int, k int")
    # the block's centre is (21, 1, 31): samples come every 0.5 m, and the one at 20.5 is exactly 1.5 away, which is clear
    got = {r.mission_id: r for r in measures.flight_ok(measures.audit_missions(legs, block)).collect()}
    assert got[1].collided and not got[1].ok and got[1].path_m == 21 and math.isclose(got[1].min_clearance, math.sqrt(2))
    assert got[2].completed and got[2].ok and got[2].path_m == 0
    low = measures.audit_missions(legs, block.where("false"), battery_s=5.0).collect()
    assert {r.mission_id: (r.landed, r.completed) for r in low} == {1: (True, False), 2: (False, True)}


def test_files(spark, tmp_path):
    pose = {"position": [10.0, -5.0, 30.0], "orientation": {"w": 1.0, "x": 0.0, "y": 0.0, "z": 0.0}}
    good = {"aoi_name": "a", "home": {"lat": 37.4, "lon": -122.1, "alt": 12.0}, "coverage": 0.93, "clips": [{"clip_id": "c1", "shot_type": "orbit", "poses": [pose], "interest_tags": ["x"], "duration_s": 8.5}]}
    bad = {**good, "coverage": 1.5, "clips": [{**good["clips"][0], "shot_type": "zoom", "poses": [], "duration_s": 0.0}]}
    (tmp_path / "sets.json").write_text("\n".join([json.dumps(good), json.dumps(bad), "{oops"]))
    rows = files.validate_footage_sets(files.read_footage_sets(spark, str(tmp_path / "sets.json"))).collect()
    assert [r.reasons for r in rows][:2] == [[], ["coverage", "shot_type", "poses", "duration_s"]]
    assert "unreadable" in rows[2].reasons
    (tmp_path / "fp.json").write_text(json.dumps({"site_id": 4, "centroid": [37.4, -122.1], "height_m": 31.2, "polygon_latlon": [[37.4, -122.1], [37.5, -122.1], [37.5, -122.2]]}))
    points = files.read_footprints(spark, str(tmp_path / "fp.json")).collect()
    assert [(p.vertex, p.lat, p.lon, p.height) for p in points][1] == (1, 37.5, -122.1, 31.2)
    tracks = spark.sql("SELECT 'poi' AS name, 1L AS track_id, 0 AS seq, 1D AS lat, 2D AS lon UNION ALL SELECT 'poi', 1L, 1, 3D, 4D")
    files.write_poi_paths(tracks, str(tmp_path / "poi"))
    assert sorted(map(tuple, files.read_poi_paths(spark, str(tmp_path / "poi")).collect())) == sorted(map(tuple, tracks.collect()))
    clips = spark.sql("SELECT 1 AS site_id, 'c2' AS clip_id, 'orbit' AS shot_type, array(1) AS poses, array('x') AS interest_tags UNION ALL SELECT 1, 'c1', 'flyby', array(2), array('y')")
    sites = spark.sql("SELECT 1 AS site_id, 37D AS home_lat, 5D AS home_lon, 0D AS home_alt")
    sets = files.footage_sets(clips, sites, spark.sql("SELECT 1 AS site_id, 0.9D AS coverage"))
    files.write_footage_sets(sets, str(tmp_path / "out"))
    assert [c.clip_id for c in sets.first().clips] == ["c1", "c2"]


def test_small_measures(spark):
    seen = spark.sql("SELECT 1 AS image_id, 3D AS px, 4D AS py, 0D AS ox, 0D AS oy UNION ALL SELECT 1, 1D, 0D, 0D, 0D UNION ALL SELECT 1, NULL, NULL, 9D, 9D")
    assert measures.reprojection_error(seen).first().error == 3
    closeups = spark.sql("SELECT 1 AS site_id, true AS resolved UNION ALL SELECT 1, false")
    stats = measures.closeup_plan_stats(closeups, spark.sql("SELECT 1 AS site_id UNION ALL SELECT 2")).collect()
    assert {r.site_id: (r.n_resolved, r.resolved_fraction) for r in stats} == {1: (1, 0.5), 2: (0, 1.0)}
    summary = spark.sql("SELECT 1 AS mission_id, 5D AS max_speed, 2D AS max_accel, 1D AS max_jerk UNION ALL SELECT 2, 5.1D, 2D, 1D")
    assert [r.mission_id for r in measures.within_limits(summary, 5, 2, 1).collect()] == [1]


SF = "/root/testdata/sf0.001"


def _flown(rows):
    """Samples (e, n, u, seconds so far) of one mission every 0.1 s."""
    out, t = [(rows[0].e, rows[0].n, rows[0].u, 0.0)], 0.0
    for a, b in zip(rows, rows[1:]):
        leg = math.dist((a.e, a.n, a.u), (b.e, b.n, b.u))
        if leg >= 1e-9:
            seconds = leg / min(max(b.speed, 0.1), 15)
            m = max(1, math.ceil(seconds / 0.1))
            out += [(*(x + (y - x) * s / m for x, y in ((a.e, b.e), (a.n, b.n), (a.u, b.u))), t + seconds * s / m) for s in range(1, m + 1)]
            t += seconds
    return out


def _missions(spark, monkeypatch, n):
    """Every ``n``-th mission of the table, in place of all, and the cells that are mapped."""
    few = T.waypoints(spark, SF).where(f"mission_id % {n} = 0").cache()
    monkeypatch.setattr(T, "waypoints", lambda spark, sf: few)
    by = {}
    for r in few.orderBy("mission_id", "seq").collect():
        by.setdefault(r.mission_id, []).append(r)
    mapped = {}
    for r in T.obstacle_map(spark, SF).collect():
        mapped.setdefault(r.site_id, set()).add((r.i, r.j, r.k))
    return by, mapped


def _centre(cells):
    return np.array(sorted(cells), float).reshape(-1, 3) * 2 + [-47, -47, 1]


def test_flights_are_audited_between_coarse_samples(spark, monkeypatch):
    by, mapped = _missions(spark, monkeypatch, 4)
    fine = {r.mission_id: r for r in Q.queries()["g9_audit_missions_fine"](spark, SF).collect()}
    exact = {r.mission_id: r for r in Q.queries()["g9_audit_missions"](spark, SF).collect()}
    assert set(fine) == set(by)
    for m, rows in by.items():
        at = _centre(mapped.get(rows[0].site_id, ()))
        least, collided, landed = math.inf, False, False
        for k, (e, n, u, t) in enumerate(_flown(rows)):
            cell = np.floor((np.array([e, n, u]) - [-48, -48, 0]) / 2)
            near = at[(np.abs((at - [-47, -47, 1]) / 2 - cell) <= 3).all(axis=1)]
            d = np.sqrt(((near - [e, n, u]) ** 2).sum(axis=1)).min(initial=math.inf)
            least = min(least, d)
            collided, landed = d < 1.5, d >= 1.5 and k > 0 and 1 - t / 1080 <= 0.15
            if collided or landed:
                break
        r = fine[m]
        assert (r.collided, r.landed, r.completed) == (collided, landed, not collided and not landed)
        assert math.isclose(math.inf if r.min_clearance is None else r.min_clearance, least, abs_tol=1e-3)
    # what samples hit, the way between them hits as well, no later and at the margin
    for m, r in exact.items():
        if fine[m].collided:
            assert r.collided and r.time_s <= fine[m].time_s + 1e-3 and r.path_m <= fine[m].path_m + 1e-3
            assert r.event_e is not None and r.min_clearance <= 1.5
            at = _centre(mapped[by[m][0].site_id])
            d = np.sqrt(((at - [r.event_e, r.event_n, r.event_u]) ** 2).sum(axis=1)).min()
            assert abs(d - 1.5) < 1e-3 or (r.path_m == 0 and d < 1.5)
        elif not r.collided:
            assert (r.landed, r.completed) == (fine[m].landed, fine[m].completed) and (r.event_e is None) == r.completed
    assert sum(r.collided for r in exact.values()) >= sum(r.collided for r in fine.values()) > 0


def test_thin_cells_beside_legs_count(spark, monkeypatch):
    by, mapped = _missions(spark, monkeypatch, 4)
    thin = {}
    for r in T.voxels(spark, SF).where("label IN (4, 5)").collect():
        thin.setdefault(r.site_id, set()).add((r.i, r.j, r.k))
    want = {}
    for rows in by.values():
        site = rows[0].site_id
        cells = sorted(thin.get(site, ()))
        if cells:
            at = _centre(cells)
            path = np.array(_flown(rows))[:, :3]
            close = np.zeros(len(at), bool)
            for p in path:
                close |= ((at - p) ** 2).sum(axis=1) <= 16
            want.setdefault(site, set()).update(c for c, x in zip(cells, close) if x)
    want = {s: (len(c - mapped.get(s, set())), len(c)) for s, c in want.items() if c}
    assert {r.site_id: (r.n_missed, r.n_on_path) for r in Q.queries()["a5_missed_on_legs"](spark, SF).collect()} == want
    exact = {r.site_id: r.n_on_path for r in Q.queries()["a5_missed_on_path"](spark, SF).collect()}
    assert all(n <= exact[s] for s, (_, n) in want.items())
    assert sum(exact.values()) - sum(n for _, n in want.values()) <= 0.01 * sum(exact.values())


def test_the_whole_plan_of_views(spark, monkeypatch):
    # sites 1 and 2 hold what six poses see in all; site 3 reaches 0.9 of its surface with five poses of nine cells
    rng = np.random.default_rng(9)
    see = {(s, p): {int(c) for c in rng.integers(0, 60, 5)} for s in (1, 2) for p in range(9)} | {(3, p): set(range(9 * p, 9 * p + 9)) for p in range(6)}
    size = {1: 60, 2: 60, 3: 50}
    voxels = spark.createDataFrame([(s, c, 0, 0, 2) for s, n in size.items() for c in range(n)], "site_id int, i int, j int, k int, label int")
    visible = spark.createDataFrame([(s, p, c, 0, 0) for (s, p), cs in see.items() for c in cs], "site_id int, pose_id long, i int, j int, k int")
    poses = spark.createDataFrame([(s, p, p) for s, p in see], "site_id int, pose_id long, seq long")
    for name, table in (("voxels", voxels), ("visibility", visible), ("view_poses", poses)):
        monkeypatch.setattr(T, name, lambda spark, sf, table=table: table)
    want = []
    for s, n in size.items():
        seen, k = set(), 0
        while len(seen) < n:
            gain, p = max((len({c for c in see[s, p] if c < n} - seen), -p) for t, p in see if t == s)
            if not gain:
                break
            seen |= {c for c in see[s, -p] if c < n}
            want.append((s, k, -p, gain))
            k += 1
    assert sorted(map(tuple, Q.queries()["g2_nbv_plan_whole"](spark, "").collect())) == want
    assert len(want) > 4 * len(size)
    # the plan up to 0.9 is the beginning of the whole one, site by site
    plan = sorted(map(tuple, Q.queries()["g2_nbv_plan"](spark, "").collect()))
    assert plan == [w for w in want if w in plan] and sum(w[0] == 3 for w in plan) == 5
