"""What must not grow faster than the input: broadcasts, samples, pairs. Results are held against brute force."""

from __future__ import annotations

import math
import random
import re

from siteview.operators import voxels


def _broadcast(df) -> list[str]:
    """The joins of a plan that ran which send a side through the driver, but for those that only ask whether a site is there."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [j for j in re.findall(r"Broadcast\w+Join[^\n]*", plan) if "LeftSemi" not in j]


def test_the_surface_is_not_broadcast(spark, monkeypatch):
    rnd = random.Random(3)
    cells = sorted({(1, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for _ in range(60)})
    points = [(i, 1, *[rnd.uniform(-60, 60) for _ in range(2)], rnd.uniform(0, 60)) for i in range(50)]
    plans, plain = [], voxels._checkpoint
    monkeypatch.setattr(voxels, "_checkpoint", lambda df: (plain(df), plans.extend(_broadcast(df)))[0])
    got = voxels.nearest_surface(spark.createDataFrame(points, "vp_id int, site_id int, e double, n double, u double"), spark.createDataFrame(cells, "site_id int, i int, j int, k int"), "vp_id", 2.0, (-48.0, -48.0, 0.0))
    at = lambda c: (-47 + 2 * c[1], -47 + 2 * c[2], 2 * c[3] + 1)
    want = {p[0]: min((math.dist(p[2:], at(c)), *c[1:]) for c in cells)[1:] for p in points}
    assert {r.vp_id: (r.i, r.j, r.k) for r in got.collect()} == want and not plans


def _stored(monkeypatch) -> list[str]:
    """Collects the broadcasts of each table that is stored from now on."""
    plans, plain = [], voxels.stored
    monkeypatch.setattr(voxels, "stored", lambda df, *a: (df.collect(), plans.extend(_broadcast(df)), plain(df, *a))[2])
    return plans


def test_close_ups_broadcast_nothing(spark, monkeypatch):
    from siteview.operators import rays

    rnd = random.Random(2)
    solid = spark.createDataFrame(sorted({(1, rnd.randrange(15, 33), rnd.randrange(15, 33), rnd.randrange(9)) for _ in range(300)}), "site_id int, i int, j int, k int")
    want = {tuple(r) for r in rays.generate_closeups(solid, solid, 8.0, 6).collect()}
    plans = _stored(monkeypatch)
    got = rays.generate_closeups(solid, solid, 8.0, 6)
    assert {tuple(r) for r in got.collect()} == want and len(want) == solid.count()
    assert not plans and not _broadcast(got)


def test_audits_broadcast_nothing(spark, monkeypatch):
    from siteview.operators import legs

    rnd = random.Random(7)
    ways = spark.createDataFrame([(m, 1, s, *[rnd.uniform(-40, 40) for _ in range(2)], rnd.uniform(2, 38), 5.0) for m in range(30) for s in range(4)], "mission_id int, site_id int, seq int, e double, n double, u double, speed double")
    cells = spark.createDataFrame(sorted({(1, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for _ in range(60)}), "site_id int, i int, j int, k int")
    plans = _stored(monkeypatch)
    got = legs.audit_flights(ways, cells)
    assert len(got.collect()) == 30 and not plans and not _broadcast(got)


def test_plots_are_not_broadcast(spark):
    from siteview.operators import plots

    rnd = random.Random(4)
    at = [(k, float(rnd.randrange(90)), float(rnd.randrange(90))) for k in range(60)]
    ring = lambda x, y: [(x, y), (x + 9, y), (x + 9, y + 9), (x, y + 9)]
    table = spark.createDataFrame([(k, ring(x, y)) for k, x, y in at], "plot_id int, polygon array<struct<x:double,y:double>>")
    pins = [(i, rnd.uniform(0, 99), rnd.uniform(0, 99)) for i in range(200)]
    got = plots.points_in_plots(spark.createDataFrame(pins, "pin_id int, e double, n double"), table, 8.0)
    assert {(r.pin_id, r.plot_id) for r in got.collect()} == {(i, k) for i, e, n in pins for k, x, y in at if x < e < x + 9 and y < n < y + 9}
    assert not _broadcast(got)


def test_samples_are_not_written_out(spark, monkeypatch):
    from siteview.operators import legs, missions, rays

    rnd = random.Random(11)
    ways = [(m, 1, s, *[rnd.uniform(-44, 44) for _ in range(2)], rnd.uniform(2, 38), rnd.choice([None, 1.0, 9.0, 99.0])) for m in range(12) for s in range(rnd.randrange(1, 5))]
    ways += [(70, 1, 0, 0.0, 0.0, 30.0, 5.0), (70, 1, 1, 0.0, 0.0, 30.0, 5.0), (71, 1, 1, 0.0, 0.0, 9.0, 5.0), (71, 1, 2, 9.0, 9.0, 9.0, 5.0)]
    ways = spark.createDataFrame(ways, "mission_id int, site_id int, seq int, e double, n double, u double, speed double")
    cells = sorted({(1, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20), rnd.choice([3, 4, 5])) for _ in range(4000)})
    truth = spark.createDataFrame(cells, "site_id int, i int, j int, k int, label int")
    mapped = truth.where("(i + j) % 2 = 0")
    for dt in (0.1, 2.0):
        path = missions.path_samples(ways, dt).withColumn("sample_id", F.struct("mission_id", "seq", "s"))
        want = rays.missed_on_path(path, truth, mapped).collect()
        assert legs.missed_on_samples(ways, truth, mapped, dt).collect() == want and want[0].n_missed > 0
    from siteview.plans import queries

    monkeypatch.setattr(missions, "path_samples", None)
    assert queries.queries()["a5_missed_on_legs"](spark, "/root/testdata/sf0.001").count() > 0


def test_sums_of_scored_pairs_are_those_of_the_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from siteview.operators import camera, interest

    rnd = random.Random(5)
    cams = spark.sql("SELECT 0 AS camera_id, 84D AS hfov, 53D AS vfov, 640 AS width, 480 AS height")
    poses = spark.createDataFrame([(s, 100 * s + i, *[rnd.uniform(-60, 60) for _ in range(3)], 0.0, 0.0, 5.0, 0) for s in (1, 2) for i in range(60)], "site_id int, vp_id int, e double, n double, u double, te double, tn double, tu double, camera_id int")
    spots = [(s, 100 * s + i, *[rnd.uniform(-15, 15) for _ in range(3)], *[rnd.gauss(0, 1) for _ in range(3)], 2.0) for s in (1, 2, 3) for i in range(40)]
    spots = spark.createDataFrame([*spots, (1, 99, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 98, 1.0, 2.0, 3.0, 0.0, 0.0, -1.0, None)], "site_id int, hs_id int, e double, n double, u double, nx double, ny double, nz double, interest double")
    aimed = camera.look_at(poses)
    near = lambda a, b: set(a) == set(b) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for k in a for x, y in zip(a[k], b[k]))
    for part in (20_000, 7):
        monkeypatch.setattr(interest, "PART", part)
        for how in ({}, {"cutoff": 30.0}, {"power": 2.0, "centre": 1.0}):
            pairs = interest.score_pairs(aimed, spots, cams, **how).cache()
            want = {r.vp_id: (r.s,) for r in pairs.groupBy("vp_id").agg(F.sum("term").alias("s")).where("s IS NOT NULL").collect()}
            sums = interest.score_sums(aimed, spots, cams, "vp_id", **how)
            got = {r.vp_id: (r.score,) for r in sums.collect() if r.score}
            assert near(got, {k: v for k, v in want.items() if v[0]}) and want
            want = {r.hs_id: (r.n, r.f) for r in pairs.groupBy("hs_id").agg(F.count("*").alias("n"), F.sum("framing").alias("f")).collect()}
            assert near({r.hs_id: (r.n, r.framing) for r in interest.score_sums(aimed, spots, cams, "hs_id", **how).collect()}, want)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_local_maxima_and_clearance_against_brute_force(spark):
    from siteview.operators import interest

    rnd = random.Random(13)
    points = [(s, 1000 * s + i, *[float(rnd.randrange(-15, 15)) for _ in range(3)], float(rnd.randrange(40))) for s in (1, 2) for i in range(400)] + [(1, 9001, None, 0.0, 0.0, 0.0), (1, 9002, None, 0.0, 0.0, 5.0)]
    table = spark.createDataFrame(points, "site_id int, vp_id int, e double, n double, u double, value double")
    known = [p for p in points if p[2] is not None]
    worse = {p[1] for p in known for q in known if p[0] == q[0] and math.dist(p[2:5], q[2:5]) <= 6 and (q[5], -q[1]) > (p[5], -p[1])}
    got = interest.local_maxima(table)
    assert {r.vp_id for r in got.collect()} == {p[1] for p in points} - worse and not _broadcast(got)
    cells = sorted({(1, rnd.randrange(15, 33), rnd.randrange(15, 33), rnd.randrange(9)) for _ in range(150)})
    clear = voxels.clearance(table.where("e IS NOT NULL"), spark.createDataFrame(cells, "site_id int, i int, j int, k int"), "vp_id", 3)
    index = lambda p: (math.floor((p[2] + 48) / 2), math.floor((p[3] + 48) / 2), math.floor(p[4] / 2))
    want = {p[1]: min((math.dist(p[2:5], (-47 + 2 * c[1], -47 + 2 * c[2], 2 * c[3] + 1)) for c in cells if c[0] == p[0] and max(abs(a - b) for a, b in zip(c[1:], index(p))) <= 3), default=None) for p in known}
    assert {r.vp_id: r.min_d for r in clear.collect()} == want and not _broadcast(clear)


def test_tagged_clips_are_sent_once(spark):
    from siteview.operators import missions

    clips = spark.createDataFrame([(i, 1, i * 1e-7, 0.0, 0.0, ["orbit"]) for i in range(-30, 31)] + [(99, 1, None, 0.0, 0.0, ["orbit"]), (98, 2, 0.0, 0.0, 0.0, ["orbit"])], "seq int, site_id int, e double, n double, u double, interest_tags array<string>")
    cameras = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (1, 5e-7, 0.0, 1e-7)], "site_id int, e double, n double, u double")
    got = missions.tag_closeups(clips, cameras)
    want = {i for i in range(-30, 31) if any(math.dist((i * 1e-7, 0.0, 0.0), c) < 1e-6 for c in ((0.0, 0.0, 0.0), (5e-7, 0.0, 1e-7)))}
    rows = got.collect()
    assert len(rows) == 63 and {r.seq for r in rows if len(r.interest_tags) == 2} == want and not _broadcast(got)


def test_flights_are_audited_without_samples(spark, monkeypatch):
    from siteview.operators import legs, measures, missions

    rnd = random.Random(17)
    ways = [(m, 1 + m % 3, s, *[rnd.uniform(-55, 55) for _ in range(2)], rnd.uniform(2, 45), rnd.choice([None, 0.05, 1.0, 9.0, 99.0])) for m in range(60) for s in range(rnd.randrange(1, 6))]
    ways += [(70, 1, 0, 0.0, 0.0, 30.0, 5.0), (70, 1, 1, 0.0, 0.0, 30.0, 5.0), (71, 1, 1, 0.0, 0.0, 9.0, 5.0), (72, 1, 0, 0.0, 0.0, 30.0, 5.0), (72, 1, 1, None, 9.0, 9.0, 5.0), (72, 1, 2, 9.0, 9.0, 9.0, 5.0)]
    ways += [(100 + k, 2, s, float(k), -3.0 + 9.0 * s, 9.0, 4.0) for k in range(-9, 10) for s in range(2)]
    ways = spark.createDataFrame(ways, "mission_id int, site_id int, seq int, e double, n double, u double, speed double")
    # a site with many cells, one with a few, one with none
    cells = sorted({(1, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for _ in range(400)} | {(2, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for _ in range(40)})
    cells = spark.createDataFrame(cells, "site_id int, i int, j int, k int")
    names = ("path_m", "time_s", "used", "min_clearance")
    flat = lambda rows: {r.mission_id: (r.collided, r.landed, r.completed, *[r[c] for c in names]) for r in rows}
    for how in ({}, {"battery_s": 60.0, "dt": 0.5}):
        want, plans = flat(measures.audit_missions(ways, cells, **how).collect()), _stored(monkeypatch)
        out = legs.audit_samples(ways, cells, **how)
        got = flat(out.collect())
        monkeypatch.undo()
        assert got.keys() == want.keys() and not plans and not _broadcast(out)
        for m, w in want.items():
            assert got[m][:3] == w[:3], m
            assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(got[m][3:], w[3:], strict=True)), (m, got[m], w)
        assert any(w[0] for w in want.values()) and any(w[2] for w in want.values()) and {w[6] is None for w in want.values()} == {True, False}
    assert any(w[1] for w in want.values())
    from siteview.plans import queries

    monkeypatch.setattr(missions, "leg_samples", None)
    assert queries.queries()["g9_audit_missions_fine"](spark, "/root/testdata/sf0.001").count() > 0


def test_missions_are_ordered_and_timed_together(spark, monkeypatch):
    import numpy as np

    from siteview.operators import routes
    from siteview.plans import queries

    rng = np.random.default_rng(9)
    sets = {m: np.round(rng.uniform(-60, 60, (1 + m % 12, 3)), int(m % 3)) for m in range(90)} | {200: np.zeros((5, 3)), 201: rng.normal(size=(routes.STRETCH + 30, 3))}
    table = spark.createDataFrame([(f"m{m}", s, *map(float, x)) for m, p in sets.items() for s, x in enumerate(p)], "mission_id string, seq int, e double, n double, u double")
    monkeypatch.setattr(routes, "HELD", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        visits, times = routes.route_missions(table).collect(), {r.mission_id: r for r in routes.scaled_durations(table).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in sorted(visits, key=lambda r: r.visit):
        got.setdefault(r.mission_id, []).append(r.seq)
    for m, p in sets.items():
        assert got[f"m{m}"] == [a + k for a in range(0, len(p), routes.STRETCH) for k in routes._visit(p[a : a + routes.STRETCH])]
    want = {r.mission_id: r for r in routes.time_scale(routes.fit_trajectories(table)).collect()}
    assert times.keys() == want.keys() and len(want) == len(sets)
    for m, w in want.items():
        assert math.isclose(times[m].length, w.length, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(times[m].duration, w.duration, rel_tol=1e-9)
    assert any(w.duration > w.length / 5 > 1 for w in want.values())
    monkeypatch.setattr(routes, "fit_trajectories", None)
    plans = [queries.queries()[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for q in ("g5_route_missions", "g7_time_scale")]
    assert all("MapInArrow" in p and "FlatMapGroupsInPandas" not in p for p in plans)


def test_no_pair_of_a_pose_and_a_cell_is_shuffled(spark, monkeypatch):
    from pyspark.sql import functions as F

    from siteview.operators import camera, rays

    rnd = random.Random(23)
    cells = {(s, rnd.randrange(14, 34), rnd.randrange(14, 34), rnd.randrange(20)) for s in (1, 2) for _ in range(500)} | {(1, -3, 20, 4), (1, 50, 20, 25), (4, 3, 3, 3)}
    solid = spark.createDataFrame(sorted(cells), "site_id int, i int, j int, k int")
    surface = solid.where("(i + j) % 2 = 0 OR i < 0").unionByName(spark.createDataFrame([(1, None, 2, 2)], solid.schema))
    poses = [(s, f"p{s}:{n}", float(rnd.randrange(-20, 20)), float(rnd.randrange(-20, 20)), float(rnd.randrange(20, 90)), *((0.0, 1.0, 0.0, 0.0) if n % 2 else [rnd.gauss(0, 1) for _ in range(4)]), 0) for s in (1, 2, 3) for n in range(30)]
    # one stands at the centre of a cell, one has no place
    poses += [(1, "in", -47.0 + 2 * 20, -47.0 + 2 * 20, 9.0, 0.0, 1.0, 0.0, 0.0, 0), (1, "no", None, 0.0, 50.0, 0.0, 1.0, 0.0, 0.0, 0)]
    poses = spark.createDataFrame(poses, "site_id int, image_id string, e double, n double, u double, qw double, qx double, qy double, qz double, camera_id int")
    cams = spark.sql("SELECT 0 AS camera_id, 84D AS hfov, 53D AS vfov, 640 AS width, 480 AS height")
    centres = voxels.voxel_center(surface, **rays.GRID).join(poses.select("image_id", "site_id"), "site_id")
    framed = camera.project_points(centres, poses, cams).where("in_view").withColumnsRenamed({c: f"t{c}" for c in "enu"})
    cast = framed.join(poses.select("image_id", "e", "n", "u"), "image_id").withColumn("ray_id", F.concat_ws(":", "image_id", "i", "j", "k"))
    want = sorted(tuple(r) for r in rays.line_of_sight(cast, solid).select("image_id", "site_id", "i", "j", "k").collect())
    monkeypatch.setattr(rays, "POSED", 7)
    monkeypatch.setattr(rays, "line_of_sight", None)
    seen, pairs = rays.visible_surface(poses, surface, solid, cams), rays.frustum_pairs(poses, surface, cams)
    assert sorted(tuple(r) for r in seen.select("image_id", "site_id", "i", "j", "k").collect()) == want and want
    assert sorted(tuple(r) for r in pairs.select("image_id", "i", "j", "k").collect()) == sorted(tuple(r) for r in framed.select("image_id", "i", "j", "k").collect())
    assert 0 < len(want) < pairs.count() and all("FlatMapCoGroupsInArrow" in d._jdf.queryExecution().executedPlan().toString() for d in (seen, pairs))


def test_crossed_cells_are_not_shuffled(spark, monkeypatch):
    from siteview.operators import rays

    rnd = random.Random(29)
    solid = spark.createDataFrame(sorted({(s, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for s in (1, 2) for _ in range(3000)}) + [(1, -4, 2, 2), (1, 48, 2, 2), (5, 1, 1, 1)], "site_id int, i int, j int, k int")
    cast = [(f"r{k}", 1 + k % 3, *[rnd.uniform(-60, 60) for _ in range(2)], rnd.uniform(0, 60), *[rnd.uniform(-60, 60) for _ in range(2)], rnd.uniform(0, 60)) for k in range(300)] + [("z", 1, None, 0.0, 0.0, 1.0, 1.0, 1.0), ("y", 1, 0.0, 0.0, 5.0, 0.0, 0.0, 5.0)]
    table = spark.createDataFrame(cast, "ray_id string, site_id int, e double, n double, u double, te double, tn double, tu double")
    want = sorted(map(tuple, rays.cast_rays(table).join(solid, voxels.CELL).select("ray_id", *voxels.CELL, "t").collect()))
    monkeypatch.setattr(rays, "CAST", 40)
    monkeypatch.setattr(rays, "STEPPED", 9)
    monkeypatch.setattr(rays, "cast_rays", None)
    hits = rays.ray_hits(table, solid)
    assert sorted(map(tuple, hits.select("ray_id", *voxels.CELL, "t").collect())) == want and len(want) > 300
    first = {r.ray_id: (r.hit_t, r.hit_i, r.hit_j, r.hit_k) for r in rays.first_hit(table, solid).collect()}
    best = {}
    for ray, _, i, j, k, t in want:
        best[ray] = min(best.get(ray, (math.inf,)), (t, i, j, k))
    assert first == {r[0]: best.get(r[0], (math.inf, None, None, None)) for r in cast}


def test_large_plans_are_several_documents(spark, monkeypatch, tmp_path):
    from siteview.sources import files

    homes = spark.createDataFrame([(f"b{k}", k, 40.0 + k, 8.0) for k in range(3)], "building string, osm_id long, home_lat double, home_lon double")
    regions = spark.createDataFrame([(k, f"r{i:03}", 40.0 + i / 1e4, 8.0, 1.0, 2.0, 5.0, i) for k in range(2) for i in range(30 if k else 2)], "osm_id long, region_id string, lat double, lon double, e double, n double, radius_m double, extra_loops int")
    ways = spark.createDataFrame([(k, f"t{i:03}", "waypoints", 14.0, 8.0, kind, s, 40.0 + i / 1e4, 8.0 + s / 1e4) for k in range(2) for i in range(50 if k else 3) for kind in ("control", "smoothed") for s in range(4)], "osm_id long, track_id string, mode string, altitude_m double, duration_s double, kind string, seq int, lat double, lon double")
    monkeypatch.setattr(files, "HELD", 10)
    files.write_plans(files.plans(homes, regions, ways), f"{tmp_path}/plans")
    read = files.read_plans(spark, f"{tmp_path}/plans").cache()
    sizes = {}
    for r in read.collect():
        sizes.setdefault(r.osm_id, []).append(len(r.poi_regions) + len(r.paths))
        assert [p.id for p in r.paths] == sorted(p.id for p in r.paths)
    assert len(sizes[0]) == len(sizes[2]) == 1 and sizes[2] == [0] and len(sizes[1]) == 8 and sum(sizes[1]) == 80 and max(sizes[1]) < 30
    key = ["osm_id", "track_id", "kind", "seq", "lat", "lon"]
    assert sorted(map(tuple, files.plan_tracks(read).select(*key).collect())) == sorted(map(tuple, ways.select(*key).collect()))
    key = ["osm_id", "region_id", "lat", "lon", "extra_loops"]
    assert sorted(map(tuple, files.plan_regions(read).select(*key).collect())) == sorted(map(tuple, regions.select(*key).collect()))


def test_summaries_write_no_samples(spark, monkeypatch):
    from siteview.operators import missions
    from siteview.plans import queries

    monkeypatch.setattr(missions, "leg_samples", None)
    assert queries.queries()["a16_mission_summary"](spark, "/root/testdata/sf0.001").where("path_m > 0 AND used > 0").count() > 0


def test_pairs_of_plots_are_clipped_together(spark, monkeypatch):
    from siteview.operators import plots, polygons

    rnd = random.Random(31)
    rings = []
    for k in range(24):
        x, y, a, b = rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.uniform(2, 9), rnd.uniform(2, 9)
        ring = [[(x, y), (x + a, y), (x + a, y + b), (x, y + b)], [(x, y), (x + a, y), (x + a, y + b / 2), (x + a / 2, y + b / 2), (x + a / 2, y + b), (x, y + b)], [(x, y), (x + a, y + 1), (x + 1, y + b)], [(x, y), (x + a, y), (x + 2 * a, y), (x + a, y)]][k % 4]
        rings.append((k, ring[:: rnd.choice([1, -1])]))
    table = spark.createDataFrame([*rings, (50, rings[0][1]), (51, rings[1][1])], "plot_id int, polygon array<struct<x:double,y:double>>")
    want = {(r.plot_a, r.plot_b): (r.iou, r.reason) for r in polygons.polygon_iou(plots.overlapping_pairs(table, 8.0)).collect()}
    monkeypatch.setattr(plots, "CLIPPED", 40)
    monkeypatch.setattr(polygons, "polygon_iou", None)
    got = {(r.plot_a, r.plot_b): (r.iou, r.reason) for r in plots.overlaps(table, 8.0).collect()}
    assert got.keys() == want.keys() and len(want) > 50 and len({r for _, r in want.values()}) == 2
    for k, (iou, reason) in want.items():
        assert got[k][1] == reason and (got[k][0] is None) == (iou is None) and (iou is None or math.isclose(got[k][0], iou, rel_tol=1e-9, abs_tol=1e-9)), k


def test_pairs_of_tracks_are_weighed_together(spark):
    from siteview.operators import measures

    rnd = random.Random(8)
    tracks = [(t, s, float(rnd.randrange(-20, 21)), float(t % 40)) for t in range(400) for s in range(rnd.randrange(1, 21))]
    table = spark.createDataFrame(tracks, "track_id long, seq int, x double, y double")
    got = measures.similar_tracks(table, 40.0)
    rows = got.collect()
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString() and not _broadcast(got)
    assert len({(r.track_a, r.track_b) for r in rows}) == len(rows) and all(r.track_a < r.track_b for r in rows)
    # in parts of a few tracks the pairs are the same
    before, measures.TRACKS = measures.TRACKS, 100
    try:
        some = measures.similar_tracks(table.where("track_id < 300"), 40.0).collect()
    finally:
        measures.TRACKS = before
    assert {tuple(r) for r in some} == {tuple(r) for r in rows if r.track_b < 300}


def test_rotations_are_worked_out_once(spark):
    from siteview.operators import camera

    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0, 0.0, 0.0), (0.0, 0.0, 5.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "e double, n double, u double, te double, tn double, tu double")
    turned = camera.pose_quaternion(camera.look_at(rows))
    kept = turned.where("qw IS NOT NULL AND abs(qx) <= 1").select("e", "qw", "qx", "qy", "qz")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest(") == 4 and len(plan) < 10_000
    # a target at the position has a row, without a rotation
    got = turned.collect()
    assert len(got) == 3 and [r.qw is None for r in got] == [False, False, True] and kept.count() == 2
    assert all(abs(r.qw**2 + r.qx**2 + r.qy**2 + r.qz**2 - 1) < 1e-12 for r in got[:2])


def test_hotspots_of_scored_sums_are_not_broadcast(spark):
    from siteview.operators import camera, interest

    cams = spark.sql("SELECT 0 AS camera_id, 84D AS hfov, 53D AS vfov, 640 AS width, 480 AS height")
    poses = spark.range(50).selectExpr("cast(id % 3 as int) AS site_id", "id AS vp_id", "id - 20D AS e", "3D * id - 60 AS n", "5D AS u", "0D AS te", "0D AS tn", "5D AS tu", "0 AS camera_id")
    spots = spark.range(90).selectExpr("cast(id % 3 as int) AS site_id", "id AS hs_id", "id % 15D AS e", "id % 13D AS n", "id % 11D AS u", "1D AS nx", "0D AS ny", "0D AS nz", "1D AS interest")
    for of in ("vp_id", "hs_id"):
        sums = interest.score_sums(camera.look_at(poses), spots, cams, of)
        assert sums.count()
        # the cells of hotspots, 27 each, and of viewpoints are merged by sorting; cameras are a handful of rows
        assert not [j for j in _broadcast(sums) if "site_id" in j]


def test_long_missions_are_ordered_whole(spark, monkeypatch):
    import numpy as np

    from siteview.operators import routes
    from siteview.plans import sight

    rng = np.random.default_rng(12)
    sets = {m: np.round(rng.uniform(-60, 60, (n, 3)), int(m % 3)) for m, n in enumerate((2, 3, 4, 5, 9, 40, 61, 62))}
    want = {m: routes._visit(p) for m, p in sets.items()}
    table = spark.createDataFrame([(m, s, *map(float, x)) for m, p in sets.items() for s, x in enumerate(p)], "mission_id int, seq int, e double, n double, u double")
    monkeypatch.setattr(sight.T, "waypoints", lambda spark, sf: table)
    monkeypatch.setattr(routes, "STRETCH", 10)
    monkeypatch.setattr(routes.route_missions, "__defaults__", (10,) if routes.route_missions.__defaults__ else None)
    for held in (routes.HELD, 200, 1):  # all distances of a mission at once, of some points, of one point
        monkeypatch.setattr(routes, "HELD", held)
        got = {}
        for r in sight.g5_route_missions(spark, None).orderBy("mission_id", "visit").collect():
            got.setdefault(r.mission_id, []).append(r.seq)
        assert got == want


def test_pairs_of_plots_are_not_shuffled(spark, monkeypatch):
    from siteview.operators import plots, polygons

    rnd = random.Random(37)
    rings = []
    for k in range(150):
        x, y, a, b = (rnd.randrange(20), rnd.randrange(20), rnd.randrange(1, 9), rnd.randrange(1, 9)) if k % 2 else (rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.uniform(1, 9), rnd.uniform(1, 9))
        box, ell = [(x, y), (x + a, y), (x + a, y + b), (x, y + b)], [(x, y), (x + a, y), (x + a, y + b / 2), (x + a / 2, y + b / 2), (x + a / 2, y + b), (x, y + b)]
        star = [(x, y), (x + a, y + 0.5), (x + a, y + b), (x + a / 2, y + 1e-9), (x - 1, y + b)]
        ring = [box, ell, star, [(x, y), (x + a, y + 1), (x + 1, y + b)], box[1:] + box[:1]][k % 5][:: rnd.choice([1, -1])]
        rings.append((f"p{k}", [(float(p), float(q)) for p, q in ring]))
    table = spark.createDataFrame(rings, "plot_id string, polygon array<struct<x:double,y:double>>")
    want = {(r.plot_a, r.plot_b): (r.iou, r.reason) for r in polygons.polygon_iou(plots.overlapping_pairs(table, 8.0)).collect()}
    monkeypatch.setattr(plots, "overlapping_pairs", None)
    monkeypatch.setattr(plots, "PLOTS", 20)
    monkeypatch.setattr(plots, "TRIED", 50)
    rows = plots.overlaps(table, 8.0)
    got = {(r.plot_a, r.plot_b): (r.iou, r.reason) for r in rows.collect()}
    assert got.keys() == want.keys() and rows.count() == len(want) > 1000
    for k, (iou, reason) in want.items():
        assert got[k][1] == reason and (got[k][0] is None) == (iou is None) and (iou is None or math.isclose(got[k][0], iou, rel_tol=1e-9, abs_tol=1e-9)), k
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "plot_id_a" not in plan


def test_legs_meet_cells_in_the_task(spark, monkeypatch):
    from siteview.operators import legs, measures

    rnd = random.Random(23)
    ways = [(m, 1 + m % 3, s, *[rnd.uniform(-55, 55) for _ in range(2)], rnd.uniform(2, 45), rnd.choice([None, 0.5, 9.0])) for m in range(40) for s in range(rnd.randrange(1, 9))]
    ways = spark.createDataFrame(ways, "mission_id int, site_id int, seq int, e double, n double, u double, speed double")
    cells = sorted({(1, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for _ in range(150)} | {(2, rnd.randrange(-3, 48), rnd.randrange(48), rnd.randrange(20)) for _ in range(30)} | {(9, 0, 0, 0)})
    cells = spark.createDataFrame([*cells, (2, 5000, 0, 0)], "site_id int, i int, j int, k int")
    flat = lambda rows: {r.mission_id: (r.collided, r.landed, r.completed, r.path_m, r.time_s, r.min_clearance) for r in rows}
    want = [flat(measures.audit_missions(ways, cells).collect()), flat(legs.audit_flights(ways, cells).collect())]
    monkeypatch.setattr(legs, "leg_cells", None)
    # many groups, pieces of two legs, few places at a time, and cells too far apart for an array
    for name, value in (("LEGS", 9), ("PIECE", 2), ("LOOKED", 3000), ("BOXED", 0)):
        monkeypatch.setattr(legs, name, value)
    for audit, rows in zip((legs.audit_samples, legs.audit_flights), want, strict=True):
        got = flat(audit(ways, cells).collect())
        assert got.keys() == rows.keys() and len({r[0] for r in rows.values()}) == 2
        for m, w in rows.items():
            assert got[m][:3] == w[:3] and all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(got[m][3:], w[3:], strict=True)), (m, got[m], w)


def test_equal_points_and_rings_are_tested_once(spark, monkeypatch):
    from siteview.operators import plots

    box = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + 5.0), (x, y + 5.0)]
    rings = {k: box(float(k % 3), 1.0, 6.0) for k in range(20)} | {30: [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]}
    pins = [(k, *[(2.5, 2.5), (7.5, 3.0), (50.0, 2.0), (0.5, 0.5)][k % 4], f"n{k}") for k in range(40)] + [(99, None, 2.0, "x"), (98, 2.5, 2.5, None), (97, 2.5, 2.5, None)]
    table = spark.createDataFrame(list(rings.items()), "plot_id int, polygon array<struct<x:double,y:double>>")
    within = lambda k, e, n: e is not None and ((e + n < 9) if k == 30 else (k % 3 < e < k % 3 + 6 and 1 < n < 6))
    want = sorted((p, e, n, str(s), k) for p, e, n, s in pins for k in rings if within(k, e, n))
    indexed, index = [], plots.raster_index
    monkeypatch.setattr(plots, "raster_index", lambda rows, cell: indexed.append(rows.count()) or index(rows, cell))
    for together, lists in ((1000, 4), (3, 3 + 3 + 2 + 1)):
        monkeypatch.setattr(plots, "TOGETHER", together, raising=False)
        rows = plots.points_in_plots(spark.createDataFrame(pins, "pin_id int, e double, n double, name string"), table, 2.0)
        assert rows.columns == ["pin_id", "e", "n", "name", "plot_id"]
        assert sorted((r.pin_id, r.e, r.n, str(r.name), r.plot_id) for r in rows.collect()) == want and len(want) > 300
        assert indexed.pop() == lists


def test_equal_poses_look_once(spark, monkeypatch):
    from siteview.operators import rays

    rnd = random.Random(29)
    solid = sorted({(s, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for s in (1, 2) for _ in range(300)})
    cells = spark.createDataFrame(solid, "site_id int, i int, j int, k int")
    cams = spark.sql("SELECT 0 AS camera_id, 84D AS hfov, 53D AS vfov, 640 AS width, 480 AS height")
    poses = [(1 + m % 2, m, float(m % 4), 2.0, 60.0, 0.0, 1.0, 0.0, 0.0, 0) for m in range(60)]
    kind = "site_id int, image_id int, e double, n double, u double, qw double, qx double, qy double, qz double, camera_id int"
    one = {}
    for r in rays.visible_surface(spark.createDataFrame(poses[:4], kind), cells, cells, cams).collect():
        one.setdefault(r.image_id, []).append((r.site_id, r.i, r.j, r.k))
    for equal in (16, 4):
        monkeypatch.setattr(rays, "EQUAL", equal, raising=False)
        rows = rays.visible_surface(spark.createDataFrame(poses, kind), cells, cells, cams)
        got = {}
        for r in rows.collect():
            got.setdefault(r.image_id, []).append((r.site_id, r.i, r.j, r.k))
        assert {m: sorted(c) for m, c in got.items()} == {m: sorted(one[m % 4]) for m in range(60)} and len(one) == 4
        # equal poses meet in one group
        assert "Window" in rows._jdf.queryExecution().executedPlan().toString()
