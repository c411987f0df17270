"""Index-backed joins against brute force: plots, block-culled views, close-ups in waves, flights without steps."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from siteview.operators import interest, legs, plots, polygons, rays

RING = "array<struct<x:double,y:double>>"


def _polygon(rnd, x, y, n):
    """A star-shaped ring of n vertices about (x, y)."""
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t in turns for r in [rnd.uniform(1, 12)]]


@pytest.mark.parametrize("cell", [1.0, 3.0, 50.0])
def test_points_in_plots_are_those_of_each_polygon(spark, cell):
    rnd = random.Random(4)
    rings = {k: _polygon(rnd, rnd.uniform(-40, 40), rnd.uniform(-40, 40), rnd.randrange(3, 9)) for k in range(40)} | {90: [(0.0, 0.0), (1.0, 1.0)], 91: [(-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0)]}
    table = spark.createDataFrame([(k, r) for k, r in rings.items()] + [(92, None)], f"plot_id int, polygon {RING}")
    points = [(i, rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(400)] + [(900, None, 1.0), (901, 8.0, 0.0), (902, -8.0, -8.0), (903, 0.0, 8.0)]
    pins = spark.createDataFrame([p + ("?",) for p in points], "pin_id int, e double, n double, plot string")

    def inside(x, y, ring, guard=0.0):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay + guard) + ax:
                odd = not odd
        return odd

    for mode in ("even_odd", "guarded", "boundary"):
        want = {(i, k) for i, x, y in points if x is not None for k, r in rings.items() if len(r) > 2 and inside(x, y, r)}
        want |= {(i, 91) for i in (901, 902, 903)} if mode == "boundary" else set()
        got = plots.points_in_plots(pins, table, cell, mode).select("pin_id", "plot_id").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    with pytest.raises(ValueError):
        polygons.in_ring("e", "n", "polygon", "other")


@pytest.mark.parametrize("cell", [2.0, 40.0])
def test_pairs_of_plots_come_once(spark, cell):
    rnd = random.Random(6)
    rings = {k: _polygon(rnd, rnd.uniform(-60, 60), rnd.uniform(-60, 60), 4) for k in range(60)} | {70: [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], 71: [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]}
    table = spark.createDataFrame([(k, r) for k, r in rings.items()] + [(80, None), (81, [(0.0, 0.0)]), (82, [(0.0, None), (1.0, 1.0), (2.0, 0.0)])], f"plot_id int, polygon {RING}")
    box = {k: (min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r)) for k, r in rings.items()}
    want = sorted((a, b) for a in box for b in box if a < b and box[a][0] <= box[b][2] and box[b][0] <= box[a][2] and box[a][1] <= box[b][3] and box[b][1] <= box[a][3])
    assert sorted((r.plot_a, r.plot_b) for r in plots.overlapping_pairs(table, cell).collect()) == want
    assert plots.overlaps(table, cell).where("plot_a = 70 AND plot_b = 71").first().iou == 0


def test_blocks_cull_most_pairs_and_no_view(spark):
    rnd = random.Random(8)
    cams = spark.sql("SELECT 0 AS camera_id, 40D AS hfov, 30D AS vfov, 640 AS width, 480 AS height")
    cells = [(1, i, j, k) for i in range(0, 48, 2) for j in range(0, 48, 2) for k in range(0, 20, 5)]
    surface = spark.createDataFrame(cells, "site_id int, i int, j int, k int")
    turns = []
    for i in range(25):
        q = [rnd.gauss(0, 1) for _ in range(4)]
        turns.append((1, f"p{i}", *[rnd.uniform(-45, 45) for _ in range(2)], rnd.uniform(5, 60), *q, 0))
    poses = spark.createDataFrame(turns, "site_id int, image_id string, e double, n double, u double, qw double, qx double, qy double, qz double, camera_id int")
    from siteview.operators import camera, voxels

    centres = voxels.voxel_center(surface, **rays.GRID).join(poses.select("image_id", "site_id"), "site_id")
    want = sorted(tuple(r) for r in camera.project_points(centres, poses, cams).where("in_view").select("image_id", "i", "j", "k").collect())
    assert sorted(tuple(r) for r in rays.frustum_pairs(poses, surface, cams).select("image_id", "i", "j", "k").collect()) == want and want
    blocks = rays.block_pairs(poses, surface, cams)
    tried = surface.select("site_id", *[F.expr(f"{c} div {rays.BLOCK}").alias(f"b{c}") for c in "ijk"]).join(blocks, ["site_id", "bi", "bj", "bk"]).count()
    print("pairs tried", tried, "of", len(cells) * len(turns), "seen", len(want))
    assert 3 * tried < len(cells) * len(turns)


def test_close_ups_in_waves_cast_fewer_rays(spark, monkeypatch):
    from siteview.operators import generators, voxels

    rnd = random.Random(2)
    solid = spark.createDataFrame([(1, rnd.randrange(15, 33), rnd.randrange(15, 33), rnd.randrange(9)) for _ in range(900)] + [(1, 20 + a, 20 + b, c) for a in range(3) for b in range(3) for c in range(3)], "site_id int, i int, j int, k int").distinct()
    frontier = solid.where("(i + j) % 5 = 0 OR (i = 21 AND j = 21 AND k = 1)")
    at = voxels.voxel_center(frontier, **rays.GRID)
    tried = generators.closeup_candidates(at, 8.0, 12, rays.GRID["res"]).withColumnsRenamed({c: f"t{c}" for c in "enu"}).withColumnsRenamed({f"c{c}": c for c in "enu"})
    clear = rays.line_of_sight(tried.withColumn("ray_id", F.concat_ws(":", "site_id", "i", "j", "k", "candidate_rank")), solid)
    want = {tuple(r)[:4]: r[4] for r in clear.groupBy("site_id", "i", "j", "k").agg(F.min("candidate_rank")).collect()}
    cast, plain = [], rays.line_of_sight
    monkeypatch.setattr(rays, "line_of_sight", lambda r, o, **k: cast.append(r.count()) or plain(r, o, **k))
    got = rays.generate_closeups(frontier, solid, 8.0, 12).collect()
    assert {(r.site_id, r.i, r.j, r.k): r.candidate_rank for r in got if r.resolved} == want and len(got) == frontier.count()
    print("rays", sum(cast), "of", tried.count())
    assert len(cast) == 4 and sum(cast) < tried.count()


def test_sight_by_blocks_is_sight_by_cells(spark):
    rnd = random.Random(12)
    solid = spark.createDataFrame([(1, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for _ in range(1500)], "site_id int, i int, j int, k int").distinct()
    shot = spark.createDataFrame([(i, 1, *[rnd.uniform(-60, 60) for _ in range(2)], rnd.uniform(0, 50), *[rnd.uniform(-47, 47) for _ in range(2)], rnd.uniform(1, 39)) for i in range(400)] + [(900, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (901, 1, None, 1.0, 1.0, 1.0, 1.0, 1.0)], "ray_id int, site_id int, e double, n double, u double, te double, tn double, tu double")
    target = shot.select("ray_id", *[F.floor((F.col(f"t{p}") - o) / 2).alias(f"_{c}") for c, p, o in zip("ijk", "enu", (-48, -48, 0))])
    hits = rays.ray_hits(shot, solid, short=0.5).where("t > 1e-6").join(target, "ray_id").where("greatest(abs(i - _i), abs(j - _j), abs(k - _k)) > 1")
    blocked = {r.ray_id for r in hits.select("ray_id").distinct().collect()}
    seen = {r.ray_id for r in rays.line_of_sight(shot, solid).collect()}
    assert seen == {r.ray_id for r in shot.collect()} - blocked and blocked


def test_flights_end_where_they_first_touch(spark):
    rnd = random.Random(7)
    ways = [(m, 1, s, *[rnd.uniform(-40, 40) for _ in range(2)], rnd.uniform(2, 38), rnd.choice([None, 1.0, 5.0, 99.0])) for m in range(60) for s in range(rnd.randrange(1, 6))]
    ways += [(70, 1, 0, 0.0, 0.0, 30.0, 5.0), (70, 1, 1, 0.0, 0.0, 30.0, 5.0), (71, 2, 0, 0.0, 0.0, 1.0, 5.0), (71, 2, 1, 40.0, 0.0, 1.0, 0.01)]
    cells = sorted({(1, rnd.randrange(48), rnd.randrange(48), rnd.randrange(20)) for _ in range(60)})
    got = {r.mission_id: r for r in legs.audit_flights(spark.createDataFrame(ways, "mission_id int, site_id int, seq int, e double, n double, u double, speed double"), spark.createDataFrame(cells, "site_id int, i int, j int, k int"), battery_s=60.0).collect()}
    at = [(-48 + 2 * i + 1, -48 + 2 * j + 1, 2 * k + 1) for _, i, j, k in cells]
    ended = 0
    for m in {w[0] for w in ways}:
        path, t, event = sorted(w for w in ways if w[0] == m), 0.0, None
        least, last = math.inf, path[0][3:6]
        obstacles = at if path[0][1] == 1 else []
        for a, b in zip([path[0], *path], path):
            length = math.dist(a[3:6], b[3:6])
            v = min(max(5.0 if b[6] is None else b[6], 0.1), 15)
            steps = max(1, math.ceil(length / 0.002)) if length else 1
            for s in range(0 if a is b else 1, steps + 1) if length else [0]:
                p = tuple(x + (y - x) * s / steps for x, y in zip(a[3:6], b[3:6]))
                d = min((math.dist(p, c) for c in obstacles), default=math.inf)
                least, now, last = min(least, d), t + length / v * s / steps, p
                event = "collided" if d < 1.5 else "landed" if now >= 0.85 * 60 else None
                if event:
                    break
            t = now if length or event else t
            if event:
                break
        r = got[m]
        assert (r.collided, r.landed, r.completed) == (event == "collided", event == "landed", event is None), m
        assert abs(r.time_s - t) < 0.05 and (r.min_clearance is None) == (least >= 6) and (least >= 6 or abs(r.min_clearance - least) < 5e-3)
        if event:
            ended += 1
            assert math.dist((r.event_e, r.event_n, r.event_u), last) < 0.05
        else:
            assert r.event_e is None
    assert 5 < ended < len(got)


def test_a_cut_off_leaves_out_far_pairs_alone(spark):
    rnd = random.Random(5)
    cams = spark.sql("SELECT 0 AS camera_id, 84D AS hfov, 53D AS vfov, 640 AS width, 480 AS height")
    from siteview.operators import camera

    poses = spark.createDataFrame([(1, i, *[rnd.uniform(-60, 60) for _ in range(3)], 0.0, 0.0, 5.0, 0) for i in range(80)], "site_id int, vp_id int, e double, n double, u double, te double, tn double, tu double, camera_id int")
    spots = spark.createDataFrame([(1, i, *[rnd.uniform(-15, 15) for _ in range(3)], *[rnd.gauss(0, 1) for _ in range(3)], 2.0) for i in range(60)] + [(1, 99, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "site_id int, hs_id int, e double, n double, u double, nx double, ny double, nz double, interest double")
    aimed = camera.look_at(poses)
    every = {(r.vp_id, r.hs_id): r for r in interest.score_pairs(aimed, spots, cams).collect()}
    near = {(r.vp_id, r.hs_id): r.term for r in interest.score_pairs(aimed, spots, cams, cutoff=40.0).collect()}
    assert near == pytest.approx({k: r.term for k, r in every.items() if r.dist <= 40.0}) and 0 < len(near) < len(every)
    assert all(r.framing > 0 and r.facing > 0 and r.hs_id != 99 for r in every.values())


def test_similar_tracks_are_all_pairs_within_the_bound(spark):
    from siteview.operators import measures

    rnd = random.Random(9)
    tracks = {}
    for k in range(40):
        x, y, way = *(rnd.choice([0.0, 30.0]) + rnd.uniform(-4, 4) for _ in range(2)), []
        for _ in range(rnd.randrange(1, 9)):
            x, y = x + rnd.uniform(-5, 9), y + rnd.uniform(-5, 9)
            way.append((x, y))
        tracks[k] = way
    tracks[50], tracks[51] = tracks[3], list(reversed(tracks[3]))

    def frechet(a, b):
        t = {}
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                before = [t[c] for c in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if c in t]
                t[i, j] = max(math.dist(p, q), min(before, default=0.0))
        return t[len(a) - 1, len(b) - 1]

    rows = [(k, s, x, y) for k, way in tracks.items() for s, (x, y) in enumerate(way)] + [(60, 0, None, 1.0), (3, 99, None, None)]
    table = spark.createDataFrame(rows, "track_id int, seq int, x double, y double")
    for bound in (6.0, 15.0):
        want = {(a, b): d for a in tracks for b in tracks if a < b and (d := frechet(tracks[a], tracks[b])) <= bound}
        got = {(r.track_a, r.track_b): r.distance for r in measures.similar_tracks(table, bound).collect()}
        assert got == pytest.approx(want) and got[3, 50] == 0 and len(want) > 1
    assert measures.similar_tracks(table.where("false"), 5.0).count() == 0
