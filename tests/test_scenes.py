"""Aimed poses, value fields, matches, footprints, traces and the stages end to end, against brute force."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteview.operators import camera, coverage, frames, generators, interest, measures, missions, polygons, rays, routes, survey, voxels
from siteview.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rotation(p, t, up=(0.0, 0.0, 1.0)):
    z = (np.array(t) - p) / np.linalg.norm(np.array(t) - p)
    x = np.cross(z, up)
    if np.linalg.norm(x) < 1e-9:
        x = np.cross(z, (0.0, 1.0, 0.0))
    x /= np.linalg.norm(x)
    return np.column_stack([x, np.cross(z, x), z])


POSE = "image_id string, site_id int, e double, n double, u double, te double, tn double, tu double"


def test_look_at_turns_the_axis_to_the_target(spark):
    rng = np.random.default_rng(1)
    rows = [(str(k), 0, *map(float, rng.normal(size=3) * 20), *map(float, rng.normal(size=3) * 20)) for k in range(40)]
    rows += [("down", 0, 1.0, 2.0, 50.0, 1.0, 2.0, 0.0), ("up", 0, 1.0, 2.0, 0.0, 1.0, 2.0, 9.0), ("none", 0, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0), ("null", 0, None, 2.0, 3.0, 1.0, 2.0, 3.0)]
    poses = camera.pose_quaternion(camera.look_at(frame(spark, rows, POSE)))
    for r in poses.collect():
        if r.image_id in ("none", "null"):
            assert r.r00 is None and r.qw is None
            continue
        want = rotation(np.array([r.e, r.n, r.u]), (r.te, r.tn, r.tu))
        assert np.allclose([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)], want)
        assert math.isclose(r.qw**2 + r.qx**2 + r.qy**2 + r.qz**2, 1)
    back = camera.pose_rotation(poses.where("r00 IS NOT NULL").drop(*[f"r{i}{j}" for i in range(3) for j in range(3)]))
    for r in back.collect():
        assert np.allclose([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)], rotation(np.array([r.e, r.n, r.u]), (r.te, r.tn, r.tu)))
    assert camera.look_at(frame(spark, [], POSE)).count() == 0


def test_value_field_against_the_formula(spark):
    rng = np.random.default_rng(2)
    views = [(str(k), int(k % 2), *map(float, rng.normal(size=3) * 15), *map(float, rng.normal(size=3) * 3)) for k in range(30)]
    spots = [(int(k % 2), k, *map(float, rng.normal(size=3) * 4), *map(float, rng.normal(size=3)), float(1 + k % 3)) for k in range(20)]
    aimed = camera.look_at(frame(spark, views, POSE)).withColumnRenamed("image_id", "vp_id").withColumn("camera_id", F.lit(0))
    aimed = aimed.withColumn("optimal", 10.0 + F.col("site_id")).withColumn("sigma", F.lit(5.0))
    hot = frame(spark, spots, "site_id int, hs_id int, e double, n double, u double, nx double, ny double, nz double, interest double")
    cams = spark.range(1).selectExpr("0 AS camera_id", "84D AS hfov", "53D AS vfov", "640 AS width", "480 AS height")
    fx, fy = 320 / math.tan(math.radians(42)), 240 / math.tan(math.radians(26.5))
    got = {r.vp_id: r.value for r in interest.build_value_field(aimed, hot, cams).collect()}
    for name, site, *v in views:
        p, turn, total = np.array(v[:3]), rotation(np.array(v[:3]), v[3:]), 0.0
        for s, _, *h in spots:
            d, normal = np.array(h[:3]) - p, np.array(h[3:6]) / np.linalg.norm(h[3:6])
            dist, c = np.linalg.norm(d), turn.T @ d
            facing = float(d / dist @ -normal)
            if s != site or facing <= 0 or c[2] <= 1e-9:
                continue
            x, y = fx * c[0] / c[2], fy * c[1] / c[2]
            if not (-320 <= x < 320 and -240 <= y < 240):
                continue
            total += h[6] * facing * (0.5 + 0.5 * (1 - min(1, math.hypot(x / 320, y / 240) / math.sqrt(2)))) * math.exp(-((dist - 10 - site) ** 2) / 50)
        assert math.isclose(got[name], total, rel_tol=1e-9, abs_tol=1e-12)
    assert sum(x > 0 for x in got.values()) > 3
    with pytest.raises(ValueError):
        interest.score_pairs(aimed, hot, cams, sigma=0)


def test_boxes_are_matched_as_by_taking_pairs_in_order(spark):
    rng = np.random.default_rng(3)
    box = lambda: (lambda x, y: (x, y, x + float(rng.integers(5, 12)), y + float(rng.integers(5, 12))))(float(rng.integers(0, 12)), float(rng.integers(0, 12)))
    pred = [(int(k % 3), k, float(rng.integers(0, 5)), *box()) for k in range(45)]
    truth = [(int(k % 4), k, *box()) for k in range(40)]
    p = frame(spark, pred, "image_id int, pred_id int, score double, x0 double, y0 double, x1 double, y1 double")
    t = frame(spark, truth, "image_id int, truth_id int, x0 double, y0 double, x1 double, y1 double")

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    pairs = sorted((-a[2], -iou(a[3:], b[2:]), a[1], b[1], a[0]) for a in pred for b in truth if a[0] == b[0] and iou(a[3:], b[2:]) >= 0.3)
    used, want = set(), set()
    for _, _, a, b, image in pairs:
        if ("p", a) not in used and ("t", b) not in used:
            used |= {("p", a), ("t", b)}
            want.add((image, a, b))
    assert len(want) > 10
    assert {(r.image_id, r.pred_id, r.truth_id) for r in measures.match_boxes(p, t, 0.3).collect()} == want
    quality = {r.image_id: r for r in measures.detection_quality(p, t, 0.3).collect()}
    for image in range(4):
        n = sum(x[0] == image for x in want)
        assert (quality[image].n_match, quality[image].false_positives) == (n, sum(x[0] == image for x in pred) - n)
        assert math.isclose(quality[image].recall, n / 10)
    assert quality[3].precision == 1.0


def test_frechet_distance(spark):
    rng = np.random.default_rng(4)
    tracks = {k: rng.integers(0, 20, (int(rng.integers(1, 9)), 2)).astype(float) for k in range(12)}

    def brute(a, b):
        c = np.full((len(a), len(b)), np.inf)
        for i in range(len(a)):
            for j in range(len(b)):
                before = min((c[x, y] for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0), default=0.0)
                c[i, j] = max(before, math.dist(a[i], b[j]))
        return c[-1, -1]

    rows = [(k, s, float(x), float(y)) for k, t in tracks.items() for s, (x, y) in enumerate(t)]
    table = frame(spark, rows, "track_id int, seq int, x double, y double")
    pairs = frame(spark, [(a, b) for a in tracks for b in tracks if a < b], "track_a int, track_b int")
    got = {(r.track_a, r.track_b): r for r in measures.frechet_similarity(table, pairs).collect()}
    assert len(got) == 66
    for (a, b), r in got.items():
        assert math.isclose(r.distance, brute(tracks[a], tracks[b])) and math.isclose(r.similarity, 1 / (1 + r.distance / 10))
    near = measures.frechet_similarity(table, pairs, bound=8.0).collect()
    assert {(r.track_a, r.track_b) for r in near} >= {k for k, r in got.items() if r.distance <= 8}


def test_clipping_and_overlap(spark):
    ring = "array<struct<x:double,y:double>>"
    square, shifted = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(2.0, 2.0), (2.0, 6.0), (6.0, 6.0), (6.0, 2.0)]
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]
    far = [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)]
    rows = [("half", square, shifted, 4 / 28), ("ell", ell, square, 12 / 16), ("ell first", square, ell, 12 / 16), ("same", square, square, 1.0), ("apart", square, far, 0.0), ("concave", ell, ell, None)]
    got = {r.name: r for r in polygons.polygon_iou(frame(spark, [r[:3] for r in rows], f"name string, a {ring}, b {ring}")).collect()}
    for name, _, _, want in rows:
        assert got[name].iou == pytest.approx(want) if want is not None else (got[name].iou is None and got[name].reason == "both concave")
    cut = polygons.clip_polygons(frame(spark, [(square, far)], f"subject {ring}, window {ring}")).first()
    assert cut.clipped == []


def test_sweeps_are_hilbert_curves(spark):
    areas = frame(spark, [(k, 0.0, 2.0**k - 1, 10.0, 10 + 2.0**k - 1, k) for k in (2, 3, 4)], "site_id int, min_x double, max_x double, min_y double, max_y double, order int")
    rows = sorted((r.site_id, r.seq, r.x, r.y - 10) for r in generators.hilbert_sweep(areas).collect())
    for k in (2, 3, 4):
        path = [r[2:] for r in rows if r[0] == k]
        assert len(set(path)) == 4**k and path[0] == (0.0, 0.0)
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_nearest_surface_reaches_far_cells(spark):
    cells = [(0, 0, 0, 0), (0, 1, 0, 0), (0, 40, 40, 10), (2, 5, 5, 5)]
    points = [(k, s, *p) for k, (s, *p) in enumerate([(0, -40.0, -47.0, 1.0), (0, 300.0, 300.0, 20.0), (1, 0.0, 0.0, 0.0), (2, -500.0, 0.0, 0.0), (0, -46.0, -47.0, 1.0)])]
    surface = frame(spark, cells, "site_id int, i int, j int, k int")
    got = {r.vp_id: (r.i, r.j, r.k, r.dist) for r in voxels.nearest_surface(frame(spark, points, "vp_id int, site_id int, e double, n double, u double"), surface, "vp_id", 2.0, (-48.0, -48.0, 0.0)).collect()}
    for name, site, *p in points:
        near = sorted((math.dist(p, (-48 + (i + 0.5) * 2, -48 + (j + 0.5) * 2, (k + 0.5) * 2)), i, j, k) for s, i, j, k in cells if s == site)
        assert (name in got) == bool(near)
        if near:
            assert got[name] == pytest.approx((*near[0][1:], near[0][0]))


def test_obstacle_sources(spark):
    cell = "site_id int, i int, j int, k int"
    cells = frame(spark, [(0, 1, 1, k) for k in range(5)] + [(0, 2, 2, 0), (0, 3, 3, 3), (1, 1, 1, 0)], cell)
    labelled = frame(spark, [(0, 2, 2, 0, 1), (0, 3, 3, 3, 4)], cell + ", label int")
    sparse = frame(spark, [(0, 1, 1, 4)], cell)
    heights = frame(spark, [(0, 1, 1, 4.0), (0, 1, 1, 2.0)], "site_id int, i int, j int, h double")
    got = {tuple(r) for r in voxels.obstacle_lookup(cells, 2.0, labelled, sparse, heights).collect()}
    assert got == {(0, 1, 1, 0), (0, 1, 1, 1), (0, 1, 1, 2), (0, 1, 1, 4), (0, 3, 3, 3)}


def test_footprints_are_extruded(spark):
    ring = [(10.0, 10.0), (40.0, 10.0), (40.0, 40.0), (10.0, 40.0), (10.0, 10.0)]
    grids, cells = voxels.voxelize_footprints(frame(spark, [(7, ring, 20.0)], "site_id int, polygon array<struct<x:double,y:double>>, height double"), 5.0)
    g, rows = grids.first(), cells.collect()
    reach = math.hypot(15, 15)
    assert (g.cx, g.cy) == (25.0, 25.0) and math.isclose(g.radius, max(14 / math.tan(math.radians(26.5)), 1.5 * reach + 4))
    centre = {(round((r.i + 0.5) * 5 + g.oe, 6), round((r.j + 0.5) * 5 + g.on, 6)) for r in rows}
    assert all(abs(x) < 15 and abs(y) < 15 for x, y in centre) and {r.k for r in rows} == {1, 2, 3, 4} and len(rows) == 4 * len(centre)


def test_tags_are_appended_once(spark):
    clips = frame(spark, [(0, 1, 0.0, 0.0, 1.0, ["a"]), (0, 2, 5.0, 0.0, 1.0, ["occlusion_closeup", "b"]), (1, 3, 0.0, 0.0, 1.0, ["c"]), (0, 4, 0.0, 0.0, 1.1, ["d", "e", "f", "g"])], "site_id int, clip int, e double, n double, u double, interest_tags array<string>")
    close = frame(spark, [(0, 0.0, 4e-7, 1.0), (0, 0.0, -4e-7, 1.0), (0, 5.0, 0.0, 1.0)], "site_id int, e double, n double, u double")
    got = {r.clip: r.interest_tags for r in missions.first_tags(missions.tag_closeups(clips, close)).collect()}
    assert got == {1: ["a", "occlusion_closeup"], 2: ["occlusion_closeup", "b"], 3: ["c"], 4: ["d", "e", "f"]}


def test_short_tracks_keep_their_corners(spark):
    rows = [(0, 0, 0.0, 0.0), (0, 1, 4.0, 4.0), (1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 4.0, 4.0), (2, 0, 1.0, 1.0)]
    out = missions.chaikin(frame(spark, rows, "track_id int, seq int, x double, y double"), 2).orderBy("track_id", "at").collect()
    assert [(r.x, r.y) for r in out if r.track_id != 1] == [(0.0, 0.0), (4.0, 4.0), (1.0, 1.0)]

    def cut(p):
        inner = [((1 - w) * a[0] + w * b[0], (1 - w) * a[1] + w * b[1]) for a, b in zip(p, p[1:], strict=False) for w in (0.25, 0.75)]
        return [p[0], *inner, p[-1]]

    assert np.allclose([(r.x, r.y) for r in out if r.track_id == 1], cut(cut([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])))


def test_routes_are_local_optima_and_long_ones_are_cut(spark):
    rng = np.random.default_rng(6)
    for n in (2, 3, 4, 5, 9, 30):
        p = rng.normal(size=(n, 3)) * 30
        d = np.rint(np.linalg.norm(p[:, None] - p[None], axis=2) * 1000) / 1000
        length = lambda path, d=d: sum(d[a, b] for a, b in zip(path, path[1:], strict=False))
        path = routes._visit(p)
        assert sorted(path) == list(range(n)) and path[0] == 0
        for a in range(1, n):
            for b in range(a, n):
                assert length(path[:a] + path[a : b + 1][::-1] + path[b + 1 :]) >= length(path) - 1e-6
                piece, rest = path[a : b + 1], path[:a] + path[b + 1 :]
                if b - a < 3:
                    assert all(length(rest[:c] + piece + rest[c:]) >= length(path) - 1e-6 for c in range(1, len(rest) + 1))
    rows = [(1, s, *map(float, rng.normal(size=3))) for s in range(routes.STRETCH + 7)]
    out = routes.route_missions(frame(spark, rows, "mission_id int, seq int, e double, n double, u double")).collect()
    assert sorted(r.visit for r in out) == list(range(len(rows))) and all((r.seq < routes.STRETCH) == (r.visit < routes.STRETCH) for r in out)


def test_unknown_keys_are_reported(spark, tmp_path):
    clip = {"clip_id": "c", "shot_type": "orbit", "poses": [{"position": [0, 0, 1], "orientation": {"w": 1, "x": 0, "y": 0, "z": 0}}], "interest_tags": []}
    good = {"aoi_name": None, "home": {"lat": 1, "lon": 2, "alt": 0}, "clips": [clip], "coverage": 0.5}
    deep = json.loads(json.dumps(good))
    deep["clips"][0]["poses"][0]["orientation"]["v"] = 1
    deep["clips"][0]["poses"][0]["roll"] = 1
    rows = [good, good | {"extra": 1}, good | {"home": good["home"] | {"city": "x"}}, good | {"clips": [clip | {"quality": 1}]}, deep]
    (tmp_path / "sets.json").write_text("\n".join(map(json.dumps, rows)) + "\nno json\n")
    sets = files.validate_footage_sets(files.read_footage_sets(spark, str(tmp_path / "sets.json"))).collect()
    assert sorted(map(tuple, (r._unknown for r in sets))) == sorted([(), (), ("extra",), ("home.city",), ("clip.quality",), ("orientation.v", "pose.roll")])
    assert sum("unknown" in r.reasons for r in sets) == 4 and sum(not r.reasons for r in sets) == 1


def test_models_refs_and_traces(spark, tmp_path):
    surface = frame(spark, [(0, 24, 24, 1), (0, 24, 25, 1)], "site_id int, i int, j int, k int")
    poses = frame(spark, [(0, 5, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0)], "site_id int, pose_id int, e double, n double, u double, qw double, qx double, qy double, qz double")
    refs = files.posed_image_refs(poses)
    assert refs.first().ref == "img_0000" and refs.first().pose.orientation.w == 1.0
    share = frame(spark, [(0, 0.25)], "site_id int, coverage double")
    model = files.model3d(surface, refs, share, 2.0, (-48.0, -48.0, 0.0))
    assert {(r.part, tuple(r.position), r.coverage) for r in model.collect()} == {("surface", (1.0, 1.0, 3.0), 0.25), ("surface", (1.0, 3.0, 3.0), 0.25), ("image", (1.0, 2.0, 3.0), 0.25)}
    given = frame(spark, [(0, 0.75)], "site_id int, override double")
    assert files.model3d(surface, refs, share, 2.0, (-48.0, -48.0, 0.0), given).first().coverage == 0.75
    sites = frame(spark, [(0, 37.0, -122.0, 0.0, 30.0)], "site_id int, home_lat double, home_lon double, home_alt double, height double")
    path = frame(spark, [(0, 0, 0.0, 0.0, 25.04), (0, 1, 100.0, 0.0, 5.0)], "site_id int, seq int, e double, n double, u double")
    trace = files.geo_trace(sites, {"trajectory": path})
    rows = {r.seq: r for r in trace.collect()}
    assert (rows[0].lat, rows[0].lon, rows[0].alt, rows[0].phase, rows[1].phase) == (37.0, -122.0, 25.0, "survey", "capture") and rows[1].lon > -122
    files.write_trace(trace, share, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/trace").count() == 2 and spark.read.json(f"{tmp_path}/out/meta").first().coverage == 0.25
    back = frames.ned_to_geodetic(frames.to_ned(path).drop("e", "n", "u"), sites).where("seq = 0").first()
    assert (back.lat, back.lon) == pytest.approx((37.0, -122.0))


@pytest.fixture(scope="module")
def scene(spark):
    """Two sites: a box building on the ground, one with a tree beside it."""
    box = [(s, i, j, k, 2) for s in (0, 1) for i in range(21, 27) for j in range(21, 27) for k in range(1, 8)]
    ground = [(s, i, j, 0, 1) for s in (0, 1) for i in range(48) for j in range(48)]
    tree = [(1, i, j, k, 3) for i in (23, 24) for j in (30, 31) for k in range(1, 9)]
    solid = frame(spark, box + ground + tree, "site_id int, i int, j int, k int, label int")
    sites = frame(spark, [(0, 37.0, -122.0, 0.0, 16.0), (1, 40.0, 10.0, 0.0, 16.0)], "site_id int, home_lat double, home_lon double, home_alt double, height double")
    cams = spark.range(1).selectExpr("0 AS camera_id", "84D AS hfov", "53D AS vfov", "640 AS width", "480 AS height")
    return sites, solid, cams


def test_stages_end_to_end(spark, scene):
    sites, solid, cams = scene
    out = survey.run_pipeline(sites, solid, cams, views=8)
    share = {r.site_id: r.coverage for r in out["coverage"].collect()}
    assert all(0.5 < x <= 1 for x in share.values()) and len(share) == 2
    surface = out["surface"].count()
    assert surface == voxels.shell_voxels(solid).count()
    seen = coverage.coverage(out["surface"], out["visibility"]).collect()
    assert all(r.coverage <= share[r.site_id] + 0.101 for r in seen)
    picks = out["plan"].collect()
    assert all(r.gain > 0 for r in picks)
    points, clips = out["waypoints"].collect(), out["clips"].collect()
    assert len(points) == len(clips) >= 4 and {r.site_id for r in points} == {0, 1}
    for site in (0, 1):
        mine = sorted((r for r in points if r.site_id == site), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(len(mine))) and mine[0].value == max(r.value for r in mine)
    assert out["keyframes"].count() == len(points) and out["quarantine"].count() == 0
    audit = {r.mission_id: r for r in out["audit"].collect()}
    assert all(r.collided or r.min_clearance is None or r.min_clearance >= 1.5 for r in audit.values())
    summary = {r.mission_id: r for r in out["summary"].collect()}
    tagged = {s: sum("occlusion_closeup" in r.interest_tags for r in clips if r.site_id == s) for s in (0, 1)}
    assert {s: summary[s].n_closeups for s in (0, 1)} == tagged
    assert out["framed"].count() == 2


def test_sites_without_a_viewpoint_are_set_aside(spark):
    field = frame(spark, [(0, "a", 0.0, 0.0, 10.0, 1.0, 0.0, 0.0, 0.0, 2.0), (1, "b", 500.0, 0.0, 10.0, 1.0, 0.0, 0.0, 0.0, 3.0)], "site_id int, vp_id string, e double, n double, u double, qw double, qx double, qy double, qz double, value double")
    aoi = generators.scene_aoi(frame(spark, [(0, 30.0, 20.0), (1, 30.0, 20.0)], "site_id int, radius double, height double"))
    out = survey.build_missions(field, aoi, frame(spark, [], "site_id int, i int, j int, k int"))
    assert [r.site_id for r in out["quarantine"].collect()] == [1] and [r.mission_id for r in out["waypoints"].collect()] == [0]


def test_what_poses_see_against_brute_force(spark, scene):
    sites, solid, cams = scene
    poses = survey._poses(generators.candidate_views(("ring", missions.orbit_poses(camera.orbit_radius(sites, 53.0), 4).withColumnRenamed("view", "step"))))
    shell = voxels.shell_voxels(solid)
    pairs = rays.frustum_pairs(poses, shell, cams).collect()
    fx, fy = 320 / math.tan(math.radians(42)), 240 / math.tan(math.radians(26.5))
    want = 0
    for r in poses.collect():
        p, turn = np.array([r.e, r.n, r.u]), rotation(np.array([r.e, r.n, r.u]), (r.te, r.tn, r.tu))
        for c in shell.where(f"site_id = {r.site_id}").collect():
            q = turn.T @ (np.array([-48 + (c.i + 0.5) * 2, -48 + (c.j + 0.5) * 2, (c.k + 0.5) * 2]) - p)
            want += q[2] > 1e-6 and -320 <= fx * q[0] / q[2] < 320 and -240 <= fy * q[1] / q[2] < 240
    assert len(pairs) == want > 0
