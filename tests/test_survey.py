"""Closed-form cases, and every registered query against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from siteview.operators import camera, frames, interest, missions, polygons, voxels
from siteview.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(frame, columns):
    cell = lambda v: "~" if v is None or v != v else f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


HOME = "1 AS site_id, 37.4275D AS home_lat, -122.1697D AS home_lon, 12D AS home_alt"


def test_frames_round_trip(spark):
    sites = spark.range(1).selectExpr(*HOME.split(", "))
    points = spark.range(200).selectExpr("1 AS site_id", "id", "37.4275D + 0.03 * sin(id) AS lat", "-122.1697D + 0.03 * cos(3 * id) AS lon", "CAST(id % 300 - 100 AS DOUBLE) AS alt")
    back = frames.enu_to_geodetic(frames.to_enu(points, sites).withColumnsRenamed({"lat": "a", "lon": "b", "alt": "c"}), sites)
    assert back.where("abs(lat - a) > 1e-9 OR abs(lon - b) > 1e-9 OR abs(alt - c) > 1e-3").count() == 0
    at_home = frames.to_enu(spark.range(1).selectExpr("1 AS site_id", "37.4275D AS lat", "-122.1697D AS lon", "12D AS alt"), sites).first()
    assert math.hypot(at_home.e, at_home.n, at_home.u) < 1e-6
    r = frames.to_ned(spark.range(1).selectExpr("3D AS e", "5D AS n", "7D AS u")).first()
    assert (r.north, r.east, r.down) == (5, 3, -7)
    assert [x.reason for x in frames.set_home(spark.sql("SELECT 1 AS site_id, 91D AS lat, 0D AS lon, 0D AS alt UNION ALL SELECT 2, 5D, 0D, NULL")).orderBy("site_id").collect()] == ["out of range", None]


def test_cameras(spark):
    cameras = spark.range(1).selectExpr("0 AS camera_id", "84D AS hfov", "53D AS vfov", "1920 AS width", "1080 AS height")
    r = camera.camera_intrinsics(cameras).first()
    assert (r.cx, r.cy) == (960, 540)
    poses = spark.sql("SELECT 1 AS image_id, 1 AS site_id, 0 AS camera_id, 2D AS e, 1D AS n, 80D AS u, 0.1D AS qw, 0.9D AS qx, 0.2D AS qy, 0.3D AS qz")
    points = spark.range(20).selectExpr("id", "1 AS image_id", "CAST(id AS DOUBLE) AS e", "CAST(id % 5 AS DOUBLE) AS n", "CAST(id % 3 AS DOUBLE) AS u")
    seen = camera.project_points(points, poses, cameras).where("px IS NOT NULL")
    back = camera.backproject_depth(seen.selectExpr("id", "image_id", "px AS u", "py AS v", "z AS depth"), poses, cameras)
    assert seen.count() and back.where("abs(e - id) > 1e-6 OR abs(n - id % 5) > 1e-6 OR abs(u - id % 3) > 1e-6").count() == 0
    turned = camera.pose_quaternion(camera.pose_rotation(poses).drop("qw", "qx", "qy", "qz")).first()
    norm = math.sqrt(0.1**2 + 0.9**2 + 0.2**2 + 0.3**2)
    assert [turned.qw * norm, turned.qx * norm, turned.qy * norm, turned.qz * norm] == pytest.approx([0.1, 0.9, 0.2, 0.3])
    sky = camera.backproject_ground(spark.sql("SELECT 1 AS image_id, 960D AS px, 540D AS py"), poses.withColumns({"qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)}), cameras).first()
    assert sky.e is None and sky.reason == "behind"
    assert camera.orbit_radius(spark.sql("SELECT 1 AS site_id, 30D AS height"), 53.0).first().radius == pytest.approx(38.11, abs=0.01)


def test_polygons(spark):
    ring = lambda *p: "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in p) + ") AS polygon"
    box = spark.range(1).selectExpr("1 AS site_id", ring((0, 0), (20, 0), (20, 12), (0, 12)), "40D AS max_altitude")
    assert polygons.polygon_area(box).first().area == 240 and polygons.is_convex(box).first().convex
    points = spark.sql("SELECT 1 AS site_id, 10D AS e, 6D AS n, 30D AS u UNION ALL SELECT 1, 25D, 6D, 30D UNION ALL SELECT 1, 20D, 6D, 30D UNION ALL SELECT 1, 10D, 6D, 50D")
    assert polygons.points_in_polygon(points, box).where("inside").count() == 2
    assert polygons.inside_geofence(points, box).count() == 2
    line = spark.range(1).selectExpr("1 AS site_id", ring((0, 0), (1, 1), (2, 2)))
    assert polygons.confirm_aoi(line).first().reason == "area"


def test_selection(spark):
    v = spark.createDataFrame([(1, k, float(e), 0.0, 10.0, float(x)) for k, (e, x) in enumerate([(0, 5), (3, 2), (40, 7), (43, 1), (-40, 6)])], "site_id int, vp_id long, e double, n double, u double, value double")
    assert sorted(r.value for r in interest.local_maxima(v).collect()) == [5, 6, 7]
    h = spark.sql("SELECT 1 AS site_id, 1 AS hs_id, 0D AS e, 0D AS n, 0D AS u, 1D AS nx, 0D AS ny, 0D AS nz, 2D AS interest")
    cams = spark.range(1).selectExpr("0 AS camera_id", "84D AS hfov", "53D AS vfov", "640 AS width", "480 AS height")
    one = spark.createDataFrame([(1, 1, 12.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)], "site_id int, vp_id long, e double, n double, u double, te double, tn double, tu double, camera_id int")
    one = camera.look_at(one)
    assert interest.viewpoint_value(one, h, cams).first().score == pytest.approx(2.0)
    assert interest.viewpoint_value(one, h.withColumn("nx", F.lit(-1.0)), cams).first().score == 0
    near = spark.createDataFrame([(1, 1, 0, 0)], "site_id int, i int, j int, k int")
    got = voxels.clearance(one.withColumn("e", F.lit(-44.0)).withColumn("n", F.lit(-47.0)).withColumn("u", F.lit(1.0)), near, "vp_id", 4).first()
    assert got.min_d == pytest.approx(1.0)


def test_missions(spark):
    w = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 4.0, 0.0), (1, 2, 3.0, 4.0, 0.0)], "mission_id long, seq int, e double, n double, u double").withColumn("speed", F.lit(None).cast("double"))
    assert missions.tour_length(w).first().length == 7
    s = missions.running_totals(missions.leg_samples(w)).agg(F.max("path_m").alias("m"), F.max("time_s").alias("t")).first()
    assert (s.m, s.t) == (pytest.approx(7), pytest.approx(1.4))
    for n in range(1, 12):
        m = spark.range(n).selectExpr("1 AS mission_id", "CAST(id AS INT) AS seq")
        assert missions.check_variety(missions.assign_shot_types(m), min(3, n)).first().varied
    with pytest.raises(ValueError):
        missions.assign_shot_types(w, palette=("orbit",))
    t = spark.range(17).selectExpr("1 AS track_id", "CAST(id AS INT) AS seq", "CAST(id * id AS DOUBLE) AS x", "0D AS y")
    assert missions.catmull_rom(t).count() == 16 * 18 + 1
