"""Registered queries of aimed poses, value fields, footprints, tags, matches and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import camera, coverage, frames, generators, interest, legs, measures, missions, polygons, rays, survey, voxels
from ..sources import driver_tables as T
from ..sources import files
from .queries import AOI, CAMERA, GEO, HOTSPOTS, LEGS, MAP, ORIGIN, POSES, RES, ROT, SHOTS, SITES, TRACKS, VIEWPOINTS, WAYPOINTS, _r, _s, _sql_ecef, register
from .views import RADIUS, VIEWS, _r4, _s4, _sites, _surface

TURN = [f"r{i}{j}" for i in range(3) for j in range(3)]


def _aim(source: str, up: float) -> str:
    """Poses of ``source`` that look at (0, 0, up) with their rotation r00..r22, as the table aimed."""
    down = "sqrt(z0 * z0 + z1 * z1) < 1e-9"
    return f"""az AS (SELECT *, -e / l AS z0, -n / l AS z1, ({up} - u) / l AS z2 FROM (SELECT *, nullif(sqrt(e * e + n * n + ({up} - u) * ({up} - u)), 0) AS l FROM {source})),
  ax AS (SELECT *, CASE WHEN {down} THEN -z2 ELSE z1 END AS a0, CASE WHEN {down} THEN 0.0 ELSE -z0 END AS a1, CASE WHEN {down} THEN z0 ELSE 0.0 END AS a2 FROM az),
  an AS (SELECT *, a0 / m AS x0, a1 / m AS x1, a2 / m AS x2 FROM (SELECT *, sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS m FROM ax)),
  aimed AS (SELECT *, x0 AS r00, z1 * x2 - z2 * x1 AS r01, z0 AS r02, x1 AS r10, z2 * x0 - z0 * x2 AS r11, z1 AS r12, x2 AS r20, z0 * x1 - z1 * x0 AS r21, z2 AS r22 FROM an)"""


def _sql_trace() -> str:
    """Waypoints as latitude and longitude, 7 places, with their phase."""
    return f"""q AS (SELECT *, {_sql_ecef('home_lat', 'home_lon', 'home_alt', 'h')}, {ROT} FROM waypoints JOIN sites USING (site_id)),
      w AS (SELECT site_id, mission_id, seq, u, height, hx - sl * e - sp * cl * n + cp * cl * u AS x, hy + cl * e - sp * sl * n + cp * sl * u AS y, hz + cp * n + sp * u AS z FROM q),
      trace AS (SELECT site_id, 'trajectory' AS part, mission_id * 1000 + seq AS seq, round_even(lat, 7) AS lat, round_even(lon, 7) AS lon, round_even(u, 1) AS alt,
        CASE WHEN u / height >= 0.70 THEN 'survey' WHEN u / height >= 0.32 THEN 'orbit' ELSE 'capture' END AS phase, {SHOTS} AS label FROM ({GEO.format('w')}))"""


def _aimed(spark, sf, up: float = 10.0):
    rows = T.viewpoints(spark, sf).withColumns({"te": F.lit(0.0), "tn": F.lit(0.0), "tu": F.lit(up), "camera_id": F.lit(0)})
    return camera.look_at(rows)


ROTATED = f"WITH {VIEWPOINTS}, {_aim('viewpoints', 10)} SELECT vp_id, {_s(*TURN)} FROM aimed WHERE r00 IS NOT NULL"


@register(ROTATED)
def p11_look_at(spark, sf):
    return _aimed(spark, sf).where("r00 IS NOT NULL").select("vp_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in TURN])


@register(ROTATED)
def p10_pose_quaternion(spark, sf):
    """The rotation of the quaternion of a rotation is that rotation."""
    back = camera.pose_rotation(camera.pose_quaternion(_aimed(spark, sf).where("r00 IS NOT NULL")).drop(*TURN))
    return back.select("vp_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in TURN])


@register(f"WITH {POSES}, {VIEWPOINTS} SELECT vp_id, image_id, {_s('c0', 'c1', 'c2')}, e, n, u FROM (SELECT vp_id, image_id, v.e - p.e AS c0, p.n - v.n AS c1, p.u - v.u AS c2, v.e, v.n, v.u FROM viewpoints v JOIN poses p ON p.image_id = v.vp_id % 200)")
def p12_camera_round_trip(spark, sf):
    poses = T.poses(spark, sf)
    points = rays.world_to_camera(T.viewpoints(spark, sf).selectExpr("vp_id", "vp_id % 200 AS image_id", "e", "n", "u"), poses)
    return rays.camera_to_world(points, poses).select("vp_id", "image_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("c0", "c1", "c2", "e", "n", "u")])


@register(f"""WITH {SITES}, {VIEWPOINTS}, q AS (SELECT *, {_sql_ecef('home_lat', 'home_lon', 'home_alt', 'h')}, {ROT} FROM viewpoints JOIN sites USING (site_id)),
  w AS (SELECT vp_id, hx - sl * e - sp * cl * n + cp * cl * u AS x, hy + cl * e - sp * sl * n + cp * sl * u AS y, hz + cp * n + sp * u AS z FROM q)
  SELECT vp_id, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 5) AS alt FROM ({GEO.format('w')})""")
def p5_ned_to_geodetic(spark, sf):
    rows = frames.ned_to_geodetic(frames.to_ned(T.viewpoints(spark, sf)).drop("e", "n", "u"), T.sites(spark, sf))
    return rows.select("vp_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("alt", 5).alias("alt"))


PINS = "pins AS (SELECT s_suppkey AS site_id, CAST(s_suppkey % 200 - 100 AS DOUBLE) AS lat, CAST(s_suppkey * 7 % 380 - 190 AS DOUBLE) AS lon, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS alt FROM supplier)"


@register(f"WITH {PINS}, g AS (SELECT *, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS ok FROM pins) SELECT site_id, CASE WHEN ok THEN lat END AS home_lat, CASE WHEN ok THEN lon END AS home_lon, CASE WHEN ok THEN coalesce(alt, 0.0) END AS home_alt, CASE WHEN NOT ok THEN 'out of range' END AS reason FROM g")
def p6_set_home(spark, sf):
    pins = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS site_id", "CAST(s_suppkey % 200 - 100 AS DOUBLE) AS lat", "CAST(s_suppkey * 7 % 380 - 190 AS DOUBLE) AS lon", "CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS alt")
    return frames.set_home(pins).select("site_id", "home_lat", "home_lon", "home_alt", "reason")


@register(f"WITH {SITES}, {VIEWPOINTS} SELECT vp_id, round(home_lat + n / 111320.0, 9) AS lat, round(home_lon + e / (111320.0 * cos(radians(home_lat))), 9) AS lon FROM viewpoints JOIN sites USING (site_id)")
def p7_planar_geodetic(spark, sf):
    return frames.planar_geodetic(T.viewpoints(spark, sf), T.sites(spark, sf)).select("vp_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@register(f"WITH {POSES}, {CAMERA} SELECT image_id, round(u / fx, 6) AS gsd FROM poses, cam")
def p18_target_gsd(spark, sf):
    rows = T.poses(spark, sf).join(F.broadcast(camera.camera_intrinsics(T.cameras(spark))), "camera_id")  # one camera model
    return camera.target_gsd(rows, F.col("u")).select("image_id", *_r("gsd"))


@register(f"{VIEWS}, {SITES}, d AS (SELECT site_id, i, j, k, -48 + (i + 0.5) * 2 - 1 AS de, -48 + (j + 0.5) * 2 - 1 AS dn FROM surface), h AS (SELECT *, sqrt(de * de + dn * dn) AS r FROM d) SELECT site_id, i, j, k, round(CASE WHEN r < 1e-9 THEN 0 ELSE de / nullif(r, 0) END, 6) + 0.0 AS nx, round(CASE WHEN r < 1e-9 THEN 0 ELSE dn / nullif(r, 0) END, 6) + 0.0 AS ny, CASE WHEN r < 1e-9 THEN 1.0 ELSE 0.0 END AS nz FROM h")
def p20_outward_normal(spark, sf):
    at = voxels.voxel_center(_surface(spark, sf), RES, ORIGIN).join(T.sites(spark, sf).select("site_id", "height"), "site_id")
    rows = coverage.outward_normal(at.withColumns({"ce": F.lit(1.0), "cn": F.lit(1.0), "cu": F.lit(0.0)}))
    return rows.select("site_id", "i", "j", "k", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("nx", "ny")], "nz")


@register(f"WITH {VIEWPOINTS} SELECT vp_id, round_even(e / 8, 2) + 0.0 AS e, round_even(u / 16, 3) AS u FROM viewpoints")
def p29_round_vectors(spark, sf):
    rows = T.viewpoints(spark, sf).select("vp_id", (F.col("e") / 8).alias("e"), (F.col("u") / 16).alias("u"))
    return frames.round_vectors(rows, {"e": 2, "u": 3}).select("vp_id", (F.col("e") + F.lit(0.0)).alias("e"), "u")


@register("WITH c AS (SELECT p_partkey AS camera_id, p_size * 40 + 1 AS w, p_size * 23 + 1 AS h FROM part), s AS (SELECT *, least(1.0::DOUBLE, 120.0::DOUBLE / greatest(w, h)) AS f FROM c) SELECT camera_id, CAST(greatest(2, round_even(w * f, 0)) AS INT) AS width, CAST(greatest(2, round_even(h * f, 0)) AS INT) AS height FROM s")
def p31_survey_camera(spark, sf):
    cameras = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS camera_id", "CAST(p_size * 40 + 1 AS INT) AS width", "CAST(p_size * 23 + 1 AS INT) AS height")
    return generators.survey_camera(cameras).select("camera_id", "width", "height")


@register(f"{RADIUS}, o AS (SELECT site_id, CAST(v AS INT) AS view, -cos(2.0::DOUBLE * pi() * v / 16) AS z0, -sin(2.0::DOUBLE * pi() * v / 16) AS z1 FROM s, range(16) x(v)) SELECT site_id, view, round(z1, 6) + 0.0 AS r00, round(-z0, 6) + 0.0 AS r10, round(z0, 6) + 0.0 AS r02, round(z1, 6) + 0.0 AS r12 FROM o")
def p33_orbit_aimed(spark, sf):
    rows = camera.look_at(missions.orbit_poses(_sites(spark, sf)))
    return rows.select("site_id", "view", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("r00", "r10", "r02", "r12")])


@register(f"""WITH RECURSIVE {AOI}, box AS (SELECT site_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM verts GROUP BY site_id),
  o AS (SELECT *, CAST(greatest(2, least(4, ceil(log2(greatest(x1 - x0, y1 - y0) / (2 * (10.0::DOUBLE + site_id) * (1 - 0.6::DOUBLE)) + 1)))) AS INT) AS k FROM box),
  h AS (SELECT site_id, k, CAST(d AS BIGINT) AS seq, CAST(d AS BIGINT) AS t, 0::BIGINT AS x, 0::BIGINT AS y, 1::BIGINT AS s FROM o, range(256) r(d) WHERE d < (1 << (2 * k))
    UNION ALL SELECT site_id, k, seq, t // 4, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN s - 1 - y ELSE y END + s * rx, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN s - 1 - x ELSE x END + s * ry, s * 2
    FROM (SELECT *, (t // 2) % 2 AS rx, xor(t, (t // 2) % 2) % 2 AS ry FROM h) WHERE s < (1 << k))
  SELECT h.site_id, seq, round(x0 + (x1 - x0) * x / ((1 << h.k) - 1), 6) + 0.0 AS x, round(y0 + (y1 - y0) * y / ((1 << h.k) - 1), 6) + 0.0 AS y FROM h JOIN o USING (site_id) WHERE s = (1 << h.k)""")
def p39_hilbert_sweep(spark, sf):
    box = polygons.polygon_stats(T.aoi(spark, sf))
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    rows = generators.hilbert_sweep(box.withColumn("order", generators.sweep_order(extent, F.col("site_id") + F.lit(10.0))))
    return rows.select("site_id", "seq", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xy"])


POIS = "pois AS (SELECT CAST(s_suppkey % 25 AS INT) AS site_id, CAST(s_suppkey % 31 - 15 AS DOUBLE) AS e, CAST(s_suppkey % 29 - 14 AS DOUBLE) AS n, CAST(5 + s_suppkey % 4 AS DOUBLE) AS r, CAST(s_suppkey % 4 AS INT) AS loops FROM supplier)"


@register(f"""WITH {VIEWPOINTS}, {POIS}, p AS (SELECT *, least(1.0::DOUBLE, 0.55 + 0.18 * CASE WHEN loops = 0 THEN 1 ELSE loops END) AS heat FROM pois), a AS (SELECT site_id, e, n, heat FROM p
  UNION ALL SELECT site_id, e + 0.6 * r * cos(pi() * k / 5), n + 0.6 * r * sin(pi() * k / 5), heat * 0.55 FROM p, range(10) x(k) UNION ALL SELECT site_id, e, n, 0.4 FROM viewpoints)
  SELECT site_id, {_s4('e', 'n', 'heat')}, count(*) AS n_rows FROM a GROUP BY ALL""")
def p40_heat_points(spark, sf):
    pois = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("CAST(s_suppkey % 25 AS INT) AS site_id", "CAST(s_suppkey % 31 - 15 AS DOUBLE) AS e", "CAST(s_suppkey % 29 - 14 AS DOUBLE) AS n", "CAST(5 + s_suppkey % 4 AS DOUBLE) AS r", "CAST(s_suppkey % 4 AS INT) AS loops")
    rows = generators.heat_points(pois, T.viewpoints(spark, sf)).select("site_id", *_r4("e", "n", "heat"))
    return rows.groupBy("site_id", "e", "n", "heat").agg(F.count("*").alias("n_rows"))


@register(f"""{RADIUS}, {CAMERA}, w AS (SELECT *, 10.0::DOUBLE AS w, height / 2 AS mid FROM s, cam), x AS (SELECT *, [0, 0, -w / 2, w / 2][k] AS px, [0, height, mid, mid][k] AS pz FROM w, range(1, 5) r(k)),
  p AS (SELECT *, cx - fx * px / (radius + w / 2) AS u, cy + fy * (mid - pz) / (radius + w / 2) AS v FROM x) SELECT site_id, 0 AS camera_id, bool_and(u BETWEEN 0.12 * 640 AND 640 - 0.12 * 640 AND v BETWEEN 0.12 * 480 AND 480 - 0.12 * 480) AS fits FROM p GROUP BY site_id""")
def f5_fits_in_frame(spark, sf):
    return camera.fits_in_frame(_sites(spark, sf), T.cameras(spark), 10.0, 0.12)


@register(f"WITH {AOI}, s AS (SELECT site_id, x * CASE WHEN site_id % 5 = 1 THEN 1e-5 ELSE 1 END AS x, y * CASE WHEN site_id % 5 = 1 THEN 1e-5 ELSE 1 END AS y, i, m FROM verts WHERE site_id % 5 <> 0 OR i <= 2), a AS (SELECT v.site_id, abs(sum(v.x * w.y - w.x * v.y)) / 2 AS area, count(*) AS n FROM s v JOIN s w ON v.site_id = w.site_id AND w.i = v.i % v.m + 1 WHERE v.site_id % 5 <> 0 GROUP BY v.site_id) SELECT site_id, CASE WHEN site_id % 5 = 0 THEN 'vertices' WHEN area < 1e-6 THEN 'area' END AS reason FROM (SELECT DISTINCT site_id FROM s) LEFT JOIN a USING (site_id)")
def f10_confirm_aoi(spark, sf):
    shrink = "transform(polygon, p -> named_struct('x', p.x * 1e-5D, 'y', p.y * 1e-5D))"
    rows = T.aoi(spark, sf).withColumn("polygon", F.expr(f"CASE site_id % 5 WHEN 0 THEN slice(polygon, 1, 2) WHEN 1 THEN {shrink} ELSE polygon END"))
    return polygons.confirm_aoi(rows).select("site_id", "reason")


def _slope(source: str, pairs: dict[str, str]) -> str:
    """Second-order time derivatives with steps of 1 s, as w6."""
    parts = ", ".join(f"CASE WHEN lag({c}) OVER w IS NULL THEN (-3 * {c} + 4 * lead({c}) OVER w - lead({c}, 2) OVER w) / 2 WHEN lead({c}) OVER w IS NULL THEN (3 * {c} - 4 * lag({c}) OVER w + lag({c}, 2) OVER w) / 2 ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS {d}" for c, d in pairs.items())
    return f"(SELECT *, {parts} FROM {source} WINDOW w AS (PARTITION BY mission_id ORDER BY seq))"


_DERIVED = _slope(_slope(_slope("waypoints", {"e": "ve", "n": "vn", "u": "vu"}), {"ve": "ae", "vn": "an", "vu": "au"}), {"ae": "je", "an": "jn", "au": "ju"})
SUMMARY = f"summary AS (SELECT mission_id, max(sqrt(ve * ve + vn * vn + vu * vu)) AS max_speed, max(sqrt(ae * ae + an * an + au * au)) AS max_accel, max(sqrt(je * je + jn * jn + ju * ju)) AS max_jerk, CAST(count(*) - 1 AS DOUBLE) AS duration FROM {_DERIVED} GROUP BY mission_id)"


# the nearest mapped cell within five cells of a sample, each way
A21_NEAR = f""", {MAP}, near AS (SELECT mission_id, min(sqrt(pow(e - (-48 + (i + 0.5) * 2), 2) + pow(n - (-48 + (j + 0.5) * 2), 2) + pow(u - (k + 0.5) * 2, 2))) AS min_clearance FROM waypoints JOIN mapped USING (site_id)
  WHERE abs(i - floor((e + 48) / 2)) <= 5 AND abs(j - floor((n + 48) / 2)) <= 5 AND abs(k - floor(u / 2)) <= 5 GROUP BY mission_id)"""


@register(f"WITH {WAYPOINTS}, {SUMMARY} SELECT mission_id, {_s('max_speed', 'max_accel', 'max_jerk', 'min_clearance')}, duration FROM summary LEFT JOIN near USING (mission_id)".replace("SELECT mission_id, round(max_speed", f"{A21_NEAR} SELECT mission_id, round(max_speed"))
def a21_trajectory_summary(spark, sf):
    rows = measures.trajectory_summary(T.waypoints(spark, sf), 1.0, obstacles=T.obstacle_map(spark, sf))
    return rows.select("mission_id", *_r("max_speed", "max_accel", "max_jerk", "min_clearance"), "duration")


@register(f"WITH {WAYPOINTS}, {SUMMARY} SELECT mission_id FROM summary WHERE max_speed <= 80.000001 AND max_accel <= 70.000001 AND max_jerk <= 90.000001")
def f14_within_limits(spark, sf):
    return measures.within_limits(measures.trajectory_summary(T.waypoints(spark, sf), 1.0), 80, 70, 90).select("mission_id")


FLOWN = f"WITH {WAYPOINTS}, {LEGS}, t AS (SELECT mission_id, sum(leg) AS path_m, sum(leg / least(greatest(speed, 0.1), 15)) / 1080 AS used FROM legs WHERE leg >= 1e-9 GROUP BY mission_id)"


def _flown(spark, sf):
    rows = legs.mission_legs(T.waypoints(spark, sf)).where("leg >= 1e-9").groupBy("mission_id").agg(F.sum("leg").alias("path_m"), (F.sum(F.col("leg") / F.col("v")) / 1080).alias("used"))
    return rows.withColumns({"collided": F.col("mission_id") % 5 == 0, "completed": F.col("used") < 0.2, "landed": F.col("mission_id") % 2 == 0})


@register(f"{FLOWN} SELECT mission_id, mission_id % 5 <> 0 AND (used < 0.2 OR mission_id % 2 = 0) AS ok FROM t")
def f16_flight_ok(spark, sf):
    return measures.flight_ok(_flown(spark, sf)).select("mission_id", "ok")


@register(f"{FLOWN}, c AS (SELECT mission_id, count(*) AS n_waypoints, count(DISTINCT {SHOTS}) AS n_shots, count(*) FILTER (seq % 4 = 3) AS n_closeups FROM waypoints GROUP BY mission_id) SELECT mission_id, n_waypoints, n_shots, n_closeups, round(path_m, 4) AS path_m, round(used, 6) AS used FROM c LEFT JOIN t USING (mission_id)")
def a16_mission_summary(spark, sf):
    clips = missions.assign_shot_types(T.waypoints(spark, sf)).withColumn("interest_tags", F.array("shot_type"))
    rows = measures.mission_summary(missions.add_tag(clips, "occlusion_closeup", F.col("seq") % 4 == 3), _flown(spark, sf))
    return rows.select("mission_id", "n_waypoints", "n_shots", "n_closeups", F.round("path_m", 4).alias("path_m"), *_r("used"))


HEIGHTS = "heights AS (SELECT CAST(l_suppkey % 25 AS INT) AS site_id, CAST(l_partkey % 48 AS INT) AS i, CAST(l_orderkey % 48 AS INT) AS j, max(l_quantity) AS h FROM lineitem GROUP BY ALL)"


@register(f"WITH {VIEWPOINTS}, {MAP}, {HEIGHTS}, c AS (SELECT DISTINCT site_id, CAST(floor((e + 48) / 2) AS INT) AS i, CAST(floor((n + 48) / 2) AS INT) AS j, CAST(floor(u / 2) AS INT) AS k FROM viewpoints) SELECT site_id, i, j, k FROM c WHERE EXISTS (SELECT 1 FROM mapped m WHERE m.site_id = c.site_id AND m.i = c.i AND m.j = c.j AND m.k = c.k) OR EXISTS (SELECT 1 FROM heights h WHERE h.site_id = c.site_id AND h.i = c.i AND h.j = c.j AND c.k * 2 <= h.h)")
def j7_obstacle_lookup(spark, sf):
    cells = voxels.voxel_index(T.viewpoints(spark, sf), RES, ORIGIN).select(*voxels.CELL).distinct()
    heights = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("CAST(l_suppkey % 25 AS INT) AS site_id", "CAST(l_partkey % 48 AS INT) AS i", "CAST(l_orderkey % 48 AS INT) AS j", "l_quantity AS h")
    return voxels.obstacle_lookup(cells, RES, sparse=T.obstacle_map(spark, sf), heights=heights)


# framing as the product of facing and the centring in the image; each aimed viewpoint with each hotspot of its site
PAIRS = f"""WITH {VIEWPOINTS}, {HOTSPOTS}, {CAMERA}, {_aim('viewpoints', 10)}, g AS (SELECT v.*, hs_id, interest, nx, ny, nz, h.e - v.e AS d0, h.n - v.n AS d1, h.u - v.u AS d2 FROM aimed v JOIN hotspots h USING (site_id)),
  f AS (SELECT *, sqrt(d0 * d0 + d1 * d1 + d2 * d2) AS dist, -(d0 * nx + d1 * ny + d2 * nz) AS dot, r00 * d0 + r10 * d1 + r20 * d2 AS c0, r01 * d0 + r11 * d1 + r21 * d2 AS c1, r02 * d0 + r12 * d1 + r22 * d2 AS c2 FROM g),
  i AS (SELECT *, cx + fx * c0 / c2 AS px, cy + fy * c1 / c2 AS py FROM f, cam WHERE dist >= 1e-9 AND dot > 0 AND c2 > 1e-9),
  pairs AS (SELECT *, dot / dist * (0.5 + 0.5 * (1 - least(1.0::DOUBLE, sqrt(pow((px - cx) / 320, 2) + pow((py - cy) / 240, 2)) / sqrt(2.0::DOUBLE)))) AS framing FROM i WHERE px >= 0 AND px < 640 AND py >= 0 AND py < 480)"""
VALUES = f"{PAIRS}, score AS (SELECT vp_id, sum(interest * framing * exp(-pow(dist - 12, 2) / 72)) AS score FROM pairs GROUP BY vp_id)"


@register(f"{PAIRS} SELECT site_id, hs_id, count(*) AS n, round(sum(framing), 4) AS framing FROM pairs WHERE framing > 0 GROUP BY ALL")
def j8_score_pairs(spark, sf):
    rows = interest.score_sums(_aimed(spark, sf), T.hotspots(spark, sf), T.cameras(spark), "hs_id")
    return rows.select("site_id", "hs_id", "n", F.round("framing", 4).alias("framing"))


@register(f"{VALUES} SELECT vp_id, round(coalesce(score, 0), 6) AS score FROM viewpoints LEFT JOIN score USING (vp_id)")
def a10_viewpoint_value(spark, sf):
    return interest.viewpoint_value(_aimed(spark, sf), T.hotspots(spark, sf), T.cameras(spark)).select("vp_id", *_r("score"))


_TRACE, _S = "r00 + r11 + r22", "sqrt({}) * 2"
_BRANCH = {
    "w": ("0.25 * s", "(r21 - r12) / s", "(r02 - r20) / s", "(r10 - r01) / s"), "x": ("(r21 - r12) / s", "0.25 * s", "(r01 + r10) / s", "(r02 + r20) / s"),
    "y": ("(r02 - r20) / s", "(r01 + r10) / s", "0.25 * s", "(r12 + r21) / s"), "z": ("(r10 - r01) / s", "(r02 + r20) / s", "(r12 + r21) / s", "0.25 * s"),
}
_Q = ", ".join(f"CASE b WHEN 0 THEN {v[0]} WHEN 1 THEN {v[1]} WHEN 2 THEN {v[2]} ELSE {v[3]} END AS q{k}" for k, v in _BRANCH.items())


@register(f"""{VALUES}, b AS (SELECT *, CASE WHEN {_TRACE} > 0 THEN 0 WHEN r00 > r11 AND r00 > r22 THEN 1 WHEN r11 > r22 THEN 2 ELSE 3 END AS b FROM aimed WHERE r00 IS NOT NULL),
  s AS (SELECT *, sqrt(CASE b WHEN 0 THEN {_TRACE} + 1 WHEN 1 THEN 1 + r00 - r11 - r22 WHEN 2 THEN 1 + r11 - r00 - r22 ELSE 1 + r22 - r00 - r11 END) * 2 AS s FROM b), q AS (SELECT vp_id, {_Q} FROM s)
  SELECT vp_id, round(abs(qw), 5) AS qw, round(abs(qx), 5) AS qx, round(abs(qy), 5) AS qy, round(abs(qz), 5) AS qz, round(coalesce(score, 0), 6) AS value FROM q LEFT JOIN score USING (vp_id)""")
def a11_build_value_field(spark, sf):
    """Sizes of the quaternion's parts: a rotation of half a turn has two, of opposite signs."""
    rows = interest.build_value_field(_aimed(spark, sf), T.hotspots(spark, sf), T.cameras(spark)).where("qw IS NOT NULL")
    return rows.select("vp_id", *[F.round(F.abs(c), 5).alias(c) for c in ("qw", "qx", "qy", "qz")], *_r("value"))


@register(f"""WITH {POSES}, {VIEWPOINTS}, cam AS (SELECT 32 / tan(radians(84) / 2) AS fx, 24 / tan(radians(53) / 2) AS fy), heat AS (SELECT l_orderkey % 200 AS image_id, l_partkey % 64 AS hu, l_suppkey % 48 AS hv, max(l_quantity) AS interest FROM lineitem GROUP BY ALL),
  p AS (SELECT vp_id, image_id, p.e - v.e AS de, p.n - v.n AS dn, p.u - v.u AS du, 32 - fx * (p.e - v.e) / (p.u - v.u) AS px, 24 + fy * (p.n - v.n) / (p.u - v.u) AS py FROM viewpoints v JOIN poses p ON p.image_id = v.vp_id % 200, cam WHERE p.u - v.u > 1e-9),
  l AS (SELECT *, sqrt(de * de + dn * dn + du * du) AS l FROM p JOIN heat h USING (image_id) WHERE hu = round_even(px, 0) AND hv = round_even(py, 0) AND interest > 10)
  SELECT vp_id, image_id, interest, round(de / l, 6) + 0.0 AS nx, round(dn / l, 6) + 0.0 AS ny, round(du / l, 6) + 0.0 AS nz FROM l""")
def j9_sample_heatmap(spark, sf):
    heat = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey % 200 AS image_id", "l_partkey % 64 AS u", "l_suppkey % 48 AS v", "l_quantity AS interest")
    heat = heat.groupBy("image_id", "u", "v").agg(F.max("interest").alias("interest"))
    points = T.viewpoints(spark, sf).selectExpr("vp_id", "vp_id % 200 AS image_id", "e", "n", "u")
    rows = interest.sample_heatmap(points, T.poses(spark, sf), generators.survey_camera(T.cameras(spark), 64), heat, 10.0)
    return rows.select("vp_id", "image_id", "interest", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


@register(f"""WITH {SITES}, {AOI}, g AS (SELECT site_id, height, max(sqrt(x * x + y * y)) AS reach FROM verts JOIN sites USING (site_id) GROUP BY ALL),
  h AS (SELECT *, greatest((height / 2 + 4) / tan(radians(53.0::DOUBLE) / 2), 1.5 * reach + 4) + reach + 6 AS half FROM g),
  c AS (SELECT site_id, height, CAST(i AS INT) AS i, CAST(j AS INT) AS j, (i + 0.5::DOUBLE) * 5 - half AS e, (j + 0.5::DOUBLE) * 5 - half AS n FROM h, range(200) a(i), range(200) b(j) WHERE i < ceil(2 * half / 5) AND j < ceil(2 * half / 5)),
  f AS (SELECT c.site_id, c.height, c.i, c.j FROM c JOIN edges d ON d.site_id = c.site_id GROUP BY c.site_id, c.height, c.i, c.j HAVING count(*) FILTER ((y1 > n) <> (y2 > n) AND e < (x2 - x1) * (n - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1)
  SELECT site_id, i, j, CAST(k AS INT) AS k FROM f, range(1, 30) r(k) WHERE k <= least(ceil(height / 5), ceil((height + 10) / 5) - 1)""")
def j14_voxelize_footprints(spark, sf):
    footprints = T.aoi(spark, sf).join(T.sites(spark, sf).select("site_id", "height"), "site_id")
    return voxels.voxelize_footprints(footprints)[1]


@register(f"WITH {WAYPOINTS}, {VIEWPOINTS}, c AS (SELECT DISTINCT site_id, e, n, u FROM viewpoints WHERE vp_id % 50 = 0) SELECT mission_id, seq, {SHOTS} || CASE WHEN c.site_id IS NULL THEN '' ELSE ',occlusion_closeup' END AS tags FROM waypoints w LEFT JOIN c ON c.site_id = w.site_id AND c.e = w.e AND c.n = w.n AND c.u = w.u")
def j15_tag_closeups(spark, sf):
    clips = missions.assign_shot_types(T.waypoints(spark, sf)).select("mission_id", "seq", "site_id", "e", "n", "u", F.array("shot_type").alias("interest_tags"))
    rows = missions.tag_closeups(clips, T.viewpoints(spark, sf).where("vp_id % 50 = 0"))
    return rows.select("mission_id", "seq", F.array_join("interest_tags", ",").alias("tags"))


@register(f"WITH {WAYPOINTS} SELECT mission_id, seq, {SHOTS} || CASE WHEN seq % 2 = 0 AND {SHOTS} <> 'orbit' THEN ',orbit' ELSE '' END || ',' || CAST(seq % 3 AS VARCHAR) || CASE WHEN seq % 2 = 0 AND {SHOTS} <> 'orbit' THEN '' ELSE ',x' END AS tags FROM waypoints")
def n6_tag_arrays(spark, sf):
    """A tag is appended once; three tags are kept."""
    clips = missions.assign_shot_types(T.waypoints(spark, sf)).withColumn("interest_tags", F.array("shot_type"))
    clips = missions.add_tag(clips, "orbit", F.col("seq") % 2 == 0)
    clips = clips.withColumn("interest_tags", F.concat("interest_tags", F.array((F.col("seq") % 3).cast("string"), F.lit("x"))))
    return missions.first_tags(clips).select("mission_id", "seq", F.array_join("interest_tags", ",").alias("tags"))


@register(f"{VIEWS}, {VIEWPOINTS}, d AS (SELECT vp_id, min({{'d': sqrt(pow(e - (-48 + (i + 0.5) * 2), 2) + pow(n - (-48 + (j + 0.5) * 2), 2) + pow(u - (k + 0.5) * 2, 2)), 'i': i, 'j': j, 'k': k}}) AS b FROM viewpoints JOIN surface USING (site_id) GROUP BY vp_id) SELECT vp_id, b.i AS i, b.j AS j, b.k AS k, round(b.d, 6) AS dist FROM d")
def j17_nearest_surface(spark, sf):
    return voxels.nearest_surface(T.viewpoints(spark, sf), _surface(spark, sf), "vp_id", RES, ORIGIN).select("vp_id", "i", "j", "k", *_r("dist"))


@register(f"{VIEWS}, truth AS (SELECT * FROM surface WHERE (i + j) % 4 = 0), t AS (SELECT site_id, avg(CASE WHEN v.site_id IS NULL THEN 1 ELSE 0 END) AS recall FROM truth LEFT JOIN (SELECT DISTINCT site_id, i, j, k FROM visibility) v USING (site_id, i, j, k) GROUP BY site_id) SELECT n_nationkey AS site_id, round(coalesce(recall, 1), 6) AS recall FROM nation LEFT JOIN t ON site_id = n_nationkey".replace("CASE WHEN v.site_id IS NULL", "CASE WHEN q IS NULL").replace("(SELECT DISTINCT site_id, i, j, k FROM visibility) v", "(SELECT DISTINCT site_id, i, j, k, 1 AS q FROM visibility) v"))
def a3_occlusion_recall(spark, sf):
    surface = _surface(spark, sf)
    flagged = coverage.frontier(surface, T.visibility(spark, sf))
    return coverage.occlusion_recall(flagged, surface.where("(i + j) % 4 = 0"), T.sites(spark, sf)).select("site_id", *_r("recall"))


@register(f"WITH {POSES}, {CAMERA}, {VIEWPOINTS}, p AS (SELECT image_id, cx + fx * (v.e - p.e) / (p.u - v.u) AS px, cy - fy * (v.n - p.n) / (p.u - v.u) AS py FROM viewpoints v JOIN poses p ON p.image_id = v.vp_id % 200, cam WHERE p.u - v.u > 1e-9) SELECT image_id, round(avg(sqrt(pow(px - floor(px / 5) * 5, 2) + pow(py - floor(py / 5) * 5, 2))), 5) AS error FROM p GROUP BY image_id")
def a27_reprojection_error(spark, sf):
    points = T.viewpoints(spark, sf).selectExpr("vp_id", "vp_id % 200 AS image_id", "e", "n", "u")
    seen = camera.project_points(points, T.poses(spark, sf), T.cameras(spark))
    seen = seen.withColumns({"ox": F.floor(F.col("px") / 5) * 5, "oy": F.floor(F.col("py") / 5) * 5})
    return measures.reprojection_error(seen).select("image_id", F.round("error", 5).alias("error"))


@register(f"{VIEWS}, c AS (SELECT site_id, (i + j + k) % 3 = 0 AS resolved FROM surface WHERE site_id % 6 <> 0) SELECT n_nationkey AS site_id, count(*) FILTER (resolved) AS n_resolved, round(coalesce(avg(CAST(resolved AS INT)), 1), 6) AS resolved_fraction FROM nation LEFT JOIN c ON site_id = n_nationkey GROUP BY n_nationkey")
def a28_closeup_plan_stats(spark, sf):
    closeups = _surface(spark, sf).where("site_id % 6 <> 0").withColumn("resolved", F.expr("(i + j + k) % 3 = 0"))
    return measures.closeup_plan_stats(closeups, T.sites(spark, sf)).select("site_id", "n_resolved", *_r("resolved_fraction"))


@register("SELECT o_custkey AS mission_id, CAST(s AS INT) AS step, round(0.5 * (1 - cos(pi() * s / 19)), 6) + 0.0 AS tau FROM (SELECT DISTINCT o_custkey FROM orders), range(20) r(s)")
def w14_ease_samples(spark, sf):
    rows = generators.ease_samples(T.waypoints(spark, sf).select("mission_id").distinct(), 20)
    return rows.select("mission_id", "step", *_r("tau"))


@register(f"""{RADIUS}, c AS (SELECT site_id, 'orbit' AS source, CAST(t AS INT) AS ord, radius * cos(2 * pi() * t / 24) AS e, radius * sin(2 * pi() * t / 24) AS n, height / 2 AS u FROM s, range(24) r(t) UNION ALL SELECT site_id, 'completion', 24, 0.0, 0.0, height + 25 FROM s
  UNION ALL SELECT site_id, 'completion', CAST(25 + t AS INT), 0.7 * radius * cos(pi() * t / 4), 0.7 * radius * sin(pi() * t / 4), height + 15 FROM s, range(8) r(t)) SELECT site_id, source, ord, {_s4('e', 'n', 'u')} FROM c""")
def u1_candidate_views(spark, sf):
    sites = _sites(spark, sf)
    rows = generators.candidate_views(("orbit", missions.orbit_poses(sites, 24).withColumnRenamed("view", "step")), ("completion", generators.completion_poses(sites)))
    return rows.select("site_id", "source", "ord", *_r4("e", "n", "u"))


@register("""WITH p AS (SELECT DISTINCT event_id // 50 AS image_id, user_id % 40 AS u, event_id % 10 AS v FROM events WHERE event_type <> 'click'), t AS (SELECT DISTINCT event_id // 50 AS image_id, user_id % 40 AS u, event_id % 10 AS v FROM events WHERE value > 20)
  SELECT 'intersect' AS kind, * FROM (SELECT * FROM p INTERSECT SELECT * FROM t) UNION ALL SELECT 'union', * FROM (SELECT * FROM p UNION SELECT * FROM t)""")
def u3_mask_set_operations(spark, sf):
    pixels = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id div 50 AS image_id", "user_id % 40 AS u", "event_id % 10 AS v", "event_type", "value")
    both = pixels.where("event_type <> 'click'"), pixels.where("value > 20")
    rows = measures.mask_intersect(*both).withColumn("kind", F.lit("intersect")).unionByName(measures.mask_union(*both).withColumn("kind", F.lit("union")))
    return rows.select("kind", "image_id", "u", "v")


def _neighbours(spark, sf):
    aoi = T.aoi(spark, sf)
    ring = lambda s, name: aoi.select((F.col("site_id") - s).alias("pair"), F.lit(s).alias("apart") if s else F.lit(0).alias("_"), F.col("polygon").alias(name))
    return ring(0, "a").drop("_").join(ring(1, "b").unionByName(ring(2, "b")), "pair")


# an even site is a box, an odd one the same without its upper right quarter; all stand at the origin
OVERLAP = """WITH s AS (SELECT n_nationkey AS k, 40.0::DOUBLE + n_nationkey AS a, 30.0::DOUBLE + n_nationkey AS b, CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 3 END AS q FROM nation),
  p AS (SELECT x.k AS pair, d AS apart, x.q AS qa, y.q AS qb, x.a * x.b * x.q AS one, y.a * y.b * y.q AS two, least(x.a, y.a) * least(x.b, y.b) * least(x.q, y.q) AS inter FROM s x, range(1, 3) r(d), s y WHERE y.k = x.k + d)"""


@register(f"{OVERLAP} SELECT pair, CAST(apart AS INT) AS apart, CASE WHEN qa = 4 OR qb = 4 THEN round(inter / (one + two - inter), 6) END AS iou, CASE WHEN qa = 3 AND qb = 3 THEN 'both concave' END AS reason FROM p")
def n3_polygon_iou(spark, sf):
    return polygons.polygon_iou(_neighbours(spark, sf)).select("pair", "apart", *_r("iou"), "reason")


@register(f"{OVERLAP} SELECT pair, CAST(apart AS INT) AS apart, round(inter, 6) AS area FROM p WHERE qb = 4")
def n2_clip_polygons(spark, sf):
    rows = _neighbours(spark, sf).where("(pair + apart) % 2 = 0").withColumnsRenamed({"a": "subject", "b": "window"})
    return polygons.clip_polygons(rows).select("pair", "apart", F.round(F.abs(polygons.signed_area("clipped")), 6).alias("area"))


def _corners(source: str) -> str:
    """A round of corner cutting of (track_id, seq, x, y), numbered anew."""
    return f"""(WITH q AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY track_id) AS m FROM {source} t0 WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
      c AS (SELECT track_id, seq + c AS pos, x * (1 - c) + x2 * c AS x, y * (1 - c) + y2 * c AS y FROM q, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) v(c) WHERE x2 IS NOT NULL AND m >= 3
      UNION ALL SELECT track_id, seq, x, y FROM q WHERE seq = 0 OR x2 IS NULL OR m < 3) SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY pos) - 1 AS seq, x, y FROM c)"""


@register(f"WITH {TRACKS} SELECT track_id, seq, {_s('x', 'y')} FROM {_corners(_corners('tracks'))} t1")
def n5_chaikin_twice(spark, sf):
    from pyspark.sql import Window

    rows = missions.chaikin(T.tracks(spark, sf), 2)
    return rows.select("track_id", (F.row_number().over(Window.partitionBy("track_id").orderBy("at")) - 1).cast("long").alias("seq"), *_r("x", "y"))


def _boxes(spark, sf):
    pred = T.detections(spark, sf).withColumnRenamed("det_id", "pred_id")
    truth = T.detections(spark, sf).where("det_id % 3 > 0").selectExpr("image_id", "det_id AS truth_id", "x0 + det_id % 7 AS x0", "y0 - det_id % 5 AS y0", "x1 + det_id % 4 AS x1", "y1 + det_id % 3 AS y1")
    return pred, truth


@register(None)
def j16_match_boxes(spark, sf):
    return measures.match_boxes(*_boxes(spark, sf)).select("image_id", "pred_id", "truth_id", *_r("iou"))


@register(None)
def a22_detection_quality(spark, sf):
    return measures.detection_quality(*_boxes(spark, sf))


@register(None)
def a29_similar_tracks(spark, sf):
    """All pairs of missions whose ways over ground are within 40 m of each other."""
    return measures.similar_tracks(T.waypoints(spark, sf).selectExpr("mission_id AS track_id", "seq", "e AS x", "n AS y"), 40.0)


@register(None)
def a29_frechet_similarity(spark, sf):
    tracks = T.waypoints(spark, sf).selectExpr("mission_id AS track_id", "seq", "e AS x", "n AS y")
    ids = tracks.select("track_id").distinct()
    pairs = ids.select(F.col("track_id").alias("track_a"), (F.col("track_id") + 1).alias("track_b"))
    return measures.frechet_similarity(tracks, pairs)


@register(f"WITH {WAYPOINTS}, {SITES} SELECT site_id, count(*) AS n_clips, min(printf('clip_%05d_%03d', mission_id, seq)) AS first_clip, home_lat, round(site_id / 25.0::DOUBLE, 6) AS coverage FROM waypoints JOIN sites USING (site_id) GROUP BY ALL")
def io3_footage_sets(spark, sf):
    shots = missions.assign_shot_types(T.waypoints(spark, sf))
    clips = shots.select("site_id", F.format_string("clip_%05d_%03d", "mission_id", "seq").alias("clip_id"), "shot_type", F.array(F.struct("e", "n", "u")).alias("poses"), F.array("shot_type").alias("interest_tags"))
    sites = T.sites(spark, sf)
    sets = files.footage_sets(clips, sites, sites.select("site_id", (F.col("site_id") / 25).alias("coverage")))
    return sets.select("site_id", F.size("clips").cast("long").alias("n_clips"), F.col("clips")[0]["clip_id"].alias("first_clip"), "home.lat", *_r("coverage")).withColumnRenamed("lat", "home_lat")


@register(None)
def g10_run_pipeline(spark, sf):
    """All stages over the whole voxel table: a row a site with its coverage (G4) and its flight."""
    out = survey.run_pipeline(T.sites(spark, sf), T.voxels(spark, sf), T.cameras(spark))
    flown = out["summary"].withColumnRenamed("mission_id", "site_id")
    return out["coverage"].join(flown, "site_id", "left")


@register(None)
def g8_build_missions(spark, sf):
    """Missions over the value field of the viewpoints themselves."""
    field = camera.pose_quaternion(_aimed(spark, sf)).where("qw IS NOT NULL").select("site_id", "vp_id", "e", "n", "u", "qw", "qx", "qy", "qz", "value")
    return survey.build_missions(field, T.aoi(spark, sf), T.obstacle_map(spark, sf))["clips"].select("mission_id", "seq", "clip_id", F.array_join("interest_tags", ",").alias("tags"))


@register(f"{VIEWS}, c AS (SELECT site_id, count(*) AS n FROM surface GROUP BY site_id), p AS (SELECT site_id, count(*) AS m FROM poses GROUP BY site_id) SELECT site_id, n AS n_surface, m AS n_poses, 2.0::DOUBLE AS voxel_size, CASE WHEN site_id % 2 = 0 THEN 0.5 ELSE round(site_id / 50.0::DOUBLE, 6) END AS coverage FROM c JOIN p USING (site_id)")
def io8_to_model3d(spark, sf):
    poses = T.view_poses(spark, sf).withColumns({"e": F.lit(0.0), "n": F.lit(0.0), "u": F.col("pose_id").cast("double"), "qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)})
    sites = T.sites(spark, sf)
    given = sites.where("site_id % 2 = 0").select("site_id", F.lit(0.5).alias("override"))
    models = files.model3d(_surface(spark, sf), files.posed_image_refs(poses), sites.select("site_id", (F.col("site_id") / 50).alias("coverage")), RES, ORIGIN, given)
    return models.groupBy("site_id").agg(F.count_if(F.col("part") == "surface").alias("n_surface"), F.count_if(F.col("part") == "image").alias("n_poses"), F.max("voxel_size").alias("voxel_size"), F.max(F.round("coverage", 6)).alias("coverage"))


@register(f"WITH {SITES}, {WAYPOINTS}, {_sql_trace()} SELECT * FROM trace")
def io4_geo_trace(spark, sf):
    waypoints = missions.assign_shot_types(T.waypoints(spark, sf))
    rows = files.geo_trace(T.sites(spark, sf), {"trajectory": waypoints.select("site_id", (F.col("mission_id") * 1000 + F.col("seq")).alias("seq"), "e", "n", "u", F.col("shot_type").alias("label"))})
    return rows.select("site_id", "part", "seq", "lat", "lon", "alt", "phase", "label")


@register(f"WITH {VIEWPOINTS} SELECT site_id, 'viewpoints' AS part, vp_id AS seq, e, n, u, round_even(CASE WHEN max(value) OVER (PARTITION BY site_id) > 0 THEN value / max(value) OVER (PARTITION BY site_id) ELSE value END, 3) AS v FROM viewpoints")
def io5_stage_trace(spark, sf):
    rows = files.stage_trace({"viewpoints": interest.normalise_value(T.viewpoints(spark, sf)).select("site_id", F.col("vp_id").alias("seq"), "e", "n", "u", F.col("norm").alias("v"))})
    return rows.select("site_id", "part", "seq", "e", "n", "u", "v")
