"""Registered queries over inputs derived from the star-schema tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import camera, frames, interest, missions, polygons, voxels
from ..sources import driver_tables as T

ORIGIN, RES = (-48.0, -48.0, 0.0), 2.0

SITES = """sites AS (SELECT n_nationkey AS site_id, CAST(-60 + 5 * n_nationkey AS DOUBLE) AS home_lat, CAST(-170 + 13 * n_nationkey AS DOUBLE) AS home_lon,
  CAST(10 * n_regionkey AS DOUBLE) AS home_alt, CAST(20 + n_nationkey AS DOUBLE) AS height FROM nation)"""
POSES = """poses AS (SELECT CAST(image_id % 25 AS INT) AS site_id, image_id, CAST(image_id % 41 - 20 AS DOUBLE) AS e, CAST(image_id % 37 - 18 AS DOUBLE) AS n, CAST(80 + image_id % 40 AS DOUBLE) AS u
  FROM (SELECT DISTINCT event_id // 50 AS image_id FROM events))"""
CAMERA = "cam AS (SELECT 320 / tan(radians(84) / 2) AS fx, 240 / tan(radians(53) / 2) AS fy, 320.0 AS cx, 240.0 AS cy)"
DETECTIONS = """detections AS (SELECT event_id // 50 AS image_id, event_id AS det_id, CAST(user_id % 500 AS DOUBLE) AS x0, CAST(event_id % 400 AS DOUBLE) AS y0,
  CAST(user_id % 500 + 20 + event_id % 60 AS DOUBLE) AS x1, CAST(event_id % 400 + 10 + user_id % 50 AS DOUBLE) AS y1, value / 500 AS score, event_type AS label FROM events)"""
CELLS = "CAST(l_suppkey % 25 AS INT) AS site_id, CAST(l_partkey % 48 AS INT) AS i, CAST(l_orderkey % 48 AS INT) AS j, CAST(CAST(l_quantity AS INT) % 20 AS INT) AS k"
VOXELS = f"voxels AS (SELECT site_id, i, j, k, min(label) AS label FROM (SELECT {CELLS}, 2 + l_linenumber % 4 AS label FROM lineitem) GROUP BY ALL)"
MAP = f"mapped AS (SELECT DISTINCT * FROM (SELECT {CELLS} FROM lineitem WHERE l_returnflag <> 'R') WHERE k <> 0)"
VIEWPOINTS = """viewpoints AS (SELECT CAST(o_custkey % 25 AS INT) AS site_id, o_orderkey AS vp_id, CAST(o_orderkey % 121 - 60 AS DOUBLE) AS e, CAST(o_custkey * 7 % 121 - 60 AS DOUBLE) AS n,
  CAST(5 + o_orderkey % 40 AS DOUBLE) AS u, o_totalprice AS value FROM orders)"""
WAYPOINTS = """waypoints AS (SELECT o_custkey AS mission_id, CAST(o_custkey % 25 AS INT) AS site_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
  CAST(o_orderkey % 121 - 60 AS DOUBLE) AS e, CAST(o_custkey * 7 % 121 - 60 AS DOUBLE) AS n, CAST(5 + o_orderkey % 40 AS DOUBLE) AS u, CAST(1 + o_orderkey % 9 AS DOUBLE) AS speed FROM orders)"""
LEGS = """legs AS (SELECT *, coalesce(sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2) + pow(u - lag(u) OVER w, 2)), 0) AS leg,
  lag(e) OVER w AS pe, lag(n) OVER w AS pn, lag(u) OVER w AS pu FROM waypoints WINDOW w AS (PARTITION BY mission_id ORDER BY seq))"""
HOTSPOTS = """hotspots AS (SELECT CAST(s_suppkey % 25 AS INT) AS site_id, h AS hs_id, CAST(h % 31 - 15 AS DOUBLE) AS e, CAST(h % 29 - 14 AS DOUBLE) AS n, CAST(h % 20 AS DOUBLE) AS u,
  CASE h % 6 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS nx, CASE h % 6 WHEN 2 THEN 1.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS ny, CASE h % 6 WHEN 4 THEN 1.0 WHEN 5 THEN -1.0 ELSE 0.0 END AS nz,
  1.0 + floor(abs(s_acctbal) / 1000) AS interest FROM (SELECT *, s_suppkey * 4 + s AS h FROM supplier, range(4) r(s)))"""
AOI = """verts AS (SELECT n_nationkey AS site_id, p.i AS i, CASE WHEN n_nationkey % 2 = 0 THEN [-a, a, a, -a][p.i] ELSE [-a, a, a, 0, 0, -a][p.i] END AS x,
  CASE WHEN n_nationkey % 2 = 0 THEN [-b, -b, b, b][p.i] ELSE [-b, -b, 0, 0, b, b][p.i] END AS y, CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 6 END AS m
  FROM (SELECT *, CAST(40 + n_nationkey AS DOUBLE) AS a, CAST(30 + n_nationkey AS DOUBLE) AS b FROM nation), range(1, 7) p(i) WHERE p.i <= CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 6 END),
  edges AS (SELECT v.site_id, v.i, v.x AS x1, v.y AS y1, w.x AS x2, w.y AS y2 FROM verts v JOIN verts w ON v.site_id = w.site_id AND w.i = v.i % v.m + 1)"""
TRACKS = """tracks AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, floor(value) AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events)"""
A, B = frames.A, frames.B
E2 = frames.E2


def _sql_ecef(lat: str, lon: str, alt: str, p: str) -> str:
    n = f"({A} / sqrt(1 - {E2!r} * sin(radians({lat})) * sin(radians({lat}))))"
    return f"({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})) AS {p}x, ({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})) AS {p}y, ({n} * {1 - E2!r} + {alt}) * sin(radians({lat})) AS {p}z"


ROT = "sin(radians(home_lat)) AS sp, cos(radians(home_lat)) AS cp, sin(radians(home_lon)) AS sl, cos(radians(home_lon)) AS cl"
GEO = f"""SELECT *, degrees(phi) AS lat, degrees(atan2(y, x)) AS lon, CASE WHEN abs(cos(phi)) > 1e-12 THEN p / cos(phi) - {A} / sqrt(1 - {E2!r} * sin(phi) * sin(phi)) ELSE abs(z) - {B!r} END AS alt
  FROM (SELECT *, atan2(z + {(A * A - B * B) / (B * B) * B!r} * pow(sin(th), 3), p - {E2 * A!r} * pow(cos(th), 3)) AS phi FROM (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {A}, sqrt(x * x + y * y) * {B!r}) AS th FROM {{}}))"""
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None) -> Callable:
    """Without SQL, tests hold the query's operator against brute force."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return wrap


def _r(*names: str) -> list:
    return [F.round(c, 6).alias(c) for c in names]


def _s(*names: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)  # + 0.0: no negative zero


@register(f"WITH {SITES} SELECT site_id, {_s('x', 'y', 'z')} FROM (SELECT site_id, {_sql_ecef('home_lat', 'home_lon', 'home_alt', '')} FROM sites)")
def p1_geodetic_to_ecef(spark, sf):
    rows = T.sites(spark, sf).withColumnsRenamed({"home_lat": "lat", "home_lon": "lon", "home_alt": "alt"})
    return frames.geodetic_to_ecef(rows).select("site_id", *_r("x", "y", "z"))


@register(f"WITH {SITES}, e AS (SELECT site_id, {_sql_ecef('home_lat', 'home_lon', 'home_alt', '')} FROM sites) SELECT site_id, {_s('lat', 'lon', 'alt')} FROM ({GEO.format('e')})")
def p2_ecef_to_geodetic(spark, sf):
    rows = T.sites(spark, sf).withColumnsRenamed({"home_lat": "lat", "home_lon": "lon", "home_alt": "alt"})
    return frames.ecef_to_geodetic(frames.geodetic_to_ecef(rows).drop("lat", "lon", "alt")).select("site_id", *_r("lat", "lon", "alt"))


@register(f"""WITH {SITES}, {VIEWPOINTS}, q AS (SELECT vp_id, site_id, home_lat + e * 1e-4 AS lat, home_lon + n * 1e-4 AS lon, home_alt + u AS alt, home_lat, home_lon, home_alt FROM viewpoints JOIN sites USING (site_id)),
  d AS (SELECT *, {_sql_ecef('lat', 'lon', 'alt', 'p')}, {_sql_ecef('home_lat', 'home_lon', 'home_alt', 'h')}, {ROT} FROM q)
  SELECT vp_id, round(-sl * (px - hx) + cl * (py - hy), 5) + 0.0 AS e, round(-sp * cl * (px - hx) - sp * sl * (py - hy) + cp * (pz - hz), 5) + 0.0 AS n, round(cp * cl * (px - hx) + cp * sl * (py - hy) + sp * (pz - hz), 5) AS u FROM d""")
def p3_to_enu(spark, sf):
    sites = T.sites(spark, sf)
    rows = T.viewpoints(spark, sf).join(sites, "site_id").selectExpr("vp_id", "site_id", "home_lat + e * 1e-4 AS lat", "home_lon + n * 1e-4 AS lon", "home_alt + u AS alt")
    return frames.to_enu(rows, sites).select("vp_id", *[F.round(c, 5).alias(c) for c in "enu"])


@register(f"""WITH {SITES}, {VIEWPOINTS}, q AS (SELECT *, {_sql_ecef('home_lat', 'home_lon', 'home_alt', 'h')}, {ROT} FROM viewpoints JOIN sites USING (site_id)),
  w AS (SELECT vp_id, hx - sl * e - sp * cl * n + cp * cl * u AS x, hy + cl * e - sp * sl * n + cp * sl * u AS y, hz + cp * n + sp * u AS z FROM q)
  SELECT vp_id, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 5) AS alt FROM ({GEO.format('w')})""")
def p4_enu_to_geodetic(spark, sf):
    rows = frames.enu_to_geodetic(T.viewpoints(spark, sf), T.sites(spark, sf))
    return rows.select("vp_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("alt", 5).alias("alt"))


@register(f"WITH {VIEWPOINTS} SELECT vp_id, n AS north, e AS east, -u AS down FROM viewpoints")
def p5_to_ned(spark, sf):
    return frames.to_ned(T.viewpoints(spark, sf)).select("vp_id", "north", "east", "down")


@register(f"WITH {SITES}, {VIEWPOINTS} SELECT vp_id, {_s('e', 'n')} FROM (SELECT vp_id, e * 1e-4 * 111320.0 * cos(radians(home_lat)) AS e, n * 1e-4 * 111320.0 AS n FROM viewpoints JOIN sites USING (site_id))")
def p7_planar_enu(spark, sf):
    sites = T.sites(spark, sf)
    rows = T.viewpoints(spark, sf).join(sites, "site_id").selectExpr("vp_id", "site_id", "home_lon + e * 1e-4 AS lon", "home_lat + n * 1e-4 AS lat")
    return frames.planar_enu(rows, sites).select("vp_id", *_r("e", "n"))


@register(f"WITH {POSES}, {CAMERA} SELECT image_id, {_s('fx', 'fy', 'cx', 'cy', 'gsd', 'radius')} FROM (SELECT image_id, fx, fy, cx, cy, u / fx AS gsd, u * tan(atan(sqrt(pow(tan(radians(84) / 2), 2) + pow(tan(radians(53) / 2), 2)))) AS radius FROM poses, cam)")
def p8_camera_intrinsics(spark, sf):
    rows = T.poses(spark, sf).join(F.broadcast(camera.camera_intrinsics(T.cameras(spark))), "camera_id")
    return camera.sensor_footprint(rows.withColumn("gsd", F.col("u") / F.col("fx")), F.col("u")).select("image_id", *_r("fx", "fy", "cx", "cy", "gsd", "radius"))


@register(f"WITH {POSES}, {CAMERA}, {VIEWPOINTS} SELECT vp_id, image_id, {_s('px', 'py', 'z')}, z > 1e-6 AND px >= 0 AND px < 640 AND py >= 0 AND py < 480 AS in_view FROM (SELECT vp_id, image_id, p.u - v.u AS z, cx + fx * (v.e - p.e) / (p.u - v.u) AS px, cy - fy * (v.n - p.n) / (p.u - v.u) AS py FROM viewpoints v JOIN poses p ON p.image_id = v.vp_id % 200, cam)")
def p13_project_points(spark, sf):
    points = T.viewpoints(spark, sf).selectExpr("vp_id", "vp_id % 200 AS image_id", "e", "n", "u")
    rows = points.join(T.poses(spark, sf).select("image_id"), "image_id", "left_semi")
    return camera.project_points(rows, T.poses(spark, sf), T.cameras(spark)).select("vp_id", "image_id", *_r("px", "py", "z"), "in_view")


DEPTH = "depth AS (SELECT l_orderkey % 200 AS image_id, l_partkey % 640 AS px, (l_suppkey * 5) % 480 AS py, 40 + l_quantity AS depth FROM lineitem)"
HITS = f"hits AS (SELECT image_id, px, py, depth, site_id, p.e + (px - cx) / fx * depth AS e, p.n - (py - cy) / fy * depth AS n, p.u - depth AS u FROM depth JOIN poses p USING (image_id), cam)"


@register(f"WITH {POSES}, {CAMERA}, {DEPTH}, {HITS} SELECT image_id, px, py, depth, {_s('e', 'n', 'u')}, count(*) AS n_rows FROM hits GROUP BY image_id, px, py, depth, e, n, u")
def p14_backproject_depth(spark, sf):
    rows = camera.backproject_depth(T.depth_samples(spark, sf), T.poses(spark, sf), T.cameras(spark))
    return rows.groupBy("image_id", "px", "py", "depth", "e", "n", "u").agg(F.count("*").alias("n_rows")).select("image_id", "px", "py", "depth", *_r("e", "n", "u"), "n_rows")


@register(f"""WITH {SITES}, {POSES}, {CAMERA}, {DETECTIONS}, g AS (SELECT det_id, site_id, p.e + ((x0 + x1) / 2 - cx) / fx * p.u AS e, p.n - ((y0 + y1) / 2 - cy) / fy * p.u AS n, 0.0 AS u
    FROM detections JOIN poses p USING (image_id), cam WHERE score >= 0.3 AND lower(label) IN ('click', 'purchase')),
  q AS (SELECT *, {_sql_ecef('home_lat', 'home_lon', 'home_alt', 'h')}, {ROT} FROM g JOIN sites USING (site_id)),
  w AS (SELECT det_id, e, n, hx - sl * e - sp * cl * n AS x, hy + cl * e - sp * sl * n AS y, hz + cp * n AS z FROM q)
  SELECT det_id, {_s('e', 'n')}, round(lat, 8) AS lat, round(lon, 8) AS lon FROM ({GEO.format('w')})""")
def p16_georeference_detections(spark, sf):
    wanted = camera.filter_detections(T.detections(spark, sf), ["Click", "purchase"])
    rows = camera.georeference_detections(wanted, T.poses(spark, sf), T.cameras(spark), T.sites(spark, sf))
    return rows.select("det_id", *_r("e", "n"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@register(f"WITH {SITES} SELECT site_id, round((height / 2 + 4) / tan(radians(53) / 2), 6) AS radius FROM sites")
def p17_orbit_radius(spark, sf):
    return camera.orbit_radius(T.sites(spark, sf), 53.0).select("site_id", *_r("radius"))


@register(f"WITH {VIEWPOINTS} SELECT vp_id, CAST(floor((e + 48) / 2) AS INT) AS i, CAST(floor((n + 48) / 2) AS INT) AS j, CAST(floor(u / 2) AS INT) AS k FROM viewpoints")
def p19_voxel_index(spark, sf):
    return voxels.voxel_index(T.viewpoints(spark, sf), RES, ORIGIN).select("vp_id", "i", "j", "k")


@register(f"WITH {VIEWPOINTS} SELECT vp_id, round(CASE WHEN max(value) OVER (PARTITION BY site_id) > 0 THEN value / max(value) OVER (PARTITION BY site_id) ELSE value END, 6) AS norm FROM viewpoints")
def p28_normalise_value(spark, sf):
    return interest.normalise_value(T.viewpoints(spark, sf)).select("vp_id", *_r("norm"))


@register(f"WITH {SITES} SELECT site_id, CAST(v AS INT) AS view, round(r * cos(2.0 * pi() * v / 16), 6) + 0.0 AS e, round(r * sin(2.0 * pi() * v / 16), 6) + 0.0 AS n, height / 2 AS u FROM (SELECT *, (height / 2 + 4) / tan(radians(53) / 2) AS r FROM sites), range(16) x(v)")
def p33_orbit_poses(spark, sf):
    return missions.orbit_poses(camera.orbit_radius(T.sites(spark, sf), 53.0)).select("site_id", "view", *_r("e", "n"), "u")


@register(f"WITH {DETECTIONS} SELECT det_id, score, label FROM detections WHERE score >= 0.3 AND lower(label) IN ('click', 'view')")
def f1_filter_detections(spark, sf):
    return camera.filter_detections(T.detections(spark, sf), ["click", "VIEW"]).select("det_id", "score", "label")


INSIDE = "SELECT vp_id, count(*) FILTER ((y1 > n) <> (y2 > n) AND e < (x2 - x1) * (n - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM viewpoints JOIN edges USING (site_id) GROUP BY vp_id"


@register(f"WITH {VIEWPOINTS}, {AOI} {INSIDE}")
def f2_points_in_polygon(spark, sf):
    return polygons.points_in_polygon(T.viewpoints(spark, sf), T.aoi(spark, sf)).select("vp_id", "inside")


FENCE = f"""fence AS (SELECT vp_id FROM (SELECT vp_id, count(*) FILTER ((y1 > n) <> (y2 > n) AND e < (x2 - x1) * (n - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1
  OR bool_or((x1 = x2 AND e = x1 AND n BETWEEN least(y1, y2) AND greatest(y1, y2)) OR (y1 = y2 AND n = y1 AND e BETWEEN least(x1, x2) AND greatest(x1, x2))) AS ok
  FROM viewpoints JOIN edges USING (site_id) WHERE u >= 0 AND u <= 100 GROUP BY vp_id) WHERE ok)"""


@register(f"WITH {VIEWPOINTS}, {AOI}, {FENCE} SELECT vp_id FROM fence")
def f3_inside_geofence(spark, sf):
    return polygons.inside_geofence(T.viewpoints(spark, sf), T.aoi(spark, sf)).select("vp_id")


@register(f"WITH {VOXELS}, c AS (SELECT *, -48 + (i + 0.5) * 2 AS e, -48 + (j + 0.5) * 2 AS n FROM voxels WHERE label IN (3, 4, 5) AND k <> 0) SELECT site_id, i, j, k FROM c WHERE sqrt(e * e + n * n) BETWEEN 20 AND 40")
def f8_hazard_annulus(spark, sf):
    hazards = voxels.voxel_center(voxels.hazards_only(voxels.drop_ground(T.voxels(spark, sf))), RES, ORIGIN)
    return voxels.annulus(hazards, 20, 40).select(*voxels.CELL)


@register(f"WITH {AOI} SELECT site_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, min(x1) AS min_x, max(x1) AS max_x, min(y1) AS min_y, max(y1) AS max_y, round(avg(x1), 6) AS cx, round(avg(y1), 6) AS cy, site_id % 2 = 0 AS convex FROM edges GROUP BY site_id")
def a18_polygon_stats(spark, sf):
    rows = polygons.is_convex(polygons.polygon_stats(polygons.polygon_area(T.aoi(spark, sf))))
    return rows.select("site_id", "area", "min_x", "max_x", "min_y", "max_y", *_r("cx", "cy"), "convex")


@register(f"""WITH {VOXELS}, b AS (SELECT * FROM voxels WHERE label = 2) SELECT site_id, i, j, k FROM b WHERE 6 > (SELECT count(*) FROM b o WHERE o.site_id = b.site_id AND abs(o.i - b.i) + abs(o.j - b.j) + abs(o.k - b.k) = 1)""")
def j13_shell_voxels(spark, sf):
    return voxels.shell_voxels(T.voxels(spark, sf))


CLEAR = """gaps AS (SELECT v.vp_id, min(sqrt(pow(v.e - (-48 + (i + 0.5) * 2), 2) + pow(v.n - (-48 + (j + 0.5) * 2), 2) + pow(v.u - (k + 0.5) * 2, 2))) AS min_d FROM viewpoints v JOIN mapped o ON o.site_id = v.site_id
  AND abs(o.i - floor((v.e + 48) / 2)) <= {w} AND abs(o.j - floor((v.n + 48) / 2)) <= {w} AND abs(o.k - floor(v.u / 2)) <= {w} GROUP BY v.vp_id)"""


@register(f"WITH {VIEWPOINTS}, {MAP}, {CLEAR.format(w=4)} SELECT vp_id, round(min_d, 6) AS min_d, coalesce(min_d >= 1.5, true) AS clear FROM viewpoints LEFT JOIN gaps USING (vp_id)")
def a7_clearance(spark, sf):
    rows = voxels.clearance(T.viewpoints(spark, sf), T.obstacle_map(spark, sf), "vp_id", 4)
    return rows.select("vp_id", *_r("min_d"), voxels.is_clear(rows).alias("clear"))


@register(f"WITH {VOXELS}, {MAP}, c AS (SELECT *, sqrt(pow(-48 + (i + 0.5) * 2, 2) + pow(-48 + (j + 0.5) * 2, 2)) AS r FROM voxels WHERE label IN (3, 4, 5)) SELECT c.site_id, count(*) AS n_truth, round(avg(CASE WHEN m.i IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM c LEFT JOIN mapped m ON m.site_id = c.site_id AND m.i = c.i AND m.j = c.j AND m.k = c.k WHERE r BETWEEN {30 * 0.65} AND {30 * 1.35} GROUP BY c.site_id")
def a4_obstacle_recall(spark, sf):
    return voxels.obstacle_recall(T.voxels(spark, sf), T.obstacle_map(spark, sf), 30.0).select("site_id", "n_truth", *_r("recall"))


@register(f"WITH {DEPTH} SELECT image_id, max(depth) - min(depth) AS height, CAST(NULL AS VARCHAR) AS reason FROM depth GROUP BY image_id")
def a6_estimate_height(spark, sf):
    return voxels.estimate_height(T.depth_samples(spark, sf))


@register(f"WITH {POSES}, {CAMERA}, {DEPTH}, {HITS}, c AS (SELECT DISTINCT site_id, CAST(floor((e + 48) / 2) AS INT) AS i, CAST(floor((n + 48) / 2) AS INT) AS j, CAST(floor(u / 2) AS INT) AS k FROM hits) SELECT site_id, count(*) AS n_cells FROM c WHERE i BETWEEN 0 AND 47 AND j BETWEEN 0 AND 47 AND k BETWEEN 1 AND 39 GROUP BY site_id")
def a9_build_obstacle_map(spark, sf):
    cells = voxels.build_obstacle_map(T.depth_samples(spark, sf), T.poses(spark, sf), T.cameras(spark), RES, ORIGIN, (48, 48, 40))
    return cells.groupBy("site_id").agg(F.count("*").alias("n_cells"))


PEAKS = """peaks AS (SELECT v.* FROM viewpoints v WHERE NOT EXISTS (SELECT 1 FROM viewpoints o WHERE o.site_id = v.site_id AND o.vp_id <> v.vp_id AND sqrt(pow(o.e - v.e, 2) + pow(o.n - v.n, 2) + pow(o.u - v.u, 2)) <= 6.000000001
  AND (o.value > v.value + 1e-12 OR (abs(o.value - v.value) <= 1e-12 AND o.vp_id < v.vp_id))))"""


@register(f"WITH {VIEWPOINTS}, {PEAKS} SELECT vp_id, value FROM peaks")
def w9_local_maxima(spark, sf):
    return interest.local_maxima(T.viewpoints(spark, sf)).select("vp_id", "value")


@register(f"WITH {VIEWPOINTS}, {MAP}, {AOI}, {PEAKS}, {FENCE}, {CLEAR.format(w=3)}, r AS (SELECT site_id, vp_id, value, row_number() OVER (PARTITION BY site_id ORDER BY value DESC, e, n, u, vp_id) AS rank FROM peaks JOIN fence USING (vp_id) LEFT JOIN gaps USING (vp_id) WHERE coalesce(min_d, 1e9) >= 1.5) SELECT site_id, vp_id, value, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def o1_select_viewpoints(spark, sf):
    return interest.select_viewpoints(T.viewpoints(spark, sf), T.aoi(spark, sf), T.obstacle_map(spark, sf)).select("site_id", "vp_id", "value", "rank")


@register(f"WITH {VIEWPOINTS} SELECT * FROM (SELECT site_id, vp_id, value, CAST(row_number() OVER (PARTITION BY site_id ORDER BY value DESC, e, n, u, vp_id) AS INT) AS rank FROM viewpoints) WHERE rank <= 5")
def o3_top_k_viewpoints(spark, sf):
    return interest.top_k_viewpoints(T.viewpoints(spark, sf), 5).select("site_id", "vp_id", "value", "rank")


@register(f"WITH {VIEWPOINTS} SELECT site_id, arg_max(vp_id, (value, -vp_id)) AS vp_id, max(value) AS value FROM viewpoints GROUP BY site_id")
def a20_peak_viewpoint(spark, sf):
    return interest.peak_viewpoint(T.viewpoints(spark, sf))


@register(f"WITH {WAYPOINTS}, {LEGS} SELECT mission_id, round(sum(leg), 6) AS length, count(*) AS n FROM legs GROUP BY mission_id")
def w1_tour_length(spark, sf):
    return missions.tour_length(T.waypoints(spark, sf)).select("mission_id", *_r("length"), "n")


@register(f"""WITH {WAYPOINTS}, {LEGS} SELECT mission_id, seq, round(CASE WHEN total < 1e-9 THEN coalesce(seq * 1.0 / nullif(m - 1, 0), 0) ELSE so_far / nullif(total, 0) END, 6) AS knot FROM (SELECT *, sum(leg) OVER (PARTITION BY mission_id ORDER BY seq) AS so_far, sum(leg) OVER (PARTITION BY mission_id) AS total, count(*) OVER (PARTITION BY mission_id) AS m FROM legs)""")
def w2_arc_length_knots(spark, sf):
    return missions.arc_length_knots(T.waypoints(spark, sf)).select("mission_id", "seq", *_r("knot"))


@register(f"WITH {WAYPOINTS}, {LEGS} SELECT mission_id, round(sum(leg), 4) AS path_m, round(sum(leg / least(greatest(speed, 0.1), 15)), 4) AS time_s, round(sum(leg / least(greatest(speed, 0.1), 15)) / 1080, 6) AS used, sum(CAST(greatest(ceil(leg / least(greatest(speed, 0.1), 15) / 0.5), 1) AS BIGINT))::BIGINT AS n_samples FROM legs WHERE leg >= 1e-9 GROUP BY mission_id")
def w4_running_totals(spark, sf):
    rows = missions.running_totals(missions.leg_samples(T.waypoints(spark, sf), 0.5))
    return rows.groupBy("mission_id").agg(F.round(F.max("path_m"), 4).alias("path_m"), F.round(F.max("time_s"), 4).alias("time_s"), F.round(F.max("used"), 6).alias("used"), F.count("*").alias("n_samples"))


SHOTS = "['orbit', 'flyby', 'reveal', 'push_in', 'top_down', 'parallax', 'dronie'][seq % 7 + 1]"


@register(f"WITH {WAYPOINTS} SELECT mission_id, seq, {SHOTS} AS shot_type FROM waypoints")
def w8_assign_shot_types(spark, sf):
    return missions.assign_shot_types(T.waypoints(spark, sf)).select("mission_id", "seq", "shot_type")


@register(f"WITH {WAYPOINTS} SELECT mission_id, count(DISTINCT {SHOTS}) AS kinds, count(DISTINCT {SHOTS}) >= 3 AS varied FROM waypoints GROUP BY mission_id")
def f15_check_variety(spark, sf):
    return missions.check_variety(missions.assign_shot_types(T.waypoints(spark, sf)))


PHASED = f"phased AS (SELECT w.*, CASE WHEN u / height >= 0.70 THEN 'survey' WHEN u / height >= 0.32 THEN 'orbit' ELSE 'capture' END AS phase FROM waypoints w JOIN sites USING (site_id))"


@register(f"WITH {SITES}, {WAYPOINTS}, {PHASED} SELECT site_id, phase, count(*) AS n_points, count(*) FILTER (NOT last) AS n_legs FROM (SELECT *, lead(seq) OVER (PARTITION BY mission_id ORDER BY seq) IS NULL AS last FROM phased) GROUP BY site_id, phase")
def a17_phase_counts(spark, sf):
    return missions.phase_counts(missions.classify_phase(T.waypoints(spark, sf), T.sites(spark, sf)))


@register(f"WITH {SITES}, {WAYPOINTS}, {PHASED} SELECT mission_id, seq, phase, e2, n2, u2 FROM (SELECT *, lead(e) OVER w AS e2, lead(n) OVER w AS n2, lead(u) OVER w AS u2 FROM phased WINDOW w AS (PARTITION BY mission_id ORDER BY seq)) WHERE e2 IS NOT NULL")
def w13_phase_segments(spark, sf):
    return missions.phase_segments(missions.classify_phase(T.waypoints(spark, sf), T.sites(spark, sf))).select("mission_id", "seq", "phase", "e2", "n2", "u2")


@register(f"WITH {WAYPOINTS}, c AS (SELECT *, count(*) OVER (PARTITION BY mission_id) AS m FROM waypoints) SELECT mission_id, seq FROM c WHERE m <= 5 OR seq IN (0, (m - 1) // 4, (m - 1) * 2 // 4, (m - 1) * 3 // 4, m - 1)")
def w11_downsample(spark, sf):
    return missions.downsample(T.waypoints(spark, sf), 5).select("mission_id", "seq")


@register(f"""WITH {TRACKS}, q AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS m, lag(x) OVER w AS l0, lead(x) OVER w AS l2, lead(x, 2) OVER w AS l3 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
  p AS (SELECT *, s / 18.0 AS t, coalesce(l0, x) AS x0, coalesce(l2, x) AS x2, coalesce(l3, l2, x) AS x3 FROM q, range(18) r(s) WHERE s = 0 OR (m >= 3 AND l2 IS NOT NULL))
  SELECT track_id, seq, CAST(s AS INT) AS step, round(CASE WHEN s = 0 THEN x ELSE 0.5 * (2 * x + (x2 - x0) * t + (2 * x0 - 5 * x + 4 * x2 - x3) * t * t + (-x0 + 3 * x - 3 * x2 + x3) * t * t * t) END, 5) AS x FROM p""")
def n4_catmull_rom(spark, sf):
    return missions.catmull_rom(T.tracks(spark, sf)).select("track_id", "seq", "step", F.round("x", 5).alias("x"))


@register(f"""WITH {TRACKS}, q AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq))
  SELECT track_id, seq + c AS at, x * (1 - c) + x2 * c AS x, y * (1 - c) + y2 * c AS y FROM q, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) v(c) WHERE x2 IS NOT NULL
  UNION ALL SELECT track_id, seq, x, y FROM q WHERE seq = 0 UNION ALL SELECT track_id, seq, x, y FROM q WHERE x2 IS NULL AND seq > 0""")
def n5_chaikin(spark, sf):
    return missions.chaikin(T.tracks(spark, sf))


@register("""WITH p AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings) SELECT a.vec_id, round(corr(CAST(a.x AS DOUBLE), CAST(b.x AS DOUBLE)), 6) AS r FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos GROUP BY a.vec_id""")
def a24_heatmap_correlation(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    human = rows.select((F.col("vec_id") - 1).alias("vec_id"), "pos", F.col("x").alias("y"))
    return rows.join(human, ["vec_id", "pos"]).groupBy("vec_id").agg(F.round(F.corr(F.col("x").cast("double"), F.col("y").cast("double")), 6).alias("r"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
