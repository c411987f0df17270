"""Registered queries of coverage, generated poses, measures and flight audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import camera, coverage, generators, legs, measures, missions
from ..sources import driver_tables as T
from ..sources import files
from .queries import CELLS, MAP, SHOTS, SITES, TRACKS, VIEWPOINTS, VOXELS, WAYPOINTS, _r, register

SURFACE = f"{VOXELS}, surface AS (SELECT site_id, i, j, k FROM voxels WHERE label = 2)"
VISIBLE = f"visibility AS (SELECT DISTINCT {CELLS}, l_orderkey % 40 AS pose_id FROM lineitem WHERE l_linenumber < 4)"
POSES = "poses AS (SELECT DISTINCT CAST(l_suppkey % 25 AS INT) AS site_id, l_orderkey % 40 AS pose_id, l_orderkey % 40 AS seq FROM lineitem)"
SEEN = "seen AS (SELECT * FROM visibility SEMI JOIN surface USING (site_id, i, j, k))"
SIZE = "size AS (SELECT site_id, count(*) AS n FROM surface GROUP BY site_id)"
VIEWS = f"WITH {SURFACE}, {VISIBLE}, {POSES}, {SEEN}, {SIZE}"
RADIUS = f"WITH {SITES}, s AS (SELECT site_id, height, (height / 2 + 4) / tan(radians(53.0::DOUBLE) / 2) AS radius FROM sites)"


def _surface(spark, sf):
    return T.voxels(spark, sf).where("label = 2").drop("label")


def _sites(spark, sf):
    return camera.orbit_radius(T.sites(spark, sf), 53.0)


@register(f"{VIEWS} SELECT site_id, count(*) AS n_surface, count(p) AS n_seen, round(count(p) * 1.0 / count(*), 6) AS coverage FROM surface LEFT JOIN (SELECT DISTINCT site_id, i, j, k, 1 AS p FROM visibility) USING (site_id, i, j, k) GROUP BY site_id")
def a1_coverage(spark, sf):
    return coverage.coverage(_surface(spark, sf), T.visibility(spark, sf)).select("site_id", "n_surface", "n_seen", *_r("coverage"))


@register(f"{VIEWS} SELECT site_id, i, j, k FROM surface ANTI JOIN visibility USING (site_id, i, j, k) QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY i, j, k) <= 40")
def o2_frontier_limit(spark, sf):
    return coverage.frontier_limit(coverage.frontier(_surface(spark, sf), T.visibility(spark, sf)), 40)


@register(f"{VIEWS} SELECT site_id, CAST(CASE WHEN n IS NULL THEN 0 WHEN best IS NULL THEN m ELSE ceil(CAST(0.9 AS DOUBLE) * n / best) END AS BIGINT) AS min_views FROM (SELECT site_id, count(*) AS m FROM poses GROUP BY site_id) LEFT JOIN size USING (site_id) LEFT JOIN (SELECT site_id, max(c) AS best FROM (SELECT site_id, pose_id, count(*) AS c FROM seen GROUP BY ALL) GROUP BY site_id) USING (site_id)")
def a13_min_views(spark, sf):
    return coverage.min_views(_surface(spark, sf), T.visibility(spark, sf), T.view_poses(spark, sf))


@register(f"{VIEWS} SELECT site_id, pose_id, count(*) AS gain FROM seen ANTI JOIN (SELECT * FROM seen WHERE pose_id < 8) USING (site_id, i, j, k) GROUP BY ALL")
def a14_information_gain(spark, sf):
    seen = T.visibility(spark, sf)
    return coverage.information_gain(_surface(spark, sf), seen, seen.where("pose_id < 8"))


@register(f"{VIEWS} SELECT site_id, i, j, k, CASE WHEN p IS NULL THEN 2.0 ELSE 1.0 END AS interest FROM surface LEFT JOIN (SELECT DISTINCT site_id, i, j, k, 1 AS p FROM visibility) USING (site_id, i, j, k)")
def a12_build_hotspots(spark, sf):
    return coverage.build_hotspots(_surface(spark, sf), T.visibility(spark, sf))


@register(f"""{VIEWS}, f AS (SELECT site_id, min(pose_id) AS seq FROM seen GROUP BY site_id, i, j, k), g AS (SELECT site_id, seq, count(*) AS gain FROM f GROUP BY ALL),
  r AS (SELECT site_id, pose_id, seq, coalesce(gain, 0) AS gain, sum(coalesce(gain, 0)) OVER (PARTITION BY site_id ORDER BY seq) * 1.0 / n AS covered FROM poses LEFT JOIN g USING (site_id, seq) JOIN size USING (site_id))
  SELECT site_id, pose_id, seq, gain, round(covered, 6) AS covered FROM (SELECT *, lag(covered) OVER (PARTITION BY site_id ORDER BY seq) AS prior FROM r) WHERE coalesce(prior, -1) < 0.9""")
def w10_lawnmower_plan(spark, sf):
    rows = coverage.lawnmower_plan(T.view_poses(spark, sf), _surface(spark, sf), T.visibility(spark, sf))
    return rows.select("site_id", "pose_id", "seq", "gain", *_r("covered"))


def _picks(target: float) -> str:
    """Greedy picks one after the other, as many as a site has poses (40), each with the cells so far and those left."""
    sql = ""
    for k in range(40):
        left, open_sites = (f"l{k - 1}", f"(SELECT site_id, n, c FROM p{k - 1})") if k else ("seen", "(SELECT site_id, n, 0 AS c FROM size)")
        sql += f", p{k} AS MATERIALIZED (SELECT site_id, pose_id, gain, c + gain AS c, n FROM (SELECT site_id, pose_id, count(*) AS gain FROM {left} GROUP BY site_id, pose_id QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY gain DESC, pose_id) = 1) JOIN {open_sites} USING (site_id) WHERE c < {target} * n)"
        sql += f", l{k} AS MATERIALIZED (SELECT * FROM {left} WHERE (site_id, i, j, k) NOT IN (SELECT (site_id, i, j, k) FROM {left} SEMI JOIN p{k} USING (site_id, pose_id)))"
    return sql + " " + " UNION ALL ".join(f"SELECT site_id, {k} AS pick, pose_id, gain FROM p{k}" for k in range(40))


@register(VIEWS + _picks(0.9))
def g2_nbv_plan(spark, sf):
    return coverage.nbv_plan(T.view_poses(spark, sf), _surface(spark, sf), T.visibility(spark, sf)).select("site_id", "pick", "pose_id", "gain")


@register(VIEWS + _picks(1.0))
def g2_nbv_plan_whole(spark, sf):
    """Until no pose adds a cell."""
    return coverage.nbv_plan(T.view_poses(spark, sf), _surface(spark, sf), T.visibility(spark, sf), 1.0).select("site_id", "pick", "pose_id", "gain")


@register(f"WITH {VIEWPOINTS} SELECT vp_id, row_number() OVER (PARTITION BY site_id ORDER BY atan2(n, e), vp_id) - 1 AS ord FROM viewpoints")
def w12_azimuth_order(spark, sf):
    return coverage.azimuth_order(T.viewpoints(spark, sf).withColumnRenamed("vp_id", "pose_id")).select(F.col("pose_id").alias("vp_id"), "ord")


def _s4(*names: str) -> str:
    return ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in names)


def _r4(*names: str) -> list:
    return [(F.round(c, 4) + F.lit(0.0)).alias(c) for c in names]


@register(f"""{RADIUS} SELECT site_id, kind, CAST(step AS INT) AS step, {_s4('e', 'n', 'u', 'te', 'tn', 'tu')} FROM (
  SELECT site_id, 'nadir' AS kind, a.a * 3 + b.b AS step, radius * (a.a - 1) AS e, radius * (b.b - 1) AS n, height + 60 AS u, radius * (a.a - 1) AS te, radius * (b.b - 1) AS tn, 0.0::DOUBLE AS tu FROM s, range(3) a(a), range(3) b(b)
  UNION ALL SELECT site_id, 'oblique', t.t, 1.1 * radius * cos(pi() * t.t / 4), 1.1 * radius * sin(pi() * t.t / 4), (height + 60) * 0.6, 0.55 * radius * cos(pi() * t.t / 4), 0.55 * radius * sin(pi() * t.t / 4), 3 FROM s, range(8) t(t))""")
def p34_survey_poses(spark, sf):
    return generators.survey_poses(_sites(spark, sf)).select("site_id", "kind", "step", *_r4("e", "n", "u", "te", "tn", "tu"))


@register(f"""{RADIUS} SELECT site_id, kind, CAST(step AS INT) AS step, {_s4('e', 'n', 'u', 'tu')} FROM (SELECT site_id, 'nadir' AS kind, 0 AS step, 0.0::DOUBLE AS e, 0.0::DOUBLE AS n, height + 25 AS u, height AS tu FROM s
  UNION ALL SELECT site_id, 'oblique', t.t, 0.7 * radius * cos(pi() * t.t / 4), 0.7 * radius * sin(pi() * t.t / 4), height + 15, height FROM s, range(8) t(t))""")
def p35_completion_poses(spark, sf):
    return generators.completion_poses(_sites(spark, sf)).select("site_id", "kind", "step", *_r4("e", "n", "u", "tu"))


@register(f"""WITH {VOXELS}, c AS (SELECT site_id, i, j, k, CAST(a.a * 6 + b.b AS INT) AS candidate_rank, -48 + (i + 0.5::DOUBLE) * 2 + 8 * cos(el) * cos(pi() * b.b / 3) AS ce, -48 + (j + 0.5::DOUBLE) * 2 + 8 * cos(el) * sin(pi() * b.b / 3) AS cn,
  (k + 0.5::DOUBLE) * 2 + 8 * sin(el) AS cu FROM (SELECT * FROM voxels WHERE label = 2), (SELECT a, radians([10, 25, 45, 60][a + 1]::DOUBLE) AS el FROM range(4) r(a)) a, range(6) b(b)) SELECT site_id, i, j, k, candidate_rank, {_s4('ce', 'cn', 'cu')} FROM c WHERE cu > 2""")
def p36_closeup_candidates(spark, sf):
    at = lambda c, o: (F.lit(o) + (F.col(c) + 0.5) * 2.0)
    targets = _surface(spark, sf).withColumns({"e": at("i", -48.0), "n": at("j", -48.0), "u": at("k", 0.0)})
    return generators.closeup_candidates(targets, azimuths=6).select("site_id", "i", "j", "k", "candidate_rank", *_r4("ce", "cn", "cu"))


@register(f"{RADIUS} SELECT site_id, p.i AS corner, round((radius * 1.6 + 8) * [-1, 1, 1, -1][p.i], 4) AS x, round((radius * 1.6 + 8) * [-1, -1, 1, 1][p.i], 4) AS y, greatest(120, height + 60) AS max_altitude FROM s, range(1, 5) p(i)")
def p37_scene_aoi(spark, sf):
    rows = generators.scene_aoi(_sites(spark, sf)).select("site_id", F.posexplode("polygon").alias("c", "p"), "max_altitude")
    return rows.select("site_id", (F.col("c") + 1).cast("long").alias("corner"), F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), "max_altitude")


@register(f"WITH {VIEWPOINTS} SELECT vp_id, t.t AS seq, round(e + 6 * cos(pi() * (t.t % 12) / 6), 4) + 0.0 AS x, round(n + 6 * sin(pi() * (t.t % 12) / 6), 4) + 0.0 AS y FROM viewpoints, range(25) t(t)")
def p38_ring_path(spark, sf):
    rows = generators.ring_path(T.viewpoints(spark, sf).select("vp_id", F.col("e").alias("x"), F.col("n").alias("y")), 6.0, 12, 2)
    return rows.select("vp_id", F.col("seq").cast("long").alias("seq"), *_r4("x", "y"))


@register("""WITH p AS (SELECT DISTINCT event_id // 50 AS image_id, user_id % 40 AS u, event_id % 10 AS v FROM events WHERE event_type <> 'click'), t AS (SELECT DISTINCT event_id // 50 AS image_id, user_id % 40 AS u, event_id % 10 AS v FROM events WHERE value > 20)
  SELECT image_id, count(*) FILTER (a AND b) AS inter, count(*) AS "union", round(count(*) FILTER (a AND b) * 1.0 / greatest(1, count(*)), 6) AS iou FROM (SELECT *, true AS a FROM p) FULL JOIN (SELECT *, true AS b FROM t) USING (image_id, u, v) GROUP BY image_id""")
def a23_mask_iou(spark, sf):
    pixels = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id div 50 AS image_id", "user_id % 40 AS u", "event_id % 10 AS v", "event_type", "value")
    return measures.mask_iou(pixels.where("event_type <> 'click'"), pixels.where("value > 20")).select("image_id", "inter", "union", *_r("iou"))


@register(f"WITH {VIEWPOINTS} SELECT site_id, round(avg(CAST(vp_id % 3 = 0 AS INT)), 6) AS overlap FROM (SELECT * FROM viewpoints QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY value DESC, vp_id) <= 10) GROUP BY site_id")
def a25_topk_overlap(spark, sf):
    rows = T.viewpoints(spark, sf)
    return measures.topk_overlap(rows, rows.where("vp_id % 3 = 0")).select("site_id", *_r("overlap"))


@register("SELECT l_suppkey AS site_id, round(median(abs(l_quantity - l_linenumber)), 6) AS error FROM lineitem GROUP BY l_suppkey")
def a26_median_abs_error(spark, sf):
    pairs = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey AS site_id", "l_quantity AS est", "l_linenumber AS ref")
    return measures.median_abs_error(pairs, "site_id").select("site_id", *_r("error"))


@register(f"""WITH {TRACKS} SELECT track_id, seq, CASE WHEN l1 IS NULL THEN (-3 * x + 4 * r1 - r2) / 2 WHEN r1 IS NULL THEN (3 * x - 4 * l1 + l2) / 2 ELSE (r1 - l1) / 2 END AS vx FROM (SELECT *, lag(x) OVER w AS l1, lag(x, 2) OVER w AS l2, lead(x) OVER w AS r1, lead(x, 2) OVER w AS r2 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq))""")
def w6_finite_differences(spark, sf):
    return measures.finite_differences(T.tracks(spark, sf), {"x": "vx"}, 1.0, "track_id").select("track_id", "seq", "vx")


@register(f"WITH {TRACKS}, q AS (SELECT *, seq AS i, count(*) OVER (PARTITION BY track_id) AS m, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq)) SELECT track_id, round(x + (coalesce(x2, x) - x) * (0.3::DOUBLE * (m - 1) - i), 6) AS x, round(y + (coalesce(y2, y) - y) * (0.3::DOUBLE * (m - 1) - i), 6) AS y FROM q WHERE i = least(floor(0.3::DOUBLE * (m - 1)), greatest(m - 2, 0))")
def w15_path_interpolate(spark, sf):
    return measures.path_interpolate(T.tracks(spark, sf), 0.3).select("track_id", *_r("x", "y"))


@register(f"WITH {WAYPOINTS}, c AS (SELECT site_id, {SHOTS} AS shot, printf('clip_%06d_%03d', mission_id, seq) AS id FROM waypoints) SELECT site_id, count(*) AS n_clips, count(DISTINCT shot) AS n_shots, count(*)::BIGINT AS n_poses, string_agg(DISTINCT shot, ',' ORDER BY shot) AS tags, string_agg(id, ',' ORDER BY id) AS clip_ids, round(site_id / 25.0::DOUBLE, 6) AS coverage FROM c GROUP BY site_id")
def a15_footage_summary(spark, sf):
    shots = missions.assign_shot_types(T.waypoints(spark, sf))
    clips = shots.select("site_id", F.format_string("clip_%06d_%03d", "mission_id", "seq").alias("clip_id"), "shot_type", F.array(F.struct("e", "n", "u")).alias("poses"), F.array("shot_type").alias("interest_tags"))
    covered = T.sites(spark, sf).select("site_id", (F.col("site_id") / 25).alias("coverage"))
    return measures.footage_summary(clips, coverage=covered).withColumns({"clip_ids": F.array_join("clip_ids", ","), "coverage": F.round("coverage", 6)})


@register(f"{VIEWS} SELECT site_id, pose_id, printf('img_%04d', row_number() OVER (PARTITION BY site_id ORDER BY pose_id) - 1) AS ref FROM poses")
def io7_posed_image_refs(spark, sf):
    return files.posed_image_refs(T.view_poses(spark, sf)).select("site_id", "pose_id", "ref")


_NEAR = "CASE WHEN qb >= 0 OR qa = 0 THEN start2 WHEN -qb >= qa THEN start2 + 2 * qb + qa ELSE start2 - qb * qb / qa END"


def near_legs(legs: str, cells: str, reach: float) -> str:
    """All pairs of a leg and a cell of its site whose centre is nearer than the reach, by segment distance."""
    c = {"e": "(-48 + (i + 0.5::DOUBLE) * 2)", "n": "(-48 + (j + 0.5::DOUBLE) * 2)", "u": "((k + 0.5::DOUBLE) * 2)"}
    dot = lambda a, b: " + ".join(f"({a.format(x)}) * ({b.format(x)})" for x in "enu")
    off = " + ".join(f"(p{x} - {c[x]}) * (p{x} - {c[x]})" for x in "enu")
    cross = " + ".join(f"({x} - p{x}) * (p{x} - {c[x]})" for x in "enu")
    box = " AND ".join(f"{c[x]} BETWEEN least({x}, p{x}) - {reach} AND greatest({x}, p{x}) + {reach}" for x in "enu")
    return f"""(SELECT * FROM (SELECT *, {_NEAR} AS near2 FROM (SELECT l.*, i, j, k, {dot('{0} - p{0}', '{0} - p{0}')} AS qa, {cross} AS qb, {off} AS start2
      FROM {legs} l JOIN {cells} c ON l.site_id = c.site_id AND {box})) WHERE near2 < {reach * reach})"""


WAYS = """ways AS (SELECT *, coalesce(sum(leg) OVER past, 0) AS before_m, coalesce(sum(leg / v) OVER past, 0) AS before_s FROM (SELECT *, sqrt((e - pe) * (e - pe) + (n - pn) * (n - pn) + (u - pu) * (u - pu)) AS leg,
  least(greatest(speed, 0.1), 15.0::DOUBLE) AS v FROM (SELECT *, coalesce(lag(e) OVER w, e) AS pe, coalesce(lag(n) OVER w, n) AS pn, coalesce(lag(u) OVER w, u) AS pu FROM waypoints WINDOW w AS (PARTITION BY mission_id ORDER BY seq)))
  WINDOW past AS (PARTITION BY mission_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register(f"""WITH {WAYPOINTS}, {MAP}, {WAYS}, cut AS (SELECT *, 918 - before_s AS rest FROM ways WHERE before_s < 918),
  part AS (SELECT *, leg > 0 AND leg / v >= rest AS lands, CASE WHEN leg > 0 AND leg / v >= rest THEN rest * v / leg ELSE 1 END AS f FROM cut),
  legs AS (SELECT mission_id, site_id, seq, pe, pn, pu, pe + (e - pe) * f AS e, pn + (n - pn) * f AS n, pu + (u - pu) * f AS u, leg * f AS leg, v, before_m, before_s, lands FROM part),
  met AS (SELECT mission_id, seq, min(CASE WHEN start2 < 2.25 THEN 0 WHEN near2 < 2.25 AND qb < 0 THEN (-qb - sqrt(qb * qb - qa * (start2 - 2.25))) / qa END) AS hit, min(near2) AS near2, min(start2) AS start2 FROM {near_legs('legs', 'mapped', 6.0)} GROUP BY ALL),
  r AS (SELECT *, count(hit) OVER (PARTITION BY mission_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hits FROM legs LEFT JOIN met USING (mission_id, seq)),
  g AS (SELECT mission_id, max(before_m + leg * coalesce(hit, 1)) AS path_m, max(before_s + leg / v * coalesce(hit, 1)) AS time_s, min(CASE WHEN hit IS NULL THEN sqrt(near2) WHEN hit > 0 THEN 1.5 ELSE sqrt(start2) END) AS min_clearance,
    bool_or(hit IS NOT NULL) AS collided, bool_or(lands AND hit IS NULL) AS landed, {', '.join(f'max_by(p{c} + ({c} - p{c}) * coalesce(hit, 1), seq) AS {c}' for c in 'enu')} FROM r WHERE hits = 0 GROUP BY mission_id)
  SELECT mission_id, {', '.join(f'round({c}, 4) AS {c}' for c in ('path_m', 'time_s', 'min_clearance'))}, collided, landed, NOT collided AND NOT landed AS completed, {', '.join(f'round(CASE WHEN collided OR landed THEN {c} END, 4) + 0.0 AS event_{c}' for c in 'enu')} FROM g""")
def g9_audit_missions(spark, sf):
    """The first event of every flight where it happens on its leg, and its place."""
    rows = legs.audit_flights(T.waypoints(spark, sf), T.obstacle_map(spark, sf))
    return rows.select("mission_id", *[F.round(c, 4).alias(c) for c in ("path_m", "time_s", "min_clearance")], "collided", "landed", "completed", *_r4("event_e", "event_n", "event_u"))


@register(None)
def g9_audit_missions_fine(spark, sf):
    """As samples every 0.1 s, which is how a simulated flight is audited; g9_audit_missions solves for the events."""
    rows = legs.audit_samples(T.waypoints(spark, sf), T.obstacle_map(spark, sf))
    return rows.select("mission_id", *_r4("path_m", "time_s", "min_clearance"), "collided", "landed", "completed")
