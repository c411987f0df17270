"""Registered queries of files: tables written as JSON to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import frames, missions, voxels
from ..sources import driver_tables as T
from ..sources import files
from .queries import AOI, SHOTS, SITES, WAYPOINTS, _s, register


def _folder(spark) -> str:
    return f"{voxels.shared_dir(spark)}/siteview-{uuid.uuid4().hex}"


POIS = """pois AS (SELECT CAST(s_suppkey % 25 AS INT) AS site_id, printf('poi_%05d', s_suppkey) AS region_id, CAST(s_suppkey % 31 - 15 AS DOUBLE) AS e, CAST(s_suppkey % 29 - 14 AS DOUBLE) AS n, CAST(5 + s_suppkey % 4 AS DOUBLE) AS radius_m, CAST(s_suppkey % 4 AS INT) AS extra_loops FROM supplier)"""


def _pois(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(
        "CAST(s_suppkey % 25 AS INT) AS site_id", "format_string('poi_%05d', s_suppkey) AS region_id", "CAST(s_suppkey % 31 - 15 AS DOUBLE) AS e", "CAST(s_suppkey % 29 - 14 AS DOUBLE) AS n",
        "CAST(5 + s_suppkey % 4 AS DOUBLE) AS radius_m", "CAST(s_suppkey % 4 AS INT) AS extra_loops",
    )


def _plans(spark, sf):
    """A plan a site: its regions, and a drawn path for each mission, smoothed."""
    sites = T.sites(spark, sf)
    homes = sites.select(F.concat(F.lit("site "), "site_id").alias("building"), F.col("site_id").cast("long").alias("osm_id"), "home_lat", "home_lon")
    regions = frames.planar_geodetic(_pois(spark, sf), sites).withColumn("osm_id", F.col("site_id").cast("long"))
    ways = T.waypoints(spark, sf).select("site_id", F.col("mission_id").alias("track_id"), "seq", F.col("e").alias("x"), F.col("n").alias("y"))
    smooth = missions.catmull_rom(ways, 4).join(ways.select("track_id", "site_id").distinct(), "track_id").select("site_id", "track_id", (F.col("seq") * 4 + F.col("step")).alias("seq"), "x", "y")
    points = ways.withColumn("kind", F.lit("control")).unionByName(smooth.withColumn("kind", F.lit("smoothed"))).withColumnsRenamed({"x": "e", "y": "n"})
    tracks = frames.planar_geodetic(points, sites).selectExpr("CAST(site_id AS LONG) AS osm_id", "format_string('cine_%06d', track_id) AS track_id", "'waypoints' AS mode", "14D AS altitude_m", "8D AS duration_s", "kind", "seq", "lat", "lon")
    path = _folder(spark)
    files.write_plans(files.plans(homes, regions, tracks), path)
    return files.read_plans(spark, path)


@register(f"WITH {SITES}, {POIS} SELECT 'site ' || site_id AS building, region_id, {_s('e', 'n')}, round(home_lat + n / 111320.0, 9) AS lat, radius_m, extra_loops FROM pois JOIN sites USING (site_id)")
def io6_plan_regions(spark, sf):
    """The regions of all plans, written and read back."""
    rows = files.plan_regions(_plans(spark, sf))
    return rows.select("building", "region_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in "en"], F.round("lat", 9).alias("lat"), "radius_m", "extra_loops")


@register(f"WITH {WAYPOINTS} SELECT 'site ' || site_id AS building, printf('cine_%06d', mission_id) AS track_id, CAST(seq AS INT) AS seq, {_s('e', 'n')} FROM waypoints")
def io6_plan_tracks(spark, sf):
    """The control points of all drawn paths, written and read back."""
    rows = files.plan_tracks(_plans(spark, sf)).where("kind = 'control'")
    return rows.select("building", "track_id", F.col("seq").cast("int").alias("seq"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in "en"])


@register(f"WITH {SITES}, {AOI} SELECT CAST(site_id AS BIGINT) AS site_id, home_lat, height, CAST(i - 1 AS INT) AS vertex, round(home_lat + y / 111320.0, 9) AS lat, round(home_lon + x / (111320.0 * cos(radians(home_lat))), 9) AS lon FROM verts JOIN sites USING (site_id)")
def io1_read_footprints(spark, sf):
    """The outlines of all sites, written and read back."""
    sites, path = T.sites(spark, sf), _folder(spark)
    points = T.aoi(spark, sf).select("site_id", F.posexplode("polygon").alias("i", "p")).select("site_id", "i", F.col("p.x").alias("e"), F.col("p.y").alias("n"))
    rings = frames.planar_geodetic(points, sites).groupBy("site_id").agg(F.expr("transform(array_sort(collect_list(struct(i, lat, lon))), p -> array(p.lat, p.lon))").alias("polygon_latlon"))
    rows = rings.join(sites, "site_id").select(F.col("site_id").cast("long").alias("site_id"), F.array("home_lat", "home_lon").alias("centroid"), F.col("height").alias("height_m"), "polygon_latlon")
    rows.write.json(path)
    return files.read_footprints(spark, path, lines=True).select("site_id", "home_lat", "height", F.col("vertex").cast("int").alias("vertex"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@register(f"""WITH {WAYPOINTS}, c AS (SELECT mission_id, site_id, count(*) AS n_clips, min({SHOTS}) AS first_shot FROM waypoints GROUP BY ALL)
  SELECT 'mission ' || mission_id AS aoi_name, n_clips, first_shot, concat_ws(',', CASE WHEN mission_id % 7 = 0 THEN 'unknown' END, CASE WHEN mission_id % 5 = 0 THEN 'home' END, CASE WHEN mission_id % 3 = 0 THEN 'coverage' END, CASE WHEN mission_id % 4 = 0 THEN 'duration_s' END) AS reasons FROM c""")
def io2_read_footage_sets(spark, sf):
    """A footage set for each mission, written and read back with what is wrong with it (F9): some homes are out of range, some coverages
    over 1, some clips without a length, and some sets have a key that there is none of."""
    shots = missions.assign_shot_types(T.waypoints(spark, sf))
    turn = F.struct(*[F.lit(v).alias(k) for k, v in (("w", 1.0), ("x", 0.0), ("y", 0.0), ("z", 0.0))])
    clip = F.struct(
        F.format_string("clip_%03d", "seq").alias("clip_id"), "shot_type", F.array(F.struct(F.array("e", "n", "u").alias("position"), turn.alias("orientation"))).alias("poses"), F.array("shot_type").alias("interest_tags"),
        F.when(F.col("mission_id") % 4 == 0, 0.0).otherwise(5.0).alias("duration_s"),
    )
    sets = shots.groupBy("mission_id").agg(F.sort_array(F.collect_list(clip)).alias("clips"))
    home = F.struct(F.when(F.col("mission_id") % 5 == 0, 99.0).otherwise(43.0).alias("lat"), F.lit(-80.0).alias("lon"), F.lit(12.0).alias("alt"))
    m, path = F.col("mission_id"), _folder(spark)
    rows = sets.select(F.concat(F.lit("mission "), m).alias("aoi_name"), home.alias("home"), "clips", F.when(m % 3 == 0, 1.5).otherwise(0.9).alias("coverage"), F.when(m % 7 == 0, "x").alias("rating"))
    files.write_footage_sets(rows, path)
    read = files.validate_footage_sets(files.read_footage_sets(spark, path))
    return read.select("aoi_name", F.size("clips").cast("long").alias("n_clips"), F.array_min("clips.shot_type").alias("first_shot"), F.array_join("reasons", ",").alias("reasons"))
