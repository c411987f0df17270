"""Files of footprints, footage sets, drawn paths and traces (IO1-IO8, F9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames, missions, voxels
from ..operators.missions import PALETTE as SHOT_TYPES

FOOTPRINT = "site_id LONG, centroid ARRAY<DOUBLE>, height_m DOUBLE, polygon_latlon ARRAY<ARRAY<DOUBLE>>"
POSE = "STRUCT<position: ARRAY<DOUBLE>, orientation: STRUCT<w: DOUBLE, x: DOUBLE, y: DOUBLE, z: DOUBLE>>"
CLIP = f"STRUCT<clip_id: STRING, shot_type: STRING, poses: ARRAY<{POSE}>, interest_tags: ARRAY<STRING>, uri: STRING, start_time_s: DOUBLE, duration_s: DOUBLE>"
FOOTAGE = f"aoi_name STRING, home STRUCT<lat: DOUBLE, lon: DOUBLE, alt: DOUBLE>, clips ARRAY<{CLIP}>, coverage DOUBLE, _corrupt STRING"


def read_footprints(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each vertex of a footprint: site_id, home_lat, home_lon, height, vertex, lat, lon. A file is one document, or
    with ``lines`` one document a line."""
    rows = spark.read.schema(FOOTPRINT).option("multiLine", not lines).json(path)
    rows = rows.select("site_id", F.col("centroid")[0].alias("home_lat"), F.col("centroid")[1].alias("home_lon"), F.col("height_m").alias("height"), F.posexplode("polygon_latlon").alias("vertex", "_p"))
    return rows.withColumns({"lat": F.col("_p")[0], "lon": F.col("_p")[1]}).drop("_p")


#: Keys of each level of a footage set.
KEYS = {
    "": ("aoi_name", "home", "clips", "coverage"),
    "home": ("lat", "lon", "alt"),
    "clip": ("clip_id", "shot_type", "poses", "interest_tags", "uri", "start_time_s", "duration_s"),
    "pose": ("position", "orientation"),
    "orientation": ("w", "x", "y", "z"),
}


def read_footage_sets(spark: SparkSession, path: str) -> DataFrame:
    """One row a set, one set a line; a line that is no JSON of this shape is kept in ``_corrupt``. ``_unknown`` lists the
    keys that no level of a set has, as ``key``, ``home.key``, ``clip.key``, ``pose.key`` or ``orientation.key``."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = rows.withColumn("_set", F.from_json("value", FOOTAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    part = {
        "": "json_object_keys(value)",
        "home": "json_object_keys(get_json_object(value, '$.home'))",
        "clip": "flatten(transform(from_json(get_json_object(value, '$.clips'), 'array<map<string,string>>'), c -> map_keys(c)))",
        "pose": "flatten(flatten(transform(from_json(get_json_object(value, '$.clips'), 'array<map<string,string>>'), c -> transform(from_json(c['poses'], 'array<map<string,string>>'), p -> map_keys(p)))))",
        "orientation": "flatten(flatten(transform(from_json(get_json_object(value, '$.clips'), 'array<map<string,string>>'), c -> transform(from_json(c['poses'], 'array<map<string,string>>'), p -> map_keys(from_json(p['orientation'], 'map<string,string>'))))))",
    }
    none = F.array().cast("array<string>")

    def beyond(level: str) -> Column:
        names = F.coalesce(F.filter(F.expr(part[level]), lambda x: x.isNotNull()), none)
        return F.transform(F.array_except(names, F.array(*map(F.lit, KEYS[level]))), lambda x: F.concat(F.lit(level + "." if level else ""), x))

    unknown = [beyond(level) for level in KEYS]
    return parsed.select("_set.*", F.array_sort(F.array_distinct(F.concat(*unknown))).alias("_unknown"))


def validate_footage_sets(sets: DataFrame) -> DataFrame:
    """Adds reasons, an array: empty for a valid set. Rows are quarantined by ``size(reasons) > 0``."""
    none = lambda c: f"({c}) IS NULL"
    shots = ", ".join(f"'{s}'" for s in SHOT_TYPES)
    rules = {
        "unreadable": "_corrupt IS NOT NULL",
        **({"unknown": "size(_unknown) > 0"} if "_unknown" in sets.columns else {}),
        "home": f"{none('home.lat')} OR {none('home.lon')} OR abs(home.lat) > 90 OR abs(home.lon) > 180",
        "coverage": f"{none('coverage')} OR coverage NOT BETWEEN 0 AND 1",
        "clips": f"{none('clips')} OR size(clips) < 1",
        "clip_id": "exists(clips, c -> c.clip_id IS NULL)",
        "shot_type": f"exists(clips, c -> c.shot_type IS NULL OR c.shot_type NOT IN ({shots}))",
        "poses": "exists(clips, c -> c.poses IS NULL OR size(c.poses) < 1 OR exists(c.poses, p -> p.position IS NULL OR size(p.position) != 3 OR p.orientation IS NULL))",
        "start_time_s": "exists(clips, c -> c.start_time_s < 0)",
        "duration_s": "exists(clips, c -> c.duration_s <= 0)",
    }
    found = F.array(*[F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return sets.withColumn("reasons", F.filter(found, lambda x: x.isNotNull()))


def footage_sets(clips: DataFrame, sites: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row a site: home, clips in order of clip_id, coverage. Clips hold site_id, clip_id, shot_type, poses, interest_tags."""
    nested = clips.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("clip_id", "shot_type", "poses", "interest_tags"))).alias("clips"))
    home = sites.select("site_id", F.struct(F.col("home_lat").alias("lat"), F.col("home_lon").alias("lon"), F.col("home_alt").alias("alt")).alias("home"))
    return nested.join(home, "site_id").join(coverage.select("site_id", "coverage"), "site_id")


def write_footage_sets(sets: DataFrame, path: str) -> None:
    sets.write.mode("errorifexists").json(path)


def read_poi_paths(spark: SparkSession, path: str) -> DataFrame:
    """Drawn paths as tracks: name, track_id, seq, lat, lon."""
    schema = "name STRING, paths ARRAY<STRUCT<id: LONG, gps: ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("name", F.explode("paths").alias("p"))
    return rows.select("name", F.col("p.id").alias("track_id"), F.posexplode("p.gps").alias("seq", "_g")).select("name", "track_id", "seq", "_g.lat", "_g.lon")


def write_poi_paths(tracks: DataFrame, path: str) -> None:
    """The sink of ``read_poi_paths``: one row a name, its paths nested in order."""
    gps = F.transform(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    rows = tracks.groupBy("name", "track_id").agg(gps.alias("gps"))
    rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.col("track_id").alias("id"), "gps"))).alias("paths")).write.mode("errorifexists").json(path)


def posed_image_refs(poses: DataFrame, prefix: str = "img") -> DataFrame:
    """Adds ref: the prefix and the number of the pose in its site, from 0, in four digits; and pose, its position and
    quaternion nested, if the poses have an orientation."""
    by = Window.partitionBy("site_id").orderBy("pose_id")
    rows = poses.withColumn("ref", F.format_string(f"{prefix}_%04d", F.row_number().over(by) - 1))
    if not {"qw", "qx", "qy", "qz"} <= set(poses.columns):
        return rows
    turn = F.struct(*[F.col(f"q{c}").alias(c) for c in "wxyz"])
    return rows.withColumn("pose", F.struct(F.array("e", "n", "u").alias("position"), turn.alias("orientation")))


def model3d(surface: DataFrame, images: DataFrame, coverage: DataFrame, res: float, origin: tuple[float, float, float], override: DataFrame | None = None) -> DataFrame:
    """Rows (site_id, part, position, ref, pose, voxel_size, coverage) of each site's model: part ``surface`` for a cell, ``image``
    for a posed image. ``override`` (site_id, override) takes the place of the measured coverage. A model is as large as
    its surface, so it stays rows and is never nested into one."""
    cells = voxels.voxel_center(surface.select("site_id", "i", "j", "k"), res, origin).select("site_id", F.lit("surface").alias("part"), F.array("e", "n", "u").alias("position"))
    shots = images.select("site_id", F.lit("image").alias("part"), F.array("e", "n", "u").alias("position"), "ref", "pose")
    measured = coverage.select("site_id", "coverage")
    if override is not None:
        measured = measured.join(override.select("site_id", "override"), "site_id", "left").select("site_id", F.coalesce("override", "coverage").alias("coverage"))
    return cells.unionByName(shots, allowMissingColumns=True).join(measured, "site_id").withColumn("voxel_size", F.lit(float(res)))


def geo_trace(sites: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(site_id, part, seq, lat, lon, alt, phase, label) of local tables (site_id, seq, e, n, u and perhaps label): degrees to 7
    places, altitudes to 1, phases by the site's height. One row a point, so that no site's trace meets in one task."""
    rows = None
    for name, points in parts.items():
        label = F.col("label") if "label" in points.columns else F.lit(None).cast("string")
        part = points.select("site_id", F.lit(name).alias("part"), "seq", "e", "n", "u", label.alias("label"))
        rows = part if rows is None else rows.unionByName(part)
    rows = missions.classify_phase(frames.enu_to_geodetic(rows, sites).withColumn("alt", F.col("u")), sites)
    return frames.round_vectors(rows, {"lat": 7, "lon": 7, "alt": 1}).select("site_id", "part", "seq", "lat", "lon", "alt", "phase", "label")


def stage_trace(parts: dict[str, DataFrame]) -> DataFrame:
    """(site_id, part, seq, e, n, u, v) of local tables (site_id, seq, e, n, u and perhaps v): metres to 2 places, values to 3."""
    rows = None
    for name, points in parts.items():
        value = F.col("v") if "v" in points.columns else F.lit(None).cast("double")
        part = points.select("site_id", F.lit(name).alias("part"), F.col("seq").cast("long").alias("seq"), "e", "n", "u", value.alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return frames.round_vectors(rows, {"e": 2, "n": 2, "u": 2, "v": 3})


def write_trace(trace: DataFrame, summary: DataFrame, path: str) -> None:
    """A trace as JSON lines, one folder a part, and beside it the folder ``meta`` with a summary row a site or mission."""
    trace.write.mode("errorifexists").partitionBy("part").json(f"{path}/trace")
    summary.write.mode("errorifexists").json(f"{path}/meta")


_POINTS = "ARRAY<ARRAY<DOUBLE>>"
PLAN = (
    "building STRING, osm_id LONG, home ARRAY<DOUBLE>, poi_regions ARRAY<STRUCT<id: STRING, center: ARRAY<DOUBLE>, enu: ARRAY<DOUBLE>, radius_m: DOUBLE, extra_loops: INT>>, "
    f"paths ARRAY<STRUCT<id: STRING, mode: STRING, altitude_m: DOUBLE, duration_s: DOUBLE, control_points: {_POINTS}, smoothed: {_POINTS}>>"
)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """One row a drawn plan, one JSON document a line or a file of its own: building, osm_id, home, poi_regions, paths."""
    return spark.read.schema(PLAN).json(path)


def _planar(rows: DataFrame) -> DataFrame:
    """Adds e, n of lat, lon about the plan's own home, which every row carries."""
    m, c = F.lit(frames.PLANAR), F.cos(F.radians("home_lat"))
    return rows.withColumns({"e": (F.col("lon") - F.col("home_lon")) * m * c, "n": (F.col("lat") - F.col("home_lat")) * m})


def plan_regions(plans: DataFrame) -> DataFrame:
    """(building, osm_id, home_lat, home_lon, region_id, lat, lon, e, n, radius_m, extra_loops): the regions of interest of plans,
    with their place about the home worked out anew from latitude and longitude; a plan without any has no row."""
    rows = plans.select("building", "osm_id", F.col("home")[0].alias("home_lat"), F.col("home")[1].alias("home_lon"), F.explode("poi_regions").alias("_r"))
    rows = rows.select("building", "osm_id", "home_lat", "home_lon", F.col("_r.id").alias("region_id"), F.col("_r.center")[0].alias("lat"), F.col("_r.center")[1].alias("lon"), "_r.radius_m", "_r.extra_loops")
    return _planar(rows).select("building", "osm_id", "home_lat", "home_lon", "region_id", "lat", "lon", "e", "n", "radius_m", "extra_loops")


def plan_tracks(plans: DataFrame) -> DataFrame:
    """(building, osm_id, home_lat, home_lon, track_id, mode, altitude_m, duration_s, kind, seq, lat, lon, e, n): the points of the drawn
    paths, of kind ``control`` or ``smoothed``."""
    rows = plans.select("building", "osm_id", F.col("home")[0].alias("home_lat"), F.col("home")[1].alias("home_lon"), F.explode("paths").alias("_p"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_p.{c}").alias("points")) for k, c in (("control", "control_points"), ("smoothed", "smoothed"))])
    rows = rows.withColumn("_k", F.explode(kinds)).select("building", "osm_id", "home_lat", "home_lon", F.col("_p.id").alias("track_id"), "_p.mode", "_p.altitude_m", "_p.duration_s", "_k.kind", F.posexplode("_k.points").alias("seq", "_g"))
    return _planar(rows.withColumns({"lat": F.col("_g")[0], "lon": F.col("_g")[1]}).drop("_g"))


#: Regions and paths of a plan's document; a plan of more is written as several.
HELD = 1000


def plans(homes: DataFrame, regions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plans of homes (building, osm_id, home_lat, home_lon), regions (osm_id, region_id, lat, lon, e, n, radius_m, extra_loops) and
    tracks as ``plan_tracks`` has them. Regions and paths stand in order of their ids; enu is written to two places. A plan
    of more than about HELD regions and paths is dealt to several documents of its home, each in that order, so that no task holds a whole plan."""
    point = lambda: F.transform(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.array(p["lat"], p["lon"]))
    lines = tracks.groupBy("osm_id", "track_id", "mode", "altitude_m", "duration_s", "kind").agg(point().alias("points"))
    of = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("points")), ignorenulls=True)
    paths = lines.groupBy("osm_id", "track_id", "mode", "altitude_m", "duration_s").agg(of("control").alias("control_points"), of("smoothed").alias("smoothed"))
    items = tracks.select("osm_id", F.col("track_id").alias("_id")).distinct().unionByName(regions.select("osm_id", F.col("region_id").alias("_id")))
    parts = items.groupBy("osm_id").agg(F.ceil(F.count("*") / HELD).cast("int").alias("_parts"))
    deal = lambda rows, c: rows.join(voxels.sorted_side(parts), "osm_id").withColumn("_part", F.expr(f"cast(pmod(xxhash64({c}), _parts) as int)"))
    paths = deal(paths, "track_id").groupBy("osm_id", "_part").agg(F.sort_array(F.collect_list(F.struct(F.col("track_id").alias("id"), "mode", "altitude_m", "duration_s", "control_points", "smoothed"))).alias("paths"))
    spots = F.struct(F.col("region_id").alias("id"), F.array("lat", "lon").alias("center"), F.array(F.bround("e", 2), F.bround("n", 2)).alias("enu"), "radius_m", "extra_loops")
    found = deal(regions, "region_id").groupBy("osm_id", "_part").agg(F.sort_array(F.collect_list(spots)).alias("poi_regions"))
    rows = homes.select("building", "osm_id", F.array("home_lat", "home_lon").alias("home")).join(parts, "osm_id", "left").withColumn("_part", F.explode(F.expr("sequence(0, coalesce(_parts, 1) - 1)")))
    rows = rows.join(voxels.sorted_side(found), ["osm_id", "_part"], "left").join(voxels.sorted_side(paths), ["osm_id", "_part"], "left")
    none = {c: F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])) for c in ("poi_regions", "paths")}
    return rows.select(F.lit(3).alias("stage"), "building", "osm_id", "home", *[v.alias(k) for k, v in none.items()])


def write_plans(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
