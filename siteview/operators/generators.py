"""Poses and paths generated from a table of sites (P31, P34-P40, U1, W14). Sites hold radius and height, and stand at the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survey_camera(cameras: DataFrame, longest: int = 120) -> DataFrame:
    """The same fields of view on fewer pixels: the longest side is capped, each side has two pixels at least."""
    share = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest("width", "height"))
    return cameras.withColumns({c: F.greatest(F.lit(2), F.rint(F.col(c) * share).cast("int")) for c in ("width", "height")})


def _steps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _ring(rows: DataFrame, n: int, radius: Column, u: Column) -> DataFrame:
    rows = rows.withColumn("step", _steps(n)).withColumn("_t", F.lit(2.0) * F.pi() * F.col("step") / n)
    return rows.withColumns({"e": radius * F.cos("_t"), "n": radius * F.sin("_t"), "u": u})


def survey_poses(sites: DataFrame, grid: int = 3, oblique: int = 8, above: float = 60.0) -> DataFrame:
    """(site_id, kind, step, e, n, u, te, tn, tu): a nadir grid over twice the radius, 60 m above the building, and a
    ring of 1.1 radii at 0.6 of that altitude which looks halfway in, 3 m up."""
    altitude = F.col("height") + above
    at = lambda s: -F.col("radius") + F.lit(2.0) * F.col("radius") * F.col(s) / max(1, grid - 1)
    nadir = sites.withColumn("_a", _steps(grid)).withColumn("_b", _steps(grid)).select(
        "site_id", F.lit("nadir").alias("kind"), (F.col("_a") * grid + F.col("_b")).alias("step"), at("_a").alias("e"), at("_b").alias("n"), altitude.alias("u"),
        at("_a").alias("te"), at("_b").alias("tn"), F.lit(0.0).alias("tu"),
    )
    ring = _ring(sites, oblique, F.col("radius") * 1.1, altitude * 0.6)
    ring = ring.select("site_id", F.lit("oblique").alias("kind"), "step", "e", "n", "u", (F.col("e") / 2).alias("te"), (F.col("n") / 2).alias("tn"), F.lit(3.0).alias("tu"))
    return nadir.unionByName(ring)


def completion_poses(sites: DataFrame, oblique: int = 8, share: float = 0.7, above: float = 15.0) -> DataFrame:
    """One nadir pose 25 m over the roof and a ring above it, all aimed at the roof's middle."""
    zero, roof = F.lit(0.0), F.col("height")
    nadir = sites.select("site_id", F.lit("nadir").alias("kind"), F.lit(0).alias("step"), zero.alias("e"), zero.alias("n"), (roof + 25).alias("u"), zero.alias("te"), zero.alias("tn"), roof.alias("tu"))
    ring = _ring(sites, oblique, F.col("radius") * share, roof + above)
    return nadir.unionByName(ring.select("site_id", F.lit("oblique").alias("kind"), "step", "e", "n", "u", zero.alias("te"), zero.alias("tn"), roof.alias("tu")))


#: Degrees above a target from which it is looked at, in the order of trial (fixed values).
ELEVATIONS = (10.0, 25.0, 45.0, 60.0)


def closeup_candidates(targets: DataFrame, standoff: float = 8.0, azimuths: int = 48, lowest: float = 2.0) -> DataFrame:
    """Camera positions (ce, cn, cu) round each target (e, n, u), ranked by elevation 10, 25, 45, 60 degrees, then azimuth;
    positions that are not above ``lowest`` are dropped."""
    elevations = F.array(*map(F.lit, ELEVATIONS))
    rows = targets.withColumn("_i", _steps(len(ELEVATIONS))).withColumn("_j", _steps(azimuths)).withColumn("_el", F.radians(F.element_at(elevations, F.col("_i") + 1)))
    az = F.lit(2.0) * F.pi() * F.col("_j") / azimuths
    rows = rows.withColumns({
        "candidate_rank": F.col("_i") * azimuths + F.col("_j"), "ce": F.col("e") + standoff * F.cos("_el") * F.cos(az),
        "cn": F.col("n") + standoff * F.cos("_el") * F.sin(az), "cu": F.col("u") + standoff * F.sin("_el"),
    })
    return rows.where(F.col("cu") > lowest).drop("_i", "_j", "_el")


def scene_aoi(sites: DataFrame, res: float = 2.0) -> DataFrame:
    """A square geofence of 1.6 radii and four cells each way, and a ceiling 60 m above the building, 120 m at least."""
    half = F.col("radius") * 1.6 + 4.0 * res
    corner = lambda x, y: F.struct((half * x).alias("x"), (half * y).alias("y"))
    ring = F.array(corner(-1.0, -1.0), corner(1.0, -1.0), corner(1.0, 1.0), corner(-1.0, 1.0))
    return sites.select("site_id", ring.alias("polygon"), F.greatest(F.lit(120.0), F.col("height") + 60).alias("max_altitude"))


def ring_path(centres: DataFrame, radius: float, segments: int, loops: int = 1) -> DataFrame:
    """Closed loops of ``segments`` points round every centre (x, y); the last point is the first again."""
    rows = centres.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(segments * loops)))).withColumn("_t", F.lit(2.0) * F.pi() * (F.col("seq") % segments) / segments)
    return rows.withColumns({"x": F.col("x") + radius * F.cos("_t"), "y": F.col("y") + radius * F.sin("_t")}).drop("_t")


def sweep_order(extent: Column, ground_radius: Column, sidelap: float = 0.6) -> Column:
    """The curve order whose cells are no wider than what images at this side-lap advance, 2 to 4."""
    spacing = ground_radius * 2 * (1 - sidelap)
    return F.greatest(F.lit(2), F.least(F.lit(4), F.ceil(F.log2(extent / spacing + 1)))).cast("int")


def hilbert_sweep(areas: DataFrame) -> DataFrame:
    """(site_id, seq, x, y): a Hilbert curve of ``order`` over the box min_x, max_x, min_y, max_y of each area, from its low
    corner; the outermost cells lie on the box. The position on the curve is read two bits a level, smallest level first."""
    fold = """aggregate(sequence(0, order - 1), struct(seq AS t, 0L AS x, 0L AS y), (a, l) -> transform(array(struct((a.t div 2) & 1L AS rx, (a.t ^ ((a.t div 2) & 1L)) & 1L AS ry)), r -> struct(
        a.t div 4 AS t,
        (CASE WHEN r.ry = 1 THEN a.x WHEN r.rx = 1 THEN shiftleft(1L, l) - 1 - a.y ELSE a.y END) + shiftleft(r.rx, l) AS x,
        (CASE WHEN r.ry = 1 THEN a.y WHEN r.rx = 1 THEN shiftleft(1L, l) - 1 - a.x ELSE a.x END) + shiftleft(r.ry, l) AS y))[0])"""
    rows = areas.withColumn("seq", F.explode(F.expr("sequence(0L, shiftleft(1L, 2 * order) - 1)"))).withColumn("_c", F.expr(fold)).withColumn("_n", F.expr("shiftleft(1L, order) - 1"))
    at = {c: F.col(f"min_{c}") + (F.col(f"max_{c}") - F.col(f"min_{c}")) * F.col(f"_c.{c}") / F.col("_n") for c in "xy"}
    return rows.select("site_id", "seq", *[v.alias(k) for k, v in at.items()])


def heat_points(pois: DataFrame, controls: DataFrame) -> DataFrame:
    """(site_id, e, n, heat): every point of interest (site_id, e, n, r, loops) at 0.55 and 0.18 a loop, 1 at most and one loop
    at least, ten samples round it at 0.6 of its radius with 0.55 of its heat, and drawn control points (site_id, e, n) at 0.4."""
    loops = F.when(F.coalesce("loops", F.lit(0)) == 0, 1).otherwise(F.col("loops"))
    centres = pois.withColumn("heat", F.least(F.lit(1.0), F.lit(0.55) + F.lit(0.18) * loops))
    around = centres.withColumn("_k", _steps(10)).withColumn("_t", F.lit(2.0) * F.pi() * F.col("_k") / 10)
    around = around.select("site_id", (F.col("e") + F.col("r") * 0.6 * F.cos("_t")).alias("e"), (F.col("n") + F.col("r") * 0.6 * F.sin("_t")).alias("n"), (F.col("heat") * 0.55).alias("heat"))
    return centres.select("site_id", "e", "n", "heat").unionByName(around).unionByName(controls.select("site_id", "e", "n", F.lit(0.4).alias("heat")))


def candidate_views(*sources: tuple[str, DataFrame]) -> DataFrame:
    """The poses of each (name, table) one after the other, with source and ord, their place in the order of a site's candidates."""
    rows = None
    for k, (name, poses) in enumerate(sources):
        part = poses.select("site_id", F.lit(name).alias("source"), F.lit(k).alias("_k"), "step", "e", "n", "u", "te", "tn", "tu")
        rows = part if rows is None else rows.unionByName(part)
    by = Window.partitionBy("site_id").orderBy("_k", "step", "e", "n", "u")
    return rows.withColumn("ord", F.row_number().over(by) - 1).drop("_k")


def ease_samples(missions: DataFrame, samples: int = 600) -> DataFrame:
    """Adds step and the eased time tau in 0..1, slow at both ends."""
    return missions.withColumn("step", _steps(samples)).withColumn("tau", F.lit(0.5) * (1 - F.cos(F.pi() * F.col("step") / (samples - 1))))
