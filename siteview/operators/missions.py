"""Routes, samples, shots and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import voxels

# shot palette in order (fixed values)
PALETTE = ("orbit", "flyby", "reveal", "push_in", "top_down", "parallax", "dronie")


def _by() -> WindowSpec:
    return Window.partitionBy("mission_id").orderBy("seq")


def leg_lengths(waypoints: DataFrame) -> DataFrame:
    """Adds leg, the distance from the waypoint before; 0 for the first."""
    d = [F.pow(F.col(c) - F.lag(c).over(_by()), 2) for c in "enu"]
    return waypoints.withColumn("leg", F.coalesce(F.sqrt(d[0] + d[1] + d[2]), F.lit(0.0)))


def tour_length(waypoints: DataFrame) -> DataFrame:
    return leg_lengths(waypoints).groupBy("mission_id").agg(F.sum("leg").alias("length"), F.count("*").alias("n"))


def arc_length_knots(waypoints: DataFrame) -> DataFrame:
    """Adds knot in 0..1: the share of the chord length so far, uniform for a path of no length."""
    rows = leg_lengths(waypoints)
    whole = Window.partitionBy("mission_id")
    so_far = F.sum("leg").over(_by().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total, n = F.sum("leg").over(whole), F.count("*").over(whole)
    uniform = F.coalesce(F.try_divide((F.row_number().over(_by()) - 1).cast("double"), n - 1), F.lit(0.0))
    return rows.withColumn("knot", F.when(total < 1e-9, uniform).otherwise(so_far / F.nullif(total, F.lit(0.0))))


def leg_samples(waypoints: DataFrame, dt: float = 0.1, cruise: float = 5.0, fastest: float = 15.0) -> DataFrame:
    """Positions every ``dt`` or less along each leg, at the speed of the waypoint that it leads to."""
    rows = leg_lengths(waypoints).withColumns({f"_{c}": F.lag(c).over(_by()) for c in "enu"}).where(F.col("leg") >= 1e-9)
    rows = rows.withColumn("v", F.least(F.greatest(F.coalesce("speed", F.lit(cruise)), F.lit(0.1)), F.lit(fastest)))
    rows = rows.withColumn("steps", F.greatest(F.ceil(F.col("leg") / F.col("v") / dt), F.lit(1)).cast("int"))
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    at = {c: F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * F.col("s") / F.col("steps") for c in "enu"}
    return rows.withColumns(at).select("mission_id", "seq", "s", "e", "n", "u", (F.col("leg") / F.col("steps")).alias("step_m"), (F.col("leg") / F.col("v") / F.col("steps")).alias("step_s"))


def path_samples(waypoints: DataFrame, dt: float = 0.1) -> DataFrame:
    """(mission_id, site_id, seq, s, e, n, u): the first waypoint of each mission and the samples of its legs."""
    start = waypoints.where("seq = 0").select("mission_id", "site_id", "seq", F.lit(0).alias("s"), "e", "n", "u")
    flown = leg_samples(waypoints, dt).join(start.select("mission_id", "site_id"), "mission_id")
    return start.unionByName(flown.select(*start.columns))


def running_totals(samples: DataFrame, battery_s: float = 1080.0) -> DataFrame:
    """Adds path length, time and battery used so far."""
    by = Window.partitionBy("mission_id").orderBy("seq", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.sum("step_s").over(by)
    return samples.withColumns({"path_m": F.sum("step_m").over(by), "time_s": t, "used": t / battery_s})


def assign_shot_types(waypoints: DataFrame, distinct: int = 3, palette: tuple[str, ...] = PALETTE) -> DataFrame:
    """Adds shot_type: the palette in turn. A palette of fewer than two kinds, or of fewer than ``distinct``, is an error."""
    if len(set(palette)) < max(2, distinct):
        raise ValueError("the palette has too few kinds of shot")
    i = F.pmod(F.row_number().over(_by()) - 1, F.lit(len(palette))).cast("int")
    return waypoints.withColumn("shot_type", F.element_at(F.array(*map(F.lit, palette)), i + 1))


def add_tag(clips: DataFrame, tag: str, where: Column) -> DataFrame:
    """Appends ``tag`` to interest_tags where the condition holds and the tag is not there yet."""
    tags = F.col("interest_tags")
    return clips.withColumn("interest_tags", F.when(F.coalesce(where, F.lit(False)) & ~F.array_contains(tags, tag), F.concat(tags, F.array(F.lit(tag)))).otherwise(tags))


def first_tags(clips: DataFrame, n: int = 3) -> DataFrame:
    return clips.withColumn("interest_tags", F.slice("interest_tags", 1, n))


def tag_closeups(clips: DataFrame, closeups: DataFrame, tolerance: float = 1e-6, tag: str = "occlusion_closeup") -> DataFrame:
    """Clips (clip key columns, site_id, e, n, u, interest_tags) with the tag where a close-up camera (site_id, e, n, u) stands
    within the tolerance. Both sides are binned to cells of twice the tolerance; a camera goes to the cells that its tolerance reaches,
    one for most, and the cameras of a cell are one row, so that each clip is sent once and comes back once."""
    cell = 2 * tolerance
    at = closeups.select("site_id", "e", "n", "u").distinct()
    for c in "enu":
        reach = F.sequence(F.floor((F.col(c) - tolerance) / cell), F.floor((F.col(c) + tolerance) / cell))
        at = at.withColumn(f"_{c}", F.explode(reach))
    keys = ["site_id", "_e", "_n", "_u"]
    at = at.groupBy(*keys).agg(F.collect_list(F.struct("e", "n", "u")).alias("_at"))
    rows = clips.withColumns({f"_{c}": F.floor(F.col(c) / cell) for c in "enu"}).join(voxels.sorted_side(at), keys, "left")
    rows = rows.withColumn("_hit", F.expr(f"exists(_at, p -> sqrt(pow(e - p.e, 2) + pow(n - p.n, 2) + pow(u - p.u, 2)) < {tolerance!r}D)"))
    rows = rows.select(*clips.columns, "_hit")
    return add_tag(rows, tag, F.col("_hit")).drop("_hit")


def check_variety(shots: DataFrame, distinct: int = 3) -> DataFrame:
    """varied: no equal neighbours and enough kinds."""
    rows = shots.withColumn("_same", F.coalesce((F.lag("shot_type").over(_by()) == F.col("shot_type")).cast("int"), F.lit(0)))
    return rows.groupBy("mission_id").agg(F.countDistinct("shot_type").alias("kinds"), F.max("_same").alias("_same")).select("mission_id", "kinds", ((F.col("_same") == 0) & (F.col("kinds") >= distinct)).alias("varied"))


def phase(u: Column, height: Column) -> Column:
    share = F.coalesce(F.try_divide(u, height), F.lit(0.0))
    return F.when(share >= 0.70, "survey").when(share >= 0.32, "orbit").otherwise("capture")


def classify_phase(waypoints: DataFrame, sites: DataFrame) -> DataFrame:
    return waypoints.join(sites.select("site_id", "height"), "site_id").withColumn("phase", phase(F.col("u"), F.col("height"))).drop("height")


def phase_segments(phased: DataFrame) -> DataFrame:
    """Consecutive waypoint pairs under the phase of the first."""
    to = {f"{c}2": F.lead(c).over(_by()) for c in "enu"}
    return phased.withColumns(to).where(F.col("e2").isNotNull()).select("mission_id", "seq", "phase", "e", "n", "u", *to)


def phase_counts(phased: DataFrame) -> DataFrame:
    points = phased.groupBy("site_id", "phase").agg(F.count("*").alias("n_points"))
    last = F.lead("seq").over(_by()).isNull()
    legs = phased.withColumn("_last", last).where(~F.col("_last")).groupBy("site_id", "phase").agg(F.count("*").alias("n_legs"))
    return points.join(legs, ["site_id", "phase"], "left").withColumn("n_legs", F.coalesce("n_legs", F.lit(0)))


def downsample(waypoints: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced points of each mission, both ends kept; all of them if there are no more."""
    m = F.count("*").over(Window.partitionBy("mission_id"))
    rows = waypoints.withColumns({"_i": F.row_number().over(_by()) - 1, "_m": m})
    wanted = F.expr(f"transform(sequence(0, {n - 1}), i -> CAST(floor(i * (_m - 1) / {n - 1}) AS INT))")
    return rows.where((F.col("_m") <= n) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_m")


def orbit_poses(sites: DataFrame, views: int = 16, altitude: Column | None = None) -> DataFrame:
    """A ring of camera positions round the origin, at half the height unless an altitude is given, aimed (te, tn, tu) at
    the site's middle at half the height."""
    rows = sites.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1)))).withColumn("_t", F.lit(2.0) * F.pi() * F.col("view") / views)
    at = F.col("height") / 2 if altitude is None else altitude
    aim = [F.lit(0.0).alias("te"), F.lit(0.0).alias("tn"), (F.col("height") / 2).alias("tu")]
    return rows.select("site_id", "view", (F.col("radius") * F.cos("_t")).alias("e"), (F.col("radius") * F.sin("_t")).alias("n"), at.alias("u"), *aim)


def _track() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("seq")


def catmull_rom(tracks: DataFrame, segments: int = 18) -> DataFrame:
    """A smooth curve through all control points of a track; fewer than three stay as they are."""
    ends = {f"{c}{k}": F.coalesce(f, F.lead(c, 1).over(_track()) if k == 3 else F.col(c)) for c in "xy" for k, f in ((0, F.lag(c).over(_track())), (2, F.lead(c, 1).over(_track())), (3, F.lead(c, 2).over(_track())))}
    rows = tracks.withColumns({**ends, "_n": F.count("*").over(Window.partitionBy("track_id")), "_last": F.lead("seq").over(_track()).isNull()})
    steps = F.when((F.col("_n") < 3) | F.col("_last"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(segments - 1)))
    rows = rows.withColumn("step", F.explode(steps)).withColumn("t", F.col("step") / segments)

    def curve(c: str) -> Column:
        return F.expr(f"0.5D * (2 * {c} + ({c}2 - {c}0) * t + (2 * {c}0 - 5 * {c} + 4 * {c}2 - {c}3) * t * t + (-{c}0 + 3 * {c} - 3 * {c}2 + {c}3) * t * t * t)")

    bent = (F.col("step") > 0) & (F.col("_n") >= 3)
    return rows.select("track_id", "seq", "step", *[F.when(bent, curve(c)).otherwise(F.col(c)).alias(c) for c in "xy"])


def chaikin(tracks: DataFrame, iters: int = 1) -> DataFrame:
    """Rounds of corner cutting, both ends kept: each segment gives its points at 1/4 and 3/4. (track_id, at, x, y), ``at`` in
    the points of the round before. Tracks of fewer than three points stay as they are."""
    rows = tracks.select("track_id", F.col("seq").cast("double").alias("seq"), "x", "y")
    for _ in range(iters):
        numbered = rows.withColumn("seq", (F.row_number().over(_track()) - 1).cast("double"))
        whole = numbered.withColumns({f"{c}2": F.lead(c).over(_track()) for c in "xy"} | {"_n": F.count("*").over(Window.partitionBy("track_id"))})
        ends = F.when((F.col("seq") == 0) | F.col("x2").isNull() | (F.col("_n") < 3), F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
        inner = F.when(F.col("x2").isNotNull() & (F.col("_n") >= 3), F.array(F.lit(0.25), F.lit(0.75))).otherwise(F.array().cast("array<double>"))
        cut = whole.withColumn("w", F.explode(F.concat(ends, inner)))
        mix = {c: F.when(F.col("w") == 0, F.col(c)).otherwise(F.col(c) * (1 - F.col("w")) + F.col(f"{c}2") * F.col("w")) for c in "xy"}
        rows = cut.select("track_id", (F.col("seq") + F.col("w")).alias("seq"), *[v.alias(k) for k, v in mix.items()])
    return rows.withColumnRenamed("seq", "at")
