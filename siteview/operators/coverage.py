"""What views see of a surface, and plans of views.

``surface`` holds the cells (site_id, i, j, k) of each site, ``visibility`` the cells each pose sees
(site_id, pose_id, i, j, k), ``poses`` the candidates (site_id, pose_id, seq). Cells outside the surface and repeated rows
of ``visibility`` count for nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .voxels import CELL, shared_dir, stored


def _seen(surface: DataFrame, visibility: DataFrame) -> DataFrame:
    """(site_id, i, j, k, pose_id) of surface cells, each once."""
    return visibility.select(*CELL, "pose_id").join(surface.select(*CELL), CELL, "left_semi").distinct()


def coverage(surface: DataFrame, visibility: DataFrame) -> DataFrame:
    """(site_id, n_surface, n_seen, coverage) of every site with a surface."""
    seen = visibility.select(*CELL).distinct().withColumn("seen", F.lit(1))
    rows = surface.select(*CELL).distinct().join(seen, CELL, "left").groupBy("site_id").agg(F.count("*").alias("n_surface"), F.count("seen").alias("n_seen"))
    return rows.withColumn("coverage", F.col("n_seen") / F.col("n_surface"))


def frontier(surface: DataFrame, visibility: DataFrame) -> DataFrame:
    """The surface cells that no pose sees."""
    return surface.join(visibility.select(*CELL).distinct(), CELL, "left_anti")


def frontier_limit(unseen: DataFrame, n: int) -> DataFrame:
    """The first ``n`` cells of each site in cell order."""
    by = Window.partitionBy("site_id").orderBy("i", "j", "k")
    return unseen.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= n).drop("_rn")


def occlusion_recall(flagged: DataFrame, truth: DataFrame, sites: DataFrame) -> DataFrame:
    """Share of the truly hidden cells that are flagged; 1 where none is hidden."""
    hit = truth.select(*CELL).distinct().join(flagged.select(*CELL).distinct().withColumn("hit", F.lit(1)), CELL, "left")
    rate = hit.groupBy("site_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return sites.select("site_id").join(rate, "site_id", "left").select("site_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def information_gain(surface: DataFrame, visibility: DataFrame, seen: DataFrame) -> DataFrame:
    """(site_id, pose_id, gain): the surface cells a pose would add to those in ``seen``; poses that add none are left out."""
    fresh = _seen(surface, visibility).join(seen.select(*CELL).distinct(), CELL, "left_anti")
    return fresh.groupBy("site_id", "pose_id").agg(F.count("*").alias("gain"))


def min_views(surface: DataFrame, visibility: DataFrame, poses: DataFrame, target: float = 0.9) -> DataFrame:
    """(site_id, min_views): the views that the target takes if each saw as much as the best and none overlapped; the
    number of candidates where no pose sees anything, 0 without a surface."""
    size = surface.select(*CELL).distinct().groupBy("site_id").agg(F.count("*").alias("n_surface"))
    best = _seen(surface, visibility).groupBy("site_id", "pose_id").agg(F.count("*").alias("n")).groupBy("site_id").agg(F.max("n").alias("best"))
    rows = poses.groupBy("site_id").agg(F.countDistinct("pose_id").alias("n_poses")).join(size, "site_id", "left").join(best, "site_id", "left")
    views = F.when(F.col("n_surface").isNull(), F.lit(0)).when(F.col("best").isNull(), F.col("n_poses")).otherwise(F.ceil(F.lit(target) * F.col("n_surface") / F.col("best")))
    return rows.select("site_id", views.cast("long").alias("min_views"))


def lawnmower_plan(poses: DataFrame, surface: DataFrame, visibility: DataFrame, target: float = 0.9, max_views: int | None = None) -> DataFrame:
    """Poses in their order (site_id, pose_id, seq, gain, covered) until the running coverage reaches the target.

    A cell counts for the first pose that sees it; poses that add nothing stay in the plan.
    """
    size = surface.select(*CELL).distinct().groupBy("site_id").agg(F.count("*").alias("_n"))
    first = _seen(surface, visibility).join(poses.select("site_id", "pose_id", "seq"), ["site_id", "pose_id"]).groupBy(*CELL).agg(F.min("seq").alias("seq"))
    gains = first.groupBy("site_id", "seq").agg(F.count("*").alias("gain"))
    rows = poses.select("site_id", "pose_id", "seq").join(gains, ["site_id", "seq"], "left").join(size, "site_id").withColumn("gain", F.coalesce("gain", F.lit(0)))
    by = Window.partitionBy("site_id").orderBy("seq")
    rows = rows.withColumns({"covered": F.sum("gain").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.col("_n"), "_rn": F.row_number().over(by)})
    # the pose that reaches the target is the last one flown
    rows = rows.withColumn("_before", F.coalesce(F.lag("covered").over(by), F.lit(-1.0))).where(F.col("_before") < target)
    if max_views is not None:
        rows = rows.where(F.col("_rn") <= max_views)
    return rows.select("site_id", "pose_id", "seq", "gain", "covered")


def nbv_plan(poses: DataFrame, surface: DataFrame, visibility: DataFrame, target: float = 0.9, max_views: int | None = None) -> DataFrame:
    """Greedy cover, all sites in step: (site_id, pick, pose_id, gain, covered).

    Every round each site takes the pose that adds the most cells, the earliest of equals, until it reaches the target,
    no pose adds any or ``max_views`` are taken. A round writes its picks beside those before it and the cells that the sites
    still going have left; only whether there are picks comes to the driver. There are at most as many rounds as one site has
    useful poses.
    """
    spark = surface.sparkSession
    size = surface.select(*CELL).distinct().groupBy("site_id").agg(F.count("*").alias("_n"))
    left = stored(_seen(surface, visibility).join(poses.select("site_id", "pose_id", "seq"), ["site_id", "pose_id"]))
    done = size.withColumn("_c", F.lit(0).cast("long")).where(F.lit(0.0) < F.lit(float(target)) * F.col("_n"))
    folder, k = f"{shared_dir(spark)}/siteview-{uuid.uuid4().hex}", 0
    out = spark.createDataFrame([], f"site_id {dict(surface.dtypes)['site_id']}, pick int, pose_id {dict(poses.dtypes)['pose_id']}, gain long, _c long, _n long")
    while max_views is None or k < max_views:
        gains = left.groupBy("site_id", "pose_id", "seq").agg(F.count("*").alias("gain"))
        best = gains.groupBy("site_id").agg(F.max_by(F.struct("pose_id", "gain"), F.struct("gain", -F.col("seq"), -F.col("pose_id"))).alias("b"))
        pick = best.join(done, "site_id").select("site_id", F.lit(k).alias("pick"), "b.pose_id", "b.gain", (F.col("_c") + F.col("b.gain")).alias("_c"), "_n")
        pick = stored(pick, f"{folder}/{k}")
        if pick.isEmpty():
            break
        k += 1
        done = pick.where(F.col("_c") < F.lit(target) * F.col("_n")).select("site_id", "_n", "_c")
        gone = left.join(pick.select("site_id", "pose_id"), ["site_id", "pose_id"], "left_semi").select(*CELL)
        left = stored(left.join(done.select("site_id"), "site_id", "left_semi").join(gone, CELL, "left_anti"))
    picks = spark.read.schema(out.schema).parquet(*[f"{folder}/{i}" for i in range(k)]) if k else out
    return picks.select("site_id", "pick", "pose_id", "gain", (F.col("_c") / F.col("_n")).alias("covered"))


def outward_normal(points: DataFrame, res: float = 2.0) -> DataFrame:
    """Adds nx, ny, nz to points (e, n, u, ce, cn, cu, height): horizontally away from the axis of the building, up on it."""
    de, dn = F.col("e") - F.col("ce"), F.col("n") - F.col("cn")
    reach = F.hypot(de, dn)
    roof = F.col("u") - (F.col("cu") + F.col("height")) > -res
    up = (roof & (reach < 1e-6)) | (reach < 1e-9)
    return points.withColumns({"nx": F.when(up, 0.0).otherwise(de / F.nullif(reach, F.lit(0.0))), "ny": F.when(up, 0.0).otherwise(dn / F.nullif(reach, F.lit(0.0))), "nz": F.when(up, 1.0).otherwise(0.0)})


def build_hotspots(surface: DataFrame, visibility: DataFrame, base: float = 1.0, boost: float = 2.0) -> DataFrame:
    """The surface with interest: ``base``, times ``boost`` for cells that no pose sees."""
    seen = visibility.select(*CELL).distinct().withColumn("_seen", F.lit(True))
    return surface.join(seen, CELL, "left").withColumn("interest", F.when(F.col("_seen"), base).otherwise(base * boost)).drop("_seen")


def azimuth_order(poses: DataFrame, centre: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds ord, from 0, by azimuth about the centre (the origin if not given); equal azimuths by pose_id."""
    ce, cn = centre or (F.lit(0.0), F.lit(0.0))
    by = Window.partitionBy("site_id").orderBy(F.atan2(F.col("n") - cn, F.col("e") - ce), "pose_id")
    return poses.withColumn("ord", F.row_number().over(by) - 1)
