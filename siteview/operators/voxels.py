"""Voxel grids and obstacle maps (P19, F6-F8, F12, J6, J7, J12-J14, J17, A4, A6-A9). Cells are (site_id, i, j, k)."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import camera, polygons

CELL = ["site_id", "i", "j", "k"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, or a temporary one of a session in one JVM."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siteview-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage; the copy lies in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """As ``_checkpoint``, as a table that is computed once, at ``path`` or under a new name in the shared folder."""
    path = path or f"{shared_dir(df.sparkSession)}/siteview-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: merged by sorting, never broadcast. Spark's own choice goes by compressed bytes, of which
    ten millions can hold hundreds of millions in the driver's memory."""
    return df.hint("merge")


def voxel_index(points: DataFrame, res: float, origin: tuple[float, float, float]) -> DataFrame:
    return points.withColumns({c: F.floor((F.col(p) - o) / res).cast("int") for c, p, o in zip("ijk", "enu", origin, strict=True)})


def voxel_center(cells: DataFrame, res: float, origin: tuple[float, float, float]) -> DataFrame:
    return cells.withColumns({p: F.lit(o) + (F.col(c) + 0.5) * res for c, p, o in zip("ijk", "enu", origin, strict=True)})


def drop_ground(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("k") != 0)


def hazards_only(voxels: DataFrame) -> DataFrame:
    """Trees, poles and wires."""
    return voxels.where(F.col("label").isin(3, 4, 5))


def annulus(points: DataFrame, inner: float, outer: float) -> DataFrame:
    return points.where(F.hypot("e", "n").between(inner, outer))


def shell_voxels(voxels: DataFrame) -> DataFrame:
    """Building cells with a face neighbour that is no building cell."""
    building = voxels.where("label = 2").select(*CELL)
    steps = F.array(*[F.struct(*[F.lit(d).alias(a) for d, a in zip(s, ("di", "dj", "dk"), strict=True)]) for s in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    faces = building.withColumn("d", F.explode(steps)).select("site_id", *CELL[1:], *[(F.col(c) + F.col(f"d.d{c}")).alias(f"_{c}") for c in "ijk"])
    other = building.select("site_id", *[F.col(c).alias(f"_{c}") for c in "ijk"])
    return faces.join(other, ["site_id", "_i", "_j", "_k"], "left_anti").select(*CELL).distinct()


def near_obstacles(points: DataFrame, obstacles: DataFrame, key: str, window: int, res: float, origin: tuple[float, float, float]) -> DataFrame:
    """Pairs of a point and an obstacle cell within a cube of ``window`` cells: both sides are binned to blocks of
    ``window`` cells, an obstacle goes to its block and the 26 round it, since a grid bounds the obstacles and not the points, blocks
    meet by equality, and the cube is tested then."""
    p = voxel_index(points, res, origin).withColumnsRenamed({c: f"p{c}" for c in "ijk"})
    p = p.withColumns({f"b{c}": F.floor(F.col(f"p{c}") / window) for c in "ijk"})
    near, o = F.sequence(F.lit(-1), F.lit(1)), obstacles.select(*CELL)
    for c in "ijk":
        o = o.withColumn("_d", F.explode(near)).withColumn(f"b{c}", F.floor(F.col(c) / window) + F.col("_d")).drop("_d")
    cube = F.lit(True)
    for c in "ijk":
        cube = cube & (F.abs(F.col(c) - F.col(f"p{c}")) <= window)
    return p.join(sorted_side(o), ["site_id", "bi", "bj", "bk"]).where(cube).drop("bi", "bj", "bk")


def clearance(points: DataFrame, obstacles: DataFrame, key: str, window: int = 4, res: float = 2.0, origin: tuple[float, float, float] = (-48.0, -48.0, 0.0)) -> DataFrame:
    """Adds min_d, the distance to the nearest obstacle centre in the window; null if it holds none."""
    pairs = near_obstacles(points.select(key, "site_id", "e", "n", "u"), obstacles, key, window, res, origin)
    gap = F.lit(0.0)
    for c, p, o in zip("ijk", "enu", origin, strict=True):
        gap = gap + F.pow(F.col(p) - (F.lit(o) + (F.col(c) + 0.5) * res), 2)
    return points.join(sorted_side(pairs.groupBy(key).agg(F.sqrt(F.min(gap)).alias("min_d"))), key, "left")


def is_clear(cleared: DataFrame, margin: float = 1.5) -> Column:
    return F.coalesce(cleared["min_d"], F.lit(float("inf"))) >= margin


def obstacle_recall(truth: DataFrame, mapped: DataFrame, radius: float, band: float = 0.35, res: float = 2.0, origin: tuple[float, float, float] = (-48.0, -48.0, 0.0)) -> DataFrame:
    """Share of hazard cells in the ring round ``radius`` that the map holds, by site."""
    ring = annulus(voxel_center(hazards_only(truth), res, origin), radius * (1 - band), radius * (1 + band))
    hit = ring.join(mapped.select(*CELL).distinct().withColumn("hit", F.lit(1)), CELL, "left")
    return hit.groupBy("site_id").agg(F.count("*").alias("n_truth"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def estimate_height(depth: DataFrame, by: str = "image_id") -> DataFrame:
    """Largest less smallest finite depth of each nadir image; null with a reason for an image that has none."""
    seen = F.when((F.abs("depth") < float("inf")) & ~F.isnan("depth"), F.col("depth"))
    rows = depth.groupBy(by).agg((F.max(seen) - F.min(seen)).alias("height"))
    return rows.withColumn("reason", F.when(F.col("height").isNull(), F.lit("no finite depth")))


def occupancy(
    depth: DataFrame, poses: DataFrame, cameras: DataFrame, res: float, origin: tuple[float, float, float], shape: tuple[int, int, int], stride: int = 1, least: int = 1, farthest: float | None = None
) -> DataFrame:
    """The cells of the grid that at least ``least`` finite depth samples hit, of pixels u, v that are multiples of ``stride`` and
    not farther than ``farthest``."""
    if stride < 1 or least < 1:
        raise ValueError("stride and least must be 1 or more")
    kept = depth.where((F.abs("depth") < float("inf")) & ~F.isnan("depth"))
    kept = kept.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0)) if stride > 1 else kept
    kept = kept if farthest is None else kept.where(F.col("depth") <= farthest)
    cells = voxel_index(camera.backproject_depth(kept, poses, cameras), res, origin)
    for c, n in zip("ijk", shape, strict=True):
        cells = cells.where((F.col(c) >= 0) & (F.col(c) < n))
    return cells.groupBy(*CELL).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*CELL)


def build_obstacle_map(depth: DataFrame, poses: DataFrame, cameras: DataFrame, res: float, origin: tuple[float, float, float], shape: tuple[int, int, int], **how: float) -> DataFrame:
    return drop_ground(occupancy(depth, poses, cameras, res, origin, shape, **how))


def obstacle_lookup(cells: DataFrame, res: float, labelled: DataFrame | None = None, sparse: DataFrame | None = None, heights: DataFrame | None = None) -> DataFrame:
    """The cells that any of the sources holds: labelled voxels but for empty and ground (0, 1), a list of occupied cells, or a
    height grid (site_id, i, j, h), whose columns are occupied up to their height."""
    found = []
    if labelled is not None:
        found.append(cells.join(labelled.where("label NOT IN (0, 1)").select(*CELL), CELL, "left_semi"))
    if sparse is not None:
        found.append(cells.join(sparse.select(*CELL), CELL, "left_semi"))
    if heights is not None:
        top = heights.groupBy("site_id", "i", "j").agg(F.max("h").alias("_h"))
        found.append(cells.join(top, ["site_id", "i", "j"]).where(F.col("k") * res <= F.col("_h")).select(*cells.columns))
    return reduce(DataFrame.unionByName, found).distinct()


def voxelize_footprints(footprints: DataFrame, res: float = 5.0, vfov: float = 53.0, margin: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Grids and building cells of footprints (site_id, polygon, height) extruded to their height.

    A closing vertex is dropped and the vertex mean becomes the origin. Grids: site_id, radius (the view's fit, or 1.5
    times the reach and the margin if that is more), oe, on, ou, nx, ny, nz. Cells (site_id, i, j, k) are those from the first
    above the ground up to the roof whose centre lies inside; only the polygon's own box is tried.
    """
    same = F.expr("size(polygon) > 1 AND abs(polygon[0].x - element_at(polygon, -1).x) <= 1e-8 + 1e-5 * abs(element_at(polygon, -1).x) AND abs(polygon[0].y - element_at(polygon, -1).y) <= 1e-8 + 1e-5 * abs(element_at(polygon, -1).y)")
    rows = footprints.withColumn("polygon", F.when(same, F.expr("slice(polygon, 1, size(polygon) - 1)")).otherwise(F.col("polygon")))
    rows = polygons.polygon_stats(rows).withColumn("polygon", F.expr("transform(polygon, p -> named_struct('x', p.x - cx, 'y', p.y - cy))"))
    rows = rows.select("site_id", "height", "polygon", "cx", "cy", "reach").withColumn("radius", F.greatest((F.col("height") / 2 + margin) / F.tan(F.radians(F.lit(vfov)) / 2), F.col("reach") * 1.5 + margin))
    rows = rows.withColumn("_half", F.expr("radius + reach + 6")).withColumns({"nx": F.ceil(F.col("_half") * 2 / res).cast("int"), "nz": F.ceil((F.col("height") + 2 * res) / res).cast("int")})
    grids = rows.select("site_id", "radius", "cx", "cy", (-F.col("_half")).alias("oe"), (-F.col("_half")).alias("on"), F.lit(0.0).alias("ou"), "nx", F.col("nx").alias("ny"), "nz")

    def span(c: str) -> Column:
        lo, hi = (F.floor((f(F.col(f"polygon.{c}")) + F.col("_half")) / res) for f in (F.array_min, F.array_max))
        return F.sequence(F.greatest(F.lit(0), lo.cast("int")), F.least(F.col("nx") - 1, hi.cast("int")))

    columns = rows.withColumn("i", F.explode(span("x"))).withColumn("j", F.explode(span("y")))
    columns = columns.withColumns({"_e": (F.col("i") + 0.5) * res - F.col("_half"), "_n": (F.col("j") + 0.5) * res - F.col("_half")}).where(polygons.inside("_e", "_n", "polygon"))
    top = F.least(F.ceil(F.col("height") / res).cast("int"), F.col("nz") - 1)
    return grids, columns.where(top >= 1).withColumn("k", F.explode(F.sequence(F.lit(1), top))).select(*CELL)


def nearest_surface(points: DataFrame, surface: DataFrame, key: str, res: float, origin: tuple[float, float, float], reach: float = 8.0) -> DataFrame:
    """(key, i, j, k, dist) of the surface cell whose centre is nearest to each point of its site, of equals the first in cell
    order; points of sites without a surface have no row.

    Points look in cubes of ``reach`` round them and, while none is found within it, in cubes of twice the edge; each round
    works on the points still open, and there are at most as many as doublings span the grid. Surface cells go to the 27 cubes
    round their own, since a grid has a bounded number of them and points may be many; neither side is ever broadcast.
    """
    centres = voxel_center(surface.select(*CELL).distinct(), res, origin).withColumnsRenamed({c: f"s{c}" for c in "enu"})
    left = points.select(key, "site_id", "e", "n", "u").join(surface.select("site_id").distinct(), "site_id", "left_semi")
    out = None
    near = F.sequence(F.lit(-1), F.lit(1))
    while True:
        cells, boxes = left, centres
        for c in "enu":
            cells = cells.withColumn(f"_{c}", F.floor(F.col(c) / reach))
            boxes = boxes.withColumn("_d", F.explode(near)).withColumn(f"_{c}", F.floor(F.col(f"s{c}") / reach) + F.col("_d")).drop("_d")
        pairs = cells.join(sorted_side(boxes), ["site_id", "_e", "_n", "_u"]).withColumn("dist", F.expr("sqrt(pow(e - se, 2) + pow(n - sn, 2) + pow(u - su, 2))")).where(F.col("dist") <= reach)
        best = _checkpoint(pairs.groupBy(key).agg(F.min(F.struct("dist", "i", "j", "k")).alias("b")).select(key, "b.i", "b.j", "b.k", "b.dist"))
        out = best if out is None else out.unionByName(best)
        left = _checkpoint(left.join(sorted_side(best.select(key)), key, "left_anti"))
        if left.isEmpty():
            return out
        reach *= 2
