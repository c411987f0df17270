"""Value of viewpoints and their selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import polygons, voxels
from .camera import camera_intrinsics, pose_quaternion, project_points


#: Parts that a site's viewpoints are dealt over in the pair join.
SALT = 8


def _sides(viewpoints: DataFrame, hotspots: DataFrame, cameras: DataFrame, optimal: float, sigma: float, power: float, centre: float, cutoff: float | None) -> tuple[DataFrame, DataFrame]:
    """Viewpoints with the rows of their camera matrix and hotspots with their unit normal, both with the cells ce, cn, cu in which
    they meet; a hotspot is in the 27 round its own."""
    if optimal <= 0 or sigma <= 0 or power <= 0 or not 0 <= centre <= 1 or (cutoff is not None and cutoff <= 0):
        raise ValueError("optimal, sigma, power and cutoff must be positive and centre in [0, 1]")
    own = {"optimal", "sigma"} <= set(viewpoints.columns)
    reach = (viewpoints.agg(F.max(F.col("optimal") + 39 * F.col("sigma"))).first()[0] or 1.0) if own else optimal + 39 * sigma
    reach = min(reach, cutoff or reach)
    best, width = (F.col("optimal"), F.col("sigma")) if own else (F.lit(optimal), F.lit(sigma))
    camera = camera_intrinsics(cameras).select("camera_id", "width", "height", "fx", "fy", "cx", "cy")
    # rows of the camera matrix: depth, and pixels times depth, of a place are linear in it
    rows = {"z": "r{i}2", "x": "fx * r{i}0 + cx * r{i}2", "y": "fy * r{i}1 + cy * r{i}2"}
    v = viewpoints.join(camera, "camera_id").select(
        "site_id", "vp_id", *[F.col(c).alias(f"v{c}") for c in "enu"], F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h"), "cx", "cy", best.alias("_best"), width.alias("_width"),
        *[F.expr(x.format(i=i)).alias(f"_{k}{i}") for k, x in rows.items() for i in range(3)],
    )
    v = v.withColumns({f"_{k}3": F.expr(f"_{k}0 * ve + _{k}1 * vn + _{k}2 * vu") for k in rows})
    size = F.sqrt(F.nullif(F.expr("nx * nx + ny * ny + nz * nz"), F.lit(0.0)))
    h = hotspots.select("site_id", "hs_id", *[F.col(c).alias(f"h{c}") for c in "enu"], *[(F.col(c) / size).alias(c) for c in ("nx", "ny", "nz")], "interest").where("nx IS NOT NULL")
    h = h.withColumn("_n", F.expr("he * nx + hn * ny + hu * nz"))
    for c in "enu":
        v = v.withColumn(f"c{c}", F.floor(F.col(f"v{c}") / reach))
        h = h.withColumn("_d", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{c}", F.floor(F.col(f"h{c}") / reach) + F.col("_d")).drop("_d")
    return v, h


def score_pairs(
    viewpoints: DataFrame, hotspots: DataFrame, cameras: DataFrame, optimal: float = 12.0, sigma: float = 6.0, power: float = 1.0, centre: float = 0.5, cutoff: float | None = None
) -> DataFrame:
    """Viewpoint and hotspot pairs of a site with a framing above 0, and their term interest * framing * focal.

    Viewpoints carry r00..r22 and camera_id. Framing is facing, the cosine between the view and the inward normal to the
    ``power``, times the in-frame reward: 0 behind the camera or off the image, else 1 less ``centre`` times the distance
    from the image's middle (1 at a corner). Beyond 39 sigma of the optimal distance the focal weight is 0 in double
    precision: both sides are binned to cells of that reach and meet the 27 neighbours, so a large site does not form all
    its pairs, and no term is lost; a ``cutoff`` in metres makes the reach smaller and leaves out all pairs beyond it.
    Viewpoints may bring an ``optimal`` and ``sigma`` of their own as columns; the widest reach of them, one number, then
    sets the cells. A site's viewpoints are dealt over SALT parts.

    Pairs are sifted by products of numbers that each side brings along: first those that face away, then those behind the
    camera, then those off the image; distances, pixels and weights are taken of what is left.
    """
    v, h = _sides(viewpoints, hotspots, cameras, optimal, sigma, power, centre, cutoff)
    v, h = v.withColumn("_salt", F.pmod(F.hash("vp_id"), F.lit(SALT))), h.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    keys = ["site_id", "ce", "cn", "cu", "_salt"]
    z, x, y = (f"(_{k}0 * he + _{k}1 * hn + _{k}2 * hu - _{k}3)" for k in "zxy")
    facing = "(ve * nx + vn * ny + vu * nz - _n)"
    pairs = v.repartition(*keys).join(h, keys).where(f"{facing} > 0 AND {z} > 1e-9 AND {x} >= 0 AND {x} < _w * {z} AND {y} >= 0 AND {y} < _h * {z}")
    dist = "sqrt((he - ve) * (he - ve) + (hn - vn) * (hn - vn) + (hu - vu) * (hu - vu))"
    pairs = pairs.selectExpr("site_id", "vp_id", "hs_id", "interest", "_best", "_width", "cx", "cy", "_w", "_h", f"{dist} AS dist", f"{facing} AS _f", f"{z} AS _z", f"{x} AS _x", f"{y} AS _y")
    off = "least(1D, sqrt(pow((_x / _z - cx) / (_w / 2), 2) + pow((_y / _z - cy) / (_h / 2), 2)) / sqrt(2D))"
    pairs = pairs.selectExpr("site_id", "vp_id", "hs_id", "interest", "_best", "_width", "dist", "_f / dist AS facing", f"{1.0 - centre}D + {float(centre)}D * (1 - {off}) AS in_frame")
    near = F.col("dist").between(1e-9, float(cutoff or "inf"))
    pairs = pairs.where(near).withColumn("framing", F.pow("facing", F.lit(float(power))) * F.col("in_frame"))
    focal = F.exp(-F.pow(F.col("dist") - F.col("_best"), 2) / (2 * F.col("_width") * F.col("_width")))
    pairs = pairs.where("in_frame > 0") if centre == 1 else pairs
    return pairs.select("site_id", "vp_id", "hs_id", "dist", "facing", "in_frame", "framing", (F.col("interest") * F.col("framing") * focal).alias("term"))


#: Rows of one side that a task holds in a group of ``score_sums``, and pairs that it weighs at once: few enough that a product of matrices stays in one
#: thread and that the arrays of a slice stay near the core.
PART, WEIGHED = 20_000, 30_000


def _sums(v: dict[str, np.ndarray], h: dict[str, np.ndarray], power: float, centre: float, cutoff: float, of: str) -> tuple[np.ndarray, ...]:
    """For ``of`` "vp_id" which viewpoints have a pair and the sum of each one's terms, for "hs_id" which hotspots have one, the number
    of each one's pairs and their framing. Only what is asked for is worked out."""
    n, m = len(v["ve"]), len(h["he"])
    term, some, count, framed = np.zeros(n), np.zeros(n, bool), np.zeros(m, np.int64), np.zeros(m)
    place, normal = np.stack([h["he"], h["hn"], h["hu"]]), np.stack([h["nx"], h["ny"], h["nz"]])
    v = v | {"_w2": v["_w"] / 2, "_h2": v["_h"] / 2, "_s": -2 * v["_width"] * v["_width"]}
    step = max(1, WEIGHED // max(1, m))
    for at in range(0, n, step):
        p = {k: x[at : at + step] for k, x in v.items()}
        rows = len(p["ve"])
        away = np.stack([p["ve"], p["vn"], p["vu"]], axis=1) @ normal
        away -= h["_n"]
        x, y, z = (np.stack([p[f"_{k}{i}"] for i in range(3)], axis=1) @ place - p[f"_{k}3"][:, None] for k in "xyz")
        on = away > 0
        for also in (z > 1e-9, x >= 0, x < p["_w"][:, None] * z, y >= 0, y < p["_h"][:, None] * z):
            on &= also
        pair = np.flatnonzero(on)
        a = pair // m
        b = pair - a * m
        away, x, y, z = (t.take(pair) for t in (away, x, y, z))
        dist = np.zeros(len(pair))
        for c in "enu":
            gap = h[f"h{c}"].take(b)
            gap -= p[f"v{c}"].take(a)
            gap *= gap
            dist += gap
        np.sqrt(dist, out=dist)
        for t, middle, half in ((x, "cx", "_w2"), (y, "cy", "_h2")):
            t /= z
            t -= p[middle].take(a)
            t /= p[half].take(a)
            t *= t
        x += y
        reward = np.sqrt(x, out=x)
        reward /= np.sqrt(2.0)
        np.minimum(reward, 1.0, out=reward)
        reward = 1.0 - centre + centre * (1 - reward)
        near = (dist >= 1e-9) & (dist <= cutoff) & ((reward > 0) if centre == 1 else True)
        if not near.all():
            a, b, dist, reward, away = a[near], b[near], dist[near], reward[near], away[near]
        away /= dist
        framing = away if power == 1 else away**power
        framing *= reward
        if of == "vp_id":
            some[at : at + step] = np.bincount(a, minlength=rows) > 0
            dist -= p["_best"].take(a)
            dist *= dist
            dist /= p["_s"].take(a)
            framing *= np.exp(dist, out=dist)
            framing *= h["interest"].take(b)
            # a term without an optimal distance or a width is null, and nulls are not summed
            known = ~np.isnan(p["_best"] + p["_width"])
            term[at : at + step] = np.bincount(a, framing if known.all() else np.where(known[a], framing, 0.0), rows)
        else:
            count += np.bincount(b, minlength=m)
            framed += np.bincount(b, framing, m)
    return (some, term) if of == "vp_id" else (count > 0, count, framed)


def score_sums(viewpoints: DataFrame, hotspots: DataFrame, cameras: DataFrame, of: str, optimal: float = 12.0, sigma: float = 6.0, power: float = 1.0, centre: float = 0.5, cutoff: float | None = None) -> DataFrame:
    """Sums over the pairs of ``score_pairs``, which are never written out: for ``of`` "vp_id" (site_id, vp_id, score), the sum of a
    viewpoint's terms, for "hs_id" (site_id, hs_id, n, framing), the pairs of a hotspot and their framing.

    Both sides of a cell are dealt over parts of about PART rows, as many as their number asks for, so that a group of a part of each has
    a bounded number of rows and pairs however large a site is. A group weighs its pairs in slices of WEIGHED as arrays.
    """
    v, h = _sides(viewpoints, hotspots, cameras, optimal, sigma, power, centre, cutoff)
    v = v.where(" AND ".join(f"_{k}{i} IS NOT NULL" for k in "zxy" for i in range(4)))
    h = h.where("he IS NOT NULL AND hn IS NOT NULL AND hu IS NOT NULL AND ny IS NOT NULL AND nz IS NOT NULL").withColumn("interest", F.coalesce("interest", F.lit(0.0)))
    keys = ["site_id", "ce", "cn", "cu"]
    parts = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    # by compressed bytes Spark would choose to send the hotspots of 27 cells through the driver
    sizes = voxels.sorted_side(parts(v, "_vs").join(voxels.sorted_side(parts(h, "_hs")), keys))
    v = v.join(sizes, keys).withColumn("_v", F.pmod(F.hash("vp_id"), "_vs")).withColumn("_h0", F.explode(F.expr("sequence(0, _hs - 1)"))).drop("_vs", "_hs")
    h = h.join(sizes, keys).withColumn("_h0", F.pmod(F.hash("hs_id"), "_hs")).withColumn("_v", F.explode(F.expr("sequence(0, _vs - 1)"))).drop("_vs", "_hs")
    vn, hn = [c for c in v.columns if c not in (*keys, "vp_id", "_v", "_h0")], ["he", "hn", "hu", "nx", "ny", "nz", "interest", "_n"]
    group = [*keys, "_v", "_h0"]
    v, h = v.select(*group, "vp_id", *[F.col(c).cast("double").alias(c) for c in vn]), h.select(*group, "hs_id", *[F.col(c).cast("double").alias(c) for c in hn])
    far = float(cutoff or "inf")
    kinds = dict(v.dtypes) | dict(h.dtypes)
    out = "_score double" if of == "vp_id" else "_count long, _framing double"

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda t, names: {c: t.column(c).to_numpy() for c in names}
        on, *sums = _sums(flat(left, vn), flat(right, hn), power, centre, far, of)
        rows = (left if of == "vp_id" else right).filter(pa.array(on))
        names = ["_score"] if of == "vp_id" else ["_count", "_framing"]
        return pa.table([rows.column("site_id"), rows.column(of), *[pa.array(x[on]) for x in sums]], names=["site_id", of, *names])

    summed = v.groupBy(*group).cogroup(h.groupBy(*group)).applyInArrow(one, f"site_id {kinds['site_id']}, {of} {kinds[of]}, {out}")
    total = [F.sum("_score").alias("score")] if of == "vp_id" else [F.sum("_count").alias("n"), F.sum("_framing").alias("framing")]
    return summed.groupBy("site_id", of).agg(*total)


def viewpoint_value(viewpoints: DataFrame, hotspots: DataFrame, cameras: DataFrame, **how: float) -> DataFrame:
    """Adds score, the sum of a viewpoint's terms; 0 where nothing is seen."""
    total = score_sums(viewpoints, hotspots, cameras, "vp_id", **how).groupBy("vp_id").agg(F.sum("score").alias("score"))
    return viewpoints.join(voxels.sorted_side(total), "vp_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def build_value_field(viewpoints: DataFrame, hotspots: DataFrame, cameras: DataFrame, **how: float) -> DataFrame:
    """(site_id, vp_id, e, n, u, qw, qx, qy, qz, value): scored viewpoints with their orientation."""
    rows = pose_quaternion(viewpoint_value(viewpoints, hotspots, cameras, **how).withColumn("value", F.col("score")))
    return rows.select("site_id", "vp_id", "e", "n", "u", "qw", "qx", "qy", "qz", "value")


def sample_heatmap(points: DataFrame, poses: DataFrame, cameras: DataFrame, heatmap: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Hotspots of the points (image_id, e, n, u) whose pixel, rounded half to even, has an interest above the threshold in
    ``heatmap`` (image_id, u, v, interest): the points with interest and a normal nx, ny, nz toward the camera."""
    pixel = project_points(points, poses, cameras).where("z > 1e-9")
    pixel = pixel.withColumns({"_u": F.rint("px").cast("long"), "_v": F.rint("py").cast("long")})
    heat = heatmap.select("image_id", F.col("u").cast("long").alias("_u"), F.col("v").cast("long").alias("_v"), "interest").where(F.col("interest") > threshold)
    size = poses.select("image_id", "camera_id", *[F.col(c).alias(f"_p{c}") for c in "enu"]).join(F.broadcast(cameras.select("camera_id", "width", "height")), "camera_id").drop("camera_id")
    rows = pixel.join(heat, ["image_id", "_u", "_v"]).join(size, "image_id").where("_u >= 0 AND _u < width AND _v >= 0 AND _v < height")
    rows = rows.withColumn("_l", F.expr("sqrt(pow(_pe - e, 2) + pow(_pn - n, 2) + pow(_pu - u, 2))")).where("_l >= 1e-9")
    normal = {f"n{x}": (F.col(f"_p{c}") - F.col(c)) / F.col("_l") for x, c in zip("xyz", "enu", strict=True)}
    return rows.withColumns(normal).select(*points.columns, "interest", *normal)


def normalise_value(viewpoints: DataFrame) -> DataFrame:
    top = F.max("value").over(Window.partitionBy("site_id"))
    return viewpoints.withColumn("norm", F.when(top > 0, F.col("value") / top).otherwise(F.col("value")))


def neighbour_pairs(viewpoints: DataFrame, radius: float = 6.0, of: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (vp_id, other) of a site within the radius, by cells of that edge; with ``of``, of its viewpoints alone and all others."""
    cell = {f"c{c}": F.floor(F.col(c) / radius) for c in "enu"}
    right = viewpoints.select("site_id", F.col("vp_id").alias("other"), *[F.col(c).alias(f"o{c}") for c in "enu"], F.col("value").alias("other_value"), *[v.alias(k) for k, v in cell.items()])
    left = (viewpoints if of is None else of).select("site_id", "vp_id", "e", "n", "u", "value", *[v.alias(k) for k, v in cell.items()])
    for c in "enu":
        left = left.withColumn("_d", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_d")).drop("_d")
    close = F.expr(f"sqrt(pow(e - oe, 2) + pow(n - on_, 2) + pow(u - ou, 2)) <= {radius + 1e-9}D")
    right = right.withColumnRenamed("on", "on_")
    return right.join(voxels.sorted_side(left), ["site_id", "ce", "cn", "cu"]).where((F.col("vp_id") != F.col("other")) & close).select("site_id", "vp_id", "other", "value", "other_value")


def local_maxima(viewpoints: DataFrame, radius: float = 6.0) -> DataFrame:
    """Viewpoints without a better neighbour; of equals the lowest id stays; a null value is 0.

    All of a cell with a diagonal below the radius are neighbours, so what is worse than the best of its cell is out at once, and only
    the best of each cell, whose number the site's extent bounds, meet all others."""
    rows = viewpoints.withColumn("value", F.coalesce("value", F.lit(0.0)))
    cell = [F.floor(F.col(c) / (radius * 0.57)) for c in "enu"]
    finite = F.coalesce(F.abs("e") + F.abs("n") + F.abs("u") < 1e15, F.lit(False))
    top = F.max("value").over(Window.partitionBy("site_id", finite, *cell))
    best = rows.withColumn("_top", top).where(~finite | (F.col("value") >= F.col("_top") - 1e-12)).drop("_top")
    better = (F.col("other_value") > F.col("value") + 1e-12) | ((F.abs(F.col("other_value") - F.col("value")) <= 1e-12) & (F.col("other") < F.col("vp_id")))
    return best.join(voxels.sorted_side(neighbour_pairs(rows, radius, best).where(better).select("vp_id").distinct()), "vp_id", "left_anti")


def top_k_viewpoints(viewpoints: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("site_id").orderBy(F.desc("value"), "e", "n", "u", "vp_id")
    return viewpoints.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def peak_viewpoint(viewpoints: DataFrame) -> DataFrame:
    return viewpoints.groupBy("site_id").agg(F.max_by("vp_id", F.struct("value", -F.col("vp_id"))).alias("vp_id"), F.max("value").alias("value"))


def select_viewpoints(viewpoints: DataFrame, aoi: DataFrame, obstacles: DataFrame, k: int = 10, radius: float = 6.0, margin: float = 1.5, window: int = 3) -> DataFrame:
    """The best admissible peaks of each site: local maxima, then the geofence, then clearance, then the limit."""
    peaks = polygons.inside_geofence(local_maxima(viewpoints, radius), aoi)
    clear = voxels.clearance(peaks, obstacles, "vp_id", window)
    return top_k_viewpoints(clear.where(voxels.is_clear(clear, margin)), k)


