"""Cameras, poses and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames


def camera_intrinsics(cameras: DataFrame) -> DataFrame:
    """Adds fx, fy, cx, cy; null for a camera without pixels."""
    good = (F.col("width") > 0) & (F.col("height") > 0)
    fx, fy = F.col("width") / 2 / F.tan(F.radians("hfov") / 2), F.col("height") / 2 / F.tan(F.radians("vfov") / 2)
    return cameras.withColumns({k: F.when(good, v) for k, v in {"fx": fx, "fy": fy, "cx": F.col("width") / 2, "cy": F.col("height") / 2}.items()})


def _once(value: Column) -> Column:
    """The value as a row made of it, which is worked out once: the optimizer writes a plain column out again wherever a filter or a
    later column names it, dozens of times for a rotation."""
    return F.explode(F.array(value))


def pose_rotation(poses: DataFrame) -> DataFrame:
    """Adds the camera-to-world rotation r00..r22 of the normalised quaternion; null for a zero one."""
    rows = poses.withColumn("_q", F.nullif(F.expr("qw * qw + qx * qx + qy * qy + qz * qz"), F.lit(0.0)))
    r = {
        "r00": "1 - 2 * (qy * qy + qz * qz) / _q", "r01": "2 * (qx * qy - qw * qz) / _q", "r02": "2 * (qx * qz + qw * qy) / _q",
        "r10": "2 * (qx * qy + qw * qz) / _q", "r11": "1 - 2 * (qx * qx + qz * qz) / _q", "r12": "2 * (qy * qz - qw * qx) / _q",
        "r20": "2 * (qx * qz - qw * qy) / _q", "r21": "2 * (qy * qz + qw * qx) / _q", "r22": "1 - 2 * (qx * qx + qy * qy) / _q",
    }
    return rows.withColumns({k: F.expr(v) for k, v in r.items()}).drop("_q")


def pose_quaternion(poses: DataFrame) -> DataFrame:
    """Adds qw, qx, qy, qz of a rotation: from its trace, or from the largest diagonal element."""
    let = "transform(array({}), {} -> {})[0]"
    sizes = """named_struct('t', 2 * sqrt(greatest(r00 + r11 + r22 + 1, 0D)), 'x', 2 * sqrt(greatest(1 + r00 - r11 - r22, 0D)),
        'y', 2 * sqrt(greatest(1 + r11 - r00 - r22, 0D)), 'z', 2 * sqrt(greatest(1 + r22 - r00 - r11, 0D)))"""
    parts = """CASE WHEN r00 + r11 + r22 > 0 THEN named_struct('w', s.t / 4, 'x', (r21 - r12) / s.t, 'y', (r02 - r20) / s.t, 'z', (r10 - r01) / s.t)
        WHEN r00 > r11 AND r00 > r22 THEN named_struct('w', (r21 - r12) / s.x, 'x', s.x / 4, 'y', (r01 + r10) / s.x, 'z', (r02 + r20) / s.x)
        WHEN r11 > r22 THEN named_struct('w', (r02 - r20) / s.y, 'x', (r01 + r10) / s.y, 'y', s.y / 4, 'z', (r12 + r21) / s.y)
        WHEN r22 IS NOT NULL THEN named_struct('w', (r10 - r01) / s.z, 'x', (r02 + r20) / s.z, 'y', (r12 + r21) / s.z, 'z', s.z / 4) END"""
    unit = "named_struct('q', p, 'l', sqrt(p.w * p.w + p.x * p.x + p.y * p.y + p.z * p.z))"
    rows = poses.withColumn("_q", _once(F.expr(let.format(sizes, "s", let.format(parts, "p", unit)))))
    return rows.withColumns({f"q{c}": F.col(f"_q.q.{c}") / F.col("_q.l") for c in "wxyz"}).drop("_q")


def look_at(poses: DataFrame, up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Adds the rotation r00..r22 that turns the optical axis from e, n, u to te, tn, tu. Straight up or down along ``up``
    north serves as up; a target at the position has no rotation (null)."""
    a, b, c = map(float, up)
    let = "transform(array({}), {} -> {})[0]"  # one value under a name, so that nothing is written out again and again
    axes = "named_struct('d0', te - e, 'd1', tn - n, 'd2', tu - u, 'l', sqrt(pow(te - e, 2) + pow(tn - n, 2) + pow(tu - u, 2)))"
    z = "named_struct('z0', d.d0 / d.l, 'z1', d.d1 / d.l, 'z2', d.d2 / d.l)"
    side = f"named_struct('x0', z.z1 * {c}D - z.z2 * {b}D, 'x1', z.z2 * {a}D - z.z0 * {c}D, 'x2', z.z0 * {b}D - z.z1 * {a}D)"
    other = "IF(s.x0 * s.x0 + s.x1 * s.x1 + s.x2 * s.x2 < 1e-18D, named_struct('x0', -z.z2, 'x1', 0D, 'x2', z.z0), s)"
    unit = "named_struct('x0', w.x0 / sqrt(w.x0 * w.x0 + w.x1 * w.x1 + w.x2 * w.x2), 'x1', w.x1 / sqrt(w.x0 * w.x0 + w.x1 * w.x1 + w.x2 * w.x2), 'x2', w.x2 / sqrt(w.x0 * w.x0 + w.x1 * w.x1 + w.x2 * w.x2))"
    turn = """named_struct('r00', x.x0, 'r01', z.z1 * x.x2 - z.z2 * x.x1, 'r02', z.z0, 'r10', x.x1, 'r11', z.z2 * x.x0 - z.z0 * x.x2, 'r12', z.z1,
        'r20', x.x2, 'r21', z.z0 * x.x1 - z.z1 * x.x0, 'r22', z.z2)"""
    for value, name in ((unit, "x"), (other, "w"), (side, "s"), (z, "z")):
        turn = let.format(value, name, turn)
    rows = poses.withColumn("_turn", _once(F.expr(let.format(axes, "d", f"IF(d.l < 1e-12D, NULL, {turn})"))))
    return rows.withColumns({f"r{i}{j}": F.col(f"_turn.r{i}{j}") for i in range(3) for j in range(3)}).drop("_turn")


def target_gsd(cameras: DataFrame, standoff: Column) -> DataFrame:
    """Adds gsd, the metres that a pixel covers at a standoff, to rows with fx."""
    return cameras.withColumn("gsd", standoff / F.col("fx"))


def fits_in_frame(sites: DataFrame, cameras: DataFrame, width: float = 0.0, border: float = 0.0) -> DataFrame:
    """(site_id, camera_id, fits): whether the extremes of a building of the site's height and ``width`` project inside the
    image, ``border`` of it left on each side, from ``radius`` north at half the height. The extremes are the base and the
    top and, if it has a width, the corners at half the height, all on the side away from the camera."""
    if not 0 <= border < 0.5:
        raise ValueError("border must be in [0, 0.5)")
    half, mid = width / 2, F.col("height") / 2
    pose = sites.select("site_id", "height", F.lit(0.0).alias("e"), F.col("radius").alias("n"), mid.alias("u"), F.lit(0.0).alias("te"), F.lit(0.0).alias("tn"), mid.alias("tu"))
    ends = [(F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.col("height"))] + ([(F.lit(-half), mid), (F.lit(half), mid)] if width > 0 else [])
    points = F.explode(F.array(*[F.struct(x.alias("x"), h.alias("h")) for x, h in ends]))
    rows = look_at(pose).withColumn("_p", points).crossJoin(F.broadcast(camera_intrinsics(cameras).withColumnRenamed("height", "height_px")))  # camera models: a handful of rows
    d = {0: F.col("_p.x") - F.col("e"), 1: F.lit(-half) - F.col("n"), 2: F.col("_p.h") - F.col("u")}
    rows = rows.withColumns({f"_c{j}": sum((F.col(f"r{i}{j}") * d[i] for i in range(3)), F.lit(0.0)) for j in range(3)})
    px, py = F.expr("cx + fx * try_divide(_c0, _c2)"), F.expr("cy + fy * try_divide(_c1, _c2)")
    bx, by = F.col("width") * border, F.col("height_px") * border
    inside = (F.col("_c2") > 1e-9) & px.between(bx, F.col("width") - bx) & py.between(by, F.col("height_px") - by)
    return rows.groupBy("site_id", "camera_id").agg(F.every(F.coalesce(inside, F.lit(False))).alias("fits"))


def _posed(rows: DataFrame, poses: DataFrame, cameras: DataFrame) -> DataFrame:
    pose = pose_rotation(poses).select("image_id", "site_id", "camera_id", F.col("e").alias("_pe"), F.col("n").alias("_pn"), F.col("u").alias("_pu"), *[f"r{i}{j}" for i in range(3) for j in range(3)])
    camera = camera_intrinsics(cameras).select("camera_id", "width", "height", "fx", "fy", "cx", "cy")
    keys = ["image_id", "site_id"] if "site_id" in rows.columns else ["image_id"]
    return rows.join(pose, keys).join(F.broadcast(camera), "camera_id")  # camera models: a handful of rows


_DROP = ("_pe", "_pn", "_pu", "width", "height", "fx", "fy", "cx", "cy", *[f"r{i}{j}" for i in range(3) for j in range(3)])


def project_points(points: DataFrame, poses: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixels px, py and depth z of points (image_id, e, n, u); behind the camera they are null. in_view is F4."""
    rows = _posed(points, poses, cameras).withColumns({"_d0": F.expr("e - _pe"), "_d1": F.expr("n - _pn"), "_d2": F.expr("u - _pu")})
    rows = rows.withColumns({f"_c{j}": F.expr(f"r0{j} * _d0 + r1{j} * _d1 + r2{j} * _d2") for j in range(3)})
    front = F.col("_c2") > 1e-9
    rows = rows.withColumns({"z": F.col("_c2"), "px": F.when(front, F.expr("cx + fx * _c0 / _c2")), "py": F.when(front, F.expr("cy + fy * _c1 / _c2"))})
    inside = (F.col("_c2") > 1e-6) & F.expr("px >= 0 AND px < width AND py >= 0 AND py < height")
    return rows.withColumn("in_view", F.coalesce(inside, F.lit(False))).drop(*_DROP, "_d0", "_d1", "_d2", "_c0", "_c1", "_c2")


def backproject_depth(pixels: DataFrame, poses: DataFrame, cameras: DataFrame) -> DataFrame:
    """World e, n, u of pixels (image_id, u, v) at an axial depth; the pixel columns become px, py."""
    rows = _posed(pixels.withColumnsRenamed({"u": "px", "v": "py"}), poses, cameras)
    rows = rows.withColumns({"_x": F.expr("(px - cx) / fx * depth"), "_y": F.expr("(py - cy) / fy * depth")})
    world = {a: F.expr(f"_p{a} + r{i}0 * _x + r{i}1 * _y + r{i}2 * depth") for i, a in enumerate("enu")}
    return rows.withColumns(world).drop(*_DROP, "_x", "_y")


def backproject_ground(pixels: DataFrame, poses: DataFrame, cameras: DataFrame, ground: float = 0.0) -> DataFrame:
    """World e, n, u where the pixel's (px, py) ray meets the plane; null with a reason if it never does."""
    rows = _posed(pixels, poses, cameras).withColumns({"_x": F.expr("(px - cx) / fx"), "_y": F.expr("(py - cy) / fy")})
    rows = rows.withColumns({f"_w{i}": F.expr(f"r{i}0 * _x + r{i}1 * _y + r{i}2") for i in range(3)})
    t = F.try_divide(F.lit(ground) - F.col("_pu"), F.col("_w2"))
    rows = rows.withColumn("_t", F.when(F.abs("_w2") >= 1e-12, t))
    reason = F.when(F.col("_t").isNull(), "parallel").when(F.col("_t") <= 0, "behind")
    rows = rows.withColumn("reason", reason).withColumn("_t", F.when(F.col("_t") > 0, F.col("_t")))
    world = {a: F.col(f"_p{a}") + F.col("_t") * F.col(f"_w{i}") for i, a in enumerate("enu")}
    return rows.withColumns(world).drop(*_DROP, "_x", "_y", "_t", "_w0", "_w1", "_w2")


def filter_detections(detections: DataFrame, prompts: list[str], threshold: float = 0.3) -> DataFrame:
    return detections.where((F.col("score") >= threshold) & F.lower("label").isin([p.lower() for p in prompts]))


def georeference_detections(detections: DataFrame, poses: DataFrame, cameras: DataFrame, sites: DataFrame) -> DataFrame:
    """Where on the map the boxes' centres lie: local e, n and lat, lon, alt."""
    centres = detections.withColumns({"px": F.expr("(x0 + x1) / 2"), "py": F.expr("(y0 + y1) / 2")})
    return frames.enu_to_geodetic(backproject_ground(centres, poses, cameras), sites)


def sensor_footprint(cameras: DataFrame, altitude: Column) -> DataFrame:
    """Adds the diagonal field of view and the ground radius it covers from an altitude."""
    half = F.atan(F.hypot(F.tan(F.radians("hfov") / 2), F.tan(F.radians("vfov") / 2)))
    return cameras.withColumns({"dfov": F.degrees(half * 2), "radius": altitude * F.tan(half)})


def orbit_radius(sites: DataFrame, vfov: float, margin: float = 4.0) -> DataFrame:
    """Adds the radius from which the building fits the view; null unless height, field and margin allow one."""
    good = (F.col("height") > 0) & F.lit(0 < vfov < 180 and margin >= 0)
    return sites.withColumn("radius", F.when(good, (F.col("height") / 2 + margin) / F.tan(F.radians(F.lit(float(vfov))) / 2)))
