"""Measures of predictions and flights against references."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import missions, voxels


def mask_intersect(one: DataFrame, two: DataFrame, by: str = "image_id") -> DataFrame:
    return one.select(by, "u", "v").intersect(two.select(by, "u", "v"))


def mask_union(one: DataFrame, two: DataFrame, by: str = "image_id") -> DataFrame:
    return one.select(by, "u", "v").union(two.select(by, "u", "v")).distinct()


def mask_iou(pred: DataFrame, truth: DataFrame, by: str = "image_id") -> DataFrame:
    """(by, inter, union, iou) of two tables of positive pixels (by, u, v); an image that only one side has counts 0."""
    key = [by, "u", "v"]
    both = pred.select(*key).distinct().withColumn("_p", F.lit(1)).join(truth.select(*key).distinct().withColumn("_t", F.lit(1)), key, "full")
    rows = both.groupBy(by).agg(F.sum(F.when(F.col("_p").isNotNull() & F.col("_t").isNotNull(), 1).otherwise(0)).alias("inter"), F.count("*").alias("union"))
    return rows.withColumn("iou", F.col("inter") / F.greatest(F.lit(1), F.col("union")))


def topk_overlap(values: DataFrame, picks: DataFrame, k: int = 10, by: str = "site_id", key: str = "vp_id") -> DataFrame:
    """Share of the k highest values of each group that are also picked; equal values by key."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), key))
    top = values.withColumn("_rn", rank).where(F.col("_rn") <= k)
    hit = top.join(picks.select(by, key).distinct().withColumn("_hit", F.lit(1)), [by, key], "left")
    return hit.groupBy(by).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("overlap"))


def median_abs_error(pairs: DataFrame, by: str) -> DataFrame:
    """Exact median of |est - ref| by group; pairs with a null side take no part."""
    return pairs.groupBy(by).agg(F.median(F.abs(F.col("est") - F.col("ref"))).alias("error"))


def reprojection_error(projected: DataFrame, by: str = "image_id") -> DataFrame:
    """Mean pixel distance of px, py from the observed ox, oy; points behind the camera take no part."""
    return projected.where("px IS NOT NULL").groupBy(by).agg(F.avg(F.hypot(F.col("px") - F.col("ox"), F.col("py") - F.col("oy"))).alias("error"))


def closeup_plan_stats(closeups: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, n_resolved, resolved_fraction); a site without close-ups has 0 and 1."""
    rows = closeups.groupBy("site_id").agg(F.count_if("resolved").alias("n"), F.avg(F.col("resolved").cast("int")).alias("f"))
    return sites.select("site_id").join(rows, "site_id", "left").select("site_id", F.coalesce("n", F.lit(0)).alias("n_resolved"), F.coalesce("f", F.lit(1.0)).alias("resolved_fraction"))


def finite_differences(samples: DataFrame, columns: dict[str, str], dt: float, by: str, order: str = "seq") -> DataFrame:
    """Adds the time derivative of each column: central inside, second-order one-sided at both ends, null below three samples."""
    w = Window.partitionBy(by).orderBy(order)
    out = {}
    for c, name in columns.items():
        x, at = F.col(c), lambda k, c=c: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
        start, end = (-3 * x + 4 * at(1) - at(2)) / (2 * dt), (3 * x - 4 * at(-1) + at(-2)) / (2 * dt)
        out[name] = F.when(at(-1).isNull(), start).when(at(1).isNull(), end).otherwise((at(1) - at(-1)) / (2 * dt))
    return samples.withColumns(out)


def trajectory_summary(samples: DataFrame, dt: float, by: str = "mission_id", obstacles: DataFrame | None = None, margin: float = 1.5) -> DataFrame:
    """(by, max_speed, max_accel, max_jerk, duration) of positions e, n, u at even times. With ``obstacles``, and samples that carry
    site_id, min_clearance too: the least distance of a sample to an obstacle's centre, looked for up to three cells beyond
    the margin; null if none is there."""
    names, rows = ("e", "n", "u"), samples
    for step in "vaj":
        new = tuple(step + c[-1] for c in names)
        rows, names = finite_differences(rows, dict(zip(names, new, strict=True)), dt, by), new
    size = lambda s: F.max(F.sqrt(sum((F.col(s + c) * F.col(s + c) for c in "enu"), F.lit(0.0))))
    out = rows.groupBy(by).agg(size("v").alias("max_speed"), size("a").alias("max_accel"), size("j").alias("max_jerk"), ((F.count("*") - 1) * F.lit(dt)).alias("duration"))
    if obstacles is None:
        return out
    near = voxels.clearance(samples.withColumn("_s", F.struct(by, "seq")), obstacles, "_s", -int(-margin // 1) + 3)
    return out.join(near.groupBy(by).agg(F.min("min_d").alias("min_clearance")), by)


def within_limits(summary: DataFrame, speed: float, accel: float, jerk: float) -> DataFrame:
    return summary.where((F.col("max_speed") <= speed + 1e-6) & (F.col("max_accel") <= accel + 1e-6) & (F.col("max_jerk") <= jerk + 1e-6))


def path_interpolate(tracks: DataFrame, fraction: float) -> DataFrame:
    """The point (x, y) of each track at a share of its segments, linear within one."""
    w = Window.partitionBy("track_id")
    rows = tracks.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("seq")) - 1, **{f"_{c}": F.lead(c).over(w.orderBy("seq")) for c in "xy"}})
    rows = rows.withColumn("_p", F.lit(float(fraction)) * (F.col("_n") - 1))
    segment = F.least(F.floor("_p"), F.greatest(F.col("_n") - 2, F.lit(0)))
    rest = F.col("_p") - F.col("_i")
    return rows.where(F.col("_i") == segment).select("track_id", *[(F.col(c) + (F.coalesce(f"_{c}", c) - F.col(c)) * rest).alias(c) for c in "xy"])


def footage_summary(clips: DataFrame, by: str = "site_id", coverage: DataFrame | None = None) -> DataFrame:
    """(by, n_clips, n_shots, n_poses, tags, clip_ids) of clips (by, clip_id, shot_type, poses array, interest_tags array), with the
    coverage (by, coverage) of their set, if given. A set's clip ids are one array, as in its file."""
    counts = clips.groupBy(by).agg(F.count("*").alias("n_clips"), F.countDistinct("shot_type").alias("n_shots"), F.sum(F.size("poses")).alias("n_poses"), F.sort_array(F.collect_list("clip_id")).alias("clip_ids"))
    tags = clips.select(by, F.explode("interest_tags").alias("tag")).distinct().groupBy(by).agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))
    rows = counts.join(tags, by, "left").select(by, "n_clips", "n_shots", "n_poses", "tags", "clip_ids")
    return rows if coverage is None else rows.join(coverage.select(by, "coverage"), by, "left")


def audit_missions(waypoints: DataFrame, obstacles: DataFrame, dt: float = 0.1, margin: float = 1.5, reserve: float = 0.15, battery_s: float = 1080.0, window: int = 3) -> DataFrame:
    """One row a mission: path_m, time_s, used, min_clearance, collided, landed, completed, up to the first event, in samples
    every ``dt``; ``legs.audit_flights`` has no steps.

    A sample nearer to an obstacle than ``margin`` is a collision, one whose battery is down to the reserve a landing; a
    collision comes first in a sample that has both. The first waypoint is tested for collision only. min_clearance is null if no
    obstacle lies in the window of any sample.
    """
    start = waypoints.where("seq = 0").select("mission_id", "site_id", "seq", F.lit(0).alias("s"), "e", "n", "u", *[F.lit(0.0).alias(c) for c in ("path_m", "time_s", "used")])
    flown = missions.running_totals(missions.leg_samples(waypoints, dt), battery_s).join(waypoints.where("seq = 0").select("mission_id", "site_id"), "mission_id")
    samples = start.unionByName(flown.select(*start.columns)).withColumn("sample", F.struct("mission_id", "seq", "s"))
    rows = voxels.clearance(samples, obstacles, "sample", window)
    hit, low = F.coalesce(F.col("min_d") < margin, F.lit(False)), (F.col("seq") > 0) & (1 - F.col("used") <= reserve)
    by = Window.partitionBy("mission_id").orderBy("seq", "s")
    events = rows.withColumn("event", F.when(hit, "collision").when(low, "landing"))
    before = F.count("event").over(by.rowsBetween(Window.unboundedPreceding, -1))
    kept = events.withColumn("_before", before).where("_before = 0")
    out = kept.groupBy("mission_id").agg(
        F.max("path_m").alias("path_m"), F.max("time_s").alias("time_s"), F.max("used").alias("used"), F.min("min_d").alias("min_clearance"),
        F.coalesce(F.max(F.col("event") == "collision"), F.lit(False)).alias("collided"), F.coalesce(F.max(F.col("event") == "landing"), F.lit(False)).alias("landed"),
    )
    return out.withColumn("completed", ~F.col("collided") & ~F.col("landed"))


def flight_ok(audit: DataFrame) -> DataFrame:
    return audit.withColumn("ok", ~F.col("collided") & (F.col("completed") | F.col("landed")))


def match_boxes(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, pred_id, truth_id, iou): a one-to-one match of boxes x0, y0, x1, y1 of an image that overlap enough.

    The result is that of taking all pairs by score, then overlap, then ids, and keeping a pair if both boxes are free.
    Each round keeps every pair that is the first of both its boxes, so images and boxes are matched at once; what is
    left is checkpointed for the next round.
    """
    t = truth.select("image_id", "truth_id", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = pred.select("image_id", "pred_id", "score", "x0", "y0", "x1", "y1").join(t, "image_id").where("x0 < tx1 AND tx0 < x1 AND y0 < ty1 AND ty0 < y1")
    pairs = pairs.withColumn("_i", F.expr("(least(x1, tx1) - greatest(x0, tx0)) * (least(y1, ty1) - greatest(y0, ty0))"))
    pairs = pairs.withColumn("iou", F.expr("_i / ((x1 - x0) * (y1 - y0) + (tx1 - tx0) * (ty1 - ty0) - _i)")).where(F.col("iou") >= threshold)
    left = voxels._checkpoint(pairs.select("image_id", "pred_id", "truth_id", "score", "iou"))
    order, out = [F.desc("score"), F.desc("iou"), "pred_id", "truth_id"], None
    while True:
        rank = lambda c: F.row_number().over(Window.partitionBy("image_id", c).orderBy(*order))
        kept = voxels._checkpoint(left.withColumns({"_p": rank("pred_id"), "_t": rank("truth_id")}).where("_p = 1 AND _t = 1").select("image_id", "pred_id", "truth_id", "iou"))
        out = kept if out is None else out.unionByName(kept)
        left = left.join(kept.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_anti").join(kept.select("image_id", "truth_id"), ["image_id", "truth_id"], "left_anti")
        left = voxels._checkpoint(left)
        if left.isEmpty():
            return out


def detection_quality(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, n_truth, n_pred, n_match, recall, precision, false_positives) of every image with boxes; an image without
    true boxes has recall 1, one without predictions precision 1."""
    hit = match_boxes(pred, truth, threshold).groupBy("image_id").agg(F.count("*").alias("n_match"))
    counts = truth.groupBy("image_id").agg(F.count("*").alias("n_truth")).join(pred.groupBy("image_id").agg(F.count("*").alias("n_pred")), "image_id", "full").join(hit, "image_id", "left")
    rows = counts.select("image_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_truth", "n_pred", "n_match")])
    share = lambda of: F.when(F.col(of) == 0, 1.0).otherwise(F.try_divide(F.col("n_match"), F.col(of)))
    return rows.withColumns({"recall": share("n_truth"), "precision": share("n_pred"), "false_positives": F.col("n_pred") - F.col("n_match")})


def frechet_similarity(tracks: DataFrame, pairs: DataFrame, scale: float = 10.0, bound: float | None = None) -> DataFrame:
    """(track_a, track_b, distance, similarity) of pairs of tracks (track_id, seq, x, y): the discrete Frechet distance d and
    1 / (1 + d / scale).

    With ``bound``, pairs whose first or last points are farther apart, and so their distance, are left out beforehand, and a
    pair is given up, with an infinite distance, as soon as no point of one row can be reached within it. A
    task holds the points of one pair; a row of the table is worked out at a time.
    """
    points = tracks.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    rows = pairs.select("track_a", "track_b").join(points.select(F.col("track_id").alias("track_a"), F.col("p").alias("a")), "track_a").join(points.select(F.col("track_id").alias("track_b"), F.col("p").alias("b")), "track_b")
    if bound is not None:
        ends = [F.hypot(F.element_at("a.x", k) - F.element_at("b.x", k), F.element_at("a.y", k) - F.element_at("b.y", k)) <= bound for k in (1, -1)]
        rows = rows.where(ends[0] & ends[1])
    flat = rows.select("track_a", "track_b", *[F.col(f"{t}.{c}").alias(f"{t}{c}") for t in "ab" for c in "xy"])
    most = float("inf") if bound is None else bound

    @F.pandas_udf("double")
    def distance(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([_frechet(np.column_stack([p, q]), np.column_stack([r, s]), most) for p, q, r, s in zip(ax, ay, bx, by, strict=True)], dtype=float)

    out = flat.select("track_a", "track_b", distance("ax", "ay", "bx", "by").alias("distance"))
    return out.withColumn("similarity", 1 / (1 + F.col("distance") / scale))


def track_candidates(tracks: DataFrame, bound: float) -> DataFrame:
    """(track_a, track_b): the pairs, track_a below track_b, whose Frechet distance can be within the bound. Their first points, their
    last points and each side of their boxes are not farther apart than it.

    Tracks meet by the cells of both ends, so that many tracks from one place meet only if they also end near each other.
    """
    if bound <= 0:
        raise ValueError("bound must be positive")
    known = tracks.where("x IS NOT NULL AND y IS NOT NULL")
    at = F.struct("seq", "x", "y")
    ends = known.groupBy("track_id").agg(F.min(at).alias("f"), F.max(at).alias("l"), *[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    ends = ends.select("track_id", *[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "fl" for c in "xy"], "lox", "loy", "hix", "hiy")
    cells = {f"c{e}{c}": F.floor(F.col(f"{e}{c}") / bound).cast("long") for e in "fl" for c in "xy"}
    left, right = ends.withColumns(cells), ends.withColumns(cells)
    near = F.explode(F.array(*[F.struct(*[F.lit(k // 3**i % 3 - 1).alias(c) for i, c in enumerate(cells)]) for k in range(81)]))
    left = left.withColumn("_d", near).withColumns({c: F.col(c) + F.col(f"_d.{c}") for c in cells}).drop("_d")
    one, two = (t.select(*cells, *[F.col(c).alias(f"{c}_{s}") for c in ends.columns]) for t, s in ((left, "a"), (right, "b")))
    pairs = one.join(two, list(cells)).where("track_id_a < track_id_b")
    for e in "fl":
        pairs = pairs.where(F.hypot(F.col(f"{e}x_a") - F.col(f"{e}x_b"), F.col(f"{e}y_a") - F.col(f"{e}y_b")) <= bound)
    for c in ("lox", "loy", "hix", "hiy"):
        pairs = pairs.where(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= bound)
    return pairs.select(F.col("track_id_a").alias("track_a"), F.col("track_id_b").alias("track_b"))


#: Points and tracks that a task holds of each side of a group of ``similar_tracks``, and points of pairs that it weighs at once.
POINTS, TRACKS, WEIGHED = 20_000, 2_000, 128_000


def _pairs_within(left: pa.Table, right: pa.Table, bound: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance): the pairs of tracks, by their rows, whose discrete Frechet distance is within the bound; of ``same``
    sides each pair once.

    Distances stay squared up to the end, which changes neither their order nor the last one's root. Pairs are taken by length, and the
    shorter tracks of a batch go on at their last point, which leaves the distance as it is."""
    sides = []
    for rows in (left, right):
        flat = [rows.column(c).combine_chunks() for c in ("xs", "ys")]
        n = np.diff(flat[0].offsets.to_numpy())
        at, (x, y) = np.cumsum(n) - n, (f.flatten().to_numpy().astype(float) for f in flat)
        order = np.argsort(n, kind="stable")
        box = [f.reduceat(c, at)[order] for f in (np.minimum, np.maximum) for c in (x, y)]
        ends = [c[k][order] for k in (at, at + n - 1) for c in (x, y)]
        sides.append((order, n[order], at[order], x, y, box, ends))
    (ia, na, pa_, xa, ya, boxa, enda), (ib, nb, pb, xb, yb, boxb, endb) = sides
    most, out = bound * bound * (1 + 1e-12), []
    strip = max(1, 500_000 // len(nb))
    for lo in range(0, len(na), strip):
        part = slice(lo, lo + strip)
        gap = [p[part, None] - q for p, q in zip(enda, endb, strict=True)]
        on = (gap[0] ** 2 + gap[1] ** 2 <= most) & (gap[2] ** 2 + gap[3] ** 2 <= most)
        if same:
            on &= ia[part, None] < ib
        a, b = np.nonzero(on)
        a += lo
        for p, q in zip(boxa, boxb, strict=True):
            near = np.abs(p[a] - q[b]) <= bound
            a, b = a[near], b[near]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        k = 0
        while k < len(a):
            size = max(1, WEIGHED // int(max(nb[b[min(k + WEIGHED, len(b)) - 1]], na[a[k : k + WEIGHED]].max())))
            i, j = a[k : k + size], b[k : k + size]
            k += size
            i, j, d = _frechets(xa, ya, pa_, na, i, xb, yb, pb, nb, j, most)
            out.append((ia[i], ib[j], np.sqrt(d)))
    one, two, d = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
    near = d <= bound
    return one[near], two[near], d[near]


def _frechets(xa, ya, sa, na, i, xb, yb, sb, nb, j, most):  # noqa: ANN001
    """The squared discrete Frechet distances of pairs (i, j) of tracks, less those of which a row has no point within ``most``."""
    at = sa[i] + np.minimum(np.arange(na[i].max())[:, None], na[i] - 1)
    to = sb[j] + np.minimum(np.arange(nb[j].max())[:, None], nb[j] - 1)
    ax, ay, bx, by = xa[at], ya[at], xb[to], yb[to]
    row = None
    for k in range(len(ax)):
        new = (bx - ax[k]) ** 2
        new += (by - ay[k]) ** 2
        if row is None:
            np.maximum.accumulate(new, axis=0, out=new)
        else:
            np.minimum(row[1:], row[:-1].copy(), out=row[1:])
            np.maximum(new[0], row[0], out=new[0])
            for m in range(1, len(new)):
                np.minimum(row[m], new[m - 1], out=row[m])
                np.maximum(new[m], row[m], out=new[m])
        row = new
        live = (row <= most).any(axis=0)
        if np.count_nonzero(live) < 0.8 * len(live):
            i, j = i[live], j[live]
            row, ax, ay, bx, by = (v.compress(live, axis=1) for v in (row, ax, ay, bx, by))
    return i, j, row[-1]


def similar_tracks(tracks: DataFrame, bound: float, scale: float = 10.0) -> DataFrame:
    """(track_a, track_b, distance, similarity) of all pairs of tracks whose discrete Frechet distance is within the bound. Points without
    a coordinate are left out, and a track without points has no pair.

    Tracks are dealt to the cells of both their ends, and those of a cell over parts of a bounded number of points. A group is two parts
    of neighbouring cells, each pair of which comes once; it weighs its pairs as arrays and writes only those within the bound."""
    if bound <= 0:
        raise ValueError("bound must be positive")
    known = tracks.where("track_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    points = known.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    cells = [f"c{e}{c}" for e in "fl" for c in "xy"]
    at = [F.floor(F.element_at(f"p.{c}", k) / bound).cast("long").alias(f"c{e}{c}") for e, k in (("f", 1), ("l", -1)) for c in "xy"]
    points = voxels._checkpoint(points.select("track_id", *at, *[F.col(f"p.{c}").cast("array<double>").alias(f"{c}s") for c in "xy"]))
    parts = F.greatest(F.ceil(F.sum(F.size("xs")) / POINTS), F.ceil(F.count("*") / TRACKS)).cast("int")
    sizes = voxels._checkpoint(points.groupBy(*cells).agg(parts.alias("parts")))
    placed = points.join(voxels.sorted_side(sizes), cells).withColumn("part", F.pmod(F.hash("track_id"), "parts")).drop("parts")
    # the cell itself and half of those round it: the others have it among theirs
    steps = [[k // 3**i % 3 - 1 for i in range(4)] for k in range(40, 81)]
    near = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip(cells, step, strict=True)]) for step in steps]))
    other = sizes.withColumn("_d", near).select(*[(F.col(c) + F.col(f"_d.{c}")).alias(c) for c in cells], *[F.col(c).alias(f"{c}_a") for c in cells], F.col("parts").alias("parts_a"))
    groups = other.join(voxels.sorted_side(sizes), cells).withColumn("own", F.forall(F.array(*[F.col(c) == F.col(f"{c}_a") for c in cells]), lambda x: x))
    groups = groups.withColumn("part_a", F.explode(F.expr("sequence(0, parts_a - 1)"))).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    groups = groups.where("NOT own OR part_a <= part").withColumn("own", F.expr("own AND part_a = part"))
    groups = voxels._checkpoint(groups.select(*cells, "part", *[f"{c}_a" for c in cells], "part_a", "own", F.monotonically_increasing_id().alias("_group")))
    one = groups.select(*[F.col(f"{c}_a").alias(c) for c in (*cells, "part")], "own", "_group")
    names = ("_group", "own", "track_id", "xs", "ys")
    one, two = (placed.join(voxels.sorted_side(g), [*cells, "part"]).select(*[F.col(c).alias(c) for c in names]) for g in (one, groups.select(*cells, "part", "own", "_group")))
    kind = dict(points.dtypes)["track_id"]

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, d = _pairs_within(left, right, bound, left.column("own")[0].as_py()) if left.num_rows and right.num_rows else (*np.zeros((2, 0), np.int64), np.zeros(0))
        return pa.table({"one": left.column("track_id").take(pa.array(a)), "two": right.column("track_id").take(pa.array(b)), "distance": pa.array(d)})

    # a group has few bytes and much work, so that Spark's own choice of partitions, by bytes, would be too few
    one, two = (t.repartition(max(1, min(groups.count(), 1000)), "_group") for t in (one, two))
    pairs = one.groupBy("_group").cogroup(two.groupBy("_group")).applyInArrow(within, f"one {kind}, two {kind}, distance double")
    return pairs.select(F.least("one", "two").alias("track_a"), F.greatest("one", "two").alias("track_b"), "distance", (1 / (1 + F.col("distance") / scale)).alias("similarity"))


def _frechet(a: np.ndarray, b: np.ndarray, most: float = float("inf")) -> float:
    row = None
    for p in a:
        d = np.sqrt(((b - p) ** 2).sum(axis=1))
        if row is None:
            row = np.maximum.accumulate(d)
            continue
        if row.min() > most:
            return float("inf")
        reach = np.minimum(row, np.concatenate([[np.inf], row[:-1]]))
        new = np.empty(len(b))
        last = np.inf
        for j, (x, y) in enumerate(zip(reach.tolist(), d.tolist(), strict=True)):
            last = new[j] = max(y, min(x, last))
        row = new
    return float(row[-1])


def mission_summary(shots: DataFrame, audit: DataFrame, tag: str = "occlusion_closeup") -> DataFrame:
    """(mission_id, n_waypoints, n_shots, n_closeups and the audit's columns) of clips (mission_id, shot_type, interest_tags)."""
    counts = shots.groupBy("mission_id").agg(
        F.count("*").alias("n_waypoints"), F.countDistinct("shot_type").alias("n_shots"), F.count_if(F.array_contains("interest_tags", tag)).alias("n_closeups")
    )
    return counts.join(audit, "mission_id", "left")
