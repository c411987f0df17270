"""The stages end to end, all sites at once (G4, G8, G10). Every step is a join, a grouping or a window over tables keyed by
site; the few tables that several steps read are checkpointed in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import camera, coverage, generators, interest, legs, measures, missions, rays, routes, voxels
from .voxels import CELL


def _poses(views: DataFrame) -> DataFrame:
    """Aimed views as poses with an image_id, an orientation and the one camera; pose_id numbers the candidates of a site
    from 0 up, its close-ups from -1 down."""
    rows = camera.pose_quaternion(camera.look_at(views)).withColumn("image_id", F.concat_ws(":", "site_id", "source", "ord"))
    rows = rows.withColumn("pose_id", F.when(F.col("source") == "closeup", -1 - F.col("ord")).otherwise(F.col("ord")))
    return rows.select("site_id", "image_id", "pose_id", "source", "ord", "e", "n", "u", "te", "tn", "tu", "qw", "qx", "qy", "qz", F.lit(0).alias("camera_id"))


def _closeup_views(closeups: DataFrame) -> DataFrame:
    """The resolved close-ups as views aimed at their cells, in cell order."""
    order = F.row_number().over(Window.partitionBy("site_id").orderBy("i", "j", "k")) - 1
    at = voxels.voxel_center(closeups.where("resolved"), **rays.GRID).withColumnsRenamed({c: f"t{c}" for c in "enu"}).withColumnsRenamed({f"c{c}": c for c in "enu"})
    return at.select("site_id", F.lit("closeup").alias("source"), order.alias("ord"), "e", "n", "u", "te", "tn", "tu")


def _seen(poses: DataFrame, surface: DataFrame, occupied: DataFrame, cameras: DataFrame) -> DataFrame:
    rows = rays.visible_surface(poses, surface, occupied, cameras)
    rows = rows.join(poses.select("image_id", "pose_id"), "image_id")
    return voxels._checkpoint(rows.select(*CELL, "pose_id"))


def map_sites(sites: DataFrame, solid: DataFrame, cameras: DataFrame, views: int = 24, target: float = 0.9, standoff: float = 8.0, closeups: int = 40) -> dict[str, DataFrame]:
    """Stage 3. Sites hold radius and height, ``solid`` the labelled voxels, ``cameras`` one camera.

    Candidates are an orbit of ``views`` and the completion poses; a greedy plan picks among them; the first ``closeups``
    cells that no pick sees get a close-up in sight of them, where there is one; the coverage is of picks and close-ups
    together. Returns surface, candidates, visibility (of the candidates), plan, closeups, poses (picks and close-ups),
    coverage. A site without a surface has coverage 0.
    """
    surface = voxels._checkpoint(voxels.shell_voxels(solid))
    ring = missions.orbit_poses(sites, views).withColumnRenamed("view", "step")
    candidates = voxels._checkpoint(_poses(generators.candidate_views(("orbit", ring), ("completion", generators.completion_poses(sites)))))
    seen = _seen(candidates, surface, solid, cameras)
    plan = coverage.nbv_plan(candidates.select("site_id", "pose_id", F.col("ord").alias("seq")), surface, seen, target)
    plan = voxels._checkpoint(plan)
    chosen = seen.join(plan.select("site_id", "pose_id"), ["site_id", "pose_id"], "left_semi")
    missing = coverage.frontier_limit(coverage.frontier(surface, chosen), closeups)
    close = voxels._checkpoint(rays.generate_closeups(missing, solid, standoff))
    close_poses = _poses(_closeup_views(close))
    picked = candidates.join(plan.select("site_id", "pose_id"), ["site_id", "pose_id"], "left_semi").select(*close_poses.columns)
    poses = voxels._checkpoint(picked.unionByName(close_poses))
    extra = _seen(poses.where("source = 'closeup'"), surface, solid, cameras)
    reached = coverage.coverage(surface, chosen.select(*CELL, "pose_id").unionByName(extra.select(*CELL, "pose_id")))
    covered = sites.select("site_id").join(reached.select("site_id", "coverage"), "site_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return {"surface": surface, "candidates": candidates, "visibility": seen, "plan": plan, "closeups": close, "poses": poses, "coverage": covered}


def build_missions(field: DataFrame, aoi: DataFrame, obstacles: DataFrame, k: int = 10, cruise: float = 5.0, distinct: int = 3) -> dict[str, DataFrame]:
    """Stage 5: the admissible peaks of a value field (G8) in visit order, as one mission a site.

    Returns waypoints (mission_id, site_id, seq, e, n, u, speed, value, orientation, shot_type), keyframes, clips,
    trajectories (time-scaled summaries) and quarantine, the sites of the field without an admissible viewpoint.
    """
    picked = voxels._checkpoint(interest.select_viewpoints(field, aoi, obstacles, k))
    stops = picked.withColumn("mission_id", F.col("site_id")).withColumn("seq", F.col("rank") - 1).withColumn("speed", F.lit(cruise))
    order = routes.route_missions(stops.select("mission_id", "site_id", "seq", "e", "n", "u", "speed"), stretch=None).select("mission_id", "seq", "visit")
    routed = stops.join(order, ["mission_id", "seq"]).drop("seq", "rank").withColumnRenamed("visit", "seq")
    waypoints = voxels._checkpoint(missions.assign_shot_types(routed, distinct))
    posed = rays.aim_points(waypoints)
    return {
        "waypoints": waypoints,
        "keyframes": rays.gimbal_keyframes(posed),
        "clips": rays.clip_rows(waypoints, F.col("value")),
        "trajectories": routes.scaled_durations(waypoints.select("mission_id", "site_id", "seq", "e", "n", "u", "speed")),
        "quarantine": field.select("site_id").distinct().join(picked.select("site_id").distinct(), "site_id", "left_anti").withColumn("reason", F.lit("no admissible viewpoint")),
    }


def run_pipeline(sites: DataFrame, solid: DataFrame, cameras: DataFrame, views: int = 24, target: float = 0.9, standoff: float = 8.0, closeups: int = 12, k: int = 10, cruise: float = 4.0, margin: float = 4.0, vfov: float = 53.0) -> dict[str, DataFrame]:
    """Stages 1 to 5 and the audit of the flights, for sites (site_id, home_lat, home_lon, home_alt, height) and their voxels.

    The geofence is a square round the site, the obstacles are the voxels above the ground. Interest doubles on faces that
    the orbit does not see; the focal distance is best at the site's own orbit radius, with half of it, 4 m at least, as
    width. Clips whose camera is a close-up carry the tag. Returns the tables of ``map_sites`` and ``build_missions`` with
    aoi, framed (whether the building fits the image from the orbit), field, audit and summary.
    """
    framed = voxels._checkpoint(camera.orbit_radius(sites, vfov, margin))
    aoi = generators.scene_aoi(framed)
    out = map_sites(framed, solid, cameras, views, target, standoff, 40)
    orbit_seen = out["visibility"].join(out["candidates"].where("source = 'orbit'").select("site_id", "pose_id"), ["site_id", "pose_id"], "left_semi")
    unseen = coverage.frontier_limit(coverage.frontier(out["surface"], orbit_seen), closeups)
    close = voxels._checkpoint(_poses(_closeup_views(rays.generate_closeups(unseen, solid, standoff))))
    spots = voxels.voxel_center(coverage.build_hotspots(out["surface"], orbit_seen), **rays.GRID).join(framed.select("site_id", "height"), "site_id")
    spots = coverage.outward_normal(spots.withColumns({c: F.lit(0.0) for c in ("ce", "cn", "cu")})).withColumn("hs_id", F.concat_ws(":", *CELL))
    viewpoints = camera.pose_rotation(out["candidates"].unionByName(close)).withColumnRenamed("image_id", "vp_id")
    focus = framed.select("site_id", F.col("radius").alias("optimal"), F.greatest(F.lit(4.0), F.col("radius") / 2).alias("sigma"))
    field = voxels._checkpoint(interest.build_value_field(viewpoints.join(focus, "site_id"), spots, cameras))
    obstacles = voxels.drop_ground(solid).select(*CELL)
    plan = build_missions(field, aoi, obstacles, k, cruise)
    tagged = missions.tag_closeups(plan["clips"].join(plan["waypoints"].select("mission_id", "site_id", "seq", "e", "n", "u", "shot_type"), ["mission_id", "seq"]), close)
    audit = legs.audit_flights(plan["waypoints"], obstacles)
    return out | plan | {"clips": tagged, "aoi": aoi, "framed": camera.fits_in_frame(framed, cameras), "field": field, "audit": audit, "summary": measures.mission_summary(tagged, audit)}
