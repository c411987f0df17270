"""Survey inputs derived from the star-schema tables by integer arithmetic, one function a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS site_id", "CAST(-60 + 5 * n_nationkey AS DOUBLE) AS home_lat", "CAST(-170 + 13 * n_nationkey AS DOUBLE) AS home_lon",
        "CAST(10 * n_regionkey AS DOUBLE) AS home_alt", "CAST(20 + n_nationkey AS DOUBLE) AS height",
    )


def aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles about the home; odd sites lose a quadrant and are concave."""
    half = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS site_id", "CAST(40 + n_nationkey AS DOUBLE) AS a", "CAST(30 + n_nationkey AS DOUBLE) AS b")
    point = "named_struct('x', {}, 'y', {})"
    ring = lambda *xy: "array(" + ", ".join(point.format(*p) for p in xy) + ")"
    box = ring(("-a", "-b"), ("a", "-b"), ("a", "b"), ("-a", "b"))
    ell = ring(("-a", "-b"), ("a", "-b"), ("a", "0D"), ("0D", "0D"), ("0D", "b"), ("-a", "b"))
    return half.selectExpr("site_id", f"IF(site_id % 2 = 0, {box}, {ell}) AS polygon", "CAST(100 AS DOUBLE) AS max_altitude")


def cameras(spark: SparkSession) -> DataFrame:
    return spark.range(1).selectExpr("0 AS camera_id", "84D AS hfov", "53D AS vfov", "640 AS width", "480 AS height")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nadir poses with north up: the quaternion (0, 1, 0, 0)."""
    images = _read(spark, sf_dir, "events").selectExpr("event_id div 50 AS image_id").distinct()
    return images.selectExpr(
        "CAST(image_id % 25 AS INT) AS site_id", "image_id", "CAST(image_id % 41 - 20 AS DOUBLE) AS e", "CAST(image_id % 37 - 18 AS DOUBLE) AS n", "CAST(80 + image_id % 40 AS DOUBLE) AS u",
        "0D AS qw", "1D AS qx", "0D AS qy", "0D AS qz", "0 AS camera_id",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id div 50 AS image_id", "event_id AS det_id", "CAST(user_id % 500 AS DOUBLE) AS x0", "CAST(event_id % 400 AS DOUBLE) AS y0",
        "CAST(user_id % 500 + 20 + event_id % 60 AS DOUBLE) AS x1", "CAST(event_id % 400 + 10 + user_id % 50 AS DOUBLE) AS y1", "value / 500 AS score", "event_type AS label",
    )


def depth_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 200 AS image_id", "l_partkey % 640 AS u", "(l_suppkey * 5) % 480 AS v", "40 + l_quantity AS depth")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each occupied cell, with its smallest label."""
    cells = _read(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey % 25 AS INT) AS site_id", "CAST(l_partkey % 48 AS INT) AS i", "CAST(l_orderkey % 48 AS INT) AS j", "CAST(CAST(l_quantity AS INT) % 20 AS INT) AS k", "2 + l_linenumber % 4 AS label"
    )
    return cells.groupBy("site_id", "i", "j", "k").agg(F.min("label").alias("label"))


def obstacle_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that a survey found: those of the lines that were not returned, so that it misses some of ``voxels``."""
    kept = _read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    cells = kept.selectExpr("CAST(l_suppkey % 25 AS INT) AS site_id", "CAST(l_partkey % 48 AS INT) AS i", "CAST(l_orderkey % 48 AS INT) AS j", "CAST(CAST(l_quantity AS INT) % 20 AS INT) AS k")
    return cells.where("k <> 0").distinct()


def viewpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey % 25 AS INT) AS site_id", "o_orderkey AS vp_id", "CAST(o_orderkey % 121 - 60 AS DOUBLE) AS e", "CAST(o_custkey * 7 % 121 - 60 AS DOUBLE) AS n",
        "CAST(5 + o_orderkey % 40 AS DOUBLE) AS u", "o_totalprice AS value",
    )


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("mission_id").orderBy("o_orderdate", "o_orderkey")
    rows = _read(spark, sf_dir, "orders").withColumn("mission_id", F.col("o_custkey"))
    return rows.withColumn("seq", F.row_number().over(by) - 1).selectExpr(
        "mission_id", "CAST(mission_id % 25 AS INT) AS site_id", "seq", "CAST(o_orderkey % 121 - 60 AS DOUBLE) AS e", "CAST(o_custkey * 7 % 121 - 60 AS DOUBLE) AS n",
        "CAST(5 + o_orderkey % 40 AS DOUBLE) AS u", "CAST(1 + o_orderkey % 9 AS DOUBLE) AS speed",
    )


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hotspots a supplier, each facing along an axis."""
    rows = _read(spark, sf_dir, "supplier").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("h", F.expr("s_suppkey * 4 + s"))
    return rows.selectExpr(
        "CAST(s_suppkey % 25 AS INT) AS site_id", "h AS hs_id", "CAST(h % 31 - 15 AS DOUBLE) AS e", "CAST(h % 29 - 14 AS DOUBLE) AS n", "CAST(h % 20 AS DOUBLE) AS u",
        "CASE h % 6 WHEN 0 THEN 1D WHEN 1 THEN -1D ELSE 0D END AS nx", "CASE h % 6 WHEN 2 THEN 1D WHEN 3 THEN -1D ELSE 0D END AS ny", "CASE h % 6 WHEN 4 THEN 1D WHEN 5 THEN -1D ELSE 0D END AS nz",
        "1D + FLOOR(ABS(s_acctbal) / 1000) AS interest",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("track_id").orderBy("ts", "event_id")
    rows = _read(spark, sf_dir, "events").withColumn("track_id", F.col("user_id")).withColumn("seq", F.row_number().over(by) - 1)
    return rows.selectExpr("track_id", "seq", "FLOOR(value) AS x", "CAST(event_id % 97 AS DOUBLE) AS y").withColumn("x", F.col("x").cast("double"))


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that each of 40 poses of a site sees: of the lines numbered below 4, so that some cells are seen by none."""
    rows = _read(spark, sf_dir, "lineitem").where("l_linenumber < 4")
    return rows.selectExpr("CAST(l_suppkey % 25 AS INT) AS site_id", "CAST(l_partkey % 48 AS INT) AS i", "CAST(l_orderkey % 48 AS INT) AS j", "CAST(CAST(l_quantity AS INT) % 20 AS INT) AS k", "l_orderkey % 40 AS pose_id").distinct()


def view_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr("CAST(l_suppkey % 25 AS INT) AS site_id", "l_orderkey % 40 AS pose_id", "l_orderkey % 40 AS seq").distinct()


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment an order, from a viewpoint to a place in the grid, clear of cell corners."""
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ray_id", "CAST(o_custkey % 25 AS INT) AS site_id", "o_orderkey % 121 - 60 + 0.37D AS e", "o_custkey * 7 % 121 - 60 + 0.21D AS n", "5 + o_orderkey % 40 + 0.13D AS u",
        "o_custkey * 13 % 89 - 44 + 0.53D AS te", "o_orderkey * 11 % 83 - 41 + 0.59D AS tn", "o_orderkey % 37 + 0.77D AS tu",
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plot a part, on one plane: a box, or where its key is divisible by 3 the same without its upper right quarter."""
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey AS plot_id", "CAST(p_partkey * 37 % 1500 AS DOUBLE) AS x", "CAST(p_partkey * 91 % 1300 AS DOUBLE) AS y", "CAST(4 + p_size AS DOUBLE) AS a", "CAST(4 + p_partkey % 40 AS DOUBLE) AS b")
    ring = lambda *xy: "array(" + ", ".join(f"named_struct('x', {p}, 'y', {q})" for p, q in xy) + ")"
    box = ring(("x", "y"), ("x + a", "y"), ("x + a", "y + b"), ("x", "y + b"))
    ell = ring(("x", "y"), ("x + a", "y"), ("x + a", "y + b / 2"), ("x + a / 2", "y + b / 2"), ("x + a / 2", "y + b"), ("x", "y + b"))
    return rows.selectExpr("plot_id", f"IF(plot_id % 3 = 0, {ell}, {box}) AS polygon")


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point an order, on the plane of the plots and clear of their edges."""
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS pin_id", "o_orderkey * 17 % 1600 + 0.37D AS e", "o_custkey * 29 % 1400 + 0.21D AS n")
