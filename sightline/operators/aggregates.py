"""Counts, means and what can be solved from them. Sums combine in the map tasks; a popular control point costs a row a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.reads import cp_image_observations


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.filter("control_point_id is not null").groupBy("control_point_id").agg(F.count(F.lit(1)).alias(name))


def cp_observation_counts(cp: DataFrame, im: DataFrame, mm: DataFrame) -> DataFrame:
    out = cp.select(F.col("id").alias("control_point_id")).join(_counts(im, "n_image"), "control_point_id", "left").join(_counts(mm, "n_map"), "control_point_id", "left")
    return out.na.fill(0, ["n_image", "n_map"])


def cp_mean_map_position(mm: DataFrame) -> DataFrame:
    return mm.filter("control_point_id is not null").groupBy("control_point_id").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count(F.lit(1)).alias("n"))


def cp_initial_guess(cp: DataFrame, im: DataFrame, ph: DataFrame, st: DataFrame, mm: DataFrame) -> DataFrame:
    """control_point_id, lat, lng, source: the mean map position, else the stored estimate, else the mean of the stations, taken as pairs; points with none are absent."""
    maps = cp_mean_map_position(mm).select("control_point_id", F.struct("lat", "lng", F.lit("map").alias("source")).alias("a"))
    own = F.when(F.col("est_lat").isNotNull() & F.col("est_lng").isNotNull(), F.struct(F.col("est_lat").alias("lat"), F.col("est_lng").alias("lng"), F.lit("estimate").alias("source")))
    stations = cp_image_observations(im, ph, st).groupBy("control_point_id").agg(F.avg("station_lat").alias("lat"), F.avg("station_lng").alias("lng"))
    stations = stations.select("control_point_id", F.struct("lat", "lng", F.lit("stations").alias("source")).alias("c"))
    rows = cp.select(F.col("id").alias("control_point_id"), own.alias("b")).join(maps, "control_point_id", "left").join(stations, "control_point_id", "left")
    return rows.select("control_point_id", F.coalesce("a", "b", "c").alias("g")).filter("g is not null").select("control_point_id", "g.lat", "g.lng", "g.source")


def cp_solvable(cp: DataFrame, im: DataFrame, mm: DataFrame) -> DataFrame:
    """An image measurement gives one equation, a map measurement two; two are needed."""
    return cp_observation_counts(cp, im, mm).select("control_point_id", (F.col("n_image") + 2 * F.col("n_map") >= 2).alias("solvable"))


def photo_free_params(anchored: DataFrame, solve_roll: bool = False) -> DataFrame:
    """photo_id, n, free: what the pose solver may move, by the count of anchored measurements."""
    counts = anchored.groupBy("station_id", "photo_id").agg(F.count(F.lit(1)).alias("n"))
    names = lambda *xs: F.array(*map(F.lit, xs))
    free = F.when(F.col("n") == 1, names("photo_az"))
    if solve_roll:
        free = free.when(F.col("n") >= 3, names("photo_az", "size_rad", "photo_roll"))
    return counts.select("station_id", "photo_id", "n", free.otherwise(names("photo_az", "size_rad")).alias("free"))


def camera_solvable(anchored: DataFrame, priors: DataFrame, solve_roll: bool = False) -> DataFrame:
    """station_id, n_obs, n_unknowns, solvable: whether a station's own place may be solved; two equations have to be left over."""
    free = photo_free_params(anchored, solve_roll).groupBy("station_id").agg(F.sum("n").alias("images"), F.sum(F.size("free")).alias("locals"))
    both = free.join(priors.groupBy("station_id").agg(F.count(F.lit(1)).alias("priors")), "station_id", "left").na.fill(0, ["priors"])
    n_obs, n_unknowns = F.col("images") + 2 * F.col("priors"), 2 + F.col("locals") + 2 * F.col("priors")
    return both.select("station_id", n_obs.alias("n_obs"), n_unknowns.alias("n_unknowns"), (n_obs >= n_unknowns + 2).alias("solvable"))


def residual_rms(residuals: DataFrame, key: str) -> DataFrame:
    return residuals.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"))
