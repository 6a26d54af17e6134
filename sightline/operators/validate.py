"""Row rules. Each adds reject_reason, null where a row passes; the first rule that fails names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.schema import DEFAULT_SIZE_RAD, ID_PATTERN


def _first_failure(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    reason = F.lit(None).cast("string")
    for ok, text in reversed(rules):
        reason = F.when(F.coalesce(ok, F.lit(True)), reason).otherwise(F.lit(text))
    return df.withColumn("reject_reason", reason)


def _lat(c: str) -> Column:
    return F.col(c).between(-90.0, 90.0)


def _lng(c: str) -> Column:
    return F.col(c).between(-180.0, 180.0)


def _unit(c: str) -> Column:
    return F.col(c).between(0.0, 1.0)


def valid_id(c: str) -> Column:
    return F.col(c).rlike(ID_PATTERN)


def validate_stations(st: DataFrame) -> DataFrame:
    return _first_failure(st, [(_lat("lat") & _lng("lng"), "lat/lng out of range")])


def validate_photos(ph: DataFrame) -> DataFrame:
    return _first_failure(ph, [((F.col("aspect") > 0) & (F.col("aspect") <= 100), "aspect out of range"), (F.col("size_rad") >= 0, "size_rad out of range"), (_unit("opacity"), "opacity out of range")])


def validate_map_measurements(mm: DataFrame) -> DataFrame:
    return _first_failure(mm, [(_lat("lat"), "lat out of range"), (_lng("lng"), "lng out of range"), (valid_id("control_point_id"), "invalid control_point_id")])


def validate_image_measurements(im: DataFrame) -> DataFrame:
    return _first_failure(im, [(_unit("u") & _unit("v"), "u/v out of range"), (valid_id("control_point_id"), "invalid control_point_id")])


def validate_control_points(cp: DataFrame) -> DataFrame:
    """Estimates may be missing; the altitude may be anything."""
    return _first_failure(cp, [(_lat("est_lat"), "est_lat out of range"), (_lng("est_lng"), "est_lng out of range")])


def validate_ids(df: DataFrame, col: str = "id") -> DataFrame:
    return df.withColumn("valid", F.coalesce(valid_id(col), F.lit(False)))


def photo_create_defaults(requests: DataFrame) -> DataFrame:
    """On create only, a size of 0 stands for the default; a missing opacity is 1."""
    return requests.withColumn("opacity", F.coalesce("opacity", F.lit(1.0))).withColumn("size_rad", F.when(F.col("size_rad") == 0, F.lit(DEFAULT_SIZE_RAD)).otherwise(F.col("size_rad")))
