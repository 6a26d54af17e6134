"""Referential actions and checks. Deletes take a frame of ids and return the tables that are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ids(ids: DataFrame, name: str = "id") -> DataFrame:
    return ids.select(F.col("id").alias(name)).distinct()


#: From so many ids on, a list is too long to be sent to all tasks.
MANY_IDS = 100_000


def _hashed(ids: DataFrame, many: bool) -> DataFrame:
    """A long list, dealt to tasks, is what they hash; the table streams by and is not sorted. A short one is left to Spark."""
    return ids.hint("shuffle_hash") if many else ids


def delete_photos(ph: DataFrame, im: DataFrame, ids: DataFrame, many: bool | None = None) -> dict[str, DataFrame]:
    """Photos, their image measurements, and the ids of files that go with them. Counts the ids, unless told whether they are many."""
    many = ids.count() > MANY_IDS if many is None else many
    listed = lambda name="id": _hashed(_ids(ids, name), many)
    gone = ph.join(listed(), "id", "left_semi").select("id")
    return {"photos": ph.join(listed(), "id", "left_anti"), "image_measurements": im.join(listed("photo_id"), "photo_id", "left_anti").select(*im.columns), "blob_ids": gone}


def delete_stations(st: DataFrame, ph: DataFrame, im: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """The photos of the stations go, and what goes with these; control points stay. Counts the ids."""
    many = ids.count() > MANY_IDS
    photos = ph.join(_hashed(_ids(ids, "station_id"), many), "station_id", "left_semi").select("id")
    return {"stations": st.join(_hashed(_ids(ids), many), "id", "left_anti"), **delete_photos(ph, im, photos, many)}


def _unlink(df: DataFrame, ids: DataFrame, many: bool) -> DataFrame:
    hit = _hashed(_ids(ids, "control_point_id").withColumn("_gone", F.lit(True)), many)
    joined = df.join(hit, "control_point_id", "left")
    return joined.withColumn("control_point_id", F.when(F.col("_gone").isNull(), F.col("control_point_id"))).select(*df.columns)


def delete_control_points(cp: DataFrame, im: DataFrame, mm: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Measurements stay, without their link. Counts the ids."""
    many = ids.count() > MANY_IDS
    return {"control_points": cp.join(_hashed(_ids(ids), many), "id", "left_anti"), "image_measurements": _unlink(im, ids, many), "map_measurements": _unlink(mm, ids, many)}


def delete_measurements(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(_hashed(_ids(ids), ids.count() > MANY_IDS), "id", "left_anti")


def fk_violations(st: DataFrame, ph: DataFrame, im: DataFrame, mm: DataFrame, cp: DataFrame) -> DataFrame:
    """rule, child_id, missing_id of rows whose parent is missing."""
    rules = [("photos.station_id", ph, "station_id", st), ("image_measurements.photo_id", im, "photo_id", ph), ("image_measurements.control_point_id", im, "control_point_id", cp), ("map_measurements.control_point_id", mm, "control_point_id", cp)]
    found = [
        child.filter(F.col(key).isNotNull()).select(F.lit(rule).alias("rule"), F.col("id").alias("child_id"), F.col(key).alias("missing_id")).join(parent.select(F.col("id").alias("missing_id")), "missing_id", "left_anti").select("rule", "child_id", "missing_id")
        for rule, child, key, parent in rules
    ]
    return reduce(DataFrame.unionByName, found)


def unobserved_control_points(cp: DataFrame, im: DataFrame, mm: DataFrame) -> DataFrame:
    out = cp.select("id")
    for df in (im, mm):
        out = out.join(df.select(F.col("control_point_id").alias("id")), "id", "left_anti")
    return out


def unlinked_measurements(im: DataFrame, mm: DataFrame) -> DataFrame:
    pick = lambda df, kind: df.filter("control_point_id is null").select(F.lit(kind).alias("kind"), "id")
    return pick(im, "image").unionByName(pick(mm, "map"))
