"""The five entity tables and the constants of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

R_EARTH_M = 6_371_000.0
M_PER_DEG_LAT = 111_320.0
DEFAULT_SIZE_RAD = 0.5236
MAP_PRIOR_SIGMA_M = 30.0
ID_PATTERN = "^[A-Z2-7]{13}$"
LIST_CAP = 1000


def _fields(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "t": T.TimestampNTZType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


STAMPS = "created_at:t updated_at:t"
ENTITIES = {
    "stations": _fields(f"id:s lat:d lng:d name:s {STAMPS}"),
    "photos": _fields(f"id:s station_id:s blob_path:s mime_type:s size_bytes:l aspect:d photo_az:d photo_tilt:d photo_roll:d size_rad:d opacity:d {STAMPS}"),
    "map_measurements": _fields(f"id:s lat:d lng:d control_point_id:s {STAMPS}"),
    "image_measurements": _fields(f"id:s photo_id:s u:d v:d control_point_id:s {STAMPS}"),
    "control_points": _fields(f"id:s description:s notes:s est_lat:d est_lng:d est_alt:d started_at:t ended_at:t {STAMPS}"),
}

#: What a change to an entity may hold: its columns and their types, and those of them that count as 0 when absent.
REQUESTS = {
    "station": ("lat double, lng double, name string", ["lat", "lng"]),
    "photo": ("aspect double, photo_az double, photo_tilt double, photo_roll double, size_rad double, opacity double", ["aspect", "photo_az", "photo_tilt", "photo_roll", "size_rad"]),
    "map_measurement": ("lat double, lng double, control_point_id string", ["lat", "lng"]),
    "image_measurement": ("u double, v double, control_point_id string", ["u", "v"]),
    "control_point": ("description string, notes string, est_lat double, est_lng double, est_alt double, started_at timestamp_ntz, ended_at timestamp_ntz", []),
}
