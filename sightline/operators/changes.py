"""Change sets: diffs of snapshots, patches, creation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.ids import id_of, pair_key
from sightline.operators.reads import pin_on_photo
from sightline.operators.validate import photo_create_defaults, validate_control_points, validate_image_measurements, validate_map_measurements, validate_photos, validate_stations
from sightline.schema import DEFAULT_SIZE_RAD, ENTITIES

VALIDATORS = {"station": validate_stations, "photo": validate_photos, "map_measurement": validate_map_measurements, "image_measurement": validate_image_measurements, "control_point": validate_control_points}

#: What a patch of each entity overwrites, null or not; of a control point, `kept` columns change only to a value.
OVERWRITTEN = {
    "station": ["lat", "lng", "name"],
    "photo": ["aspect", "photo_az", "photo_tilt", "photo_roll", "size_rad", "opacity"],
    "map_measurement": ["lat", "lng", "control_point_id"],
    "image_measurement": ["u", "v", "control_point_id"],
    "control_point": ["est_lat", "est_lng", "est_alt", "started_at", "ended_at"],
}
KEPT = {"control_point": ["description", "notes"]}


def snapshot_diff(current: DataFrame, cached: DataFrame, cols: list[str], key: str = "id", emit_creates: bool = True, minute_cols: tuple[str, ...] = ()) -> DataFrame:
    """key, op (create, update, delete) and the current columns (null for deletes). Columns in minute_cols are compared to the minute."""
    pick = lambda df, side: df.select(key, F.struct(*cols).alias(side))
    seen = lambda side, c: F.date_trunc("minute", F.col(f"{side}.{c}")) if c in minute_cols else F.col(f"{side}.{c}")
    same = F.lit(True)
    for c in cols:
        same = same & seen("now", c).eqNullSafe(seen("was", c))
    op = F.when(F.col("was").isNull(), F.lit("create") if emit_creates else F.lit(None)).when(F.col("now").isNull(), "delete").when(~same, "update")
    return pick(current, "now").join(pick(cached, "was"), key, "full").withColumn("op", op).filter("op is not null").select(key, "op", *(F.col(f"now.{c}").alias(c) for c in cols))


def apply_patches(base: DataFrame, patches: DataFrame, entity: str) -> DataFrame:
    """`base` after the patches (seq, id, columns, and at: the time of the change, if given), in order of seq.

    The last patch of a row gives its overwritten columns; kept columns take the last value that is not null. Patches
    of unknown ids do nothing.
    """
    over, kept = OVERWRITTEN[entity], KEPT.get(entity, [])
    at = [c for c in ("at",) if c in patches.columns]
    last = patches.groupBy("id").agg(
        F.max_by(F.struct(*over, *at), "seq").alias("p"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in kept)
    )
    hit = F.col("p").isNotNull()
    value = {c: F.when(hit, F.col(f"p.{c}")).otherwise(F.col(c)) for c in over}
    if entity == "photo":
        value["opacity"] = F.when(hit, F.coalesce("p.opacity", F.lit(1.0))).otherwise(F.col("opacity"))
    value |= {c: F.coalesce(f"new_{c}", c) for c in kept}
    if at:
        value["updated_at"] = F.when(hit, F.coalesce("p.at", "updated_at")).otherwise(F.col("updated_at"))
    return base.join(last, "id", "left").select(*(value.get(c, F.col(c)).alias(c) for c in base.columns))


#: Of rows as they were created: older than any patch.
OLDEST = -(1 << 63)


def _version(seq) -> Column:
    """What orders the values of a part of a row: the patch's seq, and how often it was solved since."""
    return F.struct(F.coalesce(seq, F.lit(OLDEST)).cast("long").alias("seq"), F.lit(0).alias("step"))


def _whole(columns: list[str], entity: str) -> list[str]:
    """Columns that no patch changes; updated_at is that of the creation."""
    return [c for c in columns if c not in (*OVERWRITTEN[entity], *KEPT.get(entity, []), "id", "known", "at", "v_over", *(f"v_{k}" for k in KEPT.get(entity, [])))]


def first_versions(rows: DataFrame, entity: str) -> DataFrame:
    """Rows as they were created, as versions: known (this is the row itself, not a patch), at (the time of the last patch),
    v_over (the version of what a patch overwrites), v_<column> of each kept column."""
    return rows.select("*", F.lit(True).alias("known"), F.lit(None).cast("timestamp_ntz").alias("at"), *(_version(F.lit(None)).alias(v) for v in ("v_over", *(f"v_{c}" for c in KEPT.get(entity, [])))))


def patch_versions(patches: DataFrame, entity: str) -> DataFrame:
    """A row for each id that is patched, in the shape of first_versions but without the columns that no patch changes."""
    over, kept = OVERWRITTEN[entity], KEPT.get(entity, [])
    at = F.col("at") if "at" in patches.columns else F.lit(None)
    value = {c: F.coalesce(c, F.lit(1.0)) if (entity, c) == ("photo", "opacity") else F.col(c) for c in over}
    given = {c: F.when(F.col(c).isNotNull(), F.col("seq")) for c in kept}
    last = patches.groupBy("id").agg(
        F.max_by(F.struct(*(v.alias(c) for c, v in value.items()), at.cast("timestamp_ntz").alias("at")), "seq").alias("p"), F.max("seq").alias("seq"),
        *(F.max_by(c, given[c]).alias(c) for c in kept), *(F.max(given[c]).alias(f"seq_{c}") for c in kept),
    )
    return last.select("id", "p.*", F.lit(False).alias("known"), _version(F.col("seq")).alias("v_over"), *kept, *(F.when(F.col(f"seq_{c}").isNotNull(), _version(F.col(f"seq_{c}"))).alias(f"v_{c}") for c in kept))


def merge_versions(rows: DataFrame, entity: str) -> DataFrame:
    """One row for each id: of each part the newest version. The same whatever the order of rows, and however often one is there."""
    over, kept = [*OVERWRITTEN[entity], "at"], KEPT.get(entity, [])
    whole = _whole(rows.columns, entity)
    merged = rows.groupBy("id").agg(
        F.max_by(F.struct(*whole), F.when(F.col("known"), 1)).alias("w"), F.max("known").alias("known"), F.max_by(F.struct(*over), "v_over").alias("o"), F.max("v_over").alias("v_over"),
        *(F.max_by(c, f"v_{c}").alias(c) for c in kept), *(F.max(f"v_{c}").alias(f"v_{c}") for c in kept),
    )
    part = {c: F.col(f"w.{c}") for c in whole} | {c: F.col(f"o.{c}") for c in over}
    return merged.select(*(part.get(c, F.col(c)).alias(c) for c in rows.columns))


def current_rows(versions: DataFrame, entity: str) -> DataFrame:
    """The entity's columns of merged versions; patches of ids that were never created are no rows."""
    columns = [f.name for f in ENTITIES[f"{entity}s"] if f.name in versions.columns]
    return versions.filter("known").select(*(F.coalesce("at", c).alias(c) if c == "updated_at" else F.col(c) for c in columns))


def solved_versions(versions: DataFrame, solved: DataFrame) -> DataFrame:
    """Versions of control points (merged) that have a solution (control_point_id, lat, lng), with it as their estimate, a step newer."""
    new = solved.select(F.col("control_point_id").alias("id"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    newer = F.struct("v_over.seq", (F.col("v_over.step") + 1).alias("step"))
    value = {"est_lat": F.col("_lat"), "est_lng": F.col("_lng"), "v_over": newer}
    return versions.join(new, "id").select(*(value.get(c, F.col(c)).alias(c) for c in versions.columns))


def rejected_patches(base: DataFrame, patches: DataFrame) -> DataFrame:
    return patches.join(base.select("id"), "id", "left_anti").select("seq", "id", F.lit("not found").alias("reason"))


def create_entities(requests: DataFrame, entity: str, parents: DataFrame | None = None, parent_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of create requests, which have key (for the id), at (the time), and the entity's columns."""
    rows = photo_create_defaults(requests) if entity == "photo" else requests
    if entity == "control_point":
        rows = rows.withColumn("description", F.coalesce("description", F.lit(""))).withColumn("notes", F.coalesce("notes", F.lit("")))
    checked = VALIDATORS[entity](rows)
    if parents is not None:
        known = parents.select(F.col("id").alias(parent_col)).distinct().withColumn("_known", F.lit(True))
        checked = checked.join(known, parent_col, "left").withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("_known").isNull(), F.lit(f"unknown {parent_col}"))))
    columns = [c for c in rows.columns if c not in ("key", "at")]
    made = checked.filter("reject_reason is null").select(id_of(F.col("key")).alias("id"), *columns, F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return made, checked.filter("reject_reason is not null").select("key", "reject_reason")


def cp_patch_complete(patches: DataFrame, cp: DataFrame) -> DataFrame:
    """Patches whose missing estimates and dates are filled from the control point, so that overwriting keeps them."""
    held = ["est_lat", "est_lng", "est_alt", "started_at", "ended_at"]
    now = cp.select("id", *(F.col(c).alias(f"now_{c}") for c in held))
    return patches.join(now, "id").select(*(F.coalesce(c, f"now_{c}").alias(c) if c in held else F.col(c) for c in patches.columns))


def upsert_pins(matches: DataFrame, im: DataFrame) -> DataFrame:
    """matches (seq, photo_id, control_point_id, u, v) → photo_id, control_point_id, op (move or insert), id (of the pin that moves), u, v. The last match of a photo and point wins."""
    last = matches.groupBy("photo_id", "control_point_id").agg(F.max_by(F.struct("u", "v"), "seq").alias("at"))
    return last.join(pin_on_photo(im), ["photo_id", "control_point_id"], "left").select(
        "photo_id", "control_point_id", F.when(F.col("id").isNull(), "insert").otherwise("move").alias("op"), "id", "at.u", "at.v"
    )


def create_cp_with_observation(requests: DataFrame) -> dict[str, DataFrame]:
    """requests (key, kind, description, photo_id, u, v, lat, lng, at) → new control points, each with its measurement, or neither.

    A point that comes from a photo has no estimate; one from the map starts where it was clicked.
    """
    lat_ok, unit_ok = F.col("lat").between(-90.0, 90.0) & F.col("lng").between(-180.0, 180.0), F.col("u").between(0.0, 1.0) & F.col("v").between(0.0, 1.0)
    good = F.when(F.col("kind") == "map", lat_ok).when(F.col("kind") == "image", unit_ok & F.col("photo_id").isNotNull())
    rows = requests.filter(F.coalesce(good, F.lit(False))).withColumn("cp", id_of(F.col("key") * 2)).withColumn("m", id_of(F.col("key") * 2 + 1))
    mapped = F.col("kind") == "map"
    stamps = [F.col("at").alias("created_at"), F.col("at").alias("updated_at")]
    none = lambda kind: F.lit(None).cast(kind)
    points = rows.select(
        F.col("cp").alias("id"), F.coalesce("description", F.lit("")).alias("description"), F.lit("").alias("notes"), F.when(mapped, F.col("lat")).alias("est_lat"), F.when(mapped, F.col("lng")).alias("est_lng"),
        none("double").alias("est_alt"), none("timestamp_ntz").alias("started_at"), none("timestamp_ntz").alias("ended_at"), *stamps,
    )
    link = F.col("cp").alias("control_point_id")
    images = rows.filter(~mapped).select(F.col("m").alias("id"), "photo_id", "u", "v", link, *stamps)
    maps = rows.filter(mapped).select(F.col("m").alias("id"), "lat", "lng", link, *stamps)
    return {"control_points": points, "image_measurements": images, "map_measurements": maps}


def start_stations(requests: DataFrame) -> dict[str, DataFrame]:
    """requests (key, lat, lng, name, aspects array<double>, at) → stations, and their photos spread evenly around them.

    A photo that could not be decoded (null aspect) is left out, but the others keep the places they would have had. The id of
    a photo holds its request's key in the upper bits and its number in the lower, so no two photos share one; a key or a
    number that has more bits than these is an error.
    """
    stamps = [F.col("at").alias("created_at"), F.col("at").alias("updated_at")]
    stations = requests.select(id_of(F.col("key")).alias("id"), "lat", "lng", F.nullif("name", F.lit("")).alias("name"), *stamps)
    each = requests.select("key", "at", F.size("aspects").alias("n"), F.posexplode("aspects").alias("i", "aspect")).filter("aspect is not null")
    photos = each.select(
        id_of(pair_key(F.col("key"), F.col("i"))).alias("id"), id_of(F.col("key")).alias("station_id"), "aspect", (F.col("i") / F.col("n") * F.lit(2 * math.pi)).alias("photo_az"),
        F.lit(0.0).alias("photo_tilt"), F.lit(0.0).alias("photo_roll"), F.lit(DEFAULT_SIZE_RAD).alias("size_rad"), F.lit(1.0).alias("opacity"), *stamps,
    )
    return {"stations": stations, "photos": photos}


def resolve_cp_proposals(proposals: DataFrame, cp: DataFrame) -> DataFrame:
    """Control points after the stations' proposals (station_id, control_point_id, lat, lng, solved_at): the last solve wins, ties by station."""
    last = proposals.groupBy(F.col("control_point_id").alias("id")).agg(F.max_by(F.struct("lat", "lng"), F.struct("solved_at", "station_id")).alias("p"))
    value = {"est_lat": F.coalesce("p.lat", "est_lat"), "est_lng": F.coalesce("p.lng", "est_lng")}
    return cp.join(last, "id", "left").select(*(value.get(c, F.col(c)).alias(c) for c in cp.columns))
