"""Reads: filters, lookups, joins along the links, nested results.

st, ph, mm, im, cp: stations, photos, map measurements, image measurements, control points. Joins leave the choice of
broadcast or shuffle to Spark, by size. Children are aggregated before they are joined, so rows never fan out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.geometry import lat_to_tile_y, lng_to_tile_x
from sightline.schema import LIST_CAP
from sightline.sources.shared import shared_path

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """minLng,minLat,maxLng,maxLat; corners in any order. No white space."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError("a box has four numbers: minLng,minLat,maxLng,maxLat")
    if not all(_NUMBER.fullmatch(p) for p in parts):
        raise ValueError("a value of the box is not a number")
    a, b, c, d = map(float, parts)
    return min(a, c), min(b, d), max(a, c), max(b, d)


def newest(df: DataFrame, n: int = LIST_CAP) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), "id").limit(n)


CELL_ZOOM = 12
CELL_ROWS = 64


def with_cell(df: DataFrame, lat: str = "lat", lng: str = "lng", zoom: int = CELL_ZOOM) -> DataFrame:
    """`df` with cell, a map cell's number, row by row from the north. A table that is sorted by it before it is written needs
    only the files and row groups of a box's cells to be read for that box."""
    last = F.lit(float((1 << zoom) - 1))
    whole = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(last, c))).cast("long")
    row = whole(lat_to_tile_y(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), F.col(lat))), F.lit(zoom)))
    return df.withColumn("cell", row * (1 << zoom) + whole(lng_to_tile_x(F.col(lng), F.lit(zoom))))


def in_cells(west: float, south: float, east: float, north: float, zoom: int = CELL_ZOOM) -> Column:
    """Whether `cell` may lie in a box: a range for each row of cells, or one range for all where there are many rows."""
    side = 1 << zoom
    spot = lambda x: max(0, min(side - 1, math.floor(x)))
    row = lambda lat: spot((0.5 - math.asinh(math.tan(math.radians(max(-85.0, min(85.0, lat))))) / (2 * math.pi)) * side)
    # A cell more on each side, for what rounding may move.
    first, last = max(0, row(north) - 1), min(side - 1, row(south) + 1)
    left, right = (max(0, min(side - 1, spot((lng + 180) / 360 * side) + k)) for lng, k in ((west, -1), (east, 1)))
    if last - first >= CELL_ROWS:
        return F.col("cell").between(first * side, (last + 1) * side - 1)
    hit = F.lit(False)
    for k in range(first, last + 1):
        hit = hit | F.col("cell").between(k * side + left, k * side + right)
    return hit


def _in_box(df: DataFrame, bbox: str, lat: str, lng: str) -> DataFrame:
    west, south, east, north = parse_bbox(bbox)
    inside = F.col(lng).between(west, east) & F.col(lat).between(south, north)
    return df.filter(in_cells(west, south, east, north) & inside if "cell" in df.columns else inside)


def stations_in_bbox(st: DataFrame, bbox: str, limit: int = LIST_CAP) -> DataFrame:
    """The newest stations in a box. If the table has a cell (with_cell), the scan leaves out what lies elsewhere."""
    return newest(_in_box(st, bbox, "lat", "lng"), limit)


def control_points_in_bbox(cp: DataFrame, bbox: str | None = None, limit: int = LIST_CAP) -> DataFrame:
    """Points without an estimate are left out only if there is a box."""
    return newest(cp if bbox is None else _in_box(cp, bbox, "est_lat", "est_lng"), limit)


#: A tree of cells: the whole map, in each cell 4 x 4 smaller ones down to zoom 22, and below these 64 parts by a hash of the id, twice.
PLACE_LEVELS, HASH_LEVELS = 11, 2
CELL = ["level", "cx", "cy", "ch"]
#: About how many pairs of a box and a spot, and how many rows of either, a task is given.
TASK_PAIRS, TASK_ROWS = 8_000_000, 1_000_000
#: How many boxes at most a task lists the cells of.
TASK_BOXES = 20_000


def map_x(lng) -> Column:
    """The column of a finest cell; what lies beyond the map is in its outermost one."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(2.0**22 - 1), lng_to_tile_x(lng, F.lit(22))))).cast("int")


def map_y(lat) -> Column:
    """Web-Mercator rows end near 85 degrees; beyond, points and boxes share the outermost row."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(2.0**22 - 1), lat_to_tile_y(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat)), F.lit(22))))).cast("int")


def _cells_of(spots: DataFrame, first: int, last: int) -> DataFrame:
    """A row for each level from first to last, with the spot's cell there."""
    at = F.col("level")
    rows = spots.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level"))
    narrow, part = 2 * F.greatest(PLACE_LEVELS - at, F.lit(0)), 6 * (PLACE_LEVELS + HASH_LEVELS - F.greatest(at, F.lit(PLACE_LEVELS)))
    whole = lambda c, bits: F.floor(F.col(c) / F.pow(F.lit(2.0), bits)).cast("int")
    return rows.select(*spots.columns, "level", whole("x", narrow).alias("cx"), whole("y", narrow).alias("cy"), whole("h", part).alias("ch"))


def _split_cells(spots: DataFrame, most: int) -> tuple[DataFrame | None, int]:
    """The cells with more than `most` spots (a written table) and the deepest level that has one, -1 if none has.

    Cells are counted from the top, four or five levels in a pass; later passes read the spots in cells that were too full.
    """
    spark, found, deepest, rest = spots.sparkSession, None, -1, spots
    for first, last in ((0, 4), (5, 8), (9, PLACE_LEVELS + HASH_LEVELS - 1)):
        path = shared_path(spark, "cells")
        _cells_of(rest.select("x", "y", "h"), first, last).groupBy(*CELL).count().filter(F.col("count") > most).select(*CELL).write.parquet(path)
        full = spark.read.parquet(path)
        level = full.agg(F.max("level")).first()[0]
        if level is None:
            break
        found, deepest = full if found is None else found.unionByName(full), level
        if level < last:
            break
        rest = _cells_of(spots, last, last).join(full.filter(F.col("level") == last), CELL, "left_semi")
    return found, deepest


def _leaves_of(boxes: DataFrame, split: DataFrame | None, deepest: int) -> DataFrame:
    """A row for each unsplit cell that a box (x0, x1, y0, y1) meets: level by level, a split cell gives way to its own cells in the box."""
    # From the first level's cells on, split or not, so that a join always has cells to meet by.
    wide = 4 ** (PLACE_LEVELS - 1)
    first = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / wide).cast("int"), F.floor(F.col(hi) / wide).cast("int")))
    rows = boxes.select("*", F.lit(1).alias("level"), first("x0", "x1").alias("cx")).select("*", first("y0", "y1").alias("cy"), F.lit(0).alias("ch"))
    for level in range(1, deepest + 1):
        here = split.filter(F.col("level") == level).withColumn("is_split", F.lit(True))
        rows = rows.join(here, CELL, "left")
        one = lambda c: F.array(F.col(c))
        if level < PLACE_LEVELS:
            wide = 4 ** (PLACE_LEVELS - level - 1)
            inner = lambda c, lo, hi: F.sequence(F.greatest(F.col(c) * 4, F.floor(F.col(lo) / wide).cast("int")), F.least(F.col(c) * 4 + 3, F.floor(F.col(hi) / wide).cast("int")))  # noqa: E731, B023
            lists = {"cx": inner("cx", "x0", "x1"), "cy": inner("cy", "y0", "y1")}
        else:
            lists = {"ch": F.sequence(F.col("ch") * 64, F.col("ch") * 64 + 63)}
        for c, inside in lists.items():
            others = [k for k in rows.columns if k != c]
            rows = rows.select(*others, F.explode(F.when(F.col("is_split"), inside).otherwise(one(c))).alias(c))
        rows = rows.withColumn("level", F.when(F.col("is_split"), F.lit(level + 1)).otherwise(F.col("level"))).drop("is_split")
    return rows


def _leaf_of(spots: DataFrame, split: DataFrame | None, deepest: int) -> DataFrame:
    """Spots (x, y, h) with the one unsplit cell that each lies in: that of a box of no size."""
    rows = _leaves_of(spots.select("*", *(F.col(c).alias(f"{c}{k}") for c in "xy" for k in (0, 1))), split, deepest)
    part = 6 * (PLACE_LEVELS + HASH_LEVELS - F.greatest(F.col("level"), F.lit(PLACE_LEVELS)))
    return rows.filter(F.col("ch") == F.floor(F.col("h") / F.pow(F.lit(2.0), part))).select(*spots.columns, *CELL)


def _spread(leaves: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both dealt to partitions by cell, so that a task has about TASK_PAIRS pairs, and the columns that they meet by. What a task has
    to do is the product of the two, which their sizes don't tell, so it is counted. In a cell with more, boxes are dealt to shares
    by a hash, and each share meets all of the cell's spots."""
    spark, path = leaves.sparkSession, shared_path(leaves.sparkSession, "loads")
    # One number a cell, as Spark drops keys that it sees to be constant, and then would deal both anew by their sizes.
    place = ((F.col("level").cast("long") * 2**22 + F.col("cx")) * 2**22 + F.col("cy")) * 64**HASH_LEVELS + F.col("ch")
    leaves, cells = (df.withColumn("place", place).drop(*CELL) for df in (leaves, cells))
    counted = [df.groupBy("place").agg(F.count(F.lit(1)).alias(n)) for df, n in ((leaves, "n_boxes"), (cells, "n_spots"))]
    counted[0].join(counted[1], "place").write.parquet(path)
    loads = spark.read.parquet(path)
    pairs, rows = loads.agg(F.sum(F.col("n_boxes") * F.col("n_spots")), F.sum(F.col("n_boxes") + F.col("n_spots"))).first()
    tasks, meet = 1 + max((pairs or 0) // TASK_PAIRS, (rows or 0) // TASK_ROWS), ["place"]
    shares = F.ceil(F.col("n_boxes") * F.col("n_spots") / TASK_PAIRS).cast("int")
    full = loads.select("place", shares.alias("shares")).filter("shares > 1")
    if full.limit(1).count():
        number, meet = F.coalesce("shares", F.lit(1)), ["place", "share"]
        own = F.pmod(F.xxhash64(*(c for c in leaves.columns if c != "place")), number).cast("int")
        leaves = leaves.join(full, "place", "left").withColumn("share", own).drop("shares")
        cells = cells.join(full, "place", "left").withColumn("share", F.explode(F.sequence(F.lit(0), number - 1))).drop("shares")
    return leaves.repartition(tasks, *meet), cells.repartition(tasks, *meet), meet


def spots_in_boxes(boxes: DataFrame, spots: DataFrame, most: int) -> DataFrame:
    """All columns of boxes (min_lng, min_lat, max_lng, max_lat) and spots (lat, lng, and id, which deals points of one place), where
    the spot is in the box.

    Spots are counted in a tree of cells, and a cell with more than `most` is split, however small a place the spots are crowded
    in; below the finest cells they are dealt by a hash of their id. So no cell holds more (unless one place has 4096 times as many), and a box meets as many cells as its own
    spots ask for. Pairs are counted by cell and dealt to as many tasks as they need; boxes that crowd on one cell are shared out.
    """
    bounds = boxes.filter("min_lng <= max_lng and min_lat <= max_lat").select("*", map_x(F.col("min_lng")).alias("x0"), map_x(F.col("max_lng")).alias("x1"), map_y(F.col("max_lat")).alias("y0"), map_y(F.col("min_lat")).alias("y1"))
    # A file of many boxes is small, but not their cells.
    n_boxes = bounds.count()
    bounds = bounds.repartition(-(-n_boxes // TASK_BOXES), *bounds.columns) if n_boxes > TASK_BOXES else bounds
    placed = spots.filter("lat is not null and lng is not null").select("*", map_x(F.col("lng")).alias("x"), map_y(F.col("lat")).alias("y"), F.pmod(F.xxhash64("id"), F.lit(64**HASH_LEVELS)).alias("h"))
    split, deepest = _split_cells(placed, most)
    leaves, cells, meet = _spread(_leaves_of(bounds, split, deepest).drop("x0", "x1", "y0", "y1"), _leaf_of(placed, split, deepest).drop("x", "y", "h"))
    inside = F.col("lng").between(F.col("min_lng"), F.col("max_lng")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    return leaves.join(cells, meet).filter(inside)


def boxes_join(boxes: DataFrame, points: DataFrame, most: int = 256) -> DataFrame:
    """box_id, id of all points inside each box, by cells of at most `most` points (spots_in_boxes). Counts the points first."""
    return spots_in_boxes(boxes.select("box_id", "min_lng", "min_lat", "max_lng", "max_lat"), points.select("id", "lat", "lng"), most).select("box_id", "id")


def lookup_by_id(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Every id asked for, with found, and the row's columns (null if it is missing)."""
    hit = table.withColumn("_hit", F.lit(True))
    return ids.select("id").distinct().join(hit, "id", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def photos_with_blob(ph: DataFrame) -> DataFrame:
    return ph.filter("blob_path is not null").select("id", "mime_type")


def list_map_measurements(mm: DataFrame) -> DataFrame:
    return mm.orderBy("created_at", "id")


def located_control_points(cp: DataFrame) -> DataFrame:
    return cp.filter("est_lat is not null and est_lng is not null").select("id", F.col("est_lat").alias("lat"), F.col("est_lng").alias("lng"), "description")


def fixed(c: str, digits: int) -> Column:
    """As decimal text, rounded by the number's binary value (what 0.565 stands for is below the half)."""
    scale = 10.0**digits
    return F.format_string(f"%.{digits}f", F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale)


def uv_label() -> Column:
    return F.concat(F.lit("(u="), fixed("u", 2), F.lit(", v="), fixed("v", 2), F.lit(")"))


def display_labels(st: DataFrame, cp: DataFrame, im: DataFrame, ph: DataFrame) -> DataFrame:
    """entity, id, label, link. Stations have a label for the index and one for lists; links focus on an observation."""
    short = F.substring("id", 1, 6)
    named = lambda col, left, right="": F.coalesce(col, F.concat(F.lit(left), short, F.lit(right)))
    index = st.select(F.lit("station").alias("entity"), "id", named(F.col("name"), "Untitled ").alias("label"), F.concat(F.lit("/station/"), "id").alias("link"))
    lists = st.select(F.lit("station_list").alias("entity"), "id", named(F.col("name"), "(untitled ", ")").alias("label"), F.concat(F.lit("/station/"), "id").alias("link"))
    shown = F.when(F.col("est_lat").isNotNull() & F.col("est_lng").isNotNull(), F.concat(fixed("est_lat", 5), F.lit(", "), fixed("est_lng", 5)))
    points = cp.select(F.lit("control_point").alias("entity"), "id", named(F.nullif("description", F.lit("")), "cp ").alias("label"), F.concat(F.lit("/cp/"), "id").alias("link"))
    places = cp.select(F.lit("control_point_place").alias("entity"), "id", F.coalesce(shown, F.lit("—")).alias("label"), F.concat(F.lit("/?cp="), "id").alias("link"))
    heights = cp.select(F.lit("control_point_alt").alias("entity"), "id", F.when(F.col("est_alt").isNull(), F.lit("—")).otherwise(fixed("est_alt", 1)).alias("label"), F.concat(F.lit("/cp/"), "id").alias("link"))
    seen = im.join(ph.select(F.col("id").alias("photo_id"), "station_id"), "photo_id").select(
        F.lit("image_measurement").alias("entity"), "id", uv_label().alias("label"), F.concat(F.lit("/station/"), "station_id", F.lit("?focus="), "id").alias("link")
    )
    return index.unionByName(lists).unionByName(points).unionByName(places).unionByName(heights).unionByName(seen)


def cp_image_observations(im: DataFrame, ph: DataFrame, st: DataFrame) -> DataFrame:
    """Every linked image measurement with its photo's pose and its station's place. Photos, which are fewer, meet their stations first."""
    photos = ph.select(F.col("id").alias("photo_id"), "station_id", "photo_az", "photo_tilt", "photo_roll", "size_rad", "aspect")
    stations = st.select(F.col("id").alias("station_id"), F.col("name").alias("station_name"), F.col("lat").alias("station_lat"), F.col("lng").alias("station_lng"))
    rows = im.filter("control_point_id is not null").select("id", "photo_id", "u", "v", "control_point_id", "created_at")
    return rows.join(photos.join(stations, "station_id"), "photo_id").select(
        "id", "photo_id", "u", "v", "control_point_id", "station_id", "station_name", "station_lat", "station_lng",
        "photo_az", "photo_tilt", "photo_roll", "size_rad", "aspect", "created_at",
    )


def cp_map_observations(mm: DataFrame) -> DataFrame:
    return mm.filter("control_point_id is not null").select("id", "control_point_id", "lat", "lng", "created_at")


def _ordered(df: DataFrame, key: str, name: str, *fields: str) -> DataFrame:
    """Children of each key as an array of structs, oldest first."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("created_at", "id", *(f for f in fields if f not in ("created_at", "id"))))).alias(name))


def _or_empty(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))


#: What a control point's measurements have beside created_at and id.
IMAGE_FIELDS = ("photo_id", "u", "v", "station_id", "station_name", "station_lat", "station_lng", "photo_az", "photo_tilt", "photo_roll", "size_rad", "aspect")
MAP_FIELDS = ("lat", "lng")


def cp_observations(cp: DataFrame, im: DataFrame, ph: DataFrame, st: DataFrame, mm: DataFrame, ids: DataFrame | None = None, image_fields: tuple[str, ...] = IMAGE_FIELDS, map_fields: tuple[str, ...] = MAP_FIELDS) -> DataFrame:
    """A row for each control point that exists, with its image and map measurements; empty arrays where there are none.

    Fields that are not asked for are not read: Spark can't leave them out of arrays by itself.
    """
    keys = cp.select(F.col("id").alias("control_point_id"))
    if ids is not None:
        wanted = ids.select(F.col("id").alias("control_point_id"))
        keys, im, mm = (df.join(wanted, "control_point_id", "left_semi") for df in (keys, im, mm))
        ph = ph.join(im.select(F.col("photo_id").alias("id")), "id", "left_semi")
    images = _ordered(cp_image_observations(im, ph, st), "control_point_id", "image_measurements", *image_fields)
    maps = _ordered(cp_map_observations(mm), "control_point_id", "map_measurements", *map_fields)
    out = keys.join(images, "control_point_id", "left").join(maps, "control_point_id", "left")
    return _or_empty(_or_empty(out, "image_measurements"), "map_measurements")


def ranked(df: DataFrame, key: str, order: list[str], name: str, most_rows: int = 1_000_000) -> DataFrame:
    """`df` with `name`, each row's number from 1 among those of its key, by `order`, which has to tell rows apart.

    Keys with more than `most_rows` rows are dealt to ranges of their order: each range counts and numbers its own rows, and the
    sum of the ranges before makes that a number of the whole. So no task sorts a popular key alone.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most_rows)
    n_rows = counts.agg(F.sum("_n")).first()[0]
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if not n_rows:
        return df.withColumn(name, number.cast("long"))
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // most_rows))
    large = df.join(counts.select(key), key, "left_semi").repartitionByRange(ranges, key, *order).withColumn("_part", F.spark_partition_id())
    # Written, so that what counts the ranges and what numbers their rows see the same ranges.
    path = shared_path(df.sparkSession, "ranges")
    large.write.parquet(path)
    large = df.sparkSession.read.schema(large.schema).parquet(path)
    before = large.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")).select(key, "_part", (F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    split = large.withColumn("_own", own).join(before, [key, "_part"]).select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))
    return df.join(counts.select(key), key, "left_anti").withColumn(name, number.cast("long")).unionByName(split)


def cp_observation_feed(cp: DataFrame, im: DataFrame, ph: DataFrame, st: DataFrame, mm: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """control_point_id, kind, seq (order in the list), id, label: map rows first, then image rows, oldest first."""
    station = F.coalesce("station_name", F.concat(F.lit("(untitled "), F.substring("station_id", 1, 6), F.lit(")")))
    maps = cp_map_observations(mm).select("control_point_id", F.lit("map").alias("kind"), F.lit(0).alias("rank"), "created_at", "id", F.concat(F.lit("observed at "), fixed("lat", 5), F.lit(", "), fixed("lng", 5)).alias("label"))
    images = cp_image_observations(im, ph, st).select("control_point_id", F.lit("image").alias("kind"), F.lit(1).alias("rank"), "created_at", "id", F.concat(uv_label(), F.lit(" in "), station).alias("label"))
    both = maps.unionByName(images).join(cp.select(F.col("id").alias("control_point_id")), "control_point_id", "left_semi")
    return ranked(both, "control_point_id", ["rank", "created_at", "id"], "seq", most_rows).select("control_point_id", "kind", "seq", "id", "label")


def _only(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    return df if ids is None else df.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def station_photos(ph: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return _only(ph, ids, "station_id").orderBy("station_id", "created_at", "id")


def with_station(im: DataFrame, ph: DataFrame) -> DataFrame:
    return im.join(ph.select(F.col("id").alias("photo_id"), "station_id"), "photo_id")


def station_image_measurements(im: DataFrame, ph: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return _only(with_station(im, ph), ids, "station_id").select("station_id", *im.columns)


def station_observed_cps(im: DataFrame, ph: DataFrame) -> DataFrame:
    return with_station(im.filter("control_point_id is not null").select("photo_id", "control_point_id"), ph).select("station_id", "control_point_id").distinct()


def station_control_points(cp: DataFrame, im: DataFrame, ph: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    pairs = _only(station_observed_cps(im, ph), ids, "station_id")
    return pairs.join(cp.withColumnRenamed("id", "control_point_id"), "control_point_id").select("station_id", F.col("control_point_id").alias("id"), *(c for c in cp.columns if c != "id"))


def hydrate_stations(st: DataFrame, ph: DataFrame, im: DataFrame, cp: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """station_id, station struct, and arrays of its photos, image measurements and control points."""
    stations = _only(st.withColumn("station_id", F.col("id")), ids, "station_id")
    out = stations.select("station_id", F.struct(*st.columns).alias("station"))
    listed = lambda rows, name: _ordered(rows, "station_id", name, *(c for c in rows.columns if c != "station_id"))
    images = listed(station_image_measurements(im, ph, ids), "image_measurements")
    # A station's points are told by its images, which lie together: Spark shuffles these once for both.
    seen = images.select("station_id", F.explode(F.array_distinct(F.transform("image_measurements", lambda x: x["control_point_id"]))).alias("id")).filter("id is not null")
    points = listed(seen.join(cp, "id").select("station_id", *cp.columns), "control_points")
    for name, rows in (("photos", listed(_only(ph, ids, "station_id"), "photos")), ("image_measurements", images), ("control_points", points)):
        out = _or_empty(out.join(rows, "station_id", "left"), name)
    return out


def station_located_cps(cp: DataFrame, im: DataFrame, ph: DataFrame) -> DataFrame:
    located = located_control_points(cp).select(F.col("id").alias("control_point_id"), "lat", "lng")
    return station_observed_cps(im, ph).join(located, "control_point_id").select("station_id", "control_point_id", "lat", "lng")


def station_preview(st: DataFrame, ph: DataFrame, im: DataFrame, cp: DataFrame, ids: DataFrame, most_requests: int = 10_000) -> DataFrame:
    """station_id, control_point_id, observed: every located point for each station asked for.

    `ids` is a list of requests, held against all points: it is counted, and sent to all tasks in blocks of `most_requests`.
    """
    stations = st.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("station_id"))
    blocks = max(1, -(-ids.select("id").distinct().count() // most_requests))
    points = located_control_points(cp).select(F.col("id").alias("control_point_id"))
    every = None
    for k in range(blocks):
        part = points.join(F.broadcast(stations.filter(F.pmod(F.xxhash64("station_id"), F.lit(blocks)) == k)), F.lit(True))
        every = part if every is None else every.unionByName(part)
    seen = _only(station_observed_cps(im, ph), ids, "station_id").withColumn("observed", F.lit(True))
    return every.join(seen, ["station_id", "control_point_id"], "left").select("station_id", "control_point_id", F.coalesce("observed", F.lit(False)).alias("observed"))


def point_numbers(cp: DataFrame) -> DataFrame:
    """control_point_id and n, a number of its own, of each located point: the dictionary of previews, written once."""
    path = shared_path(cp.sparkSession, "numbers")
    numbered = located_control_points(cp).select(F.col("id").alias("control_point_id"), F.monotonically_increasing_id().alias("n"))
    numbered.write.parquet(path)
    return cp.sparkSession.read.schema(numbered.schema).parquet(path)


def station_preview_bits(im: DataFrame, ph: DataFrame, numbers: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """station_id, bucket, observed: for each station the points of the dictionary that it observes, as bitmaps of 32,768 numbers
    each. It grows with what stations observe, where station_preview grows with stations times points.

    Numbers go to their station first, so that no bitmap, of 4 KB each, is shuffled or sorted."""
    seen = _only(station_observed_cps(im, ph), ids, "station_id").join(numbers, "control_point_id").select("station_id", "n").repartition("station_id")
    return seen.groupBy("station_id", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("observed"))


def preview_of(bits: DataFrame, numbers: DataFrame, ids: DataFrame) -> DataFrame:
    """station_id, control_point_id, observed: the previews of a few stations (`ids` are broadcast) from bitmaps, as station_preview has them."""
    bucket, at = F.bitmap_bucket_number("n"), F.bitmap_bit_position("n")
    chosen = F.broadcast(ids.select(F.col("id").alias("station_id")).distinct())
    rows = numbers.select("control_point_id", bucket.alias("bucket"), at.alias("at")).join(chosen, F.lit(True)).join(bits, ["station_id", "bucket"], "left")
    byte = F.conv(F.hex(F.substring("observed", F.expr("cast(at div 8 as int)") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, cast(at % 8 as int)) & 1") == 1
    return rows.withColumn("byte", byte).select("station_id", "control_point_id", F.coalesce(bit, F.lit(False)).alias("observed"))


def station_preview_cones(ph: DataFrame, ids: DataFrame) -> DataFrame:
    """station_id, photo_id, az_l, az_r: the other half of a preview, the view cones of the photos of the stations asked for."""
    half = F.col("size_rad") / 2
    return _only(ph, ids.distinct(), "station_id").select("station_id", F.col("id").alias("photo_id"), (F.col("photo_az") + half).alias("az_l"), (F.col("photo_az") - half).alias("az_r"))


def anchored_measurements(im: DataFrame, ph: DataFrame, cp: DataFrame) -> DataFrame:
    """Image measurements whose control point is linked and located: what the pose solver reads."""
    located = cp.filter("est_lat is not null and est_lng is not null").select(F.col("id").alias("control_point_id"), "est_lat", "est_lng")
    rows = with_station(im.filter("control_point_id is not null").select("id", "photo_id", "u", "v", "control_point_id"), ph).join(located, "control_point_id")
    return rows.select("station_id", "photo_id", "id", "u", "v", "control_point_id", "est_lat", "est_lng")


def solver_priors(mm: DataFrame, anchored: DataFrame, sigma_m: float = 30.0) -> DataFrame:
    """Map measurements of points that a station has anchored image measurements of."""
    pairs = anchored.select("station_id", "control_point_id").distinct()
    return cp_map_observations(mm).join(pairs, "control_point_id").select("station_id", "control_point_id", F.col("id").alias("map_measurement_id"), "lat", "lng", F.lit(sigma_m).alias("sigma_m"))


def linked_map_measurement(mm: DataFrame) -> DataFrame:
    return cp_map_observations(mm).groupBy("control_point_id").agg(F.min(F.struct("created_at", "id"))["id"].alias("map_measurement_id"))


def pin_on_photo(im: DataFrame) -> DataFrame:
    return im.filter("control_point_id is not null").groupBy("photo_id", "control_point_id").agg(F.min(F.struct("created_at", "id"))["id"].alias("id"))


def _linked(im: DataFrame, mm: DataFrame) -> DataFrame:
    kinds = [df.filter("control_point_id is not null").select(F.col("id").alias("measurement_id"), F.lit(kind).alias("kind"), "control_point_id") for df, kind in ((im, "image"), (mm, "map"))]
    return kinds[0].unionByName(kinds[1])


def linked_measurements(im: DataFrame, mm: DataFrame) -> DataFrame:
    """measurement_id, kind, control_point_id, n_image, n_map: each linked measurement, with how many others of either kind its control point has.

    The control point names the class, so members are this table's rows; pairs, which grow with the square of a popular
    point, are made for a selection only (linked_to).
    """
    rows = _linked(im, mm)
    of = lambda kind: (F.col("kind") == kind).cast("long")
    counts = rows.groupBy("control_point_id").agg(F.sum(of("image")).alias("image"), F.sum(of("map")).alias("map"))
    return rows.join(counts, "control_point_id").select("measurement_id", "kind", "control_point_id", (F.col("image") - of("image")).alias("n_image"), (F.col("map") - of("map")).alias("n_map"))


def linked_to(im: DataFrame, mm: DataFrame, selected: DataFrame) -> DataFrame:
    """measurement_id, kind, control_point_id, other_id, other_kind: for each selected measurement (measurement_id, kind) every other of its control point."""
    rows = _linked(im, mm)
    others = rows.select(F.col("measurement_id").alias("other_id"), F.col("kind").alias("other_kind"), "control_point_id")
    chosen = rows.join(selected.select("measurement_id", "kind").distinct(), ["measurement_id", "kind"], "left_semi")
    return chosen.join(others, "control_point_id").filter((F.col("measurement_id") != F.col("other_id")) | (F.col("kind") != F.col("other_kind"))).select("measurement_id", "kind", "control_point_id", "other_id", "other_kind")


def new_map_measurements(incoming: DataFrame, mm: DataFrame) -> DataFrame:
    return incoming.join(mm.select("id"), "id", "left_anti")
