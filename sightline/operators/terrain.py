"""Elevation tiles: hillshade and the rings of terrain around a station.

A tile is a row (z, x, y, elev): 256 x 256 elevations in row order. A tile that is missing has elevation 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sightline.functions import geometry as g
from sightline.schema import M_PER_DEG_LAT

TILE_PX = 256

#: Zoom, radius in tiles and stride in pixels of the rings, from the inside out.
RINGS = [(0, 11, 2, 2), (1, 9, 2, 2), (2, 7, 2, 2)]

FLAT_GRAY = 16


def with_stride(stride: int) -> list[tuple[int, int, int, int]]:
    return [(k, z, r, stride) for k, z, r, _ in RINGS]


def tiles_from_pixels(pixels: DataFrame) -> DataFrame:
    """z, x, y, elev of (z, x, y, px, py, r, g, b); a tile's pixels are put in order."""
    metres = F.col("r") * 256.0 + F.col("g") + F.col("b") / 256.0 - 32768.0
    rows = pixels.select("z", "x", "y", (F.col("py") * TILE_PX + F.col("px")).alias("at"), metres.alias("m"))
    return rows.groupBy("z", "x", "y").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("p")).select("z", "x", "y", F.col("p.m").alias("elev"))


def hillshade_cell_size(tiles: DataFrame) -> DataFrame:
    """z, y, cell_m: metres a pixel at the middle of each row of tiles."""
    lat = g.tile_y_to_lat(F.col("y") + 0.5, "z")
    return tiles.select("z", "y").distinct().select("z", "y", (F.cos(F.radians(lat)) * 156543.03 / g.tiles_across("z")).alias("cell_m"))


def shade(elev: np.ndarray, cell_m: float) -> np.ndarray:
    """Gray values of a square of elevations: central differences; at a border the border pixel stands in, over the same two cells."""
    az, alt = math.radians(315), math.radians(45)
    wide = np.pad(elev, 1, mode="edge")
    east = (wide[1:-1, 2:] - wide[1:-1, :-2]) / (2 * cell_m)
    north = (wide[:-2, 1:-1] - wide[2:, 1:-1]) / (2 * cell_m)
    facing = math.sin(alt) - east * (math.sin(az) * math.cos(alt)) - north * (math.cos(az) * math.cos(alt))
    return np.minimum(255, np.floor(255 * np.maximum(0, facing / np.sqrt(east**2 + north**2 + 1)) + 0.5)).astype(np.int32)


def hillshade(tiles: DataFrame) -> DataFrame:
    """z, x, y, px, py, gray. Tiles without elevations are flat gray. A tile is shaded where it lies, so nothing is shuffled."""

    def run(batches):
        for batch in batches:
            gray = []
            for cell, elev in zip(batch.column("cell").to_pylist(), batch.column("elev")):
                if not elev.is_valid:
                    gray.append(np.full(TILE_PX * TILE_PX, FLAT_GRAY, np.int32))
                else:
                    gray.append(shade(elev.values.to_numpy(zero_copy_only=False).reshape(TILE_PX, TILE_PX), cell).ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "zxy"), pa.array(gray, pa.list_(pa.int32()))], names=["z", "x", "y", "gray"])

    cell = F.cos(F.radians(g.tile_y_to_lat(F.col("y") + 0.5, "z"))) * 156543.03 / g.tiles_across("z")
    grays = tiles.select("z", "x", "y", cell.alias("cell"), "elev").mapInArrow(run, "z int, x int, y int, gray array<int>")
    return grays.select("z", "x", "y", F.posexplode("gray").alias("i", "gray")).select("z", "x", "y", (F.col("i") % TILE_PX).alias("px"), F.expr(f"cast(i div {TILE_PX} as int)").alias("py"), "gray")


def _rings(st: DataFrame, rings) -> DataFrame:
    spec = F.array(*(F.struct(F.lit(k).alias("ring"), F.lit(z).alias("z"), F.lit(r).alias("radius"), F.lit(s).alias("stride")) for k, z, r, s in rings))
    rows = st.select(F.col("id").alias("station_id"), "lat", "lng", F.inline(spec))
    return rows.withColumn("cx", F.floor(g.lng_to_tile_x("lng", "z")).cast("int")).withColumn("cy", F.floor(g.lat_to_tile_y("lat", "z")).cast("int"))


def tile_windows(st: DataFrame, rings=None) -> DataFrame:
    """station_id, ring, z, x, y of all tiles that a station's rings need; `distinct` over z, x, y is the fetch plan."""
    step = lambda c: F.explode(F.sequence(F.col(c) - F.col("radius"), F.col(c) + F.col("radius")))
    return _rings(st, rings or RINGS).select("*", step("cx").alias("x")).select("station_id", "ring", "z", "x", step("cy").alias("y"))


def camera_ground_elevation(st: DataFrame, tiles: DataFrame) -> DataFrame:
    """station_id, elev: the pixel under the station in the innermost ring's tile; 0 where that is missing."""
    fx, fy = g.lng_to_tile_x("lng", F.lit(RINGS[0][1])), g.lat_to_tile_y("lat", F.lit(RINGS[0][1]))
    pixel = lambda f: F.greatest(F.lit(0), F.least(F.lit(TILE_PX - 1), F.floor((f - F.floor(f)) * TILE_PX).cast("int")))
    at = st.select(F.col("id").alias("station_id"), F.lit(RINGS[0][1]).alias("z"), F.floor(fx).cast("int").alias("x"), F.floor(fy).cast("int").alias("y"), (pixel(fy) * TILE_PX + pixel(fx) + 1).alias("at"))
    # Joins with stations or tiles are sort-merge joins by hint: Spark takes rows that explode or hold arrays for small and broadcasts them.
    return at.join(tiles.hint("merge"), ["z", "x", "y"], "left").select("station_id", F.coalesce(F.element_at("elev", F.col("at")), F.lit(0.0)).alias("elev"))


def ring_axes(st: DataFrame, rings=None) -> DataFrame:
    """station_id, lat, lng, ring, z, radius, stride, cx, cy, and nx: how many vertices a row or column of the ring has."""
    return _rings(st, rings or RINGS).withColumn("nx", (F.lit(TILE_PX) / F.col("stride") * (F.col("radius") * 2 + 1) + 1).cast("int"))


def _spot(n: Column, centre: str, radius: str = "radius", stride: str = "stride") -> Column:
    """Where a ring's n-th row or column lies, in tiles. The last one falls in a tile beyond the window."""
    per = F.lit(TILE_PX) / F.col(stride)
    tile = F.floor(n / per)
    return F.col(centre) - F.col(radius) + tile + (n - tile * per) * F.col(stride) / float(TILE_PX)


def _east(at: Column, z: str = "z") -> Column:
    return (g.tile_x_to_lng(at, z) - F.col("lng")) * M_PER_DEG_LAT * F.cos(F.radians("lat"))


def _south(at: Column, z: str = "z") -> Column:
    return -(g.tile_y_to_lat(at, z) - F.col("lat")) * M_PER_DEG_LAT


def _along(each) -> Column:
    """An array of each(n) for all rows or columns of a ring."""
    return F.transform(F.sequence(F.lit(0), F.col("nx") - 1), each)


def _columns(k: float, wanted: list[int] | None = None) -> Column:
    """i, x, u, drop of all columns of a ring, or of those wanted: what depends on the column alone. k: curvature_factor."""
    whole = lambda i, x: F.struct(i.alias("i"), x.alias("x"), (i / (F.col("nx") - 1)).alias("u"), (x * x * k).alias("drop"))
    if wanted is not None:
        return F.array(*(whole(F.lit(i), _east(_spot(F.lit(i), "cx"))) for i in wanted))
    return F.transform(_along(lambda i: _east(_spot(i, "cx"))), lambda x, i: whole(i, x))


def ring_columns(st: DataFrame, rings=None, curvature: bool = True, refraction: bool = True, wanted: list[int] | None = None) -> DataFrame:
    """station_id, ring, i, x, u, drop: what all vertices of a ring's column share; wanted: of these columns only. drop: metres
    that the earth falls away along x."""
    return ring_axes(st, rings).select("station_id", "ring", F.inline(_columns(g.curvature_factor(curvature, refraction), wanted)))


def sampled(tiles: DataFrame, stride: int) -> DataFrame:
    """z, x, y, elev (array<float>; elevations are whole 256ths of a metre, so nothing is lost) of every stride-th pixel of every stride-th row."""
    n = TILE_PX // stride
    thin = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.element_at("elev", (F.floor(k / n) * (stride * TILE_PX) + k % n * stride + 1).cast("int")).cast("float"))
    return tiles.filter("elev is not null").select("z", "x", "y", thin.alias("elev"))


#: Station windows that read one copy of a strip.
WINDOWS_A_COPY = 500


def _stride(rings) -> int:
    if len({s for *_, s in rings}) != 1:
        raise ValueError("rings of one stride only")
    return rings[0][3]


def ring_strips(windows: DataFrame, tiles: DataFrame, stride: int) -> DataFrame:
    """z, radius, cx, y, r, elev: row r of the tiles that stand abreast about column cx in the row y of tiles, as one array.

    windows: distinct z, radius, cx, y. Missing tiles are 0; a last 0 stands for the column beyond the window.
    """
    per = TILE_PX // stride
    abreast = windows.select("*", F.explode(F.sequence(F.lit(0), F.col("radius") * 2)).alias("a")).withColumn("x", F.col("cx") - F.col("radius") + F.col("a"))
    found = abreast.join(sampled(tiles, stride).hint("merge"), ["z", "x", "y"], "left")
    rows = found.select("z", "radius", "cx", "y", "a", "elev", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("r"))
    none = F.array_repeat(F.lit(0.0).cast("float"), per)
    slices = rows.select("z", "radius", "cx", "y", "r", F.struct("a", F.coalesce(F.slice("elev", F.col("r") * per + 1, F.lit(per)), none).alias("e")).alias("s"))
    beyond = F.array(F.lit(0.0).cast("float"))
    return slices.groupBy("z", "radius", "cx", "y", "r").agg(F.concat(F.flatten(F.array_sort(F.collect_list("s"))["e"]), beyond).alias("elev"))


def ring_rows(st: DataFrame, tiles: DataFrame, rings=None, curvature: bool = True, refraction: bool = True, of_rows=None) -> DataFrame:
    """station_id, ring, j, z, v, base, elev: a ring as a separable height field, a row for each row of its vertices.

    elev holds the elevations of the row's vertices from the first column to the last. Everything else depends on the row
    alone or the column alone, as the earth's fall is that along x plus that along z: the vertex in column i of ring_columns
    lies at (x, elev[i] - base - drop, z). base: the camera's elevation and what the earth falls away along z.

    Tiles are thinned to the stride and laid side by side once for all stations that have them in common; stations meet these
    strips, not tiles or pixels, and their rows are the strips' own arrays. A strip that many stations share is sent in
    several copies, each for some of them, so no task makes the rows of all.

    of_rows: a function of a DataFrame with elev that puts other columns in its place. What it makes of a strip is made once,
    and stations get that instead of elev, so a job that wants sums alone moves no arrays.
    """
    rings = rings or RINGS
    stride = _stride(rings)
    per, k = TILE_PX // stride, g.curvature_factor(curvature, refraction)
    axes = ring_axes(st, rings).join(camera_ground_elevation(st, tiles).withColumnRenamed("elev", "cam").hint("merge"), "station_id")
    windows = axes.select("*", F.explode(F.sequence(F.lit(0), F.col("radius") * 2)).alias("b")).withColumn("y", F.col("cy") - F.col("radius") + F.col("b"))
    key = ["z", "radius", "cx", "y"]
    wanted = windows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / WINDOWS_A_COPY).cast("int").alias("copies"))
    windows = windows.join(wanted.hint("merge"), key).withColumn("copy", F.pmod(F.xxhash64("station_id", "ring"), F.col("copies")).cast("int"))
    of_rows = of_rows or (lambda df: df)
    strips = of_rows(ring_strips(wanted.select(*key), tiles, stride))
    made = [c for c in strips.columns if c not in (*key, "r")]
    strips = strips.join(wanted.hint("merge"), key).select(*key, "r", *made, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    inner = windows.join(strips.hint("merge"), [*key, "copy"]).select("station_id", "ring", "lat", "z", "nx", "cam", (F.col("b") * per + F.col("r")).alias("j"), (F.col("y") + F.col("r") * float(stride) / float(TILE_PX)).alias("at"), *made)
    # The last row falls in tiles beyond the window, so it has elevation 0.
    sizes = F.array(*(F.lit(n) for n in sorted({int(TILE_PX / s * (r * 2 + 1) + 1) for _, _, r, s in rings})))
    zeros = of_rows(st.sparkSession.range(1).select(F.explode(sizes).alias("nx")).select("nx", F.array_repeat(F.lit(0.0).cast("float"), F.col("nx")).alias("elev")))
    last = axes.join(F.broadcast(zeros), "nx").select("station_id", "ring", "lat", "z", "nx", "cam", (F.col("nx") - 1).alias("j"), (F.col("cy") + F.col("radius") + 1).cast("double").alias("at"), *made)
    rows = inner.unionByName(last).withColumn("south", _south(F.col("at")))
    return rows.select("station_id", "ring", "j", F.col("south").alias("z"), (F.col("j") / (F.col("nx") - 1)).alias("v"), (F.col("cam") + F.col("south") * F.col("south") * k).alias("base"), *made)


#: Station windows whose vertices one task makes from one copy of a block of strips.
WINDOWS_A_BLOCK = 5000


def of_ring_vertices(st: DataFrame, tiles: DataFrame, of_block, schema: str, rings=None, curvature: bool = True, refraction: bool = True) -> DataFrame:
    """station_id, ring and what `of_block` makes of all vertices of all rings, which are made in the tasks and not kept.

    of_block(j, z, x, elev, y) gets a block of a ring's rows: their numbers and places (by row), the columns' places (by column),
    and the elevations and heights of all their vertices (row by column); u is the column's number over the last one's, v the
    row's. It returns arrays, one for each column of `schema`, all of one length. A block is the rows of one row of tiles, or
    the last row alone. Heights are those of ring_vertices.

    Strips are sent to the tasks that make the vertices of the stations that share them: a block goes there once for
    WINDOWS_A_BLOCK stations, so what is shuffled grows by a few numbers a station, while vertices are made for each.
    """
    rings = rings or RINGS
    stride = _stride(rings)
    per, k = TILE_PX // stride, g.curvature_factor(curvature, refraction)
    key = ["z", "radius", "cx", "y"]
    axes = ring_axes(st, rings).join(camera_ground_elevation(st, tiles).withColumnRenamed("elev", "cam").hint("merge"), "station_id")
    windows = axes.select("*", F.explode(F.sequence(F.lit(0), F.col("radius") * 2 + 1)).alias("b")).withColumn("y", F.col("cy") - F.col("radius") + F.col("b"))
    # The last row falls in tiles beyond the window, so it has elevation 0 and needs no strips.
    within = F.max(F.col("b") <= F.col("radius") * 2).alias("within")
    wanted = windows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / WINDOWS_A_BLOCK).cast("int").alias("copies"), within)
    windows = windows.join(wanted.hint("merge"), key).withColumn("copy", F.pmod(F.xxhash64("station_id", "ring"), F.col("copies")).cast("int"))
    strips = ring_strips(wanted.filter("within").select(*key), tiles, stride).join(wanted.hint("merge"), key).select(*key, "r", "elev", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    types = [(f.name, f.dataType) for f in st.sparkSession.createDataFrame([], schema).schema]
    kept = pa.schema([("station_id", pa.string()), ("ring", pa.int32()), *((n, to_arrow_type(t)) for n, t in types)])

    def run(windows: pa.Table, strips: pa.Table) -> pa.Table:
        parts, heights = [], None
        if strips.num_rows and windows.num_rows:
            heights = strips.column("elev").combine_chunks().flatten().to_numpy().reshape(strips.num_rows, -1)
            heights = heights[np.argsort(strips.column("r").to_numpy())].astype(np.float64)
        for w in windows.to_pylist():
            nx, z, across = w["nx"], w["z"], 2.0 ** w["z"]
            last = w["b"] > 2 * w["radius"]
            elev = np.zeros((1, nx)) if last else heights
            r, i = np.arange(len(elev)), np.arange(nx)
            at = w["y"] + r * float(stride) / TILE_PX
            south = -(np.degrees(np.arctan(np.sinh(math.pi - 2 * math.pi * at / across))) - w["lat"]) * M_PER_DEG_LAT
            x = ((w["cx"] - w["radius"] + i // per + i % per * float(stride) / TILE_PX) / across * 360.0 - 180.0 - w["lng"]) * (M_PER_DEG_LAT * math.cos(math.radians(w["lat"])))
            y = elev - (w["cam"] + south * south * k)[:, None]
            y -= x * x * k
            parts.append((w["station_id"], w["ring"], of_block(w["b"] * per + r, south, x, elev, y)))
        if not parts:
            return kept.empty_table()
        sizes = [len(made[0]) for *_, made in parts]
        named = [np.repeat(np.array([p[i] for p in parts], object if i == 0 else np.int32), sizes) for i in (0, 1)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*named, *(np.concatenate(c) for c in zip(*(made for *_, made in parts)))], kept)], schema=kept)

    to = [*key, "copy"]
    given = windows.select(*to, "station_id", "ring", "lat", "lng", "nx", "cam", "b")
    # Both sides come from the same windows, so the strips' columns are named anew.
    strips = strips.select(*(F.col(c).alias(f"of_{c}") for c in to), "r", "elev")
    return given.groupBy(*to).cogroup(strips.groupBy(*(f"of_{c}" for c in to))).applyInArrow(run, f"station_id string, ring int, {schema}")


def ring_vertices(st: DataFrame, tiles: DataFrame, rings=None, curvature: bool = True, refraction: bool = True) -> DataFrame:
    """station_id, ring, i, j, x, y, z, u, v: the height field of ring_rows vertex by vertex, for stations that are chosen (1.2
    million rows a station)."""
    columns = ring_axes(st, rings).select("station_id", "ring", _columns(g.curvature_factor(curvature, refraction)).alias("columns"))
    rows = ring_rows(st, tiles, rings, curvature, refraction).join(columns.hint("merge"), ["station_id", "ring"])
    each = rows.select("station_id", "ring", "j", "z", "v", "base", F.inline(F.arrays_zip("elev", "columns")))
    return each.select("station_id", "ring", "columns.i", "j", "columns.x", (F.col("elev").cast("double") - F.col("base") - F.col("columns.drop")).alias("y"), "z", "columns.u", "v")


def ring_bounds(st: DataFrame, rings=None) -> DataFrame:
    """station_id, ring, x_min, x_max, z_min, z_max. x grows with the column and z with the row, so the ends are enough."""
    ends = ring_axes(st, rings).select("station_id", "ring", *(f(_spot(n, c)).alias(a) for a, f, n, c in (
        ("x_min", _east, F.lit(0), "cx"), ("x_max", _east, F.col("nx") - 1, "cx"), ("z_min", _south, F.lit(0), "cy"), ("z_max", _south, F.col("nx") - 1, "cy"))))
    return ends


def ring_quads(st: DataFrame, rings=None) -> DataFrame:
    """station_id, ring, j_first, j_last, i_first, i_last, kept, a, nx: the cells of a ring as rectangles, at most five.

    A cell that lies wholly inside the ring before is not kept. x depends on the column alone and z on the row alone, so
    these cells are a rectangle, whose sides lie where the ring before ends, in closed form; the kept ones are those above, left,
    right and below of it. a is the number of the first cell's upper left corner, nx that of the corners of a row. The cell i further
    right and j further down has the corners a + j * nx + i (upper left, a), one more (b), nx more (c), nx + 1 more (d), and the
    triangles a c b and b c d.
    """
    rings = rings or RINGS
    known = {k: spec for k, *spec in rings}
    # What is known of the ring before; null for the first.
    before = lambda i: F.coalesce(F.lit(None).cast("int"), *(F.when(F.col("ring") == k, F.lit(known[k - 1][i])) for k in known if k - 1 in known))
    places = ring_axes(st, rings).withColumns({"z_in": before(0), "radius_in": before(1), "stride_in": before(2)})
    places = places.withColumn("cx_in", F.floor(g.lng_to_tile_x("lng", "z_in")).cast("int")).withColumn("cy_in", F.floor(g.lat_to_tile_y("lat", "z_in")).cast("int"))
    places = places.withColumn("last_in", (F.lit(TILE_PX) / F.col("stride_in") * (F.col("radius_in") * 2 + 1)).cast("int"))
    ends = {}
    for low, high, along, centre in (("i0", "i1", _east, "cx"), ("j0", "j1", _south, "cy")):
        for name, n_in in ((low, F.lit(0)), (high, F.col("last_in"))):
            spot = _spot(n_in, f"{centre}_in", "radius_in", "stride_in")
            # That row or column of the ring before, counted along this ring.
            at = (spot * F.pow(F.lit(2.0), F.col("z") - F.col("z_in")) - F.col(centre) + F.col("radius")) * (F.lit(TILE_PX) / F.col("stride"))
            ends |= {name: F.round(at).cast("int"), f"{name}_in": along(spot, "z_in")}
    sides = places.withColumns(ends)
    # Rounding may put the side a row or column off, so the places themselves are compared, as for every cell.
    exact = {}
    for low, high, along, centre in (("i0", "i1", _east, "cx"), ("j0", "j1", _south, "cy")):
        place = lambda n: along(_spot(n, centre))  # noqa: E731, B023
        a, b = F.col(low), F.col(high)
        exact[low] = F.greatest(F.lit(0), F.when(place(a - 1) >= F.col(f"{low}_in"), a - 1).when(place(a) >= F.col(f"{low}_in"), a).otherwise(a + 1))
        exact[high] = F.least(F.col("nx") - 2, F.when(place(b + 1) <= F.col(f"{high}_in"), b).when(place(b) <= F.col(f"{high}_in"), b - 1).otherwise(b - 2))
    end, none = F.col("end"), F.lit(0)
    sides = sides.select("station_id", "ring", "nx", (F.col("nx") - 2).alias("end"), *(c.alias(n) for n, c in exact.items()))
    some = F.coalesce((F.col("i0") <= F.col("i1")) & (F.col("j0") <= F.col("j1")), F.lit(False)) & F.col("ring").isin([k for k in known if k - 1 in known])
    # Where no cell is hidden the rectangle above is the whole ring.
    sides = sides.select("station_id", "ring", "nx", "end", "i0", "i1", F.when(some, F.col("j0")).otherwise(end + 1).alias("j0"), F.when(some, F.col("j1")).otherwise(end).alias("j1"))
    i0, i1, j0, j1 = (F.col(c) for c in ("i0", "i1", "j0", "j1"))
    block = lambda a, b, c, d, kept: F.struct(a.alias("j_first"), b.alias("j_last"), c.alias("i_first"), d.alias("i_last"), F.lit(kept).alias("kept"))
    five = F.array(block(none, j0 - 1, none, end, True), block(j0, j1, none, i0 - 1, True), block(j0, j1, i0, i1, False), block(j0, j1, i1 + 1, end, True), block(j1 + 1, end, none, end, True))
    rows = sides.select("station_id", "ring", "nx", F.inline(five)).filter("i_first <= i_last and j_first <= j_last")
    return rows.select("station_id", "ring", "j_first", "j_last", "i_first", "i_last", "kept", (F.col("j_first") * F.col("nx") + F.col("i_first")).alias("a"), "nx")


def quad_cells(blocks: DataFrame) -> DataFrame:
    """station_id, ring, i, j, kept, a, b, c, d of rectangles of ring_quads, cell by cell, for rings that are chosen."""
    cells = blocks.select("*", F.explode(F.sequence("j_first", "j_last")).alias("j")).select("*", F.explode(F.sequence("i_first", "i_last")).alias("i"))
    a = F.col("j") * F.col("nx") + F.col("i")
    return cells.select("station_id", "ring", "i", "j", "kept", a.alias("a"), (a + 1).alias("b"), (a + F.col("nx")).alias("c"), (a + F.col("nx") + 1).alias("d"))
