from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions.ids import assign_ids
from sightline.operators import aggregates, changes, integrity, reads, solve, spatial, terrain, validate
from sightline.sources import entities
from sightline.streaming import feeds

STAMP = "timestamp_ntz'2020-01-01 00:00:00'"


def one(spark, **columns):
    return spark.range(1).select(*(F.expr(v).alias(k) if isinstance(v, str) else F.lit(v).alias(k) for k, v in columns.items()))


def png(path, width, height, pixel):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_rules_at_the_edges(spark):
    rows = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (90.1, 0.0), (0.0, 180.1)], "lat double, lng double")
    assert [r.reject_reason is None for r in validate.validate_stations(rows).collect()] == [True, True, False, False]
    photos = spark.createDataFrame([(0.0, 1.0, 1.0), (100.0, 0.0, None), (1.0, -1.0, 2.0), (1.0, 1.0, 1.1)], "aspect double, size_rad double, opacity double")
    assert [r.reject_reason for r in validate.validate_photos(photos).collect()] == ["aspect out of range", None, "size_rad out of range", "opacity out of range"]
    ids = spark.createDataFrame([("A" * 13,), ("A" * 12,), ("a" * 13,), ("A" * 12 + "8",), (None,)], "id string")
    assert [r.valid for r in validate.validate_ids(ids).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("text", ["1,2,3", "1,2,3,x", "1, 2,3,4", ""])
def test_malformed_box(text):
    with pytest.raises(ValueError):
        reads.parse_bbox(text)


def test_swapped_corners():
    assert reads.parse_bbox("2,3,1,-4") == (1.0, -4.0, 2.0, 3.0)


def test_ids_are_the_keys_bits(spark):
    got = assign_ids(spark.createDataFrame([(0,), (-1,), (1,)], "k long"), "k").collect()
    assert [r.id for r in got] == ["A" * 13, "7" * 12 + "6", "A" * 12 + "C"]


def test_projection_and_location_are_inverse(spark):
    rows = spark.range(500).select(*((F.rand(i) * b + a).alias(n) for i, (n, a, b) in enumerate([("az", -3.0, 6.0), ("tilt", -1.2, 2.4), ("roll", -3.0, 6.0), ("size", 0.1, 2.0), ("aspect", 0.3, 3.0), ("u", 0.0, 1.0), ("v", 0.0, 1.0)])))
    a, e = g.project_uv("az", "tilt", "roll", "size", "aspect", "u", "v")
    u, v = g.locate_uv("az", "tilt", "roll", "size", "aspect", "a", "e")
    got = rows.withColumn("a", a).withColumn("e", e).select(F.max(F.abs(u - F.col("u"))).alias("du"), F.max(F.abs(v - F.col("v"))).alias("dv"), F.count(u).alias("n")).first()
    assert got.du < 1e-9 and got.dv < 1e-9 and got.n == 500


def test_tiles_and_back(spark):
    rows = spark.range(200).select((F.rand(1) * 160 - 80).alias("lat"), (F.rand(2) * 360 - 180).alias("lng"), F.lit(9).alias("z"))
    got = rows.select(F.max(F.abs(g.tile_y_to_lat(g.lat_to_tile_y("lat", "z"), "z") - F.col("lat"))), F.max(F.abs(g.tile_x_to_lng(g.lng_to_tile_x("lng", "z"), "z") - F.col("lng")))).first()
    assert max(got) < 1e-9


def test_zero_vector_and_wrap(spark):
    az, alt = g.vec_to_az_alt(0.0, 0.0, 0.0)
    r = one(spark).select(alt.alias("alt"), g.wrap_pi(F.lit(3.5)).alias("w"), g.wrap_pi(F.lit(-3.5)).alias("m")).first()
    assert r.alt == 0 and abs(r.w - (3.5 - 2 * 3.141592653589793)) < 1e-12 and abs(r.m + r.w) < 1e-12


def test_nearby_pairs_meet_across_cells_and_the_date_line(spark):
    st = spark.createDataFrame([("S", 10.0, 179.99), ("N", 89.999, 0.0)], "id string, lat double, lng double")
    cp = spark.createDataFrame([("a", 10.0, -179.99), ("b", 10.0, 179.9), ("c", 89.999, 180.0), ("d", 10.0, 0.0)], "id string, est_lat double, est_lng double").withColumn("description", F.lit(""))
    got = {(r.station_id, r.control_point_id) for r in spatial.nearby_pairs(st, cp, 20_000.0).collect()}
    assert got == {("S", "a"), ("S", "b"), ("N", "c")}


@pytest.mark.parametrize("metres", [300.0, 900_000.0])
def test_nearby_pairs_of_crowded_places_are_all_pairs(spark, metres):
    import random

    rng = random.Random(8)
    somewhere = lambda: rng.choice([(47.6 + rng.random() / 200, 179.998 + rng.random() / 500), (rng.uniform(85, 90), rng.uniform(-180, 180)), (rng.uniform(-90, 90), rng.uniform(-180, 180))])
    st = spark.createDataFrame([(f"s{k}", *somewhere()) for k in range(60)], "id string, lat double, lng double").cache()
    cp = spark.createDataFrame([(f"c{k}", *somewhere(), "") for k in range(400)], "id string, est_lat double, est_lng double, description string").withColumn("est_lng", F.when(F.col("est_lng") > 180, F.col("est_lng") - 360).otherwise(F.col("est_lng"))).cache()
    got = sorted((r.station_id, r.control_point_id) for r in spatial.nearby_pairs(st, cp, metres, most=20).collect())
    far = g.ground_distance_m("st_lat", "st_lng", "est_lat", "est_lng")
    every = st.select(F.col("id").alias("s"), F.col("lat").alias("st_lat"), F.col("lng").alias("st_lng")).crossJoin(cp).filter(far <= metres)
    assert got == sorted((r.s, r.id) for r in every.collect()) and len(got) > 300


def test_nearby_pairs_have_no_nested_loop(spark):
    st = spark.createDataFrame([("S", 10.0, 1.0)], "id string, lat double, lng double")
    cp = spark.createDataFrame([("a", 10.0, 1.0, "")], "id string, est_lat double, est_lng double, description string")
    plan = spatial.nearby_pairs(st, cp, 1000.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_diff_then_apply_is_identity(spark):
    was = spark.createDataFrame([(f"{i:013d}", float(i), 1.0, None) for i in range(20)], "id string, lat double, lng double, name string").withColumn("updated_at", F.expr(STAMP))
    now = was.withColumn("lat", F.when(F.col("lat") > 10, F.col("lat") + 1).otherwise(F.col("lat")))
    diff = changes.snapshot_diff(now, was, ["lat", "lng", "name"])
    assert diff.count() == 9
    patched = changes.apply_patches(was, diff.filter("op = 'update'").withColumn("seq", F.lit(1)), "station")
    assert changes.snapshot_diff(now, patched, ["lat", "lng", "name"]).count() == 0


def test_patches_of_a_station_clear_its_name_and_unknown_ids_are_rejected(spark):
    base = spark.createDataFrame([("a", 1.0, 1.0, "name")], "id string, lat double, lng double, name string").withColumn("updated_at", F.expr(STAMP))
    patches = spark.createDataFrame([(1, "a", 2.0, 3.0, None), (2, "zz", 0.0, 0.0, None)], "seq long, id string, lat double, lng double, name string")
    assert [(r.lat, r.lng, r.name) for r in changes.apply_patches(base, patches, "station").collect()] == [(2.0, 3.0, None)]
    assert [r.id for r in changes.rejected_patches(base, patches).collect()] == ["zz"]


def test_hydrated_images_are_shuffled_once(spark):
    when = F.expr(STAMP)
    st = spark.range(30).selectExpr("concat('s', id) as id").withColumn("created_at", when)
    ph = spark.range(100).selectExpr("concat('p', id) as id", "concat('s', id % 25) as station_id").withColumn("created_at", when)
    im = spark.range(900).selectExpr("concat('i', id) as id", "concat('p', id % 100) as photo_id", "case when id % 7 > 0 then concat('c', id % 31) end as control_point_id").withColumn("created_at", when)
    cp = spark.range(28).selectExpr("concat('c', id) as id", "'' as notes").withColumn("created_at", when)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = reads.hydrate_stations(st, ph, im, cp)
        got = rows.collect()
        assert rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Range (0, 900") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    want = {(r.station_id, r.id) for r in reads.station_control_points(cp, im, ph).collect()}
    points = [(r.station_id, p.id) for r in got for p in r.control_points]
    assert len(got) == 30 and sum(len(r.image_measurements) for r in got) == 900 and sum(len(r.photos) for r in got) == 100
    assert set(points) == want and len(points) == len(want) > 300


def test_deletes_of_many_stations_sort_no_table(spark, monkeypatch):
    st = spark.range(300).selectExpr("concat('s', id) as id")
    ph = spark.range(3000).selectExpr("concat('p', id) as id", "concat('s', id % 300) as station_id")
    im = spark.range(9000).selectExpr("concat('i', id) as id", "concat('p', id % 3000) as photo_id")
    ids = st.filter("cast(substring(id, 2) as int) % 3 = 0").repartition(3)
    few = {n: sorted(map(tuple, df.collect())) for n, df in integrity.delete_stations(st, ph, im, ids.unionByName(ids)).items()}
    monkeypatch.setattr(integrity, "MANY_IDS", 50)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = integrity.delete_stations(st, ph, im, ids.unionByName(ids))
        assert {n: sorted(map(tuple, df.collect())) for n, df in left.items()} == few
        assert [len(few[n]) for n in ("stations", "photos", "image_measurements", "blob_ids")] == [200, 2000, 6000, 1000]
        assert "Sort " not in left["image_measurements"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_delete_leaves_no_broken_links(spark):
    st = spark.createDataFrame([("s1",), ("s2",)], "id string")
    ph = spark.createDataFrame([("p1", "s1"), ("p2", "s2")], "id string, station_id string")
    im = spark.createDataFrame([("i1", "p1", "c1"), ("i2", "p2", "c1")], "id string, photo_id string, control_point_id string")
    mm = spark.createDataFrame([("m1", "c1")], "id string, control_point_id string")
    cp = spark.createDataFrame([("c1",)], "id string")
    left = integrity.delete_stations(st, ph, im, st.filter("id = 's1'"))
    assert integrity.fk_violations(left["stations"], left["photos"], left["image_measurements"], mm, cp).count() == 0
    assert [r.id for r in left["blob_ids"].collect()] == ["p1"]
    cut = integrity.delete_control_points(cp, im, mm, cp)
    assert cut["image_measurements"].filter("control_point_id is null").count() == 2 and cut["control_points"].count() == 0


def test_ingest_is_strict(spark):
    bodies = ['{"lat": 1, "lng": 2}', '{"lat": 1}', '{"lat": null, "lng": 2, "name": null}', '{"lat": 1, "x": 2}', '[1]', '{"lat": ', '{"lat": "1", "lng": 2}', '{"lat": 1, "lng": 2, "name": "' + "x" * (1 << 20) + '"}', None]
    raw = spark.createDataFrame([(i, "station", "A" * 13, b) for i, b in enumerate(bodies)], "seq long, entity string, id string, body string")
    good, bad = entities.ingest_patches(raw, "station")
    assert {r.seq: (r.lat, r.lng, r.defaulted) for r in good.collect()} == {0: (1.0, 2.0, False), 1: (1.0, 0.0, True), 2: (0.0, 2.0, True)}
    assert {r.seq: r.reason for r in bad.collect()} == {3: "unknown field", 4: "invalid JSON", 5: "invalid JSON", 6: "wrong type", 7: "body too large", 8: "invalid JSON"}


def test_bodies_are_parsed_once(spark):
    bodies = ['{"LAT": 1, "Lng": 2, "NAME": "Ab \\"LAT\\": 3"}', '{"lat": 1, "lng": 2, "name": "a"}', '{"LNG": "2", "lat": 1}', '{"lat": {"LAT": 2}, "lng": 1}', '{"lat": 1, "Other": 2}']
    raw = spark.createDataFrame([(i, "station", f"id{i}", b) for i, b in enumerate(bodies)], "seq long, entity string, id string, body string")
    good, bad = entities.ingest_patches(raw, "station")
    assert sorted((r.seq, r.lat, r.lng, r.name) for r in good.collect()) == [(0, 1.0, 2.0, 'Ab "LAT": 3'), (1, 1.0, 2.0, "a")]
    assert sorted((r.seq, r.id, r.reason) for r in bad.collect()) == [(2, "id2", "wrong type"), (3, "id3", "wrong type"), (4, "id4", "unknown field")]
    for df in (good, bad):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_photo_files(spark, tmp_path):
    blobs = tmp_path / "photos"
    blobs.mkdir()
    for name, size in (("A" * 13, 10), ("B" * 13, 100), ("C" * 13, 10), ("Z" * 13, 1)):
        (blobs / name).write_bytes(b"x" * size)
    ph = spark.createDataFrame([("A" * 13, "photos/A", "image/png"), ("B" * 13, "photos/B", "image/png"), ("C" * 13, "photos/C", "text/plain"), ("D" * 13, "photos/D", "image/png"), ("E" * 13, None, None)], "id string, blob_path string, mime_type string")
    got = {r.photo_id[0]: r.status for r in entities.photo_blob_catalog(ph, str(blobs), 50).collect()}
    assert got == {"A": "stored", "B": "too_large", "C": "bad_mime", "D": "missing", "Z": "orphan_file"}


def test_aspect_of_whole_cut_and_other_pictures(spark, tmp_path):
    import struct
    import zlib

    folder = tmp_path / "kinds"
    folder.mkdir()
    whole = entities.picture(5, 2, bytes(range(30)))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    # Of two passes only, as the others have no pixels: 1 x 1 and the second column.
    laced = entities.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(b"\0\1\0\2")) + chunk(b"IEND", b"")
    bmp = b"BM" + struct.pack("<IHHI", 54 + 24, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 3, 1, 24, 0, 24, 0, 0, 0, 0) + bytes(24)
    files = {"whole": whole + b" " * 100, "cut": whole[: whole.index(b"IDAT") + 12], "few": whole.replace(struct.pack(">II", 5, 2), struct.pack(">II", 5, 9)), "laced": laced, "bmp": bmp, "like": b"BM, but no picture", "none": b"x"}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.aspect) for r in entities.photo_aspect(spark, str(folder)).collect()}
    none = (None, None, None)
    assert got == {"whole": (5, 2, 2.5), "cut": none, "few": none, "laced": (2, 1, 2.0), "bmp": (2, 3, 2 / 3), "like": none, "none": none}


def test_aspect_and_tiles_from_pictures(spark, tmp_path):
    png(tmp_path / "a" / "one.png", 6, 4, lambda x, y: (1, 2, 3))
    (tmp_path / "a" / "two.png").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: r.aspect for r in entities.photo_aspect(spark, str(tmp_path / "a")).collect()}
    assert got == {"one.png": 1.5, "two.png": None}
    png(tmp_path / "dem" / "z=9" / "x=81" / "179.png", 256, 256, lambda x, y: (128, x, y))
    tile = entities.dem_tiles(spark, str(tmp_path / "dem")).first()
    assert (tile.z, tile.x, tile.y) == (9, 81, 179) and tile.elev[256 * 3 + 7] == 7 + 3 / 256


def test_hillshade_of_flat_and_missing_tiles(spark):
    tiles = spark.createDataFrame([(9, 1, 1, [5.0] * 65536), (9, 2, 2, None)], "z int, x int, y int, elev array<double>")
    assert {(r.x, r.gray) for r in terrain.hillshade(tiles).select("x", "gray").distinct().collect()} == {(1, 180), (2, 16)}


def poses(spark, noise_m):
    """Stations with three photos of five points each; points stand where the true photos see them, and have a prior there."""
    import numpy as np

    rng = np.random.default_rng(4)
    st, ph, an, pr = [], [], [], []
    for s in range(6):
        lat, lng = round(47 + s / 100, 3), round(-122 + s / 100, 3)
        st.append((f"s{s}", lat + 0.002, lng - 0.002))
        for p in range(3):
            az, size = round(rng.uniform(-2, 2), 3), round(rng.uniform(0.6, 1.2), 3)
            ph.append((f"p{s}{p}", az + 0.03, 0.1, 0.0, size * 1.1, 1.5))
            for k, (u, v) in enumerate(rng.uniform(0.05, 0.95, (5, 2))):
                seen, d, cp = solve.seen_az(az, 0.1, 0.0, size, 1.5, u, v), rng.uniform(500, 8000) / 6371000, f"c{s}{p}{k}"
                a = np.radians(lat)
                b = np.arcsin(np.sin(a) * np.cos(d) + np.cos(a) * np.sin(d) * np.cos(-seen))
                to = np.degrees(b), lng + np.degrees(np.arctan2(np.sin(-seen) * np.sin(d) * np.cos(a), np.cos(d) - np.sin(a) * np.sin(b)))
                off = rng.normal(0, noise_m / 111320, 2)
                an.append((f"s{s}", f"p{s}{p}", f"i{cp}", float(u), float(v), cp, float(to[0]), float(to[1])))
                pr.append((f"s{s}", cp, float(to[0] + off[0]), float(to[1] + off[1])))
    return (
        spark.createDataFrame(st, "id string, lat double, lng double"), spark.createDataFrame(ph, "id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double"),
        spark.createDataFrame(an, "station_id string, photo_id string, id string, u double, v double, control_point_id string, est_lat double, est_lng double"), spark.createDataFrame(pr, "station_id string, control_point_id string, lat double, lng double"),
    )


def test_free_camera_is_recovered(spark):
    st, ph, an, pr = poses(spark, 0.0)
    got = solve.solve_station_poses(st, ph, an, pr)["stations"].orderBy("station_id").collect()
    assert [(round(r.lat, 3), round(r.lng, 3)) for r in got] == [(round(47 + s / 100, 3), round(-122 + s / 100, 3)) for s in range(6)]
    assert all(r.camera_moved for r in got)


def test_noise_never_raises_the_residual(spark):
    st, ph, an, pr = poses(spark, 20.0)
    solved = {r.station_id: r for r in solve.solve_station_poses(st, ph, an, pr)["stations"].collect()}
    import numpy as np

    rows = an.join(ph.withColumnRenamed("id", "photo_id"), "photo_id").join(st.select(F.col("id").alias("station_id"), F.col("lat").alias("st_lat"), F.col("lng").alias("st_lng")), "station_id").toPandas()
    held = pr.toPandas().rename(columns={"control_point_id": "point", "lat": "p_lat", "lng": "p_lng"})
    for s, group in rows.groupby("station_id"):
        p = solve.StationProblem(group, held[held["station_id"] == s], False, False)
        start = np.sqrt(np.mean(p.residuals(p.value) ** 2))
        assert solved[s].residual_rms < start


def test_nothing_free_returns_the_start(spark):
    st, ph, an, pr = poses(spark, 0.0)
    one_point = an.filter("control_point_id = 'c000'")
    got = solve.solve_station_poses(st, ph, one_point, pr.limit(0))
    assert got["stations"].first().camera_moved is False and got["photos"].count() == 1


def test_large_points_are_solved_from_sums_alike(spark):
    from sightline.plans.geometric import planted_observations
    from sightline.sources.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    photos, images = planted_observations(t)
    few = t.cp.orderBy("id").limit(3)
    a = {r.control_point_id: r for r in solve.solve_cp_locations(few, images, photos, t.st, t.mm).collect()}
    b = {r.control_point_id: r for r in solve.solve_cp_locations(few, images, photos, t.st, t.mm, most_rows=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k].lat - b[k].lat) < 1e-6 and abs(a[k].iterations - b[k].iterations) <= 1 for k in a)


def test_points_that_stall_start_once_more(spark):
    """A point without an estimate starts at the mean of its stations, from where no part of a step helps."""
    places = [
        (47.05116, -121.34489), (47.91696, -121.5572), (47.9966, -121.13348), (47.74978, -121.38825), (47.29599, -121.25327),
        (47.12761, -121.68898), (47.33686, -121.40354), (47.25492, -121.74963), (47.1409, -121.42542), (47.47717, -121.4431),
        (47.97222, -121.49126), (47.7127, -121.24378), (47.06685, -121.4451), (47.05556, -121.59606), (47.94674, -121.20052),
        (47.38403, -121.78819),
    ]
    lat, lng = 47.212, -121.159
    st = spark.createDataFrame([(f"s{k}", *at, "") for k, at in enumerate(places)], "id string, lat double, lng double, name string")
    az = solve.expected_az(*np.array(places).T, np.full(len(places), lat), np.full(len(places), lng))
    ph = spark.createDataFrame([(f"p{k}", f"s{k}", float(z), 0.0, 0.0, 1.0, 1.5) for k, z in enumerate(az)], "id string, station_id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double")
    im = ph.select(F.concat(F.lit("i"), "id").alias("id"), F.col("id").alias("photo_id"), F.lit(0.5).alias("u"), F.lit(0.5).alias("v"), F.lit("c").alias("control_point_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("created_at"))
    cp = spark.createDataFrame([("c", None, None)], "id string, est_lat double, est_lng double")
    mm = spark.createDataFrame([], "id string, lat double, lng double, control_point_id string, created_at timestamp_ntz")
    for most in (1_000_000, 0):
        got = solve.solve_cp_locations(cp, im, ph, st, mm, most_rows=most).first()
        assert abs(got.lat - lat) < 1e-5 and abs(got.lng - lng) < 1e-5


def test_lines_of_sight_meet_places_on_the_map():
    """At the date line and near a pole; the map alone, lines alone, and both."""
    for lat, lng in ((10.0, 179.9999), (89.99, 20.0), (-45.0, -180.0)):
        a, b = lat + np.array([-0.1, -0.2, 0.0]) * (-1 if lat < 0 else 1), lng + np.array([0.3, -0.1, 0.0])
        is_map = np.array([0.0, 0.0, 1.0])
        az = np.where(is_map > 0, 0.0, solve.expected_az(a, b, np.full(3, lat), np.full(3, lng)))
        for some in ([0, 1], [2], [0, 1, 2]):
            sums = [np.array([x[some].sum()]) for x in solve._line_products(np, is_map, a, b, az)]
            to_lat, to_lng = solve._meeting_places(sums, a[:1], b[:1])
            assert abs(to_lat[0] - lat) < 1e-6 and abs((to_lng[0] - lng + 180) % 360 - 180) < 1e-3


def test_planted_ids_are_unique_beyond_100_000_parts(spark, tmp_path):
    from sightline.plans import geometric
    from sightline.sources.fixtures import Tables

    # 1 * 100000 + 200001 = 2 * 100000 + 100001
    made = {
        "customer": "select id as c_custkey, 'n' as c_name from range(3)",
        "orders": "select id as o_orderkey, id as o_custkey, timestamp_ntz '2020-01-01 00:00:00' as o_orderdate from range(3)",
        "part": "select id as p_partkey from values (100001L), (200001L) as t(id)",
        "lineitem": "select o as l_orderkey, p as l_partkey, timestamp_ntz '2020-01-01 00:00:00' as l_shipdate from values (1L, 200001L), (2L, 100001L) as t(o, p)",
    }
    for name, text in made.items():
        spark.sql(text).write.parquet(str(tmp_path / f"{name}.parquet"))
    photos, images = geometric.planted_observations(Tables(spark, str(tmp_path)))
    assert photos.select("id").distinct().count() == images.select("id").distinct().count() == 2
    assert images.join(photos, F.col("photo_id") == photos["id"]).count() == 2


def test_two_priors_on_one_point_count_twice(spark):
    st, ph, an, pr = poses(spark, 0.0)
    doubled = solve.solve_station_poses(st, ph, an, pr.unionByName(pr))["stations"].filter("station_id = 's0'").first()
    assert abs(doubled.lat - 47) < 1e-3


def test_registered_rings_are_whole(spark):
    import numpy as np

    from sightline.plans import geometric, relational

    class One:
        st = spark.createDataFrame([("s", 47.6, -122.3)], "id string, lat double, lng double")

    rings, (lat, lng) = terrain.RINGS, (47.6, -122.3)
    got = geometric._vertices(One).toPandas()
    assert len(got) == 3 * 641 * 641 and {"ring_vertices", "ring_bounds", "ring_quads"} <= set(relational.SQL)
    height = lambda x, y, px, py: np.where((x + y) % 7 == 0, 0.0, (px * 3 + py * 5 + x * 7 + y * 13) % 256 + (px * 7 + py * 11) % 256 / 256)
    place = lambda z: (2**z * (lng + 180) / 360, 2**z * (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2)
    (fx, fy) = place(rings[0][1])
    cam = height(int(fx), int(fy), int((fx - int(fx)) * 256), int((fy - int(fy)) * 256))
    bounds = {r.ring: r for r in terrain.ring_bounds(One.st).collect()}
    cells = {k: np.zeros((640, 640), int) for k, *_ in rings}
    for r in terrain.ring_quads(One.st).collect():
        assert r.nx == 641 and r.a == r.j_first * 641 + r.i_first
        cells[r.ring][r.j_first : r.j_last + 1, r.i_first : r.i_last + 1] += 1 if r.kept else 10
    before = None
    for ring, z, radius, stride in rings:
        n = 256 // stride * (2 * radius + 1) + 1
        cx, cy = (int(v) for v in place(z))
        j, i = np.mgrid[0:n, 0:n]
        tx, px, ty, py = cx - radius + i * stride // 256, i * stride % 256, cy - radius + j * stride // 256, j * stride % 256
        x = ((tx + px / 256) / 2**z * 360 - 180 - lng) * 111320 * math.cos(math.radians(lat))
        zz = -(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (ty + py / 256) / 2**z)))) - lat) * 111320
        elev = np.where((i == n - 1) | (j == n - 1), 0.0, height(tx, ty, px, py))
        mine = got[got.ring == ring].sort_values(["j", "i"])
        for name, want in (("x", x), ("z", zz), ("y", elev - cam - 0.86 / 12742000 * (x * x + zz * zz))):
            assert np.allclose(mine[name].to_numpy(), want.ravel(), rtol=1e-9, atol=1e-3), (ring, name)
        b = bounds[ring]
        assert np.allclose([b.x_min, b.x_max, b.z_min, b.z_max], [x.min(), x.max(), zz.min(), zz.max()], atol=1e-3)
        # Every cell is in one rectangle, and hidden where the ring before covers it.
        hidden = np.zeros((640, 640), bool) if before is None else (x[:-1, :-1] >= before[0]) & (x[1:, 1:] <= before[1]) & (zz[:-1, :-1] >= before[2]) & (zz[1:, 1:] <= before[3])
        assert (cells[ring] == np.where(hidden, 10, 1)).all() and hidden.any() == (before is not None)
        before = x.min(), x.max(), zz.min(), zz.max()


def test_height_field_rows_and_columns_give_the_vertices(spark):
    st = spark.createDataFrame([("s", 47.6, -122.3), ("t", -33.1, 179.99)], "id string, lat double, lng double")
    rings = terrain.with_stride(64)
    tiles = terrain.tile_windows(st).select("z", "x", "y").distinct().filter("(x + y) % 5 <> 0").withColumn("elev", F.transform(F.sequence(F.lit(0), F.lit(65535)), lambda k: k % 97 + F.col("x") % 5 / F.lit(256.0))).cache()
    rows = {(r.station_id, r.ring, r.j): r for r in terrain.ring_rows(st, tiles, rings).collect()}
    columns = {(r.station_id, r.ring, r.i): r for r in terrain.ring_columns(st, rings).collect()}
    vertices = terrain.ring_vertices(st, tiles, rings).collect()
    assert len(rows) == len(columns) == 2 * 3 * 21 and len(vertices) == 2 * 3 * 21 * 21
    for v in vertices:
        r, c = rows[v.station_id, v.ring, v.j], columns[v.station_id, v.ring, v.i]
        assert (v.x, v.z, v.u, v.v) == (c.x, r.z, c.u, r.v) and abs(v.y - (r.elev[v.i] - r.base - c.drop)) < 1e-9
    flat = {(r.station_id, r.ring, r.j): r.base for r in terrain.ring_rows(st, tiles, rings, curvature=False).collect()}
    assert len({(k[0], b) for k, b in flat.items()}) == 2


def test_sun_stands_where_it_should(spark):
    # Noon of the equinox on the equator at Greenwich: overhead; the solstice at 47.6 north, at noon and a quarter of a day before.
    rows = spark.createDataFrame([(953554050.0, 0.0, 0.0), (961588920.0, 47.6, 0.0), (961567200.0, 47.6, 0.0)], "t double, lat double, lng double")
    az, alt = g.solar_az_alt("t", "lat", "lng")
    a, b, c = rows.orderBy(F.col("lat"), F.col("t").desc()).select(F.degrees(az).alias("az"), F.degrees(alt).alias("alt")).collect()
    assert a.alt > 87 and abs(b.alt - (90 - 47.6 + 23.44)) < 1 and 70 < c.az < 78


def brute_panorama(photos, width):
    """Every cell of every photo's station against every photo, by the ray's place in the photo's frame."""
    out = {}
    for j in range(width // 2):
        for i in range(width):
            lon, lat = ((i + 0.5) / width - 0.5) * 2 * math.pi, ((j + 0.5) / (width // 2) - 0.5) * math.pi
            ray = math.cos(lon) * math.cos(lat), math.sin(lat), math.sin(lon) * math.cos(lat)
            for p, s, az, tilt, roll, size, aspect in photos:
                a, e = math.atan2(-ray[0], -ray[2]) - az, math.asin(ray[1])
                right, level, up = -math.cos(e) * math.sin(a), math.cos(e) * math.cos(a), math.sin(e)
                ahead, above = level * math.cos(tilt) + up * math.sin(tilt), up * math.cos(tilt) - level * math.sin(tilt)
                if ahead <= 0:
                    continue
                x, y = right / ahead, above / ahead
                u, v = (x * math.cos(roll) + y * math.sin(roll)) / (2 * math.tan(size / 2)) + 0.5, (y * math.cos(roll) - x * math.sin(roll)) * aspect / (2 * math.tan(size / 2)) + 0.5
                if 0 <= u <= 1 and 0 <= v <= 1:
                    out.setdefault((s, i, j), []).append(p)
    return out


def test_panorama_in_runs_is_that_of_all_cells(spark):
    import random

    rng = random.Random(3)
    photos = [(f"p{k}", f"s{k % 3}", rng.uniform(-3.14, 3.14), rng.uniform(-1.5, 1.5), rng.uniform(-3, 3), rng.choice([0.03, 0.2, 0.9, 2.6]), rng.uniform(0.5, 2)) for k in range(24)]
    ph = spark.createDataFrame(photos, "id string, station_id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double")
    width = 64
    runs = spatial.panorama_coverage(ph, width)
    rows, want = runs.collect(), brute_panorama(photos, width)
    got = {(r.station_id, i, r.j): r.photo_ids for r in rows for i in range(r.i_first, r.i_last + 1)}
    assert len(got) == sum(r.i_last - r.i_first + 1 for r in rows) == 3 * width * width // 2
    assert {k: v for k, v in got.items() if v} == {k: sorted(v) for k, v in want.items()} and all(r.n_photos == len(r.photo_ids) for r in rows)
    shares = {r.station_id: r.uncovered for r in spatial.panorama_uncovered(runs, width).collect()}
    assert all(abs(shares[s] - sum(k[0] == s and not v for k, v in got.items()) / (width * width // 2)) < 1e-9 for s in shares)


def test_boxes_of_any_size_have_few_cells(spark):
    import random

    rng = random.Random(5)
    boxes = [("world", -180.0, -90.0, 180.0, 90.0), ("point", 10.0, 10.0, 10.0, 10.0), ("none", 1.0, 1.0, 0.0, 0.0)] + [(f"b{k}", x, y, x + w, y + h) for k in range(40) for x, y, w, h in [(rng.uniform(-180, 100), rng.uniform(-90, 60), 10 ** rng.uniform(-4, 1.8), 10 ** rng.uniform(-4, 1.4))]]
    points = [(f"p{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(800)] + [("at", 10.0, 10.0), ("edge", 90.0, 180.0)]
    got = {(r.box_id, r.id) for r in reads.boxes_join(spark.createDataFrame(boxes, "box_id string, min_lng double, min_lat double, max_lng double, max_lat double"), spark.createDataFrame(points, "id string, lat double, lng double")).collect()}
    assert got == {(b, p) for b, x0, y0, x1, y1 in boxes for p, lat, lng in points if x0 <= lng <= x1 and y0 <= lat <= y1}


def test_crowded_places_are_split(spark):
    """90 % of the points in one street, a tenth of all in one spot, some beyond the map's rows: cells hold the bound, rows are those of all pairs."""
    import random

    rng = random.Random(7)
    street = [(f"s{k}", 47.6 + rng.random() / 2000, -122.3 + rng.random() / 2000) for k in range(1600)]
    points = street + [(f"o{k}", 47.6001, -122.3001) for k in range(200)] + [(f"w{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(200)] + [(f"n{k}", 88.0, 5.0) for k in range(40)] + [("none", None, 1.0), ("nan", float("nan"), 1.0)]
    boxes = [("world", -180.0, -90.0, 180.0, 90.0), ("spot", -122.3001, 47.6001, -122.3001, 47.6001), ("north", 0.0, 86.0, 10.0, 90.0), ("empty", None, 0.0, 1.0, 1.0)]
    boxes += [(f"b{k}", x, y, x + w, y + h) for k in range(60) for x, y, w, h in [(-122.3 + rng.random() / 2000, 47.6 + rng.random() / 2000, rng.random() / 4000, rng.random() / 4000)]]
    b, p = spark.createDataFrame(boxes, "box_id string, min_lng double, min_lat double, max_lng double, max_lat double"), spark.createDataFrame(points, "id string, lat double, lng double")
    got = [(r.box_id, r.id) for r in reads.boxes_join(b, p, most=50).collect()]
    want = {(b, p) for b, x0, y0, x1, y1 in boxes if x0 is not None for p, lat, lng in points if lat is not None and x0 <= lng <= x1 and y0 <= lat <= y1}
    assert set(got) == want and len(got) == len(want)
    spots = p.filter("lat is not null and not isnan(lat)").select("id", reads.map_x(F.col("lng")).alias("x"), reads.map_y(F.col("lat")).alias("y"), F.pmod(F.xxhash64("id"), F.lit(4096)).alias("h"))
    split, deepest = reads._split_cells(spots, 50)
    leaves = reads._cells_of(spots, 0, deepest + 1).join(split.select(*reads.CELL), reads.CELL, "left_anti").groupBy("id").agg(F.min(F.struct(*reads.CELL)).alias("leaf"))
    assert deepest >= reads.PLACE_LEVELS and leaves.count() == len(points) - 2
    assert leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 50


def test_pairs_of_few_boxes_are_dealt_to_many_tasks(spark, monkeypatch):
    """Small tables with many pairs: the work is dealt by pairs, not by the size of the tables, and one crowded cell is shared out."""
    monkeypatch.setattr(reads, "TASK_PAIRS", 1000)
    boxes = [(f"b{k}", 9.9, 9.9, 10.1, 10.1) for k in range(200)] + [(f"w{k}", -10.0, -10.0, 20.0, 20.0) for k in range(100)]
    points = [(f"p{k}", 10.0, 10.0) for k in range(150)] + [(f"q{k}", k / 20, k / 20) for k in range(200)]
    b, p = spark.createDataFrame(boxes, "box_id string, min_lng double, min_lat double, max_lng double, max_lat double").coalesce(1), spark.createDataFrame(points, "id string, lat double, lng double").coalesce(1)
    rows = reads.boxes_join(b, p)
    got = [(r.box_id, r.id) for r in rows.collect()]
    want = {(b, p) for b, x0, y0, x1, y1 in boxes for p, lat, lng in points if x0 <= lng <= x1 and y0 <= lat <= y1}
    assert set(got) == want and len(got) == len(want)
    tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 20 and max(tasks) < len(got) / 5


def test_observations_carry_the_fields_that_are_asked_for(spark, monkeypatch):
    from sightline.plans import relational
    from sightline.sources.fixtures import Tables

    sf = "/root/testdata/sf0.001"
    plan = relational.QUERIES["cp_observations"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "station_lat" in plan and "photo_tilt" not in plan and "station_name" not in plan
    t = Tables(spark, sf)
    tables = t.cp, t.im, t.ph, t.st, t.mm
    whole = {r.control_point_id: r for r in reads.cp_observations(*tables).collect()}
    seen = next(r for r in whole.values() if r.image_measurements and r.map_measurements)
    assert seen.image_measurements[0].__fields__ == ["created_at", "id", *reads.IMAGE_FIELDS] and seen.map_measurements[0].__fields__ == ["created_at", "id", *reads.MAP_FIELDS]
    some = sorted(whole)[::17]
    asked = spark.createDataFrame([(k,) for k in [*some, some[0], "none"]], "id string")
    assert sorted(reads.cp_observations(*tables, asked).collect()) == [whole[k] for k in some]
    # Images are not shuffled for their stations: these meet the photos first.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = [x for x in reads.cp_image_observations(t.im, t.ph, t.st)._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(joins) == 2 and "photo_id" in joins[0] and "station_id" in joins[1]


def test_bitmaps_of_previews_are_not_shuffled(spark):
    ph = spark.createDataFrame([(f"p{k}", f"s{k % 40}") for k in range(80)], "id string, station_id string")
    im = spark.createDataFrame([(f"i{k}", f"p{k % 80}", f"c{k % 97}") for k in range(4000)], "id string, photo_id string, control_point_id string")
    numbers = spark.createDataFrame([(f"c{k}", k * 40_000) for k in range(97)], "control_point_id string, n long")
    bits = reads.station_preview_bits(im, ph, numbers)
    got = {(r.station_id, r.bucket): r.observed for r in bits.collect()}
    assert len(got) == 40 * 97 and all(sum(b.bit_count() for b in v) == 1 for v in got.values())
    plan = bits._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("bitmap_construct_agg"):].split("Exchange")[0]
    assert below.count("bitmap_construct_agg") > 1 and "partial_bitmap_construct_agg" in below


def test_previews_in_blocks(spark):
    st = spark.createDataFrame([(f"s{k}",) for k in range(9)], "id string")
    ph = spark.createDataFrame([("p1", "s1")], "id string, station_id string")
    im = spark.createDataFrame([("i1", "p1", "c1")], "id string, photo_id string, control_point_id string")
    cp = spark.createDataFrame([("c1", 1.0, 1.0, ""), ("c2", 1.0, 1.0, ""), ("c3", None, 1.0, "")], "id string, est_lat double, est_lng double, description string")
    asked = st.filter("id < 's7'").unionByName(st)
    one, many = (sorted(map(tuple, reads.station_preview(st, ph, im, cp, asked, n).collect())) for n in (10_000, 2))
    assert one == many and len(one) == 18 and [r for r in one if r[2]] == [("s1", "c1", True)]
    # The same from bitmaps, for points whose numbers lie far apart and in one byte.
    cp = spark.createDataFrame([(f"c{k}", 1.0, 1.0, "") for k in range(40)], "id string, est_lat double, est_lng double, description string").repartition(3)
    im = spark.createDataFrame([(f"i{k}", "p1", f"c{k}") for k in range(0, 40, 3)], "id string, photo_id string, control_point_id string")
    numbers = reads.point_numbers(cp)
    got = reads.preview_of(reads.station_preview_bits(im, ph, numbers), numbers, st)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reads.station_preview(st, ph, im, cp, st).collect()))


def test_ranks_of_a_popular_key_are_dealt_to_ranges(spark):
    rows = [("hot" if k % 3 == 0 else f"k{k % 50}", k * 7919 % 1000, f"{k:04d}") for k in range(1500)]
    df = spark.createDataFrame(rows, "key string, at int, id string").repartition(5)
    want = sorted(reads.ranked(df, "key", ["at", "id"], "n").collect())
    assert [r.n for r in want if r.key == "hot"] != [] and max(r.n for r in want) == 500
    assert sorted(reads.ranked(df, "key", ["at", "id"], "n", 100).collect()) == want
    assert sorted(reads.ranked(df.filter("key = 'hot'"), "key", ["at", "id"], "n", 100).collect()) == [r for r in want if r.key == "hot"]
    assert reads.ranked(df.limit(0), "key", ["at", "id"], "n").count() == 0


def test_clicks_look_at_the_columns_in_reach_only(spark):
    """Equal rows to all pairs: clicks at the zenith and the nadir, behind the camera, across north, and a point at the station."""
    import random

    rng = random.Random(8)
    st = spark.createDataFrame([("s", 47.0, -122.0)], "id string, lat double, lng double")
    points = [("s", f"c{k}", 47.0 + rng.uniform(-0.2, 0.2), -122.0 + rng.uniform(-0.2, 0.2)) for k in range(300)] + [("s", "here", 47.0, -122.0), ("s", "north", 47.1, -122.0), ("s", "south", 46.9, -122.0)]
    located = spark.createDataFrame(points, "station_id string, control_point_id string, lat double, lng double")
    clicks = [(k, "s", rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-7, 7), rng.choice([0.0, 0.1, 1.2, 1.5707, -1.5, 1.6]), rng.choice([5.0, 60.0, 120.0]), rng.choice([0.5, 1.0, 2.5])) for k in range(150)] + [(900, "s", 0.0, 0.0, math.pi, 0.0, 60.0, 1.0), (901, "s", 0.0, 0.0, 0.0, 0.0, 60.0, 1.0)]
    asked = spark.createDataFrame(clicks, "click_id int, station_id string, ndc_x double, ndc_y double, cam_az double, cam_alt double, fov_deg double, aspect double")
    run = lambda: sorted(map(tuple, spatial.match_clicks_to_columns(asked, st, located).collect()))
    got, n = run(), spatial.click_candidates(asked, st, located).count()
    every = spatial._click_bins
    try:
        spatial._click_bins = lambda radius: F.sequence(F.lit(-1), F.lit(spatial.CLICK_BINS - 1))
        assert run() == got and spatial.click_candidates(asked, st, located).count() == len(clicks) * len(points)
    finally:
        spatial._click_bins = every
    assert sum(r[1] is not None for r in got) > 20 and n < len(clicks) * len(points) / 3


def test_clicks_are_shuffled_for_few_bins(spark):
    """A click meets a bin and the one opposite at once, and a point at its station only on the middle of its screen."""
    st = spark.createDataFrame([("s", 47.0, -122.0)], "id string, lat double, lng double")
    located = spark.createDataFrame([("s", "here", 47.0, -122.0)], "station_id string, control_point_id string, lat double, lng double")
    shape = "click_id int, station_id string, ndc_x double, ndc_y double, cam_az double, cam_alt double, fov_deg double, aspect double"
    middle = spark.createDataFrame([(k, "s", x, 1 / math.tan(1.2), 0.7, 1.2, 90.0, 1.0) for k, x in enumerate((0.0, -0.005, 0.0101, 0.5))], shape)
    got = {r.click_id: (r.control_point_id, r.dist and round(r.dist, 9)) for r in spatial.match_clicks_to_columns(middle, st, located).collect()}
    assert got == {0: ("here", 0.0), 1: ("here", 0.005), 2: (None, None), 3: (None, None)}
    level = spark.createDataFrame([(k, "s", 0.5, 0.1, k * 0.0314 - 3.14, 0.1, 60.0, 1.0) for k in range(200)], shape)
    bins = [r.bins for r in level.select(spatial._click_bins(0.01).alias("bins")).collect()]
    assert max(map(len, bins)) <= 2 and all(b >= 0 for row in bins for b in row)
    # Neither lambdas, which Spark does not compile, nor a filter that works the bins out again.
    plan = spatial.click_candidates(level, st, located)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("sequence(") == 1


def test_photos_look_at_the_points_in_reach_only(spark, monkeypatch):
    import random

    rng = random.Random(9)
    st = spark.createDataFrame([("s", 47.0, -122.0)], "id string, lat double, lng double")
    photos = [(f"p{k}", "s", rng.uniform(-4, 4), rng.choice([0.0, 0.3, 1.4, -1.5, 1.7]), rng.uniform(-3, 3), rng.choice([0.1, 0.8, 2.0]), rng.uniform(0.5, 2)) for k in range(60)]
    ph = spark.createDataFrame(photos, "id string, station_id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double")
    cp = spark.createDataFrame([(f"c{k}", 47.0 + rng.uniform(-0.2, 0.2), -122.0 + rng.uniform(-0.2, 0.2), rng.choice([None, 0.0, 9000.0, -500.0]), "") for k in range(150)] + [("here", 47.0, -122.0, 100.0, "")], "id string, est_lat double, est_lng double, est_alt double, description string")
    im = cp.select(F.concat(F.lit("i"), "id").alias("id"), F.lit("p0").alias("photo_id"), F.col("id").alias("control_point_id"))
    run = lambda: sorted(map(tuple, spatial.locate_on_photo(ph, st, cp, im).collect()))
    got = run()
    monkeypatch.setattr(spatial, "_bins_in_reach", lambda *a: F.sequence(F.lit(-1), F.lit(spatial.PHOTO_BINS - 1)))
    assert run() == got and len(got) > 300


def test_ids_of_many_photos_of_a_request(spark):
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    asked = spark.range(1, 4).select(F.col("id").alias("key"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng"), F.lit("n").alias("name"), F.array_repeat(F.lit(1.5), 5000).alias("aspects"), at.alias("at"))
    got = changes.start_stations(asked)["photos"]
    assert got.count() == got.select("id").distinct().count() == 15_000
    with pytest.raises(Exception, match="no key for the pair"):
        changes.start_stations(asked.withColumn("key", F.lit(1 << 40)))["photos"].collect()


def test_many_files_are_what_was_given(spark, tmp_path):
    """Byte for byte, also of a task that runs again, and under names that tell the key."""
    rows = spark.createDataFrame([(k, bytes([k % 251, 200, 10, 0])) for k in (0, 3, 249, 250, 1007)], "k long, data binary").repartition(3)
    for path in (str(tmp_path / "a"), f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        for _ in range(2):
            names = entities.write_many_files(rows, path, "k")
        files = spark.read.format("binaryFile").load(path).withColumn("name", entities.numbered_name(F.col("path"))).join(names, "name")
        assert {r.k: bytes(r.content) for r in files.collect()} == {r.k: bytes(r.data) for r in rows.collect()}
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a", "b", "c"] and len(list((tmp_path / "a").iterdir())) == 5


def test_tiles_as_pictures_and_back(spark, tmp_path):
    elev = [float(k % 9000) - 400 + (k % 256) / 256 for k in range(65536)]
    tiles = spark.createDataFrame([(9, 1, 2, elev), (11, 700, 3, [0.0] * 65536), (7, 5, 5, None)], "z int, x int, y int, elev array<double>")
    path = entities.write_dem_tiles(tiles, str(tmp_path / "tiles"))
    entities.write_files(spark.createDataFrame([(9, 4, 4, b"no picture"), (9, 4, 5, entities.picture(4, 4, bytes(48)))], "z int, x int, y int, data binary"), f"{path}/odd", "z", "x", "y")
    got = {(r.z, r.x, r.y): r.elev for r in entities.dem_tiles(spark, path).collect()}
    assert got == {(9, 1, 2): elev, (11, 700, 3): [0.0] * 65536}


def test_linked_to_a_selection(spark):
    im = spark.createDataFrame([("i1", "c1"), ("i2", "c1"), ("i3", None)], "id string, control_point_id string")
    mm = spark.createDataFrame([("m1", "c1"), ("i1", "c2")], "id string, control_point_id string")
    classes = {(r.measurement_id, r.kind): (r.control_point_id, r.n_image, r.n_map) for r in reads.linked_measurements(im, mm).collect()}
    assert classes == {("i1", "image"): ("c1", 1, 1), ("i2", "image"): ("c1", 1, 1), ("m1", "map"): ("c1", 2, 0), ("i1", "map"): ("c2", 0, 0)}
    chosen = spark.createDataFrame([("i1", "image"), ("i1", "image")], "measurement_id string, kind string")
    assert {(r.other_id, r.other_kind) for r in reads.linked_to(im, mm, chosen).collect()} == {("i2", "image"), ("m1", "map")}


def station_rows(spark):
    return spark.createDataFrame([(f"s{k}", 1.0, 1.0, f"n{k}") for k in range(6)], "id string, lat double, lng double, name string").withColumns({"created_at": F.expr(STAMP), "updated_at": F.expr(STAMP)})


def patch_stream(spark, path, rows):
    schema = "seq long, id string, lat double, lng double, name string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_streams_keep_each_other_s_updates(spark, tmp_path):
    store = feeds.EntityStore(spark, str(tmp_path / "store"), most_changes=3, buckets=4)
    store.create_table("stations", station_rows(spark))
    rejected = []
    for k in range(5):
        stream = patch_stream(spark, str(tmp_path / f"feed{k}"), [(1, f"s{k}", 2.0, 2.0, f"stream {k}"), (2, "zz", 0.0, 0.0, None)])
        feeds.stream_apply_patches(stream, store, "stations", str(tmp_path / f"state{k}"), rejects=lambda df, n: rejected.extend(r.id for r in df.collect())).awaitTermination()
    assert {r.id: r.name for r in store.read("stations").collect()} == {f"s{k}": f"stream {k}" if k < 5 else "n5" for k in range(6)}
    assert rejected == ["zz"] * 5 and store.generation("stations") == 1 and len(store.changes("stations")) == 3
    # A stream that goes on, and a batch that runs again.
    stream = patch_stream(spark, str(tmp_path / "feed4"), [(3, "s4", 3.0, 3.0, "more")])
    feeds.stream_apply_patches(stream, store, "stations", str(tmp_path / "state4")).awaitTermination()
    before = sorted(store.read("stations").collect())
    for name in ("1", ".1.crc"):
        (tmp_path / "state4" / "commits" / name).unlink()
    feeds.stream_apply_patches(spark.readStream.schema(stream.schema).parquet(str(tmp_path / "feed4")), store, "stations", str(tmp_path / "state4")).awaitTermination()
    assert sorted(store.read("stations").collect()) == before and {r.id: r.name for r in before}["s4"] == "more"
    # Only touched rows are written for a batch.
    last = [c for c in store.changes("stations") if c != feeds.WHOLE]
    assert [spark.read.parquet(str(tmp_path / "store" / "stations" / "2" / f"change={c}")).count() for c in last] == [1]
    # A reader that knows its ids reads their buckets only.
    some = store.read("stations", spark.createDataFrame([("s4",)], "id string"))
    assert [r.name for r in some.collect()] == ["more"] and "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().toString().replace("[bucket", "[isnotnull(bucket")


CP_PATCH = "seq long, id string, description string, notes string, est_lat double, est_lng double, est_alt double, started_at timestamp_ntz, ended_at timestamp_ntz, at timestamp_ntz"


def test_any_order_and_split_of_patches_gives_the_same_table(spark, tmp_path):
    import datetime
    import random

    stamps = {"created_at": F.expr(STAMP), "updated_at": F.expr(STAMP)}
    cp = spark.createDataFrame([(f"c{k}", f"d{k}", "n", 1.0, 1.0, None, None, None) for k in range(5)], "id string, description string, notes string, est_lat double, est_lng double, est_alt double, started_at timestamp_ntz, ended_at timestamp_ntz").withColumns(stamps)
    for seed in (1,):
        rng = random.Random(seed)
        any_of = lambda *x: rng.choice(x)
        rows = [(k, f"c{rng.randrange(6)}", any_of(None, f"text {k}"), any_of(None, f"note {k}"), any_of(None, float(k)), 2.0, any_of(None, float(-k)), None, None, any_of(None, datetime.datetime(2024, 1, 1 + k))) for k in range(20)]
        want = sorted(map(tuple, changes.apply_patches(cp, spark.createDataFrame(rows, CP_PATCH), "control_point").collect()), key=repr)
        store = feeds.EntityStore(spark, str(tmp_path / f"store{seed}"), most_changes=2, buckets=3)
        store.create_table("control_points", cp)
        dealt = rows + rng.sample(rows, 6)
        rng.shuffle(dealt)
        for n, at in enumerate(range(0, len(dealt), 7)):
            feeds.patch_batch(store, "control_points", spark.createDataFrame(dealt[at : at + 7], CP_PATCH), f"b{n}")
        feeds.patch_batch(store, "control_points", spark.createDataFrame(dealt[:7], CP_PATCH), "b0")
        assert sorted(map(tuple, store.read("control_points").select(*cp.columns).collect()), key=repr) == want


def test_a_solution_is_newer_than_its_patch_and_older_than_the_next(spark, tmp_path):
    cp = spark.createDataFrame([("c", 1.0, 1.0)], "id string, est_lat double, est_lng double")
    store = feeds.EntityStore(spark, str(tmp_path / "store"))
    store.create_table("control_points", cp)
    patch = lambda seq, lat: spark.createDataFrame([(seq, "c", None, None, lat, lat, None, None, None, None)], CP_PATCH)
    solved = spark.createDataFrame([("c", 7.0, 7.0)], "control_point_id string, lat double, lng double")
    lat = lambda: store.read("control_points").first().est_lat
    feeds.patch_batch(store, "control_points", patch(5, 2.0), "a")
    store.append("control_points", changes.solved_versions(store.merged("control_points"), solved), "b")
    assert lat() == 7.0
    feeds.patch_batch(store, "control_points", patch(4, 3.0), "c")
    assert lat() == 7.0
    feeds.patch_batch(store, "control_points", patch(6, 4.0), "d")
    assert lat() == 4.0


FEED = "kind string, old_cp string, new_cp string, seq long, measurement_id string"


def test_status_names_the_latest_link(spark):
    rows = [("image", None, "c1", 1, "a"), ("map", None, "c1", 2, "b"), ("image", "c1", "c2", 3, "a"), ("map", "c1", None, 4, "b"), ("map", "c3", None, 5, "z"), ("map", "c4", "c4", 6, "y")]
    got = {r.control_point_id: (r.n_image, r.n_map, r.solvable, r.latest_link) for r in feeds.cp_status(spark.createDataFrame(rows + rows[1:3], FEED)).collect()}
    # A link goes with its measurement; what leaves first was there before; where it stays it counts as before.
    assert got == {"c1": (0, 0, False, None), "c2": (1, 0, False, "a"), "c3": (0, -1, False, None), "c4": (0, 0, False, "y")}


def test_a_feed_is_dealt_to_all_cores_and_its_ends_are_hashed(spark, monkeypatch, tmp_path):
    from sightline.plans import geometric, relational

    monkeypatch.setattr(geometric, "shared_path", lambda session, name: str(tmp_path / name))
    relational.QUERIES["stream_cp_status"](spark, "/root/testdata/sf0.001").count()
    cores = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "feed").glob("*.parquet"))) == 4 * cores and len(list((tmp_path / "status").glob("number=*"))) == 4
    rows = [("image", None, "c1", 5, "a"), ("image", "c1", "c1", 7, "a"), ("image", "c1", None, None, "a"), ("map", "c1", "c2", 3, "b"), ("map", None, "c1", 3, "b"), ("map", "c2", None, 4, "b")]
    ends = feeds.link_ends(spark.createDataFrame(rows, FEED))
    got = {(r.control_point_id, r.measurement_id): (tuple(r.first), tuple(r.last)) for r in ends.collect()}
    # At one seq a measurement leaves before it comes; a row without a seq is the oldest.
    assert got == {("c1", "a"): ((-(2**63), False), (7, True)), ("c1", "b"): ((3, False), (3, True)), ("c2", "b"): ((3, True), (4, False))}
    for df in (ends, feeds.merge_links(ends)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_any_order_and_replay_of_links_gives_the_same_statuses(spark, tmp_path):
    import random

    for seed in (1,):
        rng, rows, at = random.Random(seed), [], {}
        for seq in range(40):
            m = rng.randrange(9)
            new = rng.choice([None, "c0", "c1", "c2"])
            rows.append((("image", "map")[m % 2], at.get(m, rng.choice([None, "c3"])), new, seq, f"m{m}"))
            at[m] = new
        want = {}
        for kind, old, new, seq, m in rows:
            for c, d in ((old, -1), (new, 1)):
                if c:
                    want.setdefault(c, {"image": 0, "map": 0})[kind] += d
        last = {r[4]: r for r in rows}
        want = {c: (n["image"], n["map"], max(((r[3], r[4]) for r in last.values() if r[2] == c), default=(0, None))[1]) for c, n in want.items()}
        dealt = rows + rng.sample(rows, 15)
        rng.shuffle(dealt)
        store, shown = feeds.LinkStore(spark, str(tmp_path / f"links{seed}"), most_changes=2, buckets=3), {}
        for n, k in enumerate(range(0, len(dealt), 14)):
            for r in feeds.status_batch(store, spark.createDataFrame(dealt[k : k + 14], FEED), f"b{n}").collect():
                shown[r.control_point_id] = (r.n_image, r.n_map, r.latest_link)
        assert shown == want
        again = feeds.status_batch(store, spark.createDataFrame(dealt[:14], FEED), "b0").collect()
        assert all(want[r.control_point_id] == (r.n_image, r.n_map, r.latest_link) for r in again)


def test_large_stations_are_solved_alike(spark, monkeypatch):
    import numpy as np

    st, ph, an, pr = poses(spark, 20.0)
    rows = an.join(ph.withColumnRenamed("id", "photo_id"), "photo_id").join(st.select(F.col("id").alias("station_id"), F.col("lat").alias("st_lat"), F.col("lng").alias("st_lng")), "station_id").filter("station_id = 's1'").toPandas()
    held = pr.filter("station_id = 's1'").toPandas().rename(columns={"control_point_id": "point", "lat": "p_lat", "lng": "p_lng"})
    p = solve.StationProblem(rows, held, True, False)
    # The sparse Jacobian against one that moves each unknown of the whole state.
    x, r = p.value, p.residuals(p.value)
    whole = np.stack([(p.residuals(p.clamped(x + e)) - p.residuals(p.clamped(x - e))) / (2 * solve.EPS) for e in np.eye(len(x))[p.free] * solve.EPS], 1)
    want = np.linalg.solve(whole.T @ whole + solve.DAMPING * np.eye(len(p.free)), -whole.T @ r)
    assert np.allclose(p.step(x, r), want, rtol=1e-4, atol=1e-7)
    a, rms_a, _ = p.solve()
    monkeypatch.setattr(solve, "DENSE", 0)
    b, rms_b, _ = p.solve()
    assert np.allclose(a, b, atol=1e-5) and abs(rms_a - rms_b) < 1e-6


def stations_with_twins(spark, noise_m):
    """Points that two photos see, some held by one prior, some by two, some by none; a photo of one image only."""
    st, ph, an, pr = poses(spark, noise_m)
    st, an, pr = st.filter("id in ('s0', 's1', 's2')"), an.filter("station_id in ('s0', 's1', 's2')"), pr.filter("control_point_id like '%3' and station_id in ('s0', 's1')")
    twin = F.concat("photo_id", F.lit("b"))
    an = an.unionByName(an.select("station_id", twin.alias("photo_id"), F.concat("id", F.lit("b")).alias("id"), "u", "v", "control_point_id", "est_lat", "est_lng")).filter("photo_id != 'p01b' or id like '%3b'")
    ph = ph.unionByName(ph.withColumns({"id": F.concat("id", F.lit("b")), "photo_az": F.col("photo_az") - 0.05}))
    return st, ph, an, pr


@pytest.mark.parametrize("locked", [False, True])
def test_a_step_from_sums_is_that_of_the_whole_matrix(spark, locked):
    import numpy as np

    from sightline.operators.station_sums import Sums

    st, ph, an, pr = stations_with_twins(spark, 20.0)
    pr = pr.unionByName(pr.filter("control_point_id like 'c_1%'").withColumn("lat", F.col("lat") + 1e-4))
    rows = an.join(ph.withColumnRenamed("id", "photo_id"), "photo_id").join(st.select(F.col("id").alias("station_id"), F.col("lat").alias("st_lat"), F.col("lng").alias("st_lng")), "station_id").cache()
    held = pr.select("station_id", "control_point_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    sums = Sums(rows, held, True, locked)
    resting = sums.photos.withColumns({c: F.lit(0.0) for c in ("d0", "d1", "d2")}), sums.points.withColumns({"x0": F.lit(0.0), "x1": F.lit(0.0)})
    start = sums.norms(*resting, np.zeros((3, 2)), np.ones(3, bool), 1, False)[:, 0]
    photos, points, camera = sums.step(np.ones(3, bool))
    photos, points = ({(r[0], r[1]): r[2:] for r in df.collect()} for df in (photos, points))
    a, b = rows.toPandas(), held.toPandas().rename(columns={"control_point_id": "point"})
    for i, s in enumerate(sums.ids):
        p = solve.StationProblem(a[a["station_id"] == s], b[b["station_id"] == s], True, locked)
        r, whole = p.residuals(p.value), np.zeros(len(p.value))
        whole[p.free] = p.step(p.value, r)
        near = lambda x, y: np.allclose(x, y, rtol=1e-5, atol=1e-8)
        assert near(start[i], np.linalg.norm(r)) and near(camera[i], p.part(whole, 0))
        assert all(near(photos[s, k], [p.part(whole, j)[n] for j in (1, 2, 3)]) for n, k in enumerate(p.photos))
        assert all(near(points.get((s, k), (0, 0)), [p.part(whole, j)[n] for j in (4, 5)]) for n, k in enumerate(p.points))


def test_stations_solved_from_sums_are_those_solved_in_tasks(spark):
    """s0 and s1 have priors and go to the sums, s2 is solved in a task."""
    given = stations_with_twins(spark, 0.0)
    given = *given[:2], given[2].filter("station_id != 's2' or photo_id not like '%b'"), given[3].filter("control_point_id like 'c_03'")
    want, got = solve.solve_station_poses(*given), solve.solve_station_poses(*given, most_rows=26)
    nearly = {"lat": 1e-6, "lng": 1e-6, "photo_az": 1e-5, "size_rad": 1e-5, "size_stored": 1e-5, "photo_roll": 1e-5, "residual_rms": 1e-6}
    for part, key in (("stations", "station_id"), ("photos", "photo_id"), ("proposals", "control_point_id")):
        a, b = ({(r["station_id"], r[key]): r for r in side[part].collect()} for side in (want, got))
        assert a.keys() == b.keys()
        for k in a:
            for c in want[part].columns:
                assert abs(a[k][c] - b[k][c]) <= nearly[c] if c in nearly else c == "iterations" or a[k][c] == b[k][c], (part, k, c, a[k], b[k])


def test_many_stations_over_one_tile(spark, monkeypatch):
    st = spark.createDataFrame([(f"s{k}", 47.6 + k / 1e4, -122.3) for k in range(12)], "id string, lat double, lng double")
    tiles = terrain.tile_windows(st).select("z", "x", "y").distinct().withColumn("elev", F.transform(F.sequence(F.lit(0), F.lit(65535)), lambda k: (k % 97 + F.col("x") % 5).cast("double"))).cache()
    rings = terrain.with_stride(64)
    total = lambda: terrain.ring_vertices(st, tiles, rings).groupBy("station_id", "ring").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 3).alias("y")).orderBy("station_id", "ring").collect()
    one = total()
    monkeypatch.setattr(terrain, "WINDOWS_A_COPY", 3)
    assert total() == one and all(r.n == 21 * 21 for r in one)


@pytest.mark.parametrize("box", ["-122.1,47.4,-121.9,47.6", "-180,-90,180,90", "10,10,10,10", "-179.9,80,179.9,89.9"])
def test_cells_of_a_box(spark, tmp_path, box):
    import random

    rng = random.Random(6)
    rows = [(f"{k:04d}", *rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(47, 48), rng.uniform(-123, -121))])) for k in range(3000)] + [("at", 10.0, 10.0), ("pole", 90.0, 180.0)]
    st = spark.createDataFrame(rows, "id string, lat double, lng double").withColumn("created_at", F.expr(STAMP))
    reads.with_cell(st).repartitionByRange(4, "cell").sortWithinPartitions("cell").write.parquet(str(tmp_path / "st"))
    stored = spark.read.parquet(str(tmp_path / "st"))
    found = reads.stations_in_bbox(stored, box, 5000)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in reads.stations_in_bbox(st, box, 5000).collect())
    assert "PushedFilters" in found._jdf.queryExecution().toString() and "cell" in found._jdf.queryExecution().toString().split("PushedFilters")[1][:400]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_hidden_cells_come_in_closed_form_without_a_shuffle(spark):
    st = spark.createDataFrame([("s", 47.6, -122.3)], "id string, lat double, lng double")
    logical, _ = plan_of(terrain.ring_quads(st))
    assert "Join" not in logical and "transform(" not in logical


def test_what_is_made_of_a_strip_is_that_of_its_rows(spark):
    st = spark.createDataFrame([("s", 47.6, -122.3), ("t", 47.6001, -122.3)], "id string, lat double, lng double")
    rings = terrain.with_stride(64)
    tiles = terrain.tile_windows(st).select("z", "x", "y").distinct().withColumn("elev", F.transform(F.sequence(F.lit(0), F.lit(65535)), lambda k: k % 97 + F.col("x") % 5 / F.lit(256.0)))
    total = lambda df: df.select(*(c for c in df.columns if c != "elev"), F.aggregate("elev", F.lit(0.0), lambda a, x: a + x).alias("total"))
    want, got = (sorted(df.select("station_id", "ring", "j", "z", "v", "base", "total").collect()) for df in (total(terrain.ring_rows(st, tiles, rings)), terrain.ring_rows(st, tiles, rings, of_rows=total)))
    assert want == got and len(got) == 2 * 3 * 21


def test_blocks_of_a_ring_hold_all_its_vertices(spark):
    st = spark.createDataFrame([("s", 47.6, -122.3), ("t", 47.6001, -122.3), ("u", 47.2, -121.9)], "id string, lat double, lng double")
    rings = terrain.with_stride(64)
    tiles = terrain.tile_windows(st).select("z", "x", "y").distinct().filter("(x + y) % 5 <> 0").withColumn("elev", F.transform(F.sequence(F.lit(0), F.lit(65535)), lambda k: k % 97 + F.col("x") % 5 / F.lit(256.0)))

    def listed(j, z, x, elev, y):
        i = np.arange(len(x))
        flat = lambda a: np.broadcast_to(a, y.shape).ravel()
        return flat(j[:, None]), flat(i), flat(x), y.ravel(), flat(z[:, None]), elev.ravel()

    got = {(r.station_id, r.ring, r.j, r.i): r for r in terrain.of_ring_vertices(st, tiles, listed, "j int, i int, x double, y double, z double, elev double", rings).collect()}
    want = {(r.station_id, r.ring, r.j, r.i): r for r in terrain.ring_vertices(st, tiles, rings).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 3 * 21 * 21
    for k, r in want.items():
        assert all(abs(getattr(r, c) - getattr(got[k], c)) < 1e-6 for c in "xyz"), (k, r, got[k])


def test_the_query_of_vertices_makes_every_vertex(spark, tmp_path):
    from sightline.plans import relational

    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = relational.QUERIES["ring_vertices"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in rows) == 3 * 641 * 641 and len(rows) == 3 * 21


def test_rows_that_grow_with_stations_are_not_broadcast_for_rings(spark):
    st = spark.range(1).selectExpr("'s' as id", "47.6d as lat", "-122.3d as lng")
    tiles = terrain.tile_windows(st).select("z", "x", "y").distinct().withColumn("elev", F.array_repeat(F.lit(0.0), 65536))
    _, physical = plan_of(terrain.ring_vertices(st, tiles, terrain.with_stride(128)))
    # Only the row of zeros may be sent to all.
    assert physical.count("BroadcastHashJoin") <= 1


def test_panoramas_in_buckets_are_those_of_sums_over_all_runs(spark):
    rows = [(f"p{k:02}", f"s{k % 3}", 0.7 * k - 3, 0.1 * (k % 5) - 0.2, 0.05 * (k % 3), 0.3 + 0.1 * (k % 6), 1.5) for k in range(24)]
    ph = spark.createDataFrame(rows, "id string, station_id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double").withColumn("photo_az", F.pmod("photo_az", F.lit(6.0)) - 3)
    for f in (spatial.station_runs, spatial.station_sets, spatial.panorama_coverage):
        tasks, sums = (sorted(map(str, f(ph, 128, most_photos=n).collect())) for n in (100, 0))
        assert tasks == sums and tasks
    # Runs of cells are made and summed up where the photos are: photos alone are shuffled.
    assert spatial.station_runs(ph, 128)._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0


def test_sums_of_panoramas_are_made_where_their_runs_are(spark):
    rows = [(f"p{k:02}", f"s{k % 3}", 0.7 * k - 3, 0.1 * (k % 5) - 0.2, 0.05 * (k % 3), 0.3 + 0.1 * (k % 6), 1.5) for k in range(24)]
    ph = spark.createDataFrame(rows, "id string, station_id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double").withColumn("photo_az", F.pmod("photo_az", F.lit(6.0)) - 3)
    runs = spatial.station_runs(ph, 128)
    for f, want in ((spatial.station_rows, spatial.row_sums(runs)), (spatial.station_uncovered, spatial.panorama_uncovered(runs, 128))):
        tasks, sums, want = (sorted(map(str, df.collect())) for df in (f(ph, 128), f(ph, 128, most_photos=0), want))
        assert tasks == sums == want and tasks
        # Nothing is shuffled after the tasks that sweep.
        plan = f(ph, 128)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_stations_are_solved_in_buckets_not_one_by_one(spark):
    st = spark.createDataFrame([("s", 47.6, -122.3)], "id string, lat double, lng double")
    ph = spark.createDataFrame([("p", "s", 0.1, 0.0, 0.0, 1.0, 1.5)], "id string, station_id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double")
    an = spark.createDataFrame([("s", "p", "i", 0.5, 0.5, "c", 47.61, -122.3)], "station_id string, photo_id string, id string, u double, v double, control_point_id string, est_lat double, est_lng double")
    logical, _ = plan_of(solve.solve_station_poses(st, ph, an, an.selectExpr("station_id", "'not seen' as control_point_id", "est_lat as lat", "est_lng as lng"))["photos"])
    assert "pmod(xxhash64(station_id" in logical


#: Photos of stations that a plain solve leaves off the truth.
OFF_THE_TRUTH = [
    ("p264820", "S2", 0.002, 0.274, 0.033, 0.643, 1.0),
    ("p265819", "S2", -0.733, -0.156, -0.045, 0.609, 2.5),
    ("p267346", "S2", -0.781, -0.187, -0.093, 0.542, 2.0),
    ("p277612", "S2", 2.081, -0.249, -0.099, 0.89, 1.0),
    ("p653430", "S7", 3.068, 0.071, 0.029, 0.413, 2.0),
    ("p664792", "S7", 2.501, 0.045, 0.0, 0.374, 1.0),
    ("p670558", "S7", 2.221, -0.235, -0.015, 0.298, 2.0),
    ("p704702", "S7", 2.666, -0.276, 0.049, 1.167, 2.0),
    ("p732319", "S7", 0.366, 0.006, 0.084, 1.187, 2.5),
    ("p786766", "S8", -1.938, -0.274, -0.027, 0.861, 2.0),
    ("p858674", "S8", 0.949, -0.202, -0.074, 1.076, 2.0),
    ("p876766", "S8", -1.928, -0.121, -0.048, 0.332, 2.0),
    ("p888559", "S8", 0.886, -0.214, 0.099, 0.613, 2.5),
]


def test_a_station_that_stalls_is_solved_from_a_second_start(spark):
    from sightline.plans import geometric

    class Few:
        """Stations 28277, 73655 and 78621 of the test tables' formulas, and their photos."""

        stations = [("S2", 47.8920000, -121.0950000), ("S7", 47.594, -121.17), ("S8", 47.418, -121.514)]
        st = spark.createDataFrame(stations, "id string, lat double, lng double")
        ph = spark.createDataFrame(OFF_THE_TRUTH, "id string, station_id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double")

    truth = {r.id: r for r in Few.ph.collect()}
    for r in geometric._poses(Few, "photos").collect():
        assert all(abs(getattr(r, c) - getattr(truth[r.photo_id], c)) < 5e-5 for c in ("photo_az", "size_rad", "photo_roll")), r


def test_a_station_of_few_photos_is_solved_from_places_about_it(spark):
    from sightline.plans import geometric

    #: Stations of four photos, by the test tables' keys, that end off the truth from their own place, also on the second start.
    keys = {572214: [15120, 7556221, 728232, 119025], 31712: [573165, 6613837, 5058615, 6758514], 262240: [2176132, 6411212, 994166, 2702537], 99152: [7720570, 2154098, 7941397, 3686467]}

    class Few:
        st = spark.createDataFrame([(f"S{c}", 47 + c * 7919 % 10007 / 10007, -122 + c * 104729 % 10009 / 10009) for c in keys], "id string, lat double, lng double")
        ph = spark.createDataFrame(
            [(f"P{o}", f"S{c}", (o * 37 % 6283 - 3141) / 1000, (o * 11 % 601 - 300) / 1000, (o * 13 % 201 - 100) / 1000, (200 + o * 17 % 1001) / 1000, (o % 4 + 2) / 2) for c, orders in keys.items() for o in orders],
            "id string, station_id string, photo_az double, photo_tilt double, photo_roll double, size_rad double, aspect double",
        )

    truth = {r.id: r for r in Few.ph.collect()}
    got = geometric._poses(Few, "photos").collect()
    assert len(got) == 16
    for r in got:
        assert all(abs(getattr(r, c) - getattr(truth[r.photo_id], c)) < 5e-5 for c in ("photo_az", "size_rad", "photo_roll")), r


def test_observations_are_joined_once_and_a_points_rows_meet_once(spark):
    from sightline.plans import geometric
    from sightline.sources.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    photos, images = geometric.planted_observations(t)
    got = solve.solve_cp_locations(t.cp, images, photos, t.st, t.mm)
    logical, _ = plan_of(got)
    # What solves reads a table of observations, not photos and stations again, and rows meet their points in the tasks.
    assert "photo_az" not in logical and "FlatMapCoGroupsInPandas" in logical
    seen = solve.cp_observation_rows(t.cp, images, photos, t.st, t.mm)
    want = aggregates.cp_initial_guess(t.cp, images, photos, t.st, t.mm).join(solve._starts(t.cp, seen), "control_point_id")
    rows = want.collect()
    assert len(rows) == got.count() and all(abs(r.lat - r.lat0) < 1e-9 and abs(r.lng - r.lng0) < 1e-9 for r in rows)
