"""Poses of stations whose rows are too many for one task: the same damped Gauss-Newton as in `solve`, from sums.

An image residual depends on its station's place (c, two unknowns), its photo's pose (f, three) and, if a map measurement holds
it, its point's place (p, two). Photos share no unknown with each other, so each is eliminated by its own 3 x 3 block (a Schur
complement); what is left, the station's place and the held points, is solved by conjugate gradients. Their products are sums
over pairs of photo and point: gather by photo, scatter by point. Every sum is a groupBy that combines in the map tasks, so no
group of rows is ever held by a task. Photos and points stay in tables that are written at each step; the driver holds a few
numbers for each large station.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators.solve import DAMPING, HALVINGS, NORM_TOL, PASSES, STEP_TOL, image_residuals, image_slopes
from sightline.schema import M_PER_DEG_LAT, MAP_PRIOR_SIGMA_M
from sightline.sources.shared import shared_path

PHOTO, POINT = ["station_id", "photo_id"], ["station_id", "control_point_id"]
POSE_FREE = ["photo_az", "size_rad", "photo_roll"]
#: Part of the first squared residual at which conjugate gradients end.
CG_TOL = 1e-20


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sums(left: str, right: str, n: int, m: int, symmetric: bool = False) -> list[Column]:
    """Sums of products of columns left0.. and right0.., named by both."""
    return [F.sum(F.col(f"{left}{i}") * F.col(f"{right}{j}")).alias(f"{left}{right}{i}{j}") for i in range(n) for j in range(i if symmetric else 0, m)]


def _dot(*pairs) -> Column:
    return sum((F.col(a) * F.col(b) for a, b in pairs), F.lit(0.0))


class Sums:
    """The large stations' rows, and their state: a row for each photo, each held point and (on the driver) each station."""

    def __init__(self, rows: DataFrame, held: DataFrame, solve_roll: bool, locked: bool):
        self.spark = rows.sparkSession
        all_rows = _written(rows.select(*PHOTO, "control_point_id", "u", "v", "photo_tilt", "aspect", "est_lat", "est_lng", *POSE_FREE, "st_lat", "st_lng"), "rows")
        self.rows = all_rows.drop(*POSE_FREE, "st_lat", "st_lng")
        self.every_point = all_rows.groupBy(*POINT).agg(F.min("est_lat").alias("est_lat"), F.min("est_lng").alias("est_lng"))
        n = F.count(F.lit(1)).alias("n")
        self.photos = _written(all_rows.groupBy(*PHOTO).agg(n, *(F.min(c).alias(c) for c in POSE_FREE)), "photos")
        self.solve_roll = solve_roll
        # A point's priors as sums of their offsets from its first place.
        scale = F.lit(M_PER_DEG_LAT / MAP_PRIOR_SIGMA_M)
        offsets = held.join(self.every_point, POINT).select(*POINT, "est_lat", "est_lng", scale.alias("s0"), (scale * F.cos(F.radians("p_lat"))).alias("s1"), (F.col("p_lat") - F.col("est_lat")).alias("q0"), (F.col("p_lng") - F.col("est_lng")).alias("q1"))
        weigh = [F.sum(F.col(f"s{i}") ** 2 * F.col(f"q{i}") ** k).alias(f"w{i}{k}") for i in (0, 1) for k in (0, 1, 2)]
        self.points = _written(offsets.groupBy(*POINT).agg(F.min("est_lat").alias("lat0"), F.min("est_lng").alias("lng0"), n, *weigh).select("*", F.col("lat0").alias("lat"), F.col("lng0").alias("lng")), "points")
        local = F.sum(1 + (F.col("n") >= 2).cast("int") + ((F.col("n") >= 3) & F.lit(solve_roll)).cast("int")).alias("local")
        cam = all_rows.groupBy("station_id").agg(F.min("st_lat").alias("lat"), F.min("st_lng").alias("lng"), n).join(self.photos.groupBy("station_id").agg(local), "station_id")
        cam = cam.join(self.points.groupBy("station_id").agg(F.sum("n").alias("priors")), "station_id", "left").na.fill(0, ["priors"]).orderBy("station_id").toPandas()
        # Each prior counts two unknowns and two equations, as in a station that one task solves.
        cam["camera"] = (not locked) & (cam["n"] >= 2 + cam["local"] + 2)
        self.cam, self.ids = cam, cam["station_id"].tolist()
        self.any_held = bool((cam["priors"] > 0).any())

    def by_station(self, **values) -> DataFrame:
        """Numbers of the stations; all rows / most_rows of them at most."""
        return F.broadcast(self.spark.createDataFrame(pd.DataFrame({"station_id": self.ids, **values})))

    def summed(self, df: DataFrame, *columns: Column) -> pd.DataFrame:
        return df.groupBy("station_id").agg(*columns).toPandas().set_index("station_id").reindex(self.ids).fillna(0.0).astype(float)

    def placed(self, photos: DataFrame, points: DataFrame, cam: DataFrame) -> DataFrame:
        """The rows with what they depend on; stations that are not in `cam` are left out."""
        return self.rows.join(cam, "station_id").join(photos, PHOTO).join(points, POINT, "left")

    def linearised(self, live: np.ndarray) -> DataFrame:
        """r and the slopes c0.., f0.., p0.. of each row; 0 where an unknown is not free. held_point is null if p is not free."""
        roll = self.solve_roll

        def slopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                get = lambda c: d[c].to_numpy(float)
                held = d["lat"].notna().to_numpy()
                at = np.stack([get("cam_lat"), get("cam_lng"), *(get(c) for c in POSE_FREE), np.where(held, get("lat"), get("est_lat")), np.where(held, get("lng"), get("est_lng"))])
                rest = get("photo_tilt"), get("aspect"), get("u"), get("v")
                n, camera = get("n"), d["camera"].to_numpy(bool)
                free = np.stack([camera, camera, n >= 1, n >= 2, (n >= 3) & roll, held, held])
                out = dict(zip(["c0", "c1", "f0", "f1", "f2", "p0", "p1"], np.where(free, image_slopes(at, *rest), 0.0)))
                yield pd.DataFrame({"station_id": d["station_id"], "photo_id": d["photo_id"], "control_point_id": d["control_point_id"].where(held, None), **out, "r0": image_residuals(at, *rest)})

        cam = self.by_station(cam_lat=self.cam["lat"], cam_lng=self.cam["lng"], camera=self.cam["camera"], live=live).filter("live")
        schema = "station_id string, photo_id string, control_point_id string, " + ", ".join(f"{c} double" for c in ("c0", "c1", "f0", "f1", "f2", "p0", "p1", "r0"))
        return _written(self.placed(self.photos, self.points.select(*POINT, "lat", "lng"), cam).mapInPandas(slopes, schema), "slopes")

    def step(self, live: np.ndarray):
        """(photos with d0..d2, points with x0, x1, an array of two a station): the damped Gauss-Newton step."""
        rows = self.linearised(live)
        names = [f"i{a}{b}" for a in range(3) for b in range(3)] + [f"u{a}{b}" for a in range(3) for b in range(2)] + [f"y{a}" for a in range(3)] + ["cc00", "cc01", "cc11", "cg0", "cg1"]

        def eliminate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A photo's inverse block i, what the station's place (u) and its own gradient (y) add, and what it takes from the station."""
            for d in batches:
                ff = np.empty((len(d), 3, 3))
                for a in range(3):
                    for b in range(a, 3):
                        ff[:, a, b] = ff[:, b, a] = d[f"ff{a}{b}"]
                i = np.linalg.inv(ff + DAMPING * np.eye(3))
                fc = np.stack([d[f"fc{a}{b}"] for a in range(3) for b in range(2)], 1).reshape(-1, 3, 2)
                u, y = i @ fc, (i @ np.stack([d[f"fr{a}0"] for a in range(3)], 1)[:, :, None])[:, :, 0]
                cc, cg = fc.transpose(0, 2, 1) @ u, (fc * y[:, :, None]).sum(1)
                numbers = np.concatenate([i.reshape(-1, 9), u.reshape(-1, 6), y, cc.reshape(-1, 4)[:, [0, 1, 3]], cg], 1)
                yield pd.concat([d[PHOTO].reset_index(drop=True), pd.DataFrame(numbers, columns=names)], axis=1)

        blocks = rows.groupBy(*PHOTO).agg(*_sums("f", "f", 3, 3, True), *_sums("f", "c", 3, 2), *_sums("f", "r", 3, 1))
        blocks = _written(blocks.mapInPandas(eliminate, "station_id string, photo_id string, " + ", ".join(f"{c} double" for c in names)), "blocks")
        own = self.summed(rows, *_sums("c", "c", 2, 2, True), *_sums("c", "r", 2, 1))
        taken = self.summed(blocks, *(F.sum(c).alias(c) for c in names[-5:]))
        left = own[["cc00", "cc01", "cc11"]].to_numpy() - taken[["cc00", "cc01", "cc11"]].to_numpy()
        s_cc = left[:, [0, 1, 1, 2]].reshape(-1, 2, 2) + DAMPING * np.eye(2)
        b_c = taken[["cg0", "cg1"]].to_numpy() - own[["cr00", "cr10"]].to_numpy()
        if not self.any_held:
            d_c = np.linalg.solve(s_cc, b_c[:, :, None])[:, :, 0]
            moved = blocks.join(self.by_station(e0=d_c[:, 0], e1=d_c[:, 1]), "station_id").select(*PHOTO, *(-(F.col(f"y{a}") + _dot((f"u{a}0", "e0"), (f"u{a}1", "e1"))) for a in range(3)))
            return _written(moved.toDF(*PHOTO, "d0", "d1", "d2"), "moved"), self.points.select(*POINT, F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1")), d_c
        held = rows.filter("control_point_id is not null")
        k = lambda a, j: _dot(*((f"i{a}{b}", f"fp{b}{j}") for b in range(3))).alias(f"k{a}{j}")
        pairs = held.groupBy(*PHOTO, "control_point_id").agg(*_sums("f", "p", 3, 2)).join(blocks, PHOTO)
        pairs = _written(pairs.select("*", *(k(a, j) for a in range(3) for j in range(2))).select(*PHOTO, "control_point_id", *(f"{c}{a}{j}" for c in ("fp", "k", "u") for a in range(3) for j in range(2)), "y0", "y1", "y2"), "pairs")
        by_photos = pairs.groupBy(*POINT).agg(
            *(F.sum(_dot(*((f"fp{a}{i}", f"k{a}{j}") for a in range(3)))).alias(f"tp{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))),
            *(F.sum(_dot(*((f"fp{a}{i}", f"u{a}{j}") for a in range(3)))).alias(f"tc{i}{j}") for i in range(2) for j in range(2)),
            *(F.sum(_dot(*((f"fp{a}{i}", f"y{a}") for a in range(3)))).alias(f"ty{i}") for i in range(2)),
        )
        points = held.groupBy(*POINT).agg(*_sums("p", "p", 2, 2, True), *_sums("p", "c", 2, 2), *_sums("p", "r", 2, 1)).join(self.points, POINT).join(by_photos, POINT)
        off = [F.col("lat") - F.col("lat0"), F.col("lng") - F.col("lng0")]
        own_block = [(F.col("pp00") + F.col("w00") + DAMPING).alias("h00"), F.col("pp01").alias("h01"), (F.col("pp11") + F.col("w10") + DAMPING).alias("h11")]
        coupling = [(F.col(f"pc{i}{j}") - F.col(f"tc{i}{j}")).alias(f"z{i}{j}") for i in range(2) for j in range(2)]
        rest = [(F.col(f"ty{i}") - F.col(f"pr{i}0") - (F.col(f"w{i}0") * off[i] - F.col(f"w{i}1"))).alias(f"r{i}") for i in range(2)]
        points = points.select(*POINT, *own_block, *coupling, *rest, "tp00", "tp01", "tp11")
        # The inverse of a point's own block of the reduced matrix goes before the gradients.
        a, b, d = F.col("h00") - F.col("tp00"), F.col("h01") - F.col("tp01"), F.col("h11") - F.col("tp11")
        points = points.withColumn("det", a * d - b * b).select("*", (d / F.col("det")).alias("m00"), (-b / F.col("det")).alias("m01"), (a / F.col("det")).alias("m11"))
        x, d_c = self.gradients(pairs, points.drop("det", "tp00", "tp01", "tp11"), s_cc, b_c)
        by_point = pairs.join(x, POINT).groupBy(*PHOTO).agg(*(F.sum(_dot((f"k{a}0", "x0"), (f"k{a}1", "x1"))).alias(f"g{a}") for a in range(3)))
        moved = blocks.join(by_point, PHOTO, "left").join(self.by_station(e0=d_c[:, 0], e1=d_c[:, 1]), "station_id")
        return _written(moved.select(*PHOTO, *((-(F.col(f"y{a}") + _dot((f"u{a}0", "e0"), (f"u{a}1", "e1")) + F.coalesce(f"g{a}", F.lit(0.0)))).alias(f"d{a}") for a in range(3))), "moved"), x, d_c

    def gradients(self, pairs: DataFrame, points: DataFrame, s_cc: np.ndarray, b_c: np.ndarray):
        """Conjugate gradients of all stations side by side: (points with x0, x1; an array of two a station)."""
        zero = F.lit(0.0)
        ahead = lambda p, q: [F.col("m00") * p + F.col("m01") * q, F.col("m01") * p + F.col("m11") * q]
        z = ahead(F.col("r0"), F.col("r1"))
        now = _written(points.select("*", zero.alias("x0"), zero.alias("x1"), z[0].alias("v0"), z[1].alias("v1")), "way")
        got = self.summed(now, F.sum(F.col("r0") * F.col("v0") + F.col("r1") * F.col("v1")).alias("rz"), F.count(F.lit(1)).alias("n"))
        before = np.linalg.inv(s_cc)
        solve_c = lambda r: (before @ r[:, :, None])[:, :, 0]
        x_c, r_c, v_c = np.zeros_like(b_c), b_c, solve_c(b_c)
        size = got["rz"].to_numpy() + (r_c * v_c).sum(1)
        first, live = size, size > 0
        for _ in range(4 * int(2 * got["n"].max() + 2)):
            if not live.any():
                break
            y = pairs.join(now.select(*POINT, "v0", "v1"), POINT).groupBy(*PHOTO).agg(*(F.sum(_dot((f"fp{a}0", "v0"), (f"fp{a}1", "v1"))).alias(f"g{a}") for a in range(3)))
            back = pairs.select(*PHOTO, "control_point_id", *(f"k{a}{j}" for a in range(3) for j in range(2))).join(y, PHOTO).groupBy(*POINT).agg(*(F.sum(_dot(*((f"k{a}{j}", f"g{a}") for a in range(3)))).alias(f"t{j}") for j in range(2)))
            full = now.join(back, POINT).join(self.by_station(e0=v_c[:, 0], e1=v_c[:, 1]), "station_id")
            along = [_dot((f"h0{j}", "v0"), (f"h{j}1", "v1")) + _dot((f"z{j}0", "e0"), (f"z{j}1", "e1")) - F.col(f"t{j}") for j in range(2)]
            full = _written(full.select(*now.columns, along[0].alias("a0"), along[1].alias("a1")), "along")
            ma, mr = ahead(F.col("a0"), F.col("a1")), ahead(F.col("r0"), F.col("r1"))
            s = self.summed(full, F.sum(_dot(("v0", "a0"), ("v1", "a1"))).alias("va"), F.sum(_dot(("z00", "v0"), ("z10", "v1"))).alias("c0"), F.sum(_dot(("z01", "v0"), ("z11", "v1"))).alias("c1"),
                            F.sum(F.col("r0") * ma[0] + F.col("r1") * ma[1]).alias("ra"), F.sum(F.col("a0") * ma[0] + F.col("a1") * ma[1]).alias("aa"), F.sum(F.col("r0") * mr[0] + F.col("r1") * mr[1]).alias("rr"))
            # What is left is summed anew each time; a difference carried along would keep the first one's rounding.
            size = s["rr"].to_numpy() + (r_c * solve_c(r_c)).sum(1)
            a_c = (s_cc @ v_c[:, :, None])[:, :, 0] + s[["c0", "c1"]].to_numpy()
            bend = (v_c * a_c).sum(1) + s["va"].to_numpy()
            live = live & (bend > 0)
            alpha = np.where(live, size / np.where(live, bend, 1.0), 0.0)
            x_c, r_c = x_c + alpha[:, None] * v_c, r_c - alpha[:, None] * a_c
            to = s["rr"].to_numpy() - 2 * alpha * s["ra"].to_numpy() + alpha**2 * s["aa"].to_numpy() + (r_c * solve_c(r_c)).sum(1)
            beta = np.where(live & (size > 0), to / np.where(size > 0, size, 1.0), 0.0)
            size, live = to, live & (to > first * CG_TOL)
            v_c = solve_c(r_c) + beta[:, None] * v_c
            r = [F.col(f"r{j}") - F.col("alpha") * F.col(f"a{j}") for j in range(2)]
            z = ahead(*r)
            now = full.join(self.by_station(alpha=alpha, beta=beta), "station_id").select(
                *(c for c in points.columns if c not in ("r0", "r1")), r[0].alias("r0"), r[1].alias("r1"), *((F.col(f"x{j}") + F.col("alpha") * F.col(f"v{j}")).alias(f"x{j}") for j in range(2)), *((z[j] + F.col("beta") * F.col(f"v{j}")).alias(f"v{j}") for j in range(2)))
        return _written(now.select(*POINT, "x0", "x1"), "found"), x_c

    def norms(self, photos: DataFrame, points: DataFrame, d_c: np.ndarray, live: np.ndarray, steps: int, within: bool = True) -> np.ndarray:
        """A row for each station: the residual norms after the step, its half, its quarter and so on."""
        def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                get = lambda c: d[c].to_numpy(float)
                held = d["lat"].notna().to_numpy()
                out = {}
                for k in range(steps):
                    to = lambda c, by: get(c) + get(by) / 2**k  # noqa: E731, B023
                    size = np.clip(to("size_rad", "d1"), g.SIZE_LEAST, g.SIZE_MOST_SOLVER) if within else get("size_rad")
                    at = np.stack([to("cam_lat", "e0"), to("cam_lng", "e1"), to("photo_az", "d0"), size, to("photo_roll", "d2"), np.where(held, to("lat", "x0"), get("est_lat")), np.where(held, to("lng", "x1"), get("est_lng"))])
                    out[f"s{k}"] = image_residuals(at, get("photo_tilt"), get("aspect"), get("u"), get("v")) ** 2
                yield pd.DataFrame({"station_id": d["station_id"], **out}).groupby("station_id", as_index=False).sum()

        cam = self.by_station(cam_lat=self.cam["lat"], cam_lng=self.cam["lng"], e0=d_c[:, 0], e1=d_c[:, 1], live=live).filter("live")
        names = [f"s{k}" for k in range(steps)]
        images = self.placed(photos, points.select(*POINT, "lat", "lng", "x0", "x1"), cam).mapInPandas(squares, "station_id string, " + ", ".join(f"{c} double" for c in names))
        off = lambda k: [F.col(c) + F.col(x) / 2**k - F.col(c0) for c, x, c0 in (("lat", "x0", "lat0"), ("lng", "x1", "lng0"))]
        prior = lambda k: sum((F.col(f"w{i}0") * o * o - 2 * F.col(f"w{i}1") * o + F.col(f"w{i}2") for i, o in enumerate(off(k))), F.lit(0.0))
        both = images.unionByName(points.select("station_id", *(prior(k).alias(c) for k, c in enumerate(names))))
        return np.sqrt(np.maximum(self.summed(both, *(F.sum(c).alias(c) for c in names))[names].to_numpy(), 0.0))

    def solve(self) -> dict[str, DataFrame]:
        cam, n = self.cam, len(self.ids)
        start = cam[["lat", "lng"]].to_numpy().copy()
        at_rest = self.photos.select("*", *(F.lit(0.0).alias(c) for c in ("d0", "d1", "d2"))), self.points.select("*", F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"))
        live = np.ones(n, bool)
        # The start is taken as it is, beyond the limits of size too.
        now, passes = self.norms(*at_rest, np.zeros((n, 2)), live, 1, False)[:, 0], np.zeros(n, np.int64)
        while True:
            live = live & (passes < PASSES) & (now >= NORM_TOL)
            if not live.any():
                break
            d_photos, d_points, d_c = self.step(live)
            photos, points = self.photos.join(d_photos, PHOTO, "left").na.fill(0.0, ["d0", "d1", "d2"]), self.points.join(d_points, POINT, "left").na.fill(0.0, ["x0", "x1"])
            trials = self.norms(photos, points, d_c, live, HALVINGS)
            long = np.sqrt((d_c**2).sum(1) + self.summed(d_photos, F.sum(_dot(("d0", "d0"), ("d1", "d1"), ("d2", "d2"))).alias("d"))["d"].to_numpy() + self.summed(d_points, F.sum(_dot(("x0", "x0"), ("x1", "x1"))).alias("d"))["d"].to_numpy())
            better = trials < now[:, None]
            took, k = live & better.any(1), better.argmax(1)
            part = np.where(took, 0.5**k, 0.0)
            now = np.where(took, trials[np.arange(n), k], now)
            passes = passes + took + (took & (long * part < STEP_TOL))
            by = self.by_station(part=part, live=live)
            size = F.col("size_rad") + F.col("part") * F.col("d1")
            self.photos = _written(photos.join(by, "station_id").select(*PHOTO, "n", (F.col("photo_az") + F.col("part") * F.col("d0")).alias("photo_az"), F.when(F.col("live"), g.clamp_size(size)).otherwise(F.col("size_rad")).alias("size_rad"), (F.col("photo_roll") + F.col("part") * F.col("d2")).alias("photo_roll")), "photos")
            if self.any_held:
                shifted = {"lat": F.col("lat") + F.col("part") * F.col("x0"), "lng": F.col("lng") + F.col("part") * F.col("x1")}
                self.points = _written(points.join(by, "station_id").select(*(shifted.get(c, F.col(c)).alias(c) for c in self.points.columns)), "points")
            cam["lat"], cam["lng"] = cam["lat"] + part * d_c[:, 0], cam["lng"] + part * d_c[:, 1]
            live = took
        moved = cam["camera"].to_numpy(bool) & (cam[["lat", "lng"]].to_numpy() != start).any(1)
        stations = pd.DataFrame({"station_id": self.ids, "lat": cam["lat"], "lng": cam["lng"], "residual_rms": now / np.sqrt(np.maximum(cam["n"] + 2 * cam["priors"], 1)), "iterations": passes, "camera_moved": moved})
        schema = "station_id string, lat double, lng double, residual_rms double, iterations long, camera_moved boolean"
        found = self.every_point.join(self.points.select(*POINT, "lat", "lng"), POINT, "left")
        return {
            "stations": self.spark.createDataFrame(stations, schema),
            "photos": self.photos.select("photo_id", "station_id", "photo_az", "size_rad", "photo_roll"),
            "proposals": found.select(*POINT, F.coalesce("lat", "est_lat").alias("lat"), F.coalesce("lng", "est_lng").alias("lng")),
        }
