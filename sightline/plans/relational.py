"""Queries of the relational operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.ids import ALPHABET, assign_ids
from sightline.operators import aggregates as agg
from sightline.operators import changes, integrity, reads, validate
from sightline.plans.sql import oracle, r, stamp, star
from sightline.schema import ENTITIES, ID_PATTERN
from sightline.sources.entities import ingest_patches, load_entities, numbered_name, photo_aspect, photo_blob_catalog, picture, upgrade_legacy_layout, write_entities, write_many_files
from sightline.sources.fixtures import Tables, entity_id
from sightline.sources.shared import shared_path

BBOX = "-121.9,47.2,-121.6,47.5"
IN_BOX = "{lng} between -121.9::double and -121.6::double and {lat} between 47.2::double and 47.5::double"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Times as text."""
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes))


def near(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def query(name: str, sql: str | None = None, **views: str):
    """Registers a function of Tables under `name`."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(Tables(spark, sf_dir)))
        if sql is not None:
            SQL[name] = oracle(sql, **views)
        return f

    return put


#: The last letter of an id stands for a digit; rows that end so are chosen or spoilt.
def ends(*digits: str, col: str = "id") -> str:
    return f"substring({col}, 13, 1) in ({', '.join(repr(str(d).translate(str.maketrans('0189', 'ABIJ'))) for d in digits)})"


# --- sources, sinks -------------------------------------------------------------------------------------------------

_SUMMARY = "select '{0}' as entity, count(*) as n, count(distinct id) as ids, min(id) as first_id, max(id) as last_id from {0}"


def _summaries(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).select(F.lit(name).alias("entity"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("load_entities", " union all ".join(f"select * from ({_SUMMARY.format(n)})" for n in ENTITIES))
def _(t):
    return _summaries(load_entities(t.spark, write_entities({n: t.entity(n) for n in ENTITIES}, shared_path(t.spark, "entities"))))


@query("write_entities", " union all ".join(f"select '{n}' as entity, id, {stamp('updated_at')} as updated_at from {n}" for n in ENTITIES))
def _(t):
    back = load_entities(t.spark, write_entities({n: t.entity(n) for n in ENTITIES}, shared_path(t.spark, "entities")))
    rows = [df.select(F.lit(n).alias("entity"), "id", "updated_at") for n, df in back.items()]
    return reduce(DataFrame.unionByName, rows)


#: Some keys are those of no photo.
_FILE_KEY = "case when mod(k, 17) = 0 then k + 500000000 else k end"


def pictures(t) -> tuple[str, DataFrame]:
    """Writes a small picture for each photo, and returns the folder, and the names of its files with the photos' keys.

    Some of the files are large, some are no pictures, and some belong to no photo.
    """
    path = shared_path(t.spark, "pictures")

    def run(batches):
        for batch in batches:
            data = [b"no picture" if k % 13 == 0 else picture(k % 4 + 2, 2, bytes(6 * (k % 4 + 2))) + b" " * (2000 if k % 11 == 0 else 0) for k in batch.column("k").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(data, pa.binary())], names=["k", "data"])

    names = write_many_files(t.raw("orders").select(F.col("o_orderkey").alias("k")).repartition(4 * t.spark.sparkContext.defaultParallelism, "k").mapInArrow(run, "k long, data binary"), path, "k")
    return path, names.select("name", F.expr(entity_id("P", _FILE_KEY)).alias("photo_id"))


_FILES = f"select k, {entity_id('P', _FILE_KEY)} as id from (select o_orderkey as k from orders)"


@query("photo_blob_catalog", """select coalesce(p.id, f.id) as photo_id, case when p.id is null then 'orphan_file' when f.id is null then 'missing' when mod(f.k, 11) = 0 and mod(f.k, 13) <> 0 then 'too_large' when p.mime_type not like 'image/%' then 'bad_mime' else 'stored' end as status
    from (select id, blob_path, case when id like '%5' then 'text/plain' else mime_type end as mime_type from photos) p full join files f on f.id = p.id where p.blob_path is not null or f.id is not null""", files=_FILES)
def _(t):
    photos = t.ph.withColumn("mime_type", F.when(F.col("id").endswith("5"), "text/plain").otherwise(F.col("mime_type")))
    path, names = pictures(t)
    return photo_blob_catalog(photos, path, 1000, names=names).select("photo_id", "status")


@query("photo_aspect", "select id, mod(k, 13) <> 0 as readable, case when mod(k, 13) <> 0 then (mod(k, 4) + 2) / 2::double end as aspect from files", files=_FILES)
def _(t):
    path, names = pictures(t)
    rows = photo_aspect(t.spark, path).withColumn("name", numbered_name(F.col("path"))).join(names, "name")
    return rows.select(F.col("photo_id").alias("id"), (F.coalesce("width", F.lit(0)) > 0).alias("readable"), "aspect")


_BODY = """case mod(event_id, 9) when 0 then '{"lat": 47.5}' when 1 then '{"lat": 1, "bogus": 2}' when 2 then 'no json' when 3 then '{"lat": "x", "lng": 2}'
    when 4 then concat('{"LAT": ', cast(mod(event_id, 90) as string), ', "lng": 3}') else concat('{"lat": ', cast(mod(event_id * 13, 90) as string), ', "lng": ', cast(mod(event_id * 7, 180) as string), ', "name": "n', cast(event_id as string), '"}') end"""
_RAW = f"select event_id as seq, 'station' as entity, {entity_id('S', 'event_id')} as id, {_BODY} as body from events"


@query("ingest_patches", f"""select event_id as seq, {entity_id('S', 'event_id')} as id,
    case mod(event_id, 9) when 0 then 47.5::double when 1 then null when 2 then null when 3 then null when 4 then cast(mod(event_id, 90) as double) else cast(mod(event_id * 13, 90) as double) end as lat,
    case mod(event_id, 9) when 0 then 0::double when 1 then null when 2 then null when 3 then null when 4 then 3::double else cast(mod(event_id * 7, 180) as double) end as lng,
    case when mod(event_id, 9) > 4 then concat('n', cast(event_id as string)) end as name,
    case when mod(event_id, 9) in (1, 2, 3) then null else mod(event_id, 9) = 0 end as defaulted,
    case mod(event_id, 9) when 1 then 'unknown field' when 2 then 'invalid JSON' when 3 then 'wrong type' end as reason from events""")
def _(t):
    good, bad = ingest_patches(t.sql(_RAW), "station")
    return good.drop("entity").withColumn("reason", F.lit(None).cast("string")).unionByName(bad.drop("body"), allowMissingColumns=True)


@query("upgrade_legacy_layout", f"""select 'stations' as entity, id, null as link, {r('lat')} as a from stations union all select 'photos', id, station_id, {r('aspect')} from photos
    union all select 'control_points', id, null, {r('lat')} from map_measurements union all select 'map_measurements', id, id, {r('lat')} from map_measurements
    union all select 'image_measurements', id, control_point_id, {r('u')} from image_measurements""")
def _(t):
    got = upgrade_legacy_layout(t.st, t.ph.withColumnRenamed("station_id", "location_id"), t.mm.drop("control_point_id").withColumn("location_id", F.lit("x")), t.im.withColumnRenamed("control_point_id", "map_poi_id"))
    cols = {"stations": (F.lit(None).cast("string"), "lat"), "photos": (F.col("station_id"), "aspect"), "control_points": (F.lit(None).cast("string"), "est_lat"), "map_measurements": (F.col("control_point_id"), "lat"), "image_measurements": (F.col("control_point_id"), "u")}
    out = None
    for name, (link, a) in cols.items():
        rows = got[name].select(F.lit(name).alias("entity"), "id", link.alias("link"), F.col(a).alias("a"))
        out = rows if out is None else out.unionByName(rows)
    return near(out, "a")


def _base32(key: str) -> str:
    letters = [f"substring('{ALPHABET}', cast((({key}) >> {59 - 5 * i}) & 31 as int) + 1, 1)" for i in range(12)]
    return f"concat({', '.join(letters)}, substring('{ALPHABET}', cast(((({key}) & 15) << 1) as int) + 1, 1))"


@query("assign_ids", f"select o_orderkey, {_base32('o_orderkey * 123456789012')} as id from orders")
def _(t):
    return assign_ids(t.raw("orders").select("o_orderkey", (F.col("o_orderkey") * F.lit(123456789012)).alias("k")), "k").select("o_orderkey", "id")


# --- rules ----------------------------------------------------------------------------------------------------------

_BAD = {
    "stations": f"select id, case when {ends(3)} then lat + 50 else lat end as lat, case when {ends(4)} then lng - 100 when {ends(5)} then cast(180 as double) else lng end as lng from stations",
    "photos": f"select id, case when {ends(3)} then cast(0 as double) when {ends(4)} then cast(100 as double) else aspect end as aspect, case when {ends(5, 3)} then -size_rad else size_rad end as size_rad, case when {ends(6)} then opacity + 1 when {ends(7)} then null else opacity end as opacity from photos",
    "map_measurements": f"select id, case when {ends(3)} then lat - 150 else lat end as lat, case when {ends(4, 3)} then lng + 400 else lng end as lng, case when {ends(5, 6)} then lower(control_point_id) else control_point_id end as control_point_id from map_measurements",
    "image_measurements": f"select id, case when {ends(3)} then u + 1.5 else u end as u, case when {ends(4)} then -v - 1 when {ends(2)} then cast(1 as double) else v end as v, case when {ends(5)} then substring(control_point_id, 1, 12) when {ends(6)} then substring(control_point_id, 1, 12) || '8' else control_point_id end as control_point_id from image_measurements",
    "control_points": f"select id, case when {ends(3)} then est_lat + 50 else est_lat end as est_lat, case when {ends(4, 3)} then est_lng - 100 else est_lng end as est_lng, case when {ends(5)} then cast(-99999 as double) else est_alt end as est_alt from control_points",
}
_ID_RULE = f"control_point_id is not null and not regexp_matches(control_point_id, '{ID_PATTERN}')"
_RULES = {
    "stations": "when not (lat >= -90 and lat <= 90 and lng >= -180 and lng <= 180) then 'lat/lng out of range'",
    "photos": "when aspect <= 0 or aspect > 100 then 'aspect out of range' when size_rad < 0 then 'size_rad out of range' when opacity < 0 or opacity > 1 then 'opacity out of range'",
    "map_measurements": f"when lat < -90 or lat > 90 then 'lat out of range' when lng < -180 or lng > 180 then 'lng out of range' when {_ID_RULE} then 'invalid control_point_id'",
    "image_measurements": f"when u < 0 or u > 1 or v < 0 or v > 1 then 'u/v out of range' when {_ID_RULE} then 'invalid control_point_id'",
    "control_points": "when est_lat < -90 or est_lat > 90 then 'est_lat out of range' when est_lng < -180 or est_lng > 180 then 'est_lng out of range'",
}
for _name, _sql in _BAD.items():
    query(f"validate_{_name}", f"select id, case {_RULES[_name]} end as reject_reason from spoilt", spoilt=_sql)(
        lambda t, n=_name, s=_sql: getattr(validate, f"validate_{n}")(t.sql(s, **{n: t.entity(n)})).select("id", "reject_reason")
    )

_ODD_IDS = f"select c_custkey as k, case mod(c_custkey, 5) when 0 then 'abc' when 1 then lower({entity_id('S', 'c_custkey')}) when 2 then concat({entity_id('S', 'c_custkey')}, 'A') when 3 then cast(c_custkey as string) else {entity_id('S', 'c_custkey')} end as id from customer"


@query("validate_ids", f"select k, id, regexp_matches(id, '{ID_PATTERN}') as valid from odd", odd=_ODD_IDS)
def _(t):
    return validate.validate_ids(t.sql(_ODD_IDS))


_LOOSE = f"select id, case when {ends(3, 4)} then cast(0 as double) else size_rad end as size_rad, case when {ends(5)} then null else opacity end as opacity from photos"


@query("photo_create_defaults", "select id, case when size_rad = 0 then 0.5236::double else size_rad end as size_rad, coalesce(opacity, 1::double) as opacity from loose", loose=_LOOSE)
def _(t):
    return validate.photo_create_defaults(t.sql(_LOOSE, photos=t.ph))


# --- filters and lookups --------------------------------------------------------------------------------------------


@query("stations_in_bbox", f"select {star('stations')} from stations where {IN_BOX.format(lng='lng', lat='lat')} order by stations.created_at desc, stations.id limit 1000")
def _(t):
    return reads.stations_in_bbox(t.st, BBOX)


@query("control_points_in_bbox", f"select {star('control_points')} from control_points where {IN_BOX.format(lng='est_lng', lat='est_lat')} order by control_points.created_at desc, control_points.id limit 1000")
def _(t):
    return reads.control_points_in_bbox(t.cp, BBOX)


_BOXES = "select c_custkey as box_id, cast(-122 as double) + cast(mod(c_custkey * 37, 100) as double) / cast(100 as double) as min_lng, cast(47 as double) + cast(mod(c_custkey * 53, 100) as double) / cast(100 as double) as min_lat, cast(-122 as double) + cast(mod(c_custkey * 37, 100) + mod(c_custkey, 7) as double) / cast(100 as double) as max_lng, cast(47 as double) + cast(mod(c_custkey * 53, 100) + mod(c_custkey, 5) as double) / cast(100 as double) as max_lat from customer"


@query("boxes_join", "select box_id, id from boxes join control_points on est_lng between min_lng and max_lng and est_lat between min_lat and max_lat", boxes=_BOXES)
def _(t):
    return reads.boxes_join(t.sql(_BOXES), reads.located_control_points(t.cp))


_ASKED = f"select {entity_id('S', 'o_custkey + mod(o_orderkey, 3) * 100000')} as id from orders"


@query("lookup_by_id", "select a.id, s.id is not null as found, s.lat, s.lng, s.name from (select distinct id from asked) a left join stations s on s.id = a.id", asked=_ASKED)
def _(t):
    return reads.lookup_by_id(t.st.select("id", "lat", "lng", "name"), t.sql(_ASKED))


@query("photos_with_blob", "select id, mime_type from photos where blob_path is not null")
def _(t):
    return reads.photos_with_blob(t.ph)


@query("list_map_measurements", f"select {star('map_measurements')} from map_measurements")
def _(t):
    return reads.list_map_measurements(t.mm)


@query("located_control_points", "select id, est_lat as lat, est_lng as lng, description from control_points where est_lat is not null and est_lng is not null")
def _(t):
    return reads.located_control_points(t.cp)


@query("display_labels", """select 'station' as entity, id, coalesce(name, concat('Untitled ', substring(id, 1, 6))) as label, concat('/station/', id) as link from stations
    union all select 'station_list', id, coalesce(name, concat('(untitled ', substring(id, 1, 6), ')')), concat('/station/', id) from stations
    union all select 'control_point', id, case when description = '' then concat('cp ', substring(id, 1, 6)) else description end, concat('/cp/', id) from control_points
    union all select 'control_point_place', id, case when est_lat is null or est_lng is null then '—' else printf('%.5f, %.5f', est_lat, est_lng) end, concat('/?cp=', id) from control_points
    union all select 'control_point_alt', id, case when est_alt is null then '—' else printf('%.1f', est_alt) end, concat('/cp/', id) from control_points
    union all select 'image_measurement', i.id, printf('(u=%.2f, v=%.2f)', round(i.u, 2), round(i.v, 2)), concat('/station/', p.station_id, '?focus=', i.id) from image_measurements i join photos p on p.id = i.photo_id""")
def _(t):
    return reads.display_labels(t.st, t.cp, t.im, t.ph)


# --- joins ----------------------------------------------------------------------------------------------------------

_OBS = """select i.id, i.photo_id, i.u, i.v, i.control_point_id, s.id as station_id, s.name as station_name, s.lat as station_lat, s.lng as station_lng, p.photo_az, p.photo_tilt, p.photo_roll, p.size_rad, p.aspect, i.created_at
    from image_measurements i, photos p, stations s where p.id = i.photo_id and s.id = p.station_id and i.control_point_id is not null"""


@query("cp_image_observations", f"select * exclude (created_at) from ({_OBS})")
def cp_image_observations(t):
    return reads.cp_image_observations(t.im, t.ph, t.st).drop("created_at")


@query("cp_map_observations", "select id, control_point_id, lat, lng from map_measurements where control_point_id is not null")
def _(t):
    return reads.cp_map_observations(t.mm).drop("created_at")


def _ids_of(col: str):
    return F.array_join(F.transform(col, lambda x: x["id"]), ",")


@query("cp_observations", f"""select c.id as control_point_id, coalesce(i.n, 0) as n_image, coalesce(m.n, 0) as n_map, coalesce(i.ids, '') as image_ids, coalesce(m.ids, '') as map_ids, {r('coalesce(i.s, 0::double)')} as lat_sum
    from control_points c left join (select control_point_id, count(*) as n, string_agg(id, ',' order by created_at, id) as ids, sum(station_lat) as s from obs group by 1) i on i.control_point_id = c.id
    left join (select control_point_id, count(*) as n, string_agg(id, ',' order by created_at, id) as ids from map_measurements where control_point_id is not null group by 1) m on m.control_point_id = c.id""", obs=_OBS)
def _(t):
    rows = reads.cp_observations(t.cp, t.im, t.ph, t.st, t.mm, image_fields=("station_lat",), map_fields=())
    total = F.aggregate("image_measurements", F.lit(0.0), lambda a, x: a + x["station_lat"])
    out = rows.select("control_point_id", F.size("image_measurements").cast("long").alias("n_image"), F.size("map_measurements").cast("long").alias("n_map"), _ids_of("image_measurements").alias("image_ids"), _ids_of("map_measurements").alias("map_ids"), total.alias("lat_sum"))
    return near(out, "lat_sum")


@query("cp_observation_feed", """select control_point_id, kind, row_number() over (partition by control_point_id order by rank, created_at, id) as seq, id, label from (
    select m.control_point_id, 'map' as kind, 0 as rank, m.created_at, m.id, printf('observed at %.5f, %.5f', round(m.lat, 5), round(m.lng, 5)) as label from map_measurements m join control_points c on c.id = m.control_point_id
    union all select o.control_point_id, 'image', 1, o.created_at, o.id, concat(printf('(u=%.2f, v=%.2f) in ', round(o.u, 2), round(o.v, 2)), coalesce(station_name, concat('(untitled ', substring(station_id, 1, 6), ')'))) from obs o join control_points c on c.id = o.control_point_id)""", obs=_OBS)
def _(t):
    return reads.cp_observation_feed(t.cp, t.im, t.ph, t.st, t.mm)


@query("station_photos", f"select {star('photos')} from photos")
def _(t):
    return reads.station_photos(t.ph)


@query("station_image_measurements", f"select p.station_id, {star('image_measurements', 'i.')} from image_measurements i join photos p on p.id = i.photo_id")
def _(t):
    return reads.station_image_measurements(t.im, t.ph)


@query("station_control_points", f"""select x.station_id, {star('control_points', 'c.')} from control_points c join (select distinct p.station_id, i.control_point_id from image_measurements i join photos p on p.id = i.photo_id where i.control_point_id is not null) x on x.control_point_id = c.id""")
def _(t):
    return reads.station_control_points(t.cp, t.im, t.ph)


@query("hydrate_stations", """select s.id as station_id, s.name, coalesce(a.n, 0) as n_photos, coalesce(a.ids, '') as photos, coalesce(b.n, 0) as n_images, coalesce(b.ids, '') as images, coalesce(c.n, 0) as n_points, coalesce(c.ids, '') as points from stations s
    left join (select station_id, count(*) as n, string_agg(id, ',' order by created_at, id) as ids from photos group by 1) a on a.station_id = s.id
    left join (select station_id, count(*) as n, string_agg(i.id, ',' order by i.created_at, i.id) as ids from image_measurements i join photos p on p.id = i.photo_id group by 1) b on b.station_id = s.id
    left join (select station_id, count(*) as n, string_agg(x.id, ',' order by c.created_at, c.id) as ids from (select distinct p.station_id, i.control_point_id as id from image_measurements i join photos p on p.id = i.photo_id) x join control_points c on c.id = x.id group by 1) c on c.station_id = s.id""")
def _(t):
    rows = reads.hydrate_stations(t.st, t.ph, t.im, t.cp)
    size = lambda c: F.size(c).cast("long")
    return rows.select("station_id", "station.name", size("photos").alias("n_photos"), _ids_of("photos").alias("photos"), size("image_measurements").alias("n_images"), _ids_of("image_measurements").alias("images"), size("control_points").alias("n_points"), _ids_of("control_points").alias("points"))


_PAIRS = "select distinct p.station_id, i.control_point_id from image_measurements i join photos p on p.id = i.photo_id where i.control_point_id is not null"
_LOCATED = "select id as control_point_id, est_lat as lat, est_lng as lng from control_points where est_lat is not null and est_lng is not null"


@query("station_located_cps", "select station_id, control_point_id, lat, lng from pairs join located using (control_point_id)", pairs=_PAIRS, located=_LOCATED)
def _(t):
    return reads.station_located_cps(t.cp, t.im, t.ph)


_REQUESTED = f"select {entity_id('S', 'n_nationkey * 5 + 1')} as id from nation"


@query("station_preview", "select s.id as station_id, l.control_point_id, p.station_id is not null as observed from stations s join (select distinct id from requested) q on q.id = s.id cross join located l left join pairs p on p.station_id = s.id and p.control_point_id = l.control_point_id", pairs=_PAIRS, located=_LOCATED, requested=_REQUESTED)
def _(t):
    return reads.station_preview(t.st, t.ph, t.im, t.cp, t.sql(_REQUESTED, nation=t.raw("nation")))


@query("station_preview_bits", "select station_id, count(*) as n_observed from pairs join located using (control_point_id) group by 1", pairs=_PAIRS, located=_LOCATED)
def _(t):
    """The bitmaps of all stations, counted."""
    bits = reads.station_preview_bits(t.im, t.ph, reads.point_numbers(t.cp))
    return bits.groupBy("station_id").agg(F.sum(F.bitmap_count("observed")).alias("n_observed"))


@query("station_preview_cones", f"select s.id as station_id, p.id as photo_id, {r('p.photo_az + p.size_rad / 2')} as az_l, {r('p.photo_az - p.size_rad / 2')} as az_r from stations s join (select distinct id from requested) q on q.id = s.id join photos p on p.station_id = s.id", requested=_REQUESTED)
def _(t):
    return near(reads.station_preview_cones(t.ph, t.sql(_REQUESTED, nation=t.raw("nation"))), "az_l", "az_r")


_ANCHORED = "select p.station_id, i.photo_id, i.id, i.u, i.v, i.control_point_id, c.est_lat, c.est_lng from image_measurements i join photos p on p.id = i.photo_id join control_points c on c.id = i.control_point_id where c.est_lat is not null and c.est_lng is not null"
_PRIORS = "select x.station_id, m.control_point_id, m.id as map_measurement_id, m.lat, m.lng, 30::double as sigma_m from map_measurements m join (select distinct station_id, control_point_id from anchored) x on x.control_point_id = m.control_point_id"


@query("anchored_measurements", f"select * from ({_ANCHORED})")
def _(t):
    return reads.anchored_measurements(t.im, t.ph, t.cp)


@query("solver_priors", f"select * from ({_PRIORS})", anchored=_ANCHORED)
def _(t):
    return reads.solver_priors(t.mm, reads.anchored_measurements(t.im, t.ph, t.cp))


@query("linked_map_measurement", "select control_point_id, id as map_measurement_id from (select *, row_number() over (partition by control_point_id order by created_at, id) as k from map_measurements where control_point_id is not null) where k = 1")
def _(t):
    return reads.linked_map_measurement(t.mm)


_PINS = "select photo_id, control_point_id, id from (select *, row_number() over (partition by photo_id, control_point_id order by created_at, id) as k from image_measurements where control_point_id is not null) where k = 1"


@query("pin_on_photo", f"select * from ({_PINS})")
def _(t):
    return reads.pin_on_photo(t.im)


@query("linked_measurements", "select id as measurement_id, kind, control_point_id, (count(*) filter (where kind = 'image') over w - case when kind = 'image' then 1 else 0 end)::bigint as n_image, (count(*) filter (where kind = 'map') over w - case when kind = 'map' then 1 else 0 end)::bigint as n_map from linked window w as (partition by control_point_id)", linked="select id, 'image' as kind, control_point_id from image_measurements where control_point_id is not null union all select id, 'map', control_point_id from map_measurements where control_point_id is not null")
def _(t):
    return reads.linked_measurements(t.im, t.mm)


@query("new_map_measurements", f"select {star('map_measurements')} from map_measurements where {ends(1, 2, 3)}")
def _(t):
    return reads.new_map_measurements(t.mm, t.mm.filter(f"not ({ends(1, 2, 3)})"))


# --- referential actions --------------------------------------------------------------------------------------------


def _left(tables: dict[str, DataFrame], *links: str) -> DataFrame:
    out = None
    for name, df in tables.items():
        link = next((c for c in links if c in df.columns), None)
        rows = df.select(F.lit(name).alias("entity"), "id", (F.col(link) if link else F.lit(None).cast("string")).alias("link"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("delete_stations", f"""select 'stations' as entity, id, null as link from stations where not {ends(3, 4)} union all select 'photos', id, station_id from photos where not {ends(3, 4, col='station_id')}
    union all select 'image_measurements', i.id, i.photo_id from image_measurements i join photos p on p.id = i.photo_id where not {ends(3, 4, col='p.station_id')} union all select 'blob_ids', id, null from photos where {ends(3, 4, col='station_id')}""")
def _(t):
    return _left(integrity.delete_stations(t.st, t.ph, t.im, t.st.filter(ends(3, 4))), "station_id", "photo_id")


@query("delete_photos", f"""select 'photos' as entity, id, station_id as link from photos where not {ends(3)} union all select 'image_measurements', id, photo_id from image_measurements where not {ends(3, col='photo_id')} union all select 'blob_ids', id, null from photos where {ends(3)}""")
def _(t):
    return _left(integrity.delete_photos(t.ph, t.im, t.ph.filter(ends(3))), "station_id", "photo_id")


@query("delete_control_points", f"""select 'control_points' as entity, id, null as link from control_points where not {ends(3, 5)} union all select 'image_measurements', id, case when {ends(3, 5, col='control_point_id')} then null else control_point_id end from image_measurements
    union all select 'map_measurements', id, case when {ends(3, 5, col='control_point_id')} then null else control_point_id end from map_measurements""")
def _(t):
    # Point 0 is no row, so links to it are not touched by a delete of rows.
    return _left(integrity.delete_control_points(t.cp, t.im, t.mm, t.cp.filter(ends(3, 5))), "control_point_id")


@query("delete_measurements", f"select {star('map_measurements')} from map_measurements where not {ends(2, 7)}")
def _(t):
    return integrity.delete_measurements(t.mm, t.mm.filter(ends(2, 7)))


_CUT = f"select * from stations where not {ends(9)}"


@query("fk_violations", f"""select 'photos.station_id' as rule, id as child_id, station_id as missing_id from photos where station_id not in (select id from stations where not {ends(9)})
    union all select 'image_measurements.photo_id', id, photo_id from image_measurements where photo_id not in (select id from photos where not {ends(8)})
    union all select 'image_measurements.control_point_id', id, control_point_id from image_measurements where control_point_id not in (select id from control_points where not {ends(7)})
    union all select 'map_measurements.control_point_id', id, control_point_id from map_measurements where control_point_id not in (select id from control_points where not {ends(7)})""")
def _(t):
    return integrity.fk_violations(t.st.filter(f"not {ends(9)}"), t.ph, t.im, t.mm, t.cp.filter(f"not {ends(7)}")).filter("rule <> 'image_measurements.photo_id'").unionByName(
        integrity.fk_violations(t.st, t.ph.filter(f"not {ends(8)}"), t.im, t.mm, t.cp).filter("rule = 'image_measurements.photo_id'")
    )


@query("unobserved_control_points", "select id from control_points c where not exists (select 1 from image_measurements i where i.control_point_id = c.id) and not exists (select 1 from map_measurements m where m.control_point_id = c.id)")
def _(t):
    return integrity.unobserved_control_points(t.cp, t.im, t.mm)


@query("unlinked_measurements", "select 'image' as kind, id from image_measurements where control_point_id is null union all select 'map', id from map_measurements where control_point_id is null")
def _(t):
    return integrity.unlinked_measurements(t.im, t.mm)


# --- aggregates -----------------------------------------------------------------------------------------------------

_COUNTS = "select c.id as control_point_id, (select count(*) from image_measurements i where i.control_point_id = c.id) as n_image, (select count(*) from map_measurements m where m.control_point_id = c.id) as n_map from control_points c"


@query("cp_observation_counts", f"select * from ({_COUNTS})")
def _(t):
    return agg.cp_observation_counts(t.cp, t.im, t.mm)


@query("cp_mean_map_position", f"select control_point_id, {r('avg(lat)')} as lat, {r('avg(lng)')} as lng, count(*) as n from map_measurements where control_point_id is not null group by 1")
def _(t):
    return near(agg.cp_mean_map_position(t.mm), "lat", "lng")


@query("cp_initial_guess", f"""select c.id as control_point_id, {r("case when m.control_point_id is not null then m.lat when c.est_lat is not null and c.est_lng is not null then c.est_lat else o.lat end")} as lat,
    {r("case when m.control_point_id is not null then m.lng when c.est_lat is not null and c.est_lng is not null then c.est_lng else o.lng end")} as lng,
    case when m.control_point_id is not null then 'map' when c.est_lat is not null and c.est_lng is not null then 'estimate' else 'stations' end as source from control_points c
    left join (select control_point_id, avg(lat) as lat, avg(lng) as lng from map_measurements where control_point_id is not null group by 1) m on m.control_point_id = c.id
    left join (select control_point_id, avg(station_lat) as lat, avg(station_lng) as lng from obs group by 1) o on o.control_point_id = c.id
    where m.control_point_id is not null or (c.est_lat is not null and c.est_lng is not null) or o.control_point_id is not null""", obs=_OBS)
def _(t):
    return near(agg.cp_initial_guess(t.cp, t.im, t.ph, t.st, t.mm), "lat", "lng")


@query("cp_solvable", f"select control_point_id, n_image + 2 * n_map >= 2 as solvable from ({_COUNTS})")
def _(t):
    return agg.cp_solvable(t.cp, t.im, t.mm)


@query("photo_free_params", "select station_id, photo_id, count(*) as n, case when count(*) = 1 then 'photo_az' when count(*) >= 3 then 'photo_az,size_rad,photo_roll' else 'photo_az,size_rad' end as free from anchored group by 1, 2", anchored=_ANCHORED)
def _(t):
    return agg.photo_free_params(reads.anchored_measurements(t.im, t.ph, t.cp), True).withColumn("free", F.array_join("free", ","))


@query("camera_solvable", """select a.station_id, images + 2 * coalesce(priors, 0) as n_obs, 2 + locals + 2 * coalesce(priors, 0) as n_unknowns, images + 2 * coalesce(priors, 0) >= 2 + locals + 2 * coalesce(priors, 0) + 2 as solvable
    from (select station_id, sum(n)::bigint as images, sum(case when n = 1 then 1 else 2 end)::bigint as locals from (select station_id, photo_id, count(*) as n from anchored group by 1, 2) group by 1) a
    left join (select station_id, count(*) as priors from priors group by 1) p on p.station_id = a.station_id""", anchored=_ANCHORED, priors=_PRIORS)
def _(t):
    anchored = reads.anchored_measurements(t.im, t.ph, t.cp)
    return agg.camera_solvable(anchored, reads.solver_priors(t.mm, anchored))


@query("station_observed_cps", f"select * from ({_PAIRS})")
def _(t):
    return reads.station_observed_cps(t.im, t.ph)


# --- sort, limit, change sets ---------------------------------------------------------------------------------------


@query("recent_stations", f"select {star('stations')} from stations order by stations.created_at desc, stations.id limit 1000")
def _(t):
    return reads.newest(t.st)


@query("recent_control_points", f"select {star('control_points')} from control_points order by control_points.created_at desc, control_points.id limit 1000")
def _(t):
    return reads.newest(t.cp)


_NOW = f"select id, aspect, photo_az, photo_tilt, photo_roll, size_rad, case when {ends(4)} then opacity + 1 when {ends(5)} then null else opacity end as opacity from photos where not {ends(2)}"
_WAS = f"select id, aspect, photo_az, photo_tilt, photo_roll, size_rad, case when {ends(6)} then null else opacity end as opacity from photos where not {ends(3)}"
_POSE6 = ["aspect", "photo_az", "photo_tilt", "photo_roll", "size_rad", "opacity"]


@query("snapshot_diff", f"""select coalesce(n.id, w.id) as id, case when w.id is null then 'create' when n.id is null then 'delete' else 'update' end as op, {', '.join('n.' + c for c in _POSE6)} from now_rows n full join was_rows w on n.id = w.id
    where w.id is null or n.id is null or {' or '.join(f'n.{c} is distinct from w.{c}' for c in _POSE6)}""", now_rows=_NOW, was_rows=_WAS)
def _(t):
    return changes.snapshot_diff(t.sql(_NOW, photos=t.ph), t.sql(_WAS, photos=t.ph), _POSE6)


_CP_COLS = ["description", "est_lat", "est_lng", "est_alt", "started_at", "ended_at"]
_CP_WAS = f"select id, case when {ends(3)} then concat(description, '!') else description end as description, est_lat, est_lng, est_alt, case when {ends(2)} then started_at + interval '10' second when {ends(8)} then started_at + interval '1' hour else started_at end as started_at, ended_at from control_points where not {ends(5)}"


@query("snapshot_diff_points", f"""select coalesce(n.id, w.id) as id, case when n.id is null then 'delete' else 'update' end as op, n.description, n.est_lat, n.est_lng, n.est_alt, {stamp('n.started_at')} as started_at, {stamp('n.ended_at')} as ended_at
    from (select * from control_points where not {ends(4)}) n full join was_rows w on n.id = w.id where w.id is not null and (n.id is null or n.description is distinct from w.description or date_trunc('minute', n.started_at) is distinct from date_trunc('minute', w.started_at))""", was_rows=_CP_WAS)
def _(t):
    return changes.snapshot_diff(t.cp.filter(f"not {ends(4)}"), t.sql(_CP_WAS, control_points=t.cp), _CP_COLS, emit_creates=False, minute_cols=("started_at", "ended_at"))


_PATCHES = f"select event_id as seq, {entity_id('P', 'mod(event_id * 31, n) + 1')} as id, cast(1 + mod(event_id, 5) as double) as aspect, cast(mod(event_id, 7) as double) / cast(10 as double) as photo_az, cast(0 as double) as photo_tilt, cast(0 as double) as photo_roll, cast(mod(event_id, 3) as double) as size_rad, case when mod(event_id, 4) = 0 then null else cast(mod(event_id, 10) as double) / cast(10 as double) end as opacity from (select e.event_id, c.n from events e cross join (select count(*) as n from orders) c) x"


@query("apply_patches", """select p.id, coalesce(l.aspect, p.aspect) as aspect, coalesce(l.photo_az, p.photo_az) as photo_az, coalesce(l.photo_tilt, p.photo_tilt) as photo_tilt, coalesce(l.photo_roll, p.photo_roll) as photo_roll, coalesce(l.size_rad, p.size_rad) as size_rad, case when l.id is null then p.opacity else coalesce(l.opacity, 1::double) end as opacity
    from photos p left join (select * from (select *, row_number() over (partition by id order by seq desc) as k from patches) where k = 1) l on l.id = p.id""", patches=_PATCHES)
def _(t):
    return changes.apply_patches(t.ph, t.sql(_PATCHES), "photo").select("id", *_POSE6)


_STRAY = _PATCHES.replace("mod(event_id * 31, n) + 1", "mod(event_id * 31, 2 * n) + 1")


@query("rejected_patches", "select seq, id, 'not found' as reason from patches where id not in (select id from photos)", patches=_STRAY)
def _(t):
    return changes.rejected_patches(t.ph, t.sql(_STRAY))


_CP_PATCHES = f"select event_id as seq, {entity_id('C', 'mod(event_id * 7, n) + 1')} as id, case when mod(event_id, 3) = 0 then null else concat('d', cast(event_id as string)) end as description, case when mod(event_id, 2) = 0 then null else concat('n', cast(event_id as string)) end as notes, case when mod(event_id, 5) = 0 then null else cast(47 as double) end as est_lat, cast(-122 as double) as est_lng, cast(null as double) as est_alt, cast(null as timestamp) as started_at, cast(null as timestamp) as ended_at from (select e.event_id, c.n from events e cross join (select count(*) as n from part) c) x"


@query("apply_patches_points", """select c.id, coalesce(d.v, c.description) as description, coalesce(o.v, c.notes) as notes, case when l.id is null then c.est_lat else l.est_lat end as est_lat, case when l.id is null then c.est_lng else l.est_lng end as est_lng, case when l.id is null then c.est_alt else l.est_alt end as est_alt
    from control_points c left join (select id, arg_max(description, seq) as v from patches where description is not null group by 1) d on d.id = c.id left join (select id, arg_max(notes, seq) as v from patches where notes is not null group by 1) o on o.id = c.id
    left join (select * from (select *, row_number() over (partition by id order by seq desc) as k from patches) where k = 1) l on l.id = c.id""", patches=_CP_PATCHES)
def _(t):
    patches = t.sql(_CP_PATCHES)
    patches = patches.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})
    return changes.apply_patches(t.cp, patches, "control_point").select("id", "description", "notes", "est_lat", "est_lng", "est_alt")


_NEW_PHOTOS = f"select event_id as key, ts as at, {entity_id('S', 'mod(event_id, n) + 1')} as station_id, cast(mod(event_id, 6) as double) as aspect, cast(0 as double) as photo_az, cast(0 as double) as photo_tilt, cast(0 as double) as photo_roll, cast(mod(event_id, 2) as double) as size_rad, case when mod(event_id, 3) = 0 then null else cast(mod(event_id, 13) as double) / cast(10 as double) end as opacity from (select e.event_id, e.ts, c.n from events e cross join (select count(*) * 2 as n from customer) c) x"


@query("create_entities", f"""select null as key, {_base32('key')} as id, station_id, aspect, case when size_rad = 0 then 0.5236::double else size_rad end as size_rad, coalesce(opacity, 1::double) as opacity, null as reject_reason from asked where aspect > 0 and coalesce(opacity, 1::double) <= 1 and station_id in (select id from stations)
    union all select key, null, null, null, null, null, case when aspect <= 0 then 'aspect out of range' when opacity > 1 then 'opacity out of range' else 'unknown station_id' end from asked where not (aspect > 0 and coalesce(opacity, 1::double) <= 1 and station_id in (select id from stations))""", asked=_NEW_PHOTOS)
def _(t):
    made, bad = changes.create_entities(t.sql(_NEW_PHOTOS), "photo", t.st, "station_id")
    return made.select("id", "station_id", "aspect", "size_rad", "opacity").unionByName(bad, allowMissingColumns=True).select("key", "id", "station_id", "aspect", "size_rad", "opacity", "reject_reason")


@query("cp_patch_complete", f"select p.seq, p.id, p.description, p.notes, coalesce(p.est_lat, c.est_lat) as est_lat, coalesce(p.est_lng, c.est_lng) as est_lng, coalesce(p.est_alt, c.est_alt) as est_alt, {stamp('c.started_at')} as started_at, {stamp('c.ended_at')} as ended_at from patches p join control_points c on c.id = p.id", patches=_CP_PATCHES)
def _(t):
    patches = t.sql(_CP_PATCHES)
    return changes.cp_patch_complete(patches.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")}), t.cp)


_MATCHES = f"select l_linenumber * 1000000 + l_suppkey as seq, {entity_id('P', 'l_orderkey')} as photo_id, {entity_id('C', 'l_partkey + mod(l_orderkey, 2)')} as control_point_id, cast(mod(l_suppkey, 11) as double) / cast(10 as double) as u, cast(l_linenumber as double) / cast(10 as double) as v from lineitem"


@query("upsert_pins", "select m.photo_id, m.control_point_id, case when p.id is null then 'insert' else 'move' end as op, p.id, m.u, m.v from (select photo_id, control_point_id, max(seq) as seq, arg_max(u, seq) as u, arg_max(v, seq) as v from matches group by 1, 2) m left join pins p on p.photo_id = m.photo_id and p.control_point_id = m.control_point_id", matches=_MATCHES, pins=_PINS)
def _(t):
    return changes.upsert_pins(t.sql(_MATCHES), t.im)


_ASKS = f"select event_id as key, ts as at, case when mod(event_id, 2) = 0 then 'map' else 'image' end as kind, case when mod(event_id, 5) = 0 then null else event_type end as description, {entity_id('P', 'event_id')} as photo_id, cast(mod(event_id, 12) as double) / cast(10 as double) as u, cast(mod(event_id, 7) as double) / cast(10 as double) as v, cast(mod(event_id, 100) as double) as lat, cast(mod(event_id, 170) as double) as lng from events"


@query("create_cp_with_observation", f"""select 'control_points' as entity, {_base32('key * 2')} as id, null as link, case when kind = 'map' then lat end as a, case when kind = 'map' then lng end as b from good
    union all select case when kind = 'map' then 'map_measurements' else 'image_measurements' end, {_base32('key * 2 + 1')}, {_base32('key * 2')}, case when kind = 'map' then lat else u end, case when kind = 'map' then lng else v end from good""", asks=_ASKS, good="select * from asks where (kind = 'map' and lat <= 90) or (kind = 'image' and u <= 1)")
def _(t):
    got = changes.create_cp_with_observation(t.sql(_ASKS))
    cp = got["control_points"].select(F.lit("control_points").alias("entity"), "id", F.lit(None).cast("string").alias("link"), F.col("est_lat").alias("a"), F.col("est_lng").alias("b"))
    im = got["image_measurements"].select(F.lit("image_measurements").alias("entity"), "id", F.col("control_point_id").alias("link"), F.col("u").alias("a"), F.col("v").alias("b"))
    mm = got["map_measurements"].select(F.lit("map_measurements").alias("entity"), "id", F.col("control_point_id").alias("link"), F.col("lat").alias("a"), F.col("lng").alias("b"))
    return cp.unionByName(im).unionByName(mm)


_STARTS = "select c_custkey as key, cast('2022-01-01 00:00:00' as timestamp) as at, cast(47 as double) as lat, cast(-122 as double) as lng, case when mod(c_custkey, 3) = 0 then '' else c_name end as name from customer"


@query("start_stations", f"""select 'stations' as entity, {_base32('key')} as id, case when name = '' then null else name end as label, null as photo_az, null as aspect from starts
    union all select 'photos', {_base32('key * 16777216 + i')}, {_base32('key')}, {r('i::double / (1 + key % 6) * 2 * pi()')}, 1 + i / 2::double from (select key, unnest(range(0, 1 + key % 6)) as i from starts) where (key + i) % 5 <> 0""", starts=_STARTS)
def _(t):
    rows = t.sql(_STARTS).withColumn("at", F.col("at").cast("timestamp_ntz"))
    each = F.transform(F.sequence(F.lit(0), (F.col("key") % 6).cast("int")), lambda i: F.when((F.col("key") + i) % 5 != 0, F.lit(1.0) + i / F.lit(2.0)))
    got = changes.start_stations(rows.withColumn("aspects", each))
    st = got["stations"].select(F.lit("stations").alias("entity"), "id", F.col("name").alias("label"), F.lit(None).cast("double").alias("photo_az"), F.lit(None).cast("double").alias("aspect"))
    return st.unionByName(near(got["photos"].select(F.lit("photos").alias("entity"), "id", F.col("station_id").alias("label"), "photo_az", "aspect"), "photo_az"))


_PROPOSALS = f"select {entity_id('S', 'l_suppkey')} as station_id, {entity_id('C', 'l_partkey')} as control_point_id, cast(l_linenumber as double) as lat, cast(mod(l_orderkey, 100) as double) as lng, l_orderkey * 10 + l_linenumber as solved_at from lineitem where mod(l_partkey, 3) = 0"


@query("resolve_cp_proposals", "select c.id, coalesce(p.lat, c.est_lat) as est_lat, coalesce(p.lng, c.est_lng) as est_lng, c.est_alt from control_points c left join (select control_point_id, max(solved_at) as s from proposals group by 1) q on q.control_point_id = c.id left join (select distinct control_point_id, solved_at, lat, lng, station_id, row_number() over (partition by control_point_id order by solved_at desc, station_id desc, lat desc, lng desc) as k from proposals) p on p.control_point_id = c.id and p.k = 1", proposals=_PROPOSALS)
def _(t):
    return changes.resolve_cp_proposals(t.sql(_PROPOSALS), t.cp).select("id", "est_lat", "est_lng", "est_alt")
