"""Entity tables derived from the star-schema test tables, by one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entity_id(letter: str, key: str) -> str:
    return f"concat('{letter}', translate(lpad(cast({key} as string), 12, '0'), '0189', 'ABIJ'))"


def ratio(top: str, bottom: str | int) -> str:
    return f"cast({top} as double) / cast({bottom} as double)"


_LAT, _LNG = "cast(47 as double) + ", "cast(-122 as double) + "

VIEWS = {
    "stations": f"""select {entity_id('S', 'c_custkey')} as id, {_LAT}{ratio('mod(c_custkey * 7919, 10007)', 10007)} as lat,
        {_LNG}{ratio('mod(c_custkey * 104729, 10009)', 10009)} as lng, case when mod(c_custkey, 7) = 0 then null else c_name end as name,
        timestamp '2020-01-01 00:00:00' + c_custkey * interval '1' minute as created_at,
        timestamp '2021-01-01 00:00:00' + c_custkey * interval '1' minute as updated_at from customer""",
    "photos": f"""select {entity_id('P', 'o_orderkey')} as id, {entity_id('S', 'o_custkey')} as station_id,
        case when mod(o_orderkey, 5) = 0 then null else concat('photos/', {entity_id('P', 'o_orderkey')}) end as blob_path,
        case when mod(o_orderkey, 5) = 0 then null when mod(o_orderkey, 3) = 0 then 'image/png' else 'image/jpeg' end as mime_type,
        case when mod(o_orderkey, 5) = 0 then null else cast(mod(o_orderkey * 977, 60000000) as bigint) end as size_bytes,
        {ratio('mod(o_orderkey, 4) + 2', 2)} as aspect, {ratio('mod(o_orderkey * 37, 6283) - 3141', 1000)} as photo_az,
        {ratio('mod(o_orderkey * 11, 601) - 300', 1000)} as photo_tilt, {ratio('mod(o_orderkey * 13, 201) - 100', 1000)} as photo_roll,
        {ratio('200 + mod(o_orderkey * 17, 1001)', 1000)} as size_rad, {ratio('mod(o_orderkey, 11)', 10)} as opacity,
        o_orderdate as created_at, o_orderdate as updated_at from orders""",
    "control_points": f"""select {entity_id('C', 'p_partkey')} as id, case when mod(p_partkey, 13) = 0 then '' else p_name end as description,
        case when mod(p_partkey, 3) = 0 then p_type else '' end as notes,
        case when mod(p_partkey, 9) = 0 then null else {_LAT}{ratio('mod(p_partkey * 6151, 997)', 1000)} end as est_lat,
        case when mod(p_partkey, 9) = 0 then null else {_LNG}{ratio('mod(p_partkey * 3571, 991)', 1000)} end as est_lng,
        case when mod(p_partkey, 4) = 0 then cast(p_size as double) else null end as est_alt,
        case when mod(p_partkey, 6) = 0 then timestamp '1990-01-01 00:00:30' + p_partkey * interval '1' day else null end as started_at,
        case when mod(p_partkey, 12) = 0 then timestamp '2010-01-01 00:00:30' + p_partkey * interval '1' day else null end as ended_at,
        timestamp '2020-01-01 00:00:00' + p_partkey * interval '1' minute as created_at,
        timestamp '2021-01-01 00:00:00' + p_partkey * interval '1' minute as updated_at from part""",
    "image_measurements": f"""select {entity_id('I', 'l_orderkey * 100000 + l_partkey')} as id, {entity_id('P', 'l_orderkey')} as photo_id,
        {ratio('mod(l_orderkey * 31 + l_partkey * 17, 1001)', 1000)} as u, {ratio('mod(l_orderkey * 7 + l_partkey * 29, 1001)', 1000)} as v,
        case when mod(l_orderkey + l_partkey, 17) = 0 or mod(l_partkey, 25) = 3 then null else {entity_id('C', 'l_partkey')} end as control_point_id,
        min(l_shipdate) as created_at, min(l_shipdate) as updated_at from lineitem group by l_orderkey, l_partkey""",
    "map_measurements": f"""select {entity_id('M', 'event_id')} as id,
        {_LAT}{ratio('mod(k * 6151, 997)', 1000)} + {ratio('mod(event_id * 19, 201) - 100', 1000000)} as lat,
        {_LNG}{ratio('mod(k * 3571, 991)', 1000)} + {ratio('mod(event_id * 23, 201) - 100', 1000000)} as lng,
        case when mod(event_id, 10) = 0 or mod(k, 25) = 3 then null else {entity_id('C', 'k')} end as control_point_id, ts as created_at, ts as updated_at
        from (select event_id, ts, mod(event_id * 7, n) as k from events cross join (select count(*) as n from part) c) e""",
}


class Tables:
    """The driver's tables and the entity tables over them, by name, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """Runs SQL over raw tables and the given frames; names in the text are those of tables."""
        names = {n: more.get(n) if n in more else self.raw(n) for n in ("customer", "orders", "part", "lineitem", "events") if f" {n}" in text} | more
        text = text.replace("{", "{{").replace("}", "}}")
        for n in names:
            text = text.replace(f" from {n}", f" from {{{n}}}").replace(f" join {n}", f" join {{{n}}}")
        return self.spark.sql(text, **names)

    def entity(self, name: str) -> DataFrame:
        df = self.sql(VIEWS[name])
        return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))

    st = property(lambda self: self.entity("stations"))
    ph = property(lambda self: self.entity("photos"))
    cp = property(lambda self: self.entity("control_points"))
    im = property(lambda self: self.entity("image_measurements"))
    mm = property(lambda self: self.entity("map_measurements"))
