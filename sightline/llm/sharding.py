"""Two-pass external shuffle into shards.

Pass one scatters records over memory-sized buckets by a seeded hash of the whole record; each bucket is a partition by
itself. Pass two shuffles each bucket (Spark's `shuffle` is an inside-out Fisher-Yates, seeded by the bucket as that is the
partition's number) and lays the buckets end to end. Shards are equal cuts of that sequence, so their row counts differ by
one at most (law `rows`). The result depends on the rows and the seed only, not on how the rows were partitioned.

Records that are equal in all columns would share a hash. They are found by digest first, one of each kind is counted, and
the copies are numbered and scattered by their number, in blocks, so that no task makes or holds all copies of one record.

Defined cases: null or empty texts are records of 16 bytes; very long texts are moved whole; repeated doc_ids, equal texts
and equal rows stay separate records, as do rows whose nulls stand in different columns; an empty table gives no rows; columns named shard or slot are replaced. Columns of map
type are not supported.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline.llm.common import table, written

#: Counted rows of three longs that are sent to all tasks; beyond, Spark shuffles.
BROADCAST_ROWS = 200_000
COPIES = 1000


def record_bytes(text: str = "text"):
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _told_apart(docs: DataFrame) -> list:
    """What the hashes of a record take in: its columns, which of them are null (a hash passes nulls over), and nested ones as
    text, for the nulls inside."""
    nested = [F.to_json(F.struct(f.name)) for f in docs.schema if isinstance(f.dataType, (T.StructType, T.ArrayType))]
    return [*docs.columns, *(F.col(f"`{c}`").isNull() for c in docs.columns), *nested]


def numbered_records(docs: DataFrame, seed: int) -> DataFrame:
    """h (the hash that scatters) and record of each row. Equal rows have hashes of their own."""
    one, two = (F.xxhash64(F.lit(seed + k), *_told_apart(docs)) for k in (0, 1))
    keyed = docs.select(one.alias("h"), two.alias("h2"), F.struct(*docs.columns).alias("record"))
    equal = written(docs.select(one.alias("h"), two.alias("h2")).groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "h2"), "equal-rows")
    if equal.isEmpty():
        return keyed.select("h", "record")
    equal = _few(equal)
    single = keyed.join(equal, ["h", "h2"], "left_anti").select("h", "record")
    # Records are compared, not their hashes only: each different one is counted for itself.
    kinds = keyed.join(equal, ["h", "h2"]).groupBy("h", "h2", "record").agg(F.count(F.lit(1)).alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = kinds.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("from")).repartition(parts, "h", "h2", "from")
    copies = blocks.select("h", "h2", "record", F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + COPIES) - 1)).alias("copy"))
    return single.unionByName(copies.select(F.xxhash64("h", "h2", "copy").alias("h"), "record"))


def shard_documents(docs: DataFrame, n_shards: int, seed: int = 17, bucket_bytes: int = 8 << 20, most_buckets: int = 200_000, text: str = "text") -> DataFrame:
    """`docs` with shard (0 to n_shards - 1) and slot (gapless from 0 in its shard), shuffled as a whole.

    A task holds one bucket, of about `bucket_bytes`; from `most_buckets` on buckets grow instead (100 TB: 500 MB each).
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    docs = docs.select(*names)
    n_rows, n_bytes = docs.agg(F.count(F.lit(1)), F.sum(record_bytes(text))).first()
    n_buckets = min(most_buckets, max(n_shards, math.ceil((n_bytes or 0) / bucket_bytes)))
    placed = numbered_records(docs, seed).select(F.pmod("h", F.lit(n_buckets)).cast("int").alias("bucket"), "record")
    # One row for each bucket, so this window is bounded by most_buckets.
    starts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start")
    )
    # Sorted before the shuffle: a task that runs again draws the same permutation.
    buckets = placed.repartitionById(n_buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list("record")).alias("records"))
    shuffled = buckets.select("bucket", F.shuffle("records", seed).alias("records"))
    ranked = shuffled.join(F.broadcast(starts), "bucket").select("start", F.posexplode("records").alias("pos", "record")).select((F.col("start") + F.col("pos")).alias("rank"), "record")
    n_rows = max(n_rows, 1)
    shard = F.expr(f"rank * {n_shards} div {n_rows}")
    first = F.expr(f"(shard * {n_rows} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).select("record.*", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str, fmt: str = "parquet", file_rows: int = 100_000) -> None:
    """One folder a shard; a shard's files hold `file_rows` consecutive slots each, in order, and are written by several tasks."""
    n = sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")
    part = F.expr(f"slot div {file_rows}")
    rows = sharded.withColumn("_part", part).repartition(int(n), "shard", "_part").sortWithinPartitions("shard", "_part", "slot").drop("_part")
    rows.write.option("maxRecordsPerFile", file_rows).partitionBy("shard").format(fmt).save(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law `rows`; groups (equal texts) are not kept together."""
    sharded = shard_documents(table(spark, sf_dir, "documents"), 40)
    return sharded.select(
        "doc_id",
        record_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
