"""Canonical exact digests.

A text is brought to one form (compatibility decomposition, full case folding, composition, runs of white space to one
space, ends trimmed), digested to 128 bits of xxhash, and grouped; inside each bucket of equal digests the canonical
bytes are compared, and a text that differs there gets a number after its digest. ICU, which Spark ships for its
collations, is called through the SQL function `reflect`; texts of ASCII only take `lower` instead, which gives the same.

Defined cases: null counts as empty; equal texts have equal fingerprints; doc_ids may be of any type that has an order, null
ids come after all others; repeated doc_ids are ordered by their texts, and all rows of one doc_id meet in one task; very long
texts are digested whole; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline.llm.common import table, wide_hash, written

LOWEST = -(1 << 63)


def canonical(text: Column) -> Column:
    icu = lambda name, method, x: F.reflect(F.lit(f"com.ibm.icu.{name}"), F.lit(method), x, F.lit(True))
    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "decompose", text)))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(plain, r"(?U)\s{2,}|[^\S ]", " "))


def digest(canon: Column, bits: int = 128) -> list[Column]:
    """Two longs; fewer bits are for tests of what happens when digests collide."""
    return [h if bits == 128 else F.pmod(h, F.lit(1 << bits // 2)) for h in wide_hash(canon)]


def fingerprint_text(h1: Column, h2: Column, variant: Column) -> Column:
    hexed = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(hexed(h1), hexed(h2), F.when(variant > 0, F.concat(F.lit("."), variant.cast("string"))).otherwise(""))


def digested(docs: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id, canon, h1, h2."""
    canon = docs.select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("canon"))
    return canon.select("doc_id", "canon", *(h.alias(a) for h, a in zip(digest(F.col("canon"), bits), ("h1", "h2"))))


def collisions(docs: DataFrame, buckets: DataFrame, bits: int = 128, broadcast_rows: int = 1_000_000) -> DataFrame:
    """h1, h2, canon, variant (from 0, in order of the bytes) of the buckets whose texts differ.

    buckets: h1, h2 of those with several documents. Equal texts meet as early as in the map task, so a group of copies
    sends one text a task. Few buckets are broadcast; more are joined by a shuffle.
    """
    few = buckets.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = digested(docs, bits).join(F.broadcast(buckets) if few else buckets, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "canon").agg(F.count(F.lit(1)).alias("n"))
    mixed = texts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("h1", "h2")
    return texts.join(mixed, ["h1", "h2"]).select("h1", "h2", "canon", (F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1).alias("variant"))


def shared_buckets(digests: DataFrame) -> DataFrame:
    return digests.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")


def fingerprint_documents(docs: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id, fingerprint, group_id (the least doc_id with that fingerprint), copies."""
    docs = docs.select("doc_id", "text")
    rows = digested(docs, bits)
    mixed = written(collisions(docs, written(shared_buckets(rows.select("h1", "h2")), "buckets"), bits), "collisions")
    if mixed.isEmpty():
        named = rows.select("doc_id", fingerprint_text(F.col("h1"), F.col("h2"), F.lit(0)).alias("fingerprint"))
    else:
        named = rows.join(mixed, ["h1", "h2", "canon"], "left").select("doc_id", fingerprint_text(F.col("h1"), F.col("h2"), F.coalesce("variant", F.lit(0))).alias("fingerprint"))
    groups = named.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    return named.join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id", "copies")


PREFIX_BYTES = 7


def order_key(docs: DataFrame) -> Column:
    """A long that never falls as doc_id grows, the least one for null. Of texts it is PREFIX_BYTES bytes after what the least and
    the greatest have in common."""
    kind, c = docs.schema["doc_id"].dataType, F.col("doc_id")
    if isinstance(kind, T.StringType):
        ends = [(v or "").encode() for v in docs.agg(F.min("doc_id"), F.max("doc_id")).first()]
        shared = len(os.path.commonprefix(ends))
        part = F.substring(F.encode(c, "UTF-8"), shared + 1, PREFIX_BYTES)
        key = F.conv(F.rpad(F.hex(part), 2 * PREFIX_BYTES, "0"), 16, 10).cast("long")
    elif isinstance(kind, T.DateType):
        key = F.unix_date(c).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        key = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.IntegralType):
        key = c.cast("long")
    else:
        whole = F.floor(c.cast("double"))
        key = F.when(F.isnan(whole) | (whole >= 2.0**62), F.lit(1 << 62)).when(whole <= -(2.0**62), F.lit(-(1 << 62))).otherwise(whole.try_cast("long"))
    return F.coalesce(key, F.lit(LOWEST))


def with_next(docs: DataFrame, cells: int, columns: list[str]) -> DataFrame:
    """`docs` (doc_id, text, and `columns`) with next_<column> of the next row in descending doc_id, cyclically.

    Rows are dealt to ranges of doc_id of about equal counts. The first row of a range also goes to the range before it,
    so each range finds all successors by itself; a range's rows meet once, sorted, and no text moves twice.
    """
    key = order_key(docs)
    cells = max(1, cells)
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / cells for i in range(1, cells)] or [0.5], 20 * cells)).first()[0]
    cuts = sorted(set(cuts or []))
    # Two levels, so that a row is compared with about 2 * sqrt(ranges) bounds.
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[LOWEST]]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    block = F.size(F.filter(longs([g[0] for g in groups[1:]]), lambda c: c < key)) if len(groups) > 1 else F.lit(0)
    inner = F.size(F.filter(F.element_at(F.array(*map(longs, groups)), F.col("block") + 1), lambda c: c < key))
    placed = docs.withColumn("block", block).withColumn("cell", F.col("block") * (step + 1) + inner)
    tops = sorted((r.cell, r.top) for r in docs.select("doc_id").withColumn("block", block).withColumn("cell", F.col("block") * (step + 1) + inner).groupBy("cell").agg(F.max(key).alias("top")).collect())
    if not tops:
        return docs.select("*", *(F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns)).limit(0)
    above = {c: tops[(i + 1) % len(tops)][0] for i, (c, _) in enumerate(tops)}
    top, goes = dict(tops), [c for c, _ in tops]
    width = max(goes) + 1
    at = lambda values: F.element_at(longs([values.get(i, LOWEST) for i in range(width)]), F.col("cell") + 1)
    homes = F.when(key == at(top), F.array(F.struct(F.col("cell").alias("home"), F.lit(0).alias("guest")), F.struct(at(above).cast("int").alias("home"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("cell").alias("home"), F.lit(0).alias("guest")))
    )
    rows = placed.select("*", F.inline(homes))
    order = Window.partitionBy("home").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    return rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter("guest = 0").drop("home", "guest", "cell", "block")


def edited_fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprints of texts and of their edited texts; the columns of the query below."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(rows, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), ["text"])
    n, k = F.col("n_chars"), F.expr("n_chars div 3").cast("int")
    edited = pairs.withColumn("n_chars", F.char_length("text").cast("long")).select(
        "doc_id", "n_chars", "text", "next_text", F.concat(F.substring("text", F.lit(1), (n - k).cast("int")), F.substring("next_text", F.lit(1), k)).alias("edited")
    )
    canons = edited.select("doc_id", "n_chars", "next_text", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"), canonical(F.col("next_text")).alias("next_canon"))
    both = lambda x, *names: [h.alias(a) for h, a in zip(digest(F.col(x), bits), names)]
    light = written(
        canons.select(
            "doc_id", "n_chars", "edited_sha256", *both("canon", "h1", "h2"), *both("edited_canon", "e1", "e2"),
            (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
            (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
        ),
        "digests",
    )
    mixed = written(collisions(docs, written(shared_buckets(light.select("h1", "h2")), "buckets"), bits), "collisions")
    plain = lambda a, b, v=None: fingerprint_text(F.col(a), F.col(b), F.lit(0) if v is None else F.coalesce(v, F.lit(0)))
    if mixed.isEmpty():
        out = light.select("*", plain("h1", "h2").alias("fingerprint"), plain("e1", "e2").alias("edited_fingerprint"))
    else:
        # A bucket holds different texts: only then are the canonical texts needed beside their digests.
        rows = canons.select("doc_id", "n_chars", "edited_sha256", "canon", "edited_canon", (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"), (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"))
        rows = rows.select("*", *both("canon", "h1", "h2"), *both("edited_canon", "e1", "e2"))
        theirs = mixed.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("canon").alias("edited_canon"), F.col("variant").alias("edited_variant"))
        most = mixed.groupBy(F.col("h1").alias("e1"), F.col("h2").alias("e2")).agg(F.max("variant").alias("last"))
        rows = rows.join(mixed, ["h1", "h2", "canon"], "left").join(theirs, ["e1", "e2", "edited_canon"], "left").join(most, ["e1", "e2"], "left")
        own = F.when(F.col("edited_variant").isNull() & F.col("last").isNotNull(), F.col("last") + 1).otherwise(F.col("edited_variant"))
        out = rows.select("*", plain("h1", "h2", F.col("variant")).alias("fingerprint"), plain("e1", "e2", own).alias("edited_fingerprint"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
