"""Benchmark decontamination by a broadcast set of normalised n-grams.

Each benchmark item is cut into windows of n consecutive words (an item of fewer words is one window). A window is kept
under its longest word. One scan over the documents looks each word up in that broadcast set and, on a hit, compares the
whole window of the document with the n-gram. The set's size is counted first; beyond `broadcast_windows` the items are
taken in blocks of that size, each block against all documents.

Words: A-Z lower-cased, then runs of ASCII letters, digits and non-ASCII characters. Defined cases: null and empty texts
have no words and no hits; items without words match nothing; rows that agree in doc_id and text get the same result;
rows that share a doc_id only are told apart by their texts; clashing extra columns are left aside; an empty table on
either side gives no hits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import DELIMITER, ascii_lower, raw_words, table, wide_hash

SPAN = "array<struct<start:int,len:int>>"


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """item_id, gram (its words joined by a space), len, anchor_key and anchor (the longest word's place in it)."""
    items = benchmark.select("item_id", F.transform(raw_words(F.col("text")), ascii_lower).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    windows = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, n))).alias("w")).distinct()
    longest = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("size"), (-i).alias("at"))))
    return windows.select(
        "item_id", F.array_join("w", " ").alias("gram"), F.size("w").alias("len"), (-longest["at"]).alias("anchor"), "w"
    ).select("item_id", "gram", "len", "anchor", F.xxhash64(F.lower(F.element_at("w", F.col("anchor") + 1))).alias("anchor_key"))


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = 1_000_000) -> DataFrame:
    """doc_id, h1, h2 (hash of the text), items array, spans array<struct<start,len>> in words; a row per contaminated document."""
    windows = benchmark_windows(benchmark, n)
    blocks = max(1, math.ceil(windows.count() / broadcast_windows))
    scan = docs.select("doc_id", *(h.alias(a) for h, a in zip(wide_hash(F.col("text")), ("h1", "h2"))), raw_words(F.col("text")).alias("words"))
    # The outer form: Spark then adds no filter that would split every text a second time.
    at = scan.select("doc_id", "h1", "h2", "words", F.posexplode_outer("words").alias("pos", "word"))
    start = F.col("pos") - F.col("anchor")
    here = ascii_lower(F.array_join(F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("len")), " "))
    same = (F.xxhash64(F.lower("word")) == F.col("anchor_key")) & (start >= 0) & (here == F.col("gram"))
    found = None
    for block in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block)
        hits = at.join(F.broadcast(part), same).select("doc_id", "h1", "h2", "item_id", start.cast("int").alias("start"), "len")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "h1", "h2").agg(
        F.collect_set("item_id").alias("items"), F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans")
    )


def covered(spans: str = "spans"):
    """Words inside any of the spans, which are sorted by start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
    )
    return F.aggregate(spans, start, step, lambda a: a["n"])


def _matched(docs: DataFrame, hits: DataFrame, how: str, *columns) -> DataFrame:
    keyed = docs.select(*columns, *(h.alias(a) for h, a in zip(wide_hash(F.col("text")), ("h1", "h2")))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.h1") == F.col("h.h1")) & (F.col("d.h2") == F.col("h.h2"))
    return keyed.join(hits.alias("h"), same, how)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, **limits) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    hits = window_hits(docs, benchmark, n, **limits)
    ids = F.array_sort(F.transform(F.coalesce("h.items", F.array()), lambda x: x.cast("string")))
    n_hit = F.coalesce(covered("h.spans"), F.lit(0).cast("long"))
    return _matched(docs, hits, "left", "doc_id", F.size(raw_words(F.col("text"))).cast("long").alias("n_words")).select(
        "d.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("h.spans", F.array().cast(SPAN)).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", **limits) -> DataFrame:
    """`docs` without contaminated documents, or (`remove="spans"`) without the words that were hit and what follows each up to the next word."""
    hits = window_hits(docs, benchmark, n, **limits)
    record = F.struct(*docs.columns).alias("record")
    if remove == "documents":
        return _matched(docs, hits, "left_anti", "doc_id", record).select("record.*")
    pieces = F.expr(rf"regexp_extract_all(record.text, r'{DELIMITER.replace('[', '[^', 1)}+{DELIMITER}*', 0)")
    kept = F.filter(pieces, lambda _, i: ~F.exists("h.spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["len"])))
    cut = F.concat(F.regexp_extract("record.text", f"^{DELIMITER}*", 0), F.array_join(kept, ""))
    rows = _matched(docs, hits, "left", "doc_id", record)
    return rows.withColumn("record", F.col("record").withField("text", F.when(F.col("h.spans").isNull(), F.col("record.text")).otherwise(cut))).select("record.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_SPLIT = r"[x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"

#: DuckDB's rows for op8: all windows of each length, joined with the items' windows.
OP8_SQL = f"""with item_words as (select item_id, {_SPLIT} as w from benchmark where text is not null),
    grams as (select distinct item_id, list_slice(w, s, s + 9) as g from item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(s) where len(w) > 0),
    doc_words as (select doc_id, case when text is null then [] else {_SPLIT} end as w from documents),
    windows as (select doc_id, s, size, list_slice(w, s, s + size - 1) as g from doc_words, (select distinct len(g) as size from grams) z, unnest(range(1, len(w) - size + 2)) r(s)),
    hits as (select doc_id, s, size, item_id from windows join grams using (g)),
    places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from hits) group by 1),
    found as (select doc_id, count(*) as n_items, sha256(string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar))) as items_sha256 from (select distinct doc_id, item_id from hits) group by 1)
    select d.doc_id, len(d.w) as n_words, coalesce(p.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items, coalesce(f.items_sha256, sha256('')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
    from doc_words d left join places p using (doc_id) left join found f using (doc_id)"""
