"""Ranked lexical search for a set of query texts: the best k documents of each, by exact integer scores.

A document is a vector of impacts over the terms that some query holds. Every coordinate is scaled by the root of its term's
weight in the query and in the document, which leaves all inner products as they are and makes lengths tell documents of rare
terms from those of common ones.

Vectors are ordered by length into buckets (a range of lengths a partition, and stretches of `bucket_rows` inside). The
bucket of the greatest lengths gives each query a first k-th best score. Then, for each query and bucket: if the product of
the query's length with the bucket's greatest is below the k-th best score (Cauchy-Schwarz), the bucket and all after it
fall away, in the scan already where that holds for all queries; inside a bucket the coordinates of the query's heaviest terms
are multiplied out and what the others can add is bounded by the lengths of the rests; documents whose bound reaches the k-th
best score are rescored exactly in integers. Nothing is approximate: a bound below the k-th best score is proof.

Queries are taken in blocks whose terms have `block_bytes` at most, which is what is sent to tasks (a single query with more
makes a block alone).

Defined cases: null and empty texts have no terms, are not counted and never found; a query without terms has no rows; rows
of the benchmark that share an item_id are ranked each; rows that share a doc_id are found each; equal scores go by ascending
doc_id, null ids last; very long texts count whole; an empty table on either side gives no rows; other columns are left aside.
"""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline.llm.common import table, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Of a bound, for what floating point may lose.
SLACK = 1e-9


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.encode().lower().decode()) if text else []  # bytes.lower: A-Z only


def query_terms(queries: DataFrame, id_col: str) -> DataFrame:
    """q (a number), id, terms (distinct, sorted), size (bytes of them); queries without terms have no row."""
    out = T.StructType([T.StructField("id", queries.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("size", T.LongType())])

    def run(batches):
        for b in batches:
            terms = [sorted(set(terms_of(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(terms, pa.list_(pa.string())), pa.array([sum(len(t.encode()) for t in ts) for ts in terms], pa.int64())], names=out.names)

    rows = queries.select(F.col(id_col).alias("id"), "text").mapInArrow(run, out).filter(F.size("terms") > 0)
    return written(rows.select(F.monotonically_increasing_id().alias("q"), "*"), "queries")


def term_counts(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those that queries hold, ascending), tf. numbers: a broadcast dict."""
    out = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])

    def run(batches):
        of = numbers.value
        for b in batches:
            ns, terms, tfs = [], [], []
            for text in b.column("text"):
                words = terms_of(text.as_py())
                ns.append(len(words))
                found = sorted((of[t], n) for t, n in collections.Counter(words).items() if t in of)
                terms.append([t for t, _ in found])
                tfs.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out).filter("n > 0")


def document_frequencies(counts: DataFrame, width: int) -> list[int]:
    """For each of the `width` terms, how many documents hold it; a task adds up its own documents first."""

    def run(batches):
        total = np.zeros(width, np.int64)
        for b in batches:
            total += np.bincount(b.column("terms").flatten().to_numpy(), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    df = [0] * width
    for term, n in counts.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # one row a term
        df[term] = n
    return df


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list begins and the last ends."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def impacts(counts: DataFrame, weights, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, norm, terms, impacts (whole numbers) of the documents that can score; norm is the length in scaled coordinates."""
    out = T.StructType([counts.schema["doc_id"], T.StructField("norm", T.DoubleType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("impacts", T.ArrayType(T.IntegerType()))])

    def run(batches):
        w = weights.value
        for b in batches:
            if not b.num_rows:
                continue
            terms, at = flat(b.column("terms"))
            tf, _ = flat(b.column("tf"))
            m = np.array([50 + 50 * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
            imp = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(at)))
            square = np.concatenate([[0.0], np.cumsum(w[terms] * imp.astype(np.float64) ** 2)])
            norm = np.sqrt(np.maximum(square[at[1:]] - square[at[:-1]], 0)) * (1 + 1e-6)  # differences of sums: rounded up
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (terms, imp)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(norm), *lists], names=out.names)

    return counts.filter(F.size("terms") > 0).mapInArrow(run, out).filter("norm > 0")


class Bucket:
    """Documents of about equal length, as an inverted list for each term."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, impact: np.ndarray, norm: np.ndarray, weights: np.ndarray):
        self.at, self.terms, self.impact, self.norm2, self.most = at, terms, impact, norm**2, norm.max()
        order = np.argsort(terms, kind="stable")
        row = np.repeat(np.arange(len(norm)), np.diff(at))
        self.row, self.value, self.first = row[order], impact[order], np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def scores(self, query: np.ndarray, weights: np.ndarray, focus: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may reach `least`, with their exact scores. query: its terms, the heaviest first."""
        head, rest = query[:focus], query[focus:]
        part, norm2 = np.zeros(len(self.norm2)), self.norm2.copy()
        for t in head:
            s = slice(self.first[t], self.first[t + 1])
            part[self.row[s]] += weights[t] * self.value[s]
            norm2[self.row[s]] -= weights[t] * self.value[s].astype(np.float64) ** 2
        bound = (part + math.sqrt(float(weights[rest].sum())) * np.sqrt(np.maximum(norm2, 0))) * (1 + SLACK) + 1
        rows = np.flatnonzero(bound >= least)
        if not len(rows):
            return rows, rows
        own = np.zeros(len(weights), np.int64)
        own[query] = weights[query]
        size = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(size)
        spots = np.arange(ends[-1]) + np.repeat(self.at[rows] - (ends - size), size)
        exact = np.add.reduceat(own[self.terms[spots]] * self.impact[spots], ends - size)
        keep = (exact >= max(least, 1))
        return rows[keep], exact[keep]


def bucket_search(vectors: DataFrame, queries, weights, least: dict[int, int], k: int, bucket_rows: int, focus: int) -> DataFrame:
    """q, doc_id, score: of each partition the best k documents of each query, if they reach the query's `least`.

    vectors: partitions sorted by descending norm. queries: a broadcast list of (q, terms), the heaviest term first.
    """
    out = T.StructType([T.StructField("q", T.LongType()), vectors.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches):
        w, kind, best = weights.value, None, {}
        asked = [(q, terms, math.sqrt(float(w[terms].sum()))) for q, terms in queries.value]
        need = dict(least)
        for b in batches:
            kind = b.schema.field("doc_id").type
            for start in range(0, b.num_rows, bucket_rows):
                part = b.slice(start, bucket_rows)
                terms, at = flat(part.column("terms"))
                bucket = Bucket(at, terms, flat(part.column("impacts"))[0].astype(np.int64), part.column("norm").to_numpy(), w)
                ids = part.column("doc_id")
                for q, own, norm in asked:
                    if (norm * bucket.most) * (1 + SLACK) + 1 < need.get(q, 1):
                        continue
                    rows, scores = bucket.scores(own, w, focus, need.get(q, 1))
                    if not len(rows):
                        continue
                    if len(rows) > k:  # of those below the k-th best none can stay
                        few = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        rows, scores = rows[few], scores[few]
                    found = best.get(q, []) + list(zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist()))
                    best[q] = found = sorted(found, key=lambda x: (-x[0], x[1] is None, *x[1:] * (x[1] is not None)))[:k]
                    if len(found) == k:
                        need[q] = max(need.get(q, 1), found[-1][0])
        rows = [(q, doc_id, score) for q, found in best.items() for score, doc_id in found]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], names=out.names)

    return vectors.mapInArrow(run, out)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """q, doc_id, score, rank. Spark's window group limit keeps k rows a task and query before the shuffle."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "item_id", k: int = 50, block_bytes: int = 16 << 20, bucket_rows: int = 2048, focus: int = 12, first_share: float = 0.01) -> DataFrame:
    """<id_col>, rank, doc_id, score: the k best documents of each query.

    first_share: the share of documents, those of the greatest lengths, that are searched first.
    """
    spark = docs.sparkSession
    asked = query_terms(queries, id_col)
    blocks = max(1, math.ceil((asked.agg(F.sum("size")).first()[0] or 0) / block_bytes))
    found = None
    for block in range(blocks):
        own = {r.q: r.terms for r in asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "terms").collect()}  # block_bytes at most
        if not own and blocks > 1:
            continue
        vocabulary = sorted({t for terms in own.values() for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        counts = written(term_counts(docs, spark.sparkContext.broadcast(number)), "counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(counts, len(vocabulary))
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df], np.int64)
        weights = spark.sparkContext.broadcast(w)
        heaviest = {q: np.array(sorted((number[t] for t in terms), key=lambda i: -w[i]), np.int64) for q, terms in own.items()}
        sent = spark.sparkContext.broadcast(list(heaviest.items()))
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        vectors = impacts(counts, weights, n_docs, n_terms)
        # Equal lengths, as of copies, are parted by their own bits.
        vectors = vectors.repartitionByRange(parts, F.col("norm").desc(), F.xxhash64("doc_id", "impacts")).sortWithinPartitions(F.col("norm").desc())
        vectors = written(vectors, "vectors")
        cut = vectors.agg(F.percentile_approx("norm", 1 - first_share, 10_000)).first()[0] or 0.0
        top = written(best_of(bucket_search(vectors.filter(F.col("norm") >= cut), sent, weights, {}, k, bucket_rows, focus), k), "first")
        least = {r.q: r.score for r in top.filter(F.col("rank") == k).select("q", "score").collect()}  # one row a query of the block
        floor = min((least.get(q, 1) / math.sqrt(max(float(w[t].sum()), 1.0)) for q, t in heaviest.items()), default=0.0) * (1 - 1e-6)
        rest = bucket_search(vectors.filter((F.col("norm") < cut) & (F.col("norm") >= floor)), sent, weights, least, k, bucket_rows, focus)
        both = top.select("q", "doc_id", "score").unionByName(rest)
        found = both if found is None else found.unionByName(both)
    ranked = best_of(found, k)
    return ranked.join(asked.select("q", F.col("id").alias(id_col)), "q").select(id_col, F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"[x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') if x <> '']"

#: DuckDB's rows for op12: all postings joined with all terms of the items.
OP12_SQL = f"""with doc_terms as (select doc_id, {_TERMS} as ts from documents where text is not null),
    lengths as (select row_number() over () as d, doc_id, ts, len(ts) as n from doc_terms where len(ts) > 0),
    whole as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from lengths),
    postings as (select d, t, count(*) as tf from (select d, unnest(ts) as t from lengths) group by 1, 2),
    weights as (select t, cast(floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from postings, whole group by t),
    asked as (select distinct q, item_id, unnest(ts) as t from (select row_number() over () as q, item_id, {_TERMS} as ts from benchmark where text is not null)),
    scored as (select q, any_value(item_id) as item_id, d, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
        from asked join postings using (t) join weights using (t) join lengths using (d), whole group by q, d),
    ranked as (select q, item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0)
    select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50"""
