"""Best-fit packing of documents into as few training sequences as it can.

Each document is tokenised once and ends with an end id. What is longer than a sequence is cut into full sequences, of which
the first may be shorter; all pieces are packed by best-fit decreasing over the whole table: longest first, each into the
tightest open sequence that takes it, which a segment tree over remaining capacities finds in logarithmic time.

Pieces of equal length are interchangeable, so the plan is made from the counts of lengths alone (`size` numbers, however many
documents there are): sequences of equal contents are one class, and a run of equal pieces fills a class in one step. The
result is what best-fit decreasing gives piece by piece. Pieces then find their places by their rank among those of their
length: each task numbers its own pieces as it writes them, and a prefix sum over tasks makes that a rank of the whole.

Ids are the tokenizer's own, so the name of a special token in a text becomes its id.

Defined cases: a null text is empty and has its end id only; repeated rows are packed each; very long texts are tokenised whole
and cut; an empty table gives no rows; other columns, whatever their names, are left aside; a null doc_id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline.llm import tokens
from sightline.llm.common import table, written

PIECES_A_BATCH = 20_000


def best_fit_decreasing(counts: list[int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, pieces, sequence, a_sequence, offset): the `pieces` of that length from `rank` on go to the
    sequences from `sequence` on, `a_sequence` into each, one after the other from `offset` on.

    counts[n]: how many pieces are n long.
    """
    leaves = 1
    while leaves <= size:
        leaves *= 2
    some = [False] * (2 * leaves)  # of a node: a sequence is open whose room is below it
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room: first sequence, how many

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_at[room].append((first, n))
            node = leaves + room
            while node and not some[node]:
                some[node] = True
                node //= 2

    def tightest(need: int) -> int:
        node = leaves + need
        while not some[node]:
            while node % 2:  # a right child: what lies to the right of it is above
                node //= 2
            if not node:
                return 0
            node += 1
        while node < leaves:
            node = 2 * node + (not some[2 * node])
        return node - leaves

    def take(room: int) -> tuple[int, int]:
        found = open_at[room].pop()
        node = leaves + room
        if not open_at[room]:
            some[node] = False
            while node > 1 and not some[node ^ 1]:
                node //= 2
                some[node] = False
        return found

    runs, made = [], 0
    for length in range(size, 0, -1):
        rank = 0
        while rank < counts[length]:
            left, room = counts[length] - rank, tightest(length)
            if room:
                first, n = take(room)
            else:
                room, first = size, made
                n = -(-left // (room // length))
                made += n
            each = room // length
            used = min(n, -(-left // each))
            pieces = min(left, used * each)
            runs.append((length, rank, pieces, first, each, size - room))
            whole, rest = divmod(pieces, each)
            put(room - each * length, first, whole)
            put(room - rest * length, first + whole, min(rest, 1))
            put(room, first + used, n - used)
            rank += pieces
    return runs


def token_pieces(docs: DataFrame, size: int, end_id: int, paths: dict[str, str], keep_ids: bool) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, part and nth (its number in its task among those of its
    length), ids (null unless kept)."""
    out = T.StructType(
        [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "nth")), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def run(batches):
        part, seen, kind = TaskContext.get().partitionId(), [0] * (size + 1), None

        def batch(rows):
            columns = list(zip(*rows))
            types = [kind, pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=out.names)

        rows = []
        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                ids = np.array([*tokens.encode(text.as_py() or "", paths), end_id], "<u4")
                starts = [0, *range(len(ids) % size or size, len(ids), size)]
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc_id.as_py(), k, a, z - a, zlib.crc32(ids[a:z].tobytes()), part, seen[z - a], ids[a:z].astype("i4") if keep_ids else None))
                    seen[z - a] += 1
                    if len(rows) == PIECES_A_BATCH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def best_fit_pack(docs: DataFrame, size: int = 1024, end_id: int = 2, keep_ids: bool = True, paths: dict[str, str] | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (null unless kept).

    size: at most 2 ** 20.
    """
    pieces = written(token_pieces(docs, size, end_id, paths or tokens.vocabulary(), keep_ids), "pieces")
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = [0] * (size + 1)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # one row a length
        total[length] = n
    runs = np.array(best_fit_decreasing(total, size), np.int64).reshape(-1, 6)
    keys = (runs[:, 0] << 42) | runs[:, 1]  # in decreasing order of lengths, so turned for the search
    order = np.argsort(keys)
    runs, keys = runs[order], keys[order]
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = T.StructType([*(pieces.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), pieces.schema["ids"]])

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 42) | rank, "right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset), b.column("ids")], names=out.names)

    return ranked.select(*names, "rank", "ids").mapInArrow(place, out)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
