"""Packing of documents into training sequences.

Each document is tokenised once and ends with an end id. What is longer than a sequence is cut into full sequences; the
rest of each document is packed by first-fit decreasing, with a tournament tree over the free room of the bins, inside
randomised groups of about `group_docs` documents. Groups are independent, so the packing is one pass over light rows.

Ids are the tokenizer's own, so the name of a special token in a text becomes its id.

Defined cases: a null text is empty and has its end id only; repeated rows are packed each, in groups of their own; very long
texts are tokenised whole and cut; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import tokens
from sightline.llm.common import table


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Item by item, longest first, into the leftmost bin that has room."""
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    free = [room] * (2 * leaves)  # free[k]: the most room below node k
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable"):
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, room - free[node]
        free[node] -= need
        node //= 2
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return bins, offsets


def token_rows(docs: DataFrame, size: int, end_id: int, paths: dict[str, str], keep_ids: bool) -> DataFrame:
    """doc_id, doc_tokens, crcs (one for each piece), ids (null unless kept)."""
    out = T.StructType([docs.schema["doc_id"], T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            n, crcs, kept = [], [], []
            for text in batch.column("text"):
                ids = np.array([*tokens.encode(text.as_py() or "", paths), end_id], "<u4")
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + size].tobytes()) for i in range(0, len(ids), size)])
                kept.append(ids.astype("i4") if keep_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int32()))], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 0, group_docs: int = 4096, seed: int = 5, keep_ids: bool = True, paths: dict[str, str] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless kept)."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    rows = token_rows(docs, size, end_id, paths or tokens.vocabulary(), keep_ids)
    # Equal rows have the same hash but for where they stand in their task.
    spot = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("pack", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "crcs", spot), F.lit(groups)))
    long = T.LongType()
    out = T.StructType(
        [docs.schema["doc_id"], *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_tokens", "doc_id"], kind="stable").reset_index(drop=True)
        total = group["doc_tokens"].to_numpy()
        pieces = -(-total // size)
        row = np.repeat(np.arange(len(group)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
        length = np.minimum(size, total[row] - start)
        full = length == size
        sequence, offset = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        sequence[full] = np.arange(full.sum())
        bins, at = first_fit_decreasing(length[~full], size)
        sequence[~full], offset[~full] = full.sum() + bins, at
        made = pd.DataFrame({"doc_id": group["doc_id"].to_numpy()[row], "start": start, "length": length, "ids_crc32": np.concatenate(group["crcs"].to_list()).astype(np.int64), "doc_tokens": total[row]})
        made["sequence_id"], made["offset"] = (int(group["pack"].iloc[0]) << 32) + sequence, offset
        made["ids"] = [group["ids"].iloc[r][s : s + size] for r, s in zip(row, start)] if keep_ids else None
        return made

    return rows.groupBy("pack").applyInPandas(pack, out)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
