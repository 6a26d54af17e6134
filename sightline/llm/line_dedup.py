"""Removal of repeated line chunks and passages.

Lines with words are hashed, and a polynomial hash rolls over each two that follow one another. Its 64 bits give `CUTTINGS`
independent cuttings of the text, four bits each: a cutting cuts between the two lines where its bits fall below `CUT_BELOW`.
So a cut depends on the two lines that it parts and on nothing else, and inserting lines moves only the cuts beside them.
Chunks of at least two lines with words are looked up, from all cuttings: a passage that is repeated between other neighbours
is a chunk of its own in some cutting, or is covered by several, however short it is.

With `over_words`, passages are looked up too, wherever they begin: from each line with words the least run of lines that
has over so many words, forwards and backwards. These runs cover every run of lines with more words that two places share
(from its first line with words to its last), so that all of it goes but one copy; a line of over so many words is such a
run by itself.

Chunks and passages are grouped by digest over all documents. The document with the least doc_id keeps its first
occurrence, all others lose theirs. Of the chunks that a document would lose, as few as cover the same lines are taken, and
their bytes are compared with the kept ones' before anything is removed.

Defined cases: null texts stay null; other one-line chunks (so one-line texts) are never removed; what repeats inside its
keeper, without overlap, stays once; rows that share a doc_id are told apart by their texts, and rows that agree in both
count as one document; texts without doc_id keep a chunk only if no text with doc_id has it; a word is what stands between
white space, and each character of the scripts that are written without spaces; each removed line stands in some text that
is left; very long texts are read whole; an empty table gives no rows; extra columns are kept, and those named n_lines or
n_removed are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table, written
from sightline.llm.jaccard_join import mix, powers

#: Passages of more words than these go in the query and in the pipeline.
OVER_WORDS = 50

CUTTINGS, CUT_BELOW = 16, 12

#: Losers of one chunk that one copy of its bytes is sent to.
LOSERS_A_COPY = 1000

_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def count_words(line: str) -> int:
    return len(line.split()) + (0 if line.isascii() else len(_UNSPACED.findall(line)))


def line_hashes(lines: list[str]) -> np.ndarray:
    """Two words of 64 bits for each line."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<u8").reshape(-1, 2)


def cuttings(hashes: np.ndarray) -> np.ndarray:
    """Whether each cutting (a row) cuts before each line, and after the last. The ends of the text are cuts."""
    cuts = np.ones((CUTTINGS, len(hashes) + 1), bool)
    rolled = mix(hashes[:-1] * np.uint64(_LANES[0]) + hashes[1:])
    bits = np.uint64(64 // CUTTINGS) * np.arange(CUTTINGS, dtype=np.uint64)
    cuts[:, 1:-1] = (rolled >> bits[:, None]) & np.uint64((1 << 64 // CUTTINGS) - 1) < np.uint64(CUT_BELOW)
    return cuts


def chunks_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and lines of the chunks of all cuttings."""
    cutting, at = np.nonzero(cuttings(hashes))
    size = np.diff(at)
    several = (cutting[1:] == cutting[:-1]) & (size > 1)
    return at[:-1][several], size[several]


def passages(counts: list[int], over_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of the least runs of over `over_words` words that begin or end at a line with words. counts: words of each line."""
    worded = [(i, n) for i, n in enumerate(counts) if n]
    spans: set[tuple[int, int]] = set()
    for step in (1, -1):
        total, k = 0, 0
        for i, n in (run := worded[::step]):
            while k < len(run) and total <= over_words:
                total += run[k][1]
                k += 1
            if total <= over_words:
                break
            j = run[k - 1][0]
            spans.add((min(i, j), abs(i - j) + 1))
            total -= n
    return sorted(spans)


def looked_up(lines: list[str], over_words: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first line, lines, and two hashes of all that is looked up, in order; and whether the same stands earlier in the text, apart from it."""
    hashes, counts = line_hashes(lines), list(map(count_words, lines))
    worded = np.flatnonzero(np.array(counts))
    first = n = np.empty(0, np.int64)
    if len(worded) > 1:
        at, size = chunks_of(hashes[worded, 0])
        first, n = worded[at], worded[at + size - 1] - worded[at] + 1
    if over_words is not None and (more := passages(counts, over_words)):
        more = np.array(more)
        first, n = np.append(first, more[:, 0]), np.append(n, more[:, 1])
    first, n = np.divmod(np.unique(first * (len(lines) + 1) + n), len(lines) + 1)
    keys = []
    for lane, base in enumerate(_LANES):
        total = np.append(np.zeros(1, np.uint64), np.cumsum(hashes[:, lane] * powers(base, len(lines)), dtype=np.uint64))
        keys.append(mix((total[first + n] - total[first]) * powers(pow(base, -1, 1 << 64), len(lines))[first] + n.astype(np.uint64)).view(np.int64))
    _, once, which = np.unique(keys[0], return_index=True, return_inverse=True)
    again = first - first[once[which]] >= n
    for i in np.flatnonzero(again):
        j = first[once[which[i]]]
        again[i] = lines[first[i] : first[i] + n[i]] == lines[j : j + n[i]]
    return first, n, keys[0], keys[1], again


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, t, text: a document is known by its doc_id and a hash of its text."""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text")


def line_chunks(docs: DataFrame, over_words: int | None) -> DataFrame:
    """doc_id, t, first, n, h1, h2 of all that is looked up, and again: whether the same stands earlier in its own text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [looked_up(t.as_py().split("\n"), over_words) for t in batch.column("text")]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found]))
            first, n, h1, h2, again = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("t").take(at), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(h1), pa.array(h2), pa.array(again.astype(bool))],
                names=["doc_id", "t", "first", "n", "h1", "h2", "again"],
            )

    return identified(docs).filter("text is not null").mapInArrow(run, f"doc_id {kind}, t long, first int, n int, h1 long, h2 long, again boolean")


def covering(spans: list[tuple[int, int]]) -> list[int]:
    """Which of the (first, n) cover the same lines, as few as need be: from each line that is not yet covered the span that reaches furthest."""
    order = sorted(range(len(spans)), key=lambda i: spans[i][0])
    taken, end, k = [], 0, 0
    while k < len(order):
        best = None
        start = max(end, spans[order[k]][0])
        while k < len(order) and spans[order[k]][0] <= start:
            if best is None or sum(spans[order[k]]) > sum(spans[best]):
                best = order[k]
            k += 1
        if sum(spans[best]) > end:
            taken.append(best)
            end = sum(spans[best])
    return taken


def covered(lost: pa.Array) -> pa.Array:
    """Of each list of (first, n, h1, h2, copies) those that cover its lines."""
    out = []
    for spans in lost:
        spans = spans.as_py()
        out.append([spans[i] for i in covering([(s["first"], s["n"]) for s in spans])])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("copies", pa.int32())])))


def same_document(docs: DataFrame, other: DataFrame, names: tuple[str, str]):
    return docs["doc_id"].eqNullSafe(other[names[0]]) & (F.xxhash64(docs["text"]) == other[names[1]])


def kept_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, copies, chunk: the bytes of each chunk that is kept, out of its keeper's text. wanted: for each keeper an array of (first, n, h1, h2, copies)."""

    def run(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                found = wanted.as_py()
                lines = text.as_py().split("\n") if found else []
                for w in found or ():
                    for c, v in zip(cols, (w["h1"], w["h2"], w["copies"], "\n".join(lines[w["first"] : w["first"] + w["n"]]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["h1", "h2", "copies", "chunk"])

    # The same join as the last one of dedup_lines, without a filter, so that Spark sends the texts to their documents once for both.
    held = docs.join(wanted, same_document(docs, wanted, ("_op5_k_id", "_op5_k_t")), "left").select(F.when(F.col("_op5_k_t").isNotNull(), docs["text"]).alias("text"), F.col("_op5_wanted").alias("wanted"))
    return held.mapInArrow(run, "h1 long, h2 long, copies int, chunk string")


def dedup_lines(docs: DataFrame, over_words: int | None = None) -> DataFrame:
    """`docs` with text freed of repeated chunks (and passages of over `over_words` words), n_lines (of the text before) and n_removed."""
    docs = docs.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")))
    chunks = written(line_chunks(docs, over_words), "chunks")
    once = chunks.filter("not again").drop("again")
    # First the keys alone, which are light; then the places of those that stand twice.
    twice = written(once.groupBy("h1").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h1"), "keys")
    hits = written(once.join(twice, "h1"), "hits")
    # Those with doc_id first. Two documents at least.
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t")
    kept = hits.groupBy("h1", "h2").agg(F.min(F.struct(order.alias("who"), "first", "n")).alias("kept"), F.max(order).alias("last"), F.count(F.lit(1)).alias("times")).filter("kept.who <> last")
    copies = F.ceil(F.col("times") / LOSERS_A_COPY).cast("int").alias("copies")
    kept = written(kept.select("h1", "h2", copies, F.col("kept.who.doc_id").alias("k_id"), F.col("kept.who.t").alias("k_t"), F.col("kept.first").alias("k_first"), F.col("kept.n").alias("k_n")), "kept")
    lost = hits.join(kept.select("h1", "h2", "k_id", "k_t", "copies"), ["h1", "h2"]).filter(~(F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("t") == F.col("k_t"))))
    lost = lost.groupBy("doc_id", "t").agg(F.arrow_udf(covered, "array<struct<first:int,n:int,h1:long,h2:long,copies:int>>")(F.collect_set(F.struct("first", "n", "h1", "h2", "copies"))).alias("lost"))
    lost = written(lost.select("doc_id", "t", F.inline("lost")), "lost")
    needed = kept.join(lost.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    wanted = needed.groupBy(F.col("k_id").alias("_op5_k_id"), F.col("k_t").alias("_op5_k_t")).agg(F.collect_set(F.struct(F.col("k_first").alias("first"), F.col("k_n").alias("n"), "h1", "h2", "copies")).alias("_op5_wanted"))
    # Rows that are copies of a keeper in doc_id and text give the same bytes. A chunk that very many lose is sent in several copies.
    chunk_bytes = kept_bytes(docs, wanted).dropDuplicates(["h1", "h2"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    losers = lost.withColumn("copy", F.pmod(F.xxhash64("doc_id", "t"), F.col("copies")).cast("int")).drop("copies")
    proven = losers.join(chunk_bytes, ["h1", "h2", "copy"]).select("doc_id", "t", "first", "n", "chunk")
    inside = chunks.filter("again").select("doc_id", "t", "first", "n").distinct().withColumn("chunk", F.lit(None).cast("string"))
    drops = proven.unionByName(inside).groupBy(F.col("doc_id").alias("_op5_id"), F.col("t").alias("_op5_t")).agg(F.collect_list(F.struct("first", "n", "chunk")).alias("_op5_drops"))

    @F.arrow_udf("text string, n_lines long, n_removed long")
    def freed(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, drops):
            if (text := text.as_py()) is None:
                out.append({"text": None, "n_lines": 0, "n_removed": 0})
                continue
            if not (found := found.as_py()):
                out.append({"text": text, "n_lines": text.count("\n") + 1, "n_removed": 0})
                continue
            lines = text.split("\n")
            gone: set[int] = set()
            for d in found:
                # What repeats inside its own text was compared there.
                if d["chunk"] is None or "\n".join(lines[d["first"] : d["first"] + d["n"]]) == d["chunk"]:
                    gone.update(range(d["first"], d["first"] + d["n"]))
            out.append({"text": "\n".join(x for i, x in enumerate(lines) if i not in gone), "n_lines": len(lines), "n_removed": len(gone)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())]))

    d = docs.join(drops, same_document(docs, drops, ("_op5_id", "_op5_t")), "left").withColumn("_op5_freed", freed(docs["text"], F.col("_op5_drops")))
    return d.select(*(F.col("_op5_freed.text").alias(c) if c == "text" else docs[c] for c in docs.columns), "_op5_freed.n_lines", "_op5_freed.n_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), OVER_WORDS)
