"""Near-duplicate join on word 5-grams: chosen-path join.

A text is the set of its runs of five words (A-Z lower-cased; a text of fewer words is one run). Texts of equal sets form
a class; one member stands for it. A class is known in the search by a signature, the least values of its set under
`positions` hash functions, which embeds sets so that positions agree as often as the sets overlap.

Each run splits all classes by the value at one position, the run's own. Nodes of up to `leaf` classes are leaves; larger
ones are split again, at positions drawn for the node (one, and with a quarter's chance a second, so that a pair at the
threshold keeps an expected path), down to `depth`. What is still large then is compared exactly block by block. The
number of runs follows from the recall that is wanted for pairs just at the threshold.

Inside leaves every pair is first compared by signature, then by its whole sets. A pair that meets in several leaves is
handled in the least of them only, so links are counted once without pairs being written: each task returns a count for
each class, and for each group of linked classes a star of edges for the components.

Joins are left to Spark, which broadcasts a side only below its own size limit and splits hot keys; each step's table is
written, so that plans stay short and no later step builds an earlier one again.

Defined cases: null texts and texts without words have no links and are classes by themselves; rows with null doc_id
take part with their text, and name no class; rows that share a doc_id are told apart by their sets; very long texts are
read whole; an empty table gives no rows; extra columns are left aside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import table, written
from sightline.llm.components import components

WORDS = 5
POSITIONS = 64
BLOCK = 512

_KIND = np.zeros(256, np.uint8)  # of a byte: 0 between words, else its lower-case form
_KIND[128:] = np.arange(128, 256)
_KIND[48:58] = np.arange(48, 58)
_KIND[97:123] = np.arange(97, 123)
_KIND[65:91] = np.arange(97, 123)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    if base not in _TABLES or len(_TABLES[base]) < n:
        _TABLES[base] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)), dtype=np.uint64)
    return _TABLES[base][:n]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of the text's runs of words."""
    kind = _KIND[np.frombuffer((text or "").encode(), np.uint8)]
    inside = np.concatenate([[False], kind > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    # Each word as a polynomial in its bytes; the inverse power takes out where it stands.
    total = np.append(np.zeros(1, np.uint64), np.cumsum(kind * powers(_BASE, len(kind)), dtype=np.uint64))
    word = mix((total[end] - total[start]) * powers(_INVERSE, len(kind))[start] + (end - start).astype(np.uint64))
    k = min(words, len(word))
    run = np.full(len(word) - k + 1, k, np.uint64)
    for i in range(k):
        run = mix(run * np.uint64(31) + word[i : len(word) - k + 1 + i])
    return np.unique(run)


_A, _B = np.random.default_rng(11).integers(0, 1 << 64, (2, POSITIONS), np.uint64)
_A |= np.uint64(1)


def signature(tokens: np.ndarray) -> np.ndarray:
    least = np.full(POSITIONS, np.uint64((1 << 64) - 1))
    for i in range(0, len(tokens), 1024):
        least = np.minimum(least, (tokens[i : i + 1024, None] * _A + _B).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def signed_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, size, c1, c2 (the set's digest of 128 bits), sig (array<int>, null for an empty set)."""
    out = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("size int, c1 long, c2 long, sig array<int>").fields])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                s = shingles(text.as_py(), words)
                rows.append((len(s), *_digest(s), signature(s) if len(s) else None))
            size, c1, c2, sig = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs until a pair at the threshold has met with that probability, if it has to survive `depth` splits in each."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def leaves(classes: DataFrame, threshold: float, recall: float, leaf: int, depth: int) -> DataFrame:
    """classes (c, sig) → c, base (the leaf), part (the pair of blocks in it), block, first, second."""
    runs = runs_for(recall, threshold, depth)
    if runs > POSITIONS:
        raise ValueError(f"{runs} runs need more than {POSITIONS} positions")
    spot = lambda key, i, r: F.pmod(F.xxhash64(key, F.lit(i), F.lit(r)), F.lit(POSITIONS)).cast("int")
    child = lambda key, at: F.xxhash64(key, at, F.element_at("sig", at + 1))
    roots = F.array(*(F.xxhash64(F.lit(r), F.element_at("sig", r + 1)) for r in range(runs)))
    nodes = classes.select("c", F.explode(roots).alias("key"))
    found = []
    for level in range(1, depth + 1):
        counts = written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"nodes-{level}")
        fits = F.lit(True) if level == depth else F.col("n") <= leaf
        placed = written(nodes.join(counts, "key"), f"placed-{level}")
        found.append(placed.filter(fits))
        if counts.filter(~fits).isEmpty():
            break
        first = spot(F.col("key"), 1, level)
        second = F.when(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(4)) == 0, F.pmod(first + 1 + spot(F.col("key"), 3, level) % (POSITIONS - 1), F.lit(POSITIONS)).cast("int"))
        split = F.array_compact(F.array(first, second))
        # Only what stands in large nodes is split, and needs its signature again.
        large = placed.filter(~fits).select("c", "key").join(classes, "c")
        nodes = written(large.select("c", F.explode(F.transform(split, lambda at: child(F.col("key"), at))).alias("key")), f"split-{level}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # A leaf that stayed large is dealt to pairs of blocks; each class goes to as many as there are blocks.
    blocks = F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int")
    out = out.select("c", F.col("key").alias("base"), blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("c", "base"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("first"), F.greatest("block", j).alias("second")))
    return out.select("c", "base", "block", F.inline(pairs)).withColumn("part", F.xxhash64("base", "first", "second"))


def _groups(batches, key: str):
    """Runs of rows with one value of `key`, over batches that are sorted by it, as tables of many whole groups."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = now.column(key).to_numpy()
        end = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        if end:
            yield now.slice(0, end).combine_chunks()
        rest = now.slice(end)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _spans(keys: np.ndarray):
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return zip(edge[:-1], edge[1:])


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values.to_numpy().astype(kind, copy=False)


def _pairs(sub: dict, lo: int, hi: int, agree):
    """(a, later rows) of a group: the pairs that this group has to handle and that `agree`, a function of a row and later rows, takes.

    A pair that stands together in a lesser leaf too is handled there.
    """
    base, one, two = int(sub["base"][lo]), int(sub["first"][lo]), int(sub["second"][lo])
    at = sub["at"][lo : hi + 1]
    bases, row = sub["bases"][at[0] : at[-1]], np.repeat(np.arange(hi - lo), np.diff(at))
    lesser = bases < base
    leaf, code = np.unique(bases[lesser], return_inverse=True)
    row = row[lesser]
    order = np.argsort(row, kind="stable")
    row, code = row[order], code[order]
    cut = np.searchsorted(row, np.arange(hi - lo + 1))
    by_leaf = np.argsort(code, kind="stable")
    leaf_cut = np.searchsorted(code[by_leaf], np.arange(len(leaf) + 1))
    block, met = sub["block"][lo:hi], np.zeros(hi - lo, bool)
    for a in range(hi - lo - 1):
        later = np.arange(a + 1, hi - lo)
        if one != two:
            later = later[block[later] != block[a]]
        if cut[a] < cut[a + 1] and len(later):
            for k in code[cut[a] : cut[a + 1]]:
                met[row[by_leaf[leaf_cut[k] : leaf_cut[k + 1]]]] = True
            later = later[~met[later]]
            met[:] = False
        if len(later):
            later = later[agree(lo + a, lo + later)]
        if len(later):
            yield lo + a, lo + later


def _plain(t: pa.Table) -> dict:
    got = {c: t.column(c).to_numpy() for c in ("c", "part", "base", "block", "first", "second", "size")}
    got["at"], got["bases"] = _flat(t.column("bases"), np.int64)
    return got


def candidates(rows: DataFrame, threshold: float, screen: float | None) -> DataFrame:
    """The rows of each part that have a partner there whose signature comes near the threshold, without signatures."""
    near = 0.0 if screen is None else threshold - screen * math.sqrt(threshold * (1 - threshold) / POSITIONS)
    names = ["c", "part", "base", "block", "first", "second", "size", "bases"]

    def run(batches):
        for t in _groups(batches, "part"):
            sub = _plain(t)
            at, flat = _flat(t.column("sig"), np.int32)
            sig = flat[at[0] : at[-1]].reshape(-1, POSITIONS)
            hit = np.zeros(t.num_rows, bool)

            def agree(a, later):
                ratio = np.minimum(sub["size"][a], sub["size"][later]) >= threshold * np.maximum(sub["size"][a], sub["size"][later])
                return ratio & ((sig[later] == sig[a]).mean(1) >= near)

            for lo, hi in _spans(sub["part"]):
                for a, later in _pairs(sub, lo, hi, agree):
                    hit[a] = hit[later] = True
            yield from t.select(names).filter(pa.array(hit)).to_batches()

    schema = "c long, part long, base long, block int, first int, second int, size int, bases array<long>"
    return rows.select(*names, "sig").mapInArrow(run, schema)


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """c, links (partners found in this part), root (the least class that it hangs together with there); rows with links only."""

    def run(batches):
        for t in _groups(batches, "part"):
            sub = _plain(t)
            at, tokens = _flat(t.column("tokens"), np.int64)
            links, root = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows)
            for lo, hi in _spans(sub["part"]):
                own = tokens[at[lo] : at[hi]]
                _, code = np.unique(own, return_inverse=True)
                place, width = at[lo : hi + 1] - at[lo], code.max() + 1 if len(code) else 1
                mark = np.zeros(width, bool)

                def agree(a, later):
                    mine = code[place[a - lo] : place[a - lo + 1]]
                    mark[mine] = True
                    first, last = later[0] - lo, later[-1] - lo + 1
                    hits = np.concatenate([[0], np.cumsum(mark[code[place[first] : place[last]]])])
                    mark[mine] = False
                    both = hits[place[later - lo + 1] - place[first]] - hits[place[later - lo] - place[first]]
                    # Integers, so that a pair just at the threshold is taken.
                    return both * 1000 >= np.rint(threshold * 1000) * (sub["size"][a].astype(np.int64) + sub["size"][later] - both)

                label = root[lo:hi]
                for a, later in _pairs(sub, lo, hi, agree):
                    links[a] += len(later)
                    links[later] += 1
                    for other in np.unique(label[later - lo]):
                        if other != label[a - lo]:
                            label[label == other] = label[a - lo]
            least = np.full(t.num_rows, np.iinfo(np.int64).max)
            np.minimum.at(least, root, sub["c"])
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(sub["c"][hit]), pa.array(links[hit]), pa.array(least[root][hit])], names=["c", "links", "root"])

    return rows.select("part", "base", "block", "first", "second", "size", "bases", "c", "tokens").mapInArrow(run, "c long, links long, root long")


def token_sets(docs: DataFrame, words: int) -> DataFrame:
    """c1, c2, tokens."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column("text")]
            c1, c2 = zip(*map(_digest, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["c1", "c2", "tokens"])

    return docs.select("text").mapInArrow(run, "c1 long, c2 long, tokens array<long>")


def class_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """c, tokens of `classes` (c, c1, c2, copy_of): out of the texts of their least documents."""
    ids = written(classes.select("c", "c1", "c2", "copy_of"), "wanted")
    texts = docs.join(ids.select(F.col("copy_of").alias("doc_id")).filter("doc_id is not null").distinct(), "doc_id", "left_semi")
    if not ids.filter("copy_of is null").isEmpty():
        texts = texts.unionByName(docs.filter("doc_id is null"))
    sets = token_sets(texts, words).join(ids.select("c", "c1", "c2"), ["c1", "c2"])
    return sets.groupBy("c").agg(F.first("tokens").alias("tokens"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, words: int = WORDS, leaf: int = 64, depth: int = 4, screen: float | None = 4.0) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id of its group of linked documents), copy_of (the least
    doc_id with the same set), copies (documents with that set), n_links (other sets that are similar to it).

    recall: of pairs just at the threshold. screen: pairs whose signatures agree less than the threshold by so many
    standard deviations are not compared by their sets; at 4, three pairs at the threshold in 100,000, for which the runs
    make up. None compares every pair of a leaf.
    """
    docs = docs.select("doc_id", "text")
    missed = 0.0 if screen is None else math.erfc(screen / math.sqrt(2)) / 2
    signed = written(signed_sets(docs, words), "signatures")
    grouped = signed.filter("size > 0").groupBy("c1", "c2", "size", "sig").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("copies"))
    classes = written(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
    # Where each class stands, without signatures; all that follows reads this.
    rows = written(leaves(classes.select("c", "sig"), threshold, min(0.999999, recall + missed), leaf, depth), "leaves")
    of = written(rows.groupBy("c").agg(F.array_sort(F.collect_set("base")).alias("bases")), "bases")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = of.join(classes.select("c", "size", "sig"), "c")
    ready = rows.join(described, "c").repartition(parts, "part").sortWithinPartitions("part", "c")
    maybe = written(candidates(ready, threshold, screen), "candidates")
    wanted = classes.join(maybe.select("c").distinct(), "c", "left_semi")
    sets = written(class_sets(docs, wanted, words), "sets")
    proof = maybe.join(sets, "c").repartition(parts, "part").sortWithinPartitions("part", "c")
    proven = written(verified(proof, threshold), "links")
    links = proven.groupBy("c").agg(F.sum("links").alias("n_links"))
    roots = components(proven.select(F.col("c").alias("a"), F.col("root").alias("b")))
    linked = classes.select("c", "c1", "c2", "copy_of", "copies").join(links, "c", "left").join(roots, F.col("c") == F.col("node"), "left")
    linked = written(linked.select("c", "c1", "c2", "copy_of", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "c").alias("root")), "linked")
    named = written(linked.groupBy("root").agg(F.min("copy_of").alias("class_id")), "named")
    table_ = written(linked.join(named, "root").select("c1", "c2", "copy_of", "copies", "n_links", "class_id"), "classes")
    alone = signed.filter("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return signed.filter("size > 0").select("doc_id", "c1", "c2").join(table_, ["c1", "c2"]).select("doc_id", "class_id", "copy_of", "copies", "n_links").unionByName(alone)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
