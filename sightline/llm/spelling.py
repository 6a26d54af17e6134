"""Spelling variants of a vocabulary: words that differ by one code point, found on a relational trie.

The words are kept in two tries, one of the words and one of the reversed words, as tables of edges spread over the cluster.
Nodes are named by a hash of the letters that lead to them, and letters between two forks are one edge, so an edge is (node,
its first letter, all its letters, the node below or the word that ends there). States (word, position, node, edits) are
joined with the edge table level by level: an unedited state stands at a fork on its word's own path and spends its edit there
(another letter instead, or the word's letter left out; the longer word of a pair finds the shorter, so nothing is
inserted); an edited one follows the edge that its next letter names. A state that ends where its word ends is a pair.
The edit always lies at the first letter that differs, so forks are the only places for it; and if it lies in the first half
of the word, its reverse finds it in the other trie, so unedited states start at the middle, where forks have few edges.
Letters are compared, never hashes only, and each pair is held against the whole words at the end.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each; texts and
words of any length count whole (a level is a fork, not a letter); equal counts go to the smaller word in code-point order; an
empty table gives no rows; other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import collections
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table, written

RUN = "[A-Za-zÀ-ÿ]"
ROWS_A_BATCH = 50_000
#: Of the hash that names nodes: modulus and factor.
MODULUS, FACTOR = (1 << 61) - 1, 1_000_003_777


def corpus_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, typo_every: int | None = None) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least that many code points, that occur at least so often.

    typo_every: from a run loses one letter in each document whose crc32 of "<doc_id>:<run>" it divides.
    """

    def run(batches):
        whole = re.compile(f"{RUN}{{{least_length},}}")
        for b in batches:
            total = collections.Counter()
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                runs = collections.Counter(whole.findall((text.as_py() or "").encode().lower().decode()))  # bytes.lower: A-Z only
                for word, n in runs.items():
                    if typo_every and (h := zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())) % typo_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letters_on_the_way(words: DataFrame) -> DataFrame:
    """w, way (0: the word, 1: its reverse), depth, node, next (the letter after the node, none at the end), from the middle on."""

    def run(batches):
        rows = []

        def batch():
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["w", "way", "depth", "node", "next"])

        for b in batches:
            for w, word in zip(b.column("w").to_pylist(), b.column("word").to_pylist()):
                for way, letters in enumerate((word, word[::-1])):
                    node, middle = way + 1, len(word) // 2 if way == 0 else len(word) - len(word) // 2
                    for depth, letter in enumerate([*letters, ""]):
                        if depth >= middle:
                            rows.append((w, way, depth, node, letter))
                        if letter:
                            node = (node * FACTOR + ord(letter)) % MODULUS
                        if len(rows) == ROWS_A_BATCH:
                            yield batch()
                            rows = []
        if rows:
            yield batch()

    return words.select("w", "word").mapInArrow(run, "w long, way int, depth int, node long, next string")


def forks(words: DataFrame) -> DataFrame:
    """w, letters (the word or its reverse), chain: its forks as array<struct<depth,node>>, the shallowest first."""
    way = letters_on_the_way(words)
    forked = way.groupBy("node").agg(F.min("next").alias("least"), F.max("next").alias("most")).filter("least <> most").select("node")
    chains = way.join(forked, "node", "left_semi").groupBy("w", "way").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("chain"))
    letters = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    return written(chains.join(words, "w").select("w", letters.alias("letters"), "chain"), "forks")


def trie_edges(chains: DataFrame) -> DataFrame:
    """node, first, label (all its letters), below (a node) or ends (the word that ends there)."""
    at = F.posexplode(F.transform("chain", lambda x, i: F.struct(x["depth"].alias("depth"), x["node"].alias("node"), F.get("chain", i + 1).alias("next"))))
    steps = chains.select("w", "letters", at.alias("i", "x"))
    label = F.when(F.col("x.next").isNull(), F.substring("letters", F.col("x.depth") + 1, F.char_length("letters"))).otherwise(F.substring("letters", F.col("x.depth") + 1, F.col("x.next.depth") - F.col("x.depth")))
    edges = steps.select(F.col("x.node").alias("node"), label.alias("label"), F.col("x.next.node").alias("below"), F.when(F.col("x.next").isNull(), F.col("w")).alias("ends")).distinct()
    return written(edges.select("node", F.substring("label", 1, 1).alias("first"), "label", "below", "ends"), "edges")


def _from(position: Column, size: Column) -> Column:
    """Letters of the state's word from `position` (from 0) on."""
    return F.substring("letters", position + 1, size)


def _moved(found: DataFrame) -> DataFrame:
    """States with position at the edge's far end; those that end a word elsewhere than at their own end are dead."""
    alive = F.col("ends").isNull() | (F.col("position") == F.char_length("letters"))
    return found.filter(alive).select("w", "letters", "position", F.col("below").alias("node"), F.lit(1).alias("edits"), "ends")


def first_edits(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """States that have spent their edit at a fork of their word's path and walked the edge that they chose."""
    states = chains.select("w", "letters", F.explode("chain").alias("x")).select("w", "letters", F.col("x.depth").alias("position"), F.col("x.node").alias("node"), F.lit(0).alias("edits"))
    size, at = F.char_length("label"), F.col("position")
    other = (F.col("first") != _from(at, F.lit(1))) & (at < F.char_length("letters"))
    replaced = (size > 0) & (_from(at + 1, size - 1) == F.substring("label", F.lit(2), size))
    left_out = (F.col("first") == _from(at + 1, F.lit(1))) & (_from(at + 1, size) == F.col("label"))
    ways = F.array_compact(F.array(F.when(replaced, at + size), F.when(left_out, at + size + 1)))
    found = states.join(edges, "node").filter(other & (replaced | left_out))
    return _moved(found.select("w", "letters", "below", "ends", F.explode(ways).alias("position")))


def next_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    here = states.select("w", "letters", "position", "node", _from(F.col("position"), F.lit(1)).alias("first"))
    size = F.char_length("label")
    found = here.join(edges, ["node", "first"]).filter(_from(F.col("position"), size) == F.col("label"))
    return _moved(found.withColumn("position", F.col("position") + size))


def near_words(words: DataFrame) -> DataFrame:
    """a, b (numbers of words, a < b) of all pairs of words that differ by exactly one code point. words: w, word."""
    chains = forks(words)
    edges = trie_edges(chains)
    level = written(first_edits(chains, edges), "level")
    pairs = level.filter("ends is not null").select("w", "ends")
    while not (states := level.filter("ends is null")).isEmpty():
        level = written(next_level(states, edges), "level")
        pairs = pairs.unionByName(level.filter("ends is not null").select("w", "ends"))
    pairs = pairs.select(F.least("w", "ends").alias("a"), F.greatest("w", "ends").alias("b")).distinct()
    one, two = (words.select(F.col("w").alias(x), F.col("word").alias(f"{x}_word")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").filter(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """w, up: from w along links (w, up) to the last. Each round doubles the way; a way never turns back as counts grow along it."""
    while True:
        after = links.select(F.col("w").alias("up"), F.col("up").alias("further"))
        links = written(links.join(after, "up", "left").select("w", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.select("w", "up")
        links = links.select("w", "up")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n; words are distinct).

    form: of the words that differ by one code point the most frequent, if it is `ratio` times as frequent at least.
    """
    words = written(words.select(F.monotonically_increasing_id().alias("w"), "word", "n"), "words")
    pairs = written(near_words(words), "pairs")
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("x")).unionByName(pairs.select(F.col("b").alias("w"), F.col("a").alias("x")))
    others = words.select(F.col("w").alias("x"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = both.join(others, "x").groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("key"), "form", "form_n", "x")).alias("best"))
    known = written(words.join(best, "w", "left").select("w", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.form_n") >= ratio * F.col("n"), F.col("best")).alias("best")), "known")
    ends = roots(known.filter("best is not null").select("w", F.col("best.x").alias("up")))
    named = ends.join(words.select(F.col("w").alias("up"), F.col("word").alias("root")), "up").select("w", "root")
    return known.join(named, "w", "left").select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("best.form_n").alias("form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(table(spark, sf_dir, "documents"), typo_every=31))
