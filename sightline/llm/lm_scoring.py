"""Subword lattice likelihood.

A text is its words, each with a space before it, and one end. The scores of an existing unigram vocabulary weigh all ways to
cut a word into pieces (single bytes among them); a forward recursion in log space over the lattice of pieces sums them to
the word's marginal. Pieces never cross a space, so the recursion over a document is the product over its words. With
`rounds=0` and without `label` that is the model, but that a word which training knows also has its discounted share of the
training tokens, and the lattice gets what the discount leaves:

    p(word) = max(c - d, 0) / N + d * V / N * lattice(word)

Training can change the scores: they are then the prior of the pieces' probabilities, worth `prior` uses in all, to which
`rounds` passes add the expected uses of each piece (forward and backward over the lattices) over all distinct words.

With `label` a text is of one of several components, the most frequent labels of training documents, and its probability
sums over these: each component has its own word counts and pieces, and falls back on the counts of all documents too. All
documents with null or rarer labels are one further component. The text alone is scored; labels are read of training
documents only. Word counts cover all training documents; nothing is sampled.

Words that are common in training (a table of at most `common_words`, found by a histogram of counts) are scored in the
scan; the others travel to their counts by a shuffle and back as sums, so any word finds its exact count.

Defined cases: null counts as empty, a document of one end; repeated rows are scored each; very long texts and words are
read whole; without training documents every word has count 0 and the lattice alone scores; an empty table gives no rows;
other columns are left aside.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table, written

LN10 = float(np.log(10))
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Bytes from which on a word's lattice is built by itself rather than beside others of its length.
LONG = 64


#: Added to a rank before it becomes a probability (Zipf and Mandelbrot's law).
RANK_SHIFT = 10.0


def unigram_pieces(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """A public vocabulary as bytes, a space for its word mark, and the natural logs of its pieces' probabilities.

    Scores that are whole numbers are ranks, as byte-pair vocabularies have them: 1 / (rank + a shift) is their probability.
    Other scores are logs of probabilities. Pieces with A-Z can't occur and are left out; bytes that are no pieces come last.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if piece.lower() == piece and b" " not in piece[1:]:
                found[piece] = model.get_score(i)
    if all(v == round(v) for v in found.values()):
        found = {k: -math.log(RANK_SHIFT - v) for k, v in found.items()}
    least = min(found.values())
    found = {bytes([b]): least for b in range(256)} | found
    pieces = sorted(found)
    logp = np.array([found[x] for x in pieces])
    return pieces, logp - np.logaddexp.reduce(logp)


class Lattice:
    """Pieces and the logarithms of their probabilities, a row for each component."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.longest, self.logp = max(map(len, pieces)), logp
        self.key = np.array([self._one(p) for p in pieces], np.uint64)
        # Two tables from the top bits of a key's product with a factor: the second holds what found its place in the first taken.
        ids = np.arange(len(pieces))
        self.first, rest = self._table(ids, np.uint64(0xD6E8FEB86659FD93))
        factor = np.uint64(0xA0761D6478BD642F)
        while True:
            self.second, more = self._table(ids[rest], factor)
            if not len(more):
                break
            factor += np.uint64(2)

    def _table(self, ids: np.ndarray, factor: np.uint64):
        slots, spot = np.zeros(1 << 18, np.int32), self._spot(self.key[ids], factor)
        slots[spot[::-1]] = ids[::-1]  # the first of those that share a place
        return (slots, factor), np.flatnonzero(slots[spot] != ids)

    @staticmethod
    def _spot(key: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((key * factor) >> np.uint64(46)).astype(np.int64)

    @staticmethod
    def _one(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_STEP) + b + 1) % (1 << 64)
        return h

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pieces', and the pieces."""
        one, two = (slots[self._spot(h, factor)] for slots, factor in (self.first, self.second))
        ids = np.where(self.key[one] == h, one, two)
        at = np.flatnonzero(self.key[ids] == h)
        return at, ids[at]

    def _arcs(self, rows: np.ndarray):
        """(i, j, words, pieces): which words, of one length and a row each, have which piece from i to j."""
        width = rows.shape[1]
        head = np.zeros((width + 1, len(rows)), np.uint64)
        for j in range(width):
            head[j + 1] = head[j] * _STEP + rows[:, j].astype(np.uint64) + np.uint64(1)
        power = np.cumprod(np.append(np.ones(1, np.uint64), np.full(self.longest, _STEP, np.uint64)), dtype=np.uint64)
        for j in range(1, width + 1):
            for i in range(max(0, j - self.longest), j):
                at, ids = self._known(head[j] - head[i] * power[j - i])
                if len(at):
                    yield i, j, at, ids

    @staticmethod
    def _forward(rows: np.ndarray, arcs, logp: np.ndarray) -> np.ndarray:
        """Place, component, word."""
        alpha = np.full((rows.shape[1] + 1, len(logp), len(rows)), -np.inf)
        alpha[0] = 0
        for i, j, at, ids in arcs:
            alpha[j][:, at] = np.logaddexp(alpha[j][:, at], alpha[i][:, at] + logp[:, ids])
        return alpha

    @staticmethod
    def _by_length(words: list[bytes]):
        """Places and byte rows of words of one length, some at a time."""
        size = np.array([len(w) for w in words])
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            step = max(1, 200_000 // int(width))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                yield some, np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), width)

    def _long(self, word: np.ndarray):
        """(starts, ends, pieces) of one word's arcs, in order of their ends: found for all places at once, a piece length at a time."""
        head = np.zeros(len(word) + 1, np.uint64)
        for j, b in enumerate(word.tolist()):
            head[j + 1] = np.uint64((int(head[j]) * int(_STEP) + b + 1) % (1 << 64))
        found = []
        for size in range(1, min(self.longest, len(word)) + 1):
            power = np.uint64(pow(int(_STEP), size, 1 << 64))
            at, ids = self._known(head[size:] - head[:-size] * power)
            found.append(np.stack([at, at + size, ids]))
        found = np.concatenate(found, 1)
        return found[:, np.argsort(found[1], kind="stable")]

    @staticmethod
    def _sweep(length: int, at: np.ndarray, to: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log sums over paths from place 0, for arcs (at, to) in order of `to`; component, place."""
        out = np.full((len(weight), length + 1), -np.inf)
        out[:, 0] = 0
        cuts = np.searchsorted(to, np.arange(length + 2)).tolist()
        for j in range(1, length + 1):
            some = slice(cuts[j], cuts[j + 1])
            out[:, j] = np.logaddexp.reduce(out[:, at[some]] + weight[:, some], axis=1)
        return out

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability in each component."""
        out = np.zeros((len(words), len(self.logp)))
        for at, rows in self._by_length(words):
            if rows.shape[1] <= LONG:
                out[at] = self._forward(rows, self._arcs(rows), self.logp)[-1].T
            else:
                for i, row in zip(at, rows):
                    starts, ends, ids = self._long(row)
                    out[i] = self._sweep(len(row), starts, ends, self.logp[:, ids])[:, -1]
        return out

    def expected(self, words: list[bytes], component: int) -> np.ndarray:
        """Expected uses of each piece, over the words."""
        logp = self.logp[component : component + 1]
        total = np.zeros(logp.shape[1])
        for _, rows in self._by_length(words):
            if rows.shape[1] > LONG:
                for row in rows:
                    n, (starts, ends, ids) = len(row), self._long(row)
                    alpha = self._sweep(n, starts, ends, logp[:, ids])[0]
                    back = np.argsort(n - starts, kind="stable")
                    beta = self._sweep(n, n - ends[back], n - starts[back], logp[:, ids[back]])[0][::-1]
                    total += np.bincount(ids, np.exp(alpha[starts] + logp[0, ids] + beta[ends] - alpha[-1]), len(total))
                continue
            arcs = list(self._arcs(rows))
            alpha = self._forward(rows, arcs, logp)[:, 0]
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for i, j, at, ids in reversed(arcs):
                arc = logp[0, ids] + beta[j, at]
                total += np.bincount(ids, np.exp(alpha[i, at] + arc - alpha[-1, at]), len(total))
                beta[i, at] = np.logaddexp(beta[i, at], arc)
        return total


def merged(batches, rows: int = 100_000):
    """Batches of at least so many rows, but for the last: words of one length then are many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only


def word_counts(train: DataFrame, labels: list[str], size: int) -> DataFrame:
    """word, c (over all of `train`), and c0, c1, ... (over the documents of each label, then of all others); the ends are not among them."""
    place = {v: i for i, v in enumerate(labels)}

    def run(batches):
        def flush(counts):
            words = [(w, k, n) for k, some in counts.items() for w, n in some.items()]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _, _ in words], pa.string()), pa.array([k for _, k, _ in words], pa.int32()), pa.array([n for _, _, n in words], pa.int64())], names=["word", "k", "n"])

        counts: dict[int, Counter] = {}
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                counts.setdefault(place.get(label, size - 1), Counter()).update(words_of(text.as_py()))
                if sum(map(len, counts.values())) > 500_000:
                    yield flush(counts)
                    counts = {}
        yield flush(counts)

    parts = [F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(size)]
    return train.mapInArrow(run, "word string, k int, n long").groupBy("word").agg(F.sum("n").alias("c"), *parts)


def train_pieces(words: DataFrame, pieces: list[bytes], logp: np.ndarray, components: int, rounds: int, prior: float) -> np.ndarray:
    """Log probabilities of the pieces in each component after some rounds over all its distinct words, each counted once; `logp` is worth `prior` uses."""
    first = np.exp(logp) * prior
    logp = np.repeat(logp[None], components, 0)
    for _ in range(rounds):
        lattice = Lattice(pieces, logp)

        def run(batches, lattice=lattice):
            total = np.zeros((components, len(pieces)))
            for batch in merged(batches):
                found = [b" " + w.encode() for w in batch.column("word").to_pylist()]
                for k in range(components):
                    total[k] += lattice.expected([found[i] for i in np.flatnonzero(batch.column(f"c{k}").to_numpy())], k)
            k, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(total[k, at])], names=["k", "piece", "n"])

        got = words.drop("c").mapInArrow(run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        uses = np.repeat(first[None], components, 0)
        uses[got["k"], got["piece"]] += got["n"]
        logp = np.log(uses / uses.sum(1, keepdims=True))
    return logp


class Model:
    """What counts and lattice scores make of a word: log10 by each component, and by add-one smoothing over all.

    n, v, ends, once, twice: tokens, distinct tokens, documents, words seen once and twice; numbers for all documents,
    and arrays for the components.
    """

    def __init__(self, n: int, v: int, ends: int, parts: dict[str, np.ndarray], shared: float = 0.3):
        self.n, self.v, self.ends = n, v, ends
        self.shared = shared if len(parts["n"]) > 1 else 0.0  # one component has all counts
        self.parts_n, self.parts_ends = np.maximum(parts["n"], 1), np.maximum(parts["ends"], 0.5)
        some = (parts["once"] > 0) & (parts["twice"] > 0)
        self.discount = np.where(some, parts["once"] / np.maximum(parts["once"] + 2 * parts["twice"], 1), 0.5)
        self.left = np.log(np.maximum(self.discount * parts["v"], 0.5) / self.parts_n)
        self.prior = np.log10(self.parts_ends / self.parts_ends.sum())

    def base(self, c):
        return np.log10((np.asarray(c) + 1) / (self.n + self.v + 1))

    def full(self, c, parts, lattice):
        """c: counts in training; parts, lattice: counts and natural logs of the pieces' marginals, a column for each component."""
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(parts - self.discount, 0) / self.parts_n)
            all_ = np.log(self.shared * np.asarray(c, float)[:, None] / max(self.n, 1))
        return np.logaddexp(own, self.left + np.logaddexp(all_, math.log(1 - self.shared) + lattice)) / LN10

    def end(self) -> np.ndarray:
        return np.log10(self.parts_ends / self.parts_n)


def score_documents(
    docs: DataFrame, train: DataFrame, label: str | None = None, components: int = 16, common_words: int = 1 << 17, rounds: int = 2, prior: float = 100.0, vocabulary: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each of `docs`. label: a column of `train`; its `components`
    most frequent values are components, and all other documents are one more."""
    spark = docs.sparkSession
    train = train.select("text", (F.col(label) if label else F.lit(None)).cast("string").alias("label"))
    by_label = [(r["label"], r["count"]) for r in train.filter("label is not null").groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(components).collect()]
    ends = train.count()
    labels, label_ends = [v for v, _ in by_label], [n for _, n in by_label]
    if not labels or ends > sum(label_ends):
        label_ends.append(ends - sum(label_ends))
    size = len(label_ends)
    words = written(word_counts(train, labels, size), "words")
    level = F.floor(F.log2(F.col("c").cast("double")) * 4)
    sums = [F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")]
    for k in range(size):
        sums += [F.sum(f"c{k}").alias(f"n{k}")] + [F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"v{k}")] + [F.sum((F.col(f"c{k}") == i).cast("long")).alias(f"{name}{k}") for i, name in ((1, "once"), (2, "twice"))]
    steps = sorted(words.groupBy(level.alias("step")).agg(*sums).collect(), key=lambda r: -r["step"])
    parts = {name: np.array([sum(r[f"{name}{k}"] for r in steps) for k in range(size)]) for name in ("n", "v", "once", "twice")}
    parts["ends"] = np.array(label_ends)
    parts["n"] = parts["n"] + parts["ends"]
    model = Model(sum(r["n"] for r in steps) + ends, sum(r["v"] for r in steps) + (ends > 0), ends, parts)
    pieces, logp = unigram_pieces(vocabulary)
    lattice = spark.sparkContext.broadcast(Lattice(pieces, train_pieces(words, pieces, logp, size, rounds, prior)))
    # The counts from which on there are at most `common_words` words.
    step, many = None, 0
    for r in steps:
        many += r["v"]
        if many > common_words:
            break
        step = r["step"]
    counts, full = [f"c{k}" for k in range(size)], [f"f{k}" for k in range(size)]
    columns = lambda names: ", ".join(f"{n} double" for n in names)

    def numbers(batch, names):
        return np.stack([batch.column(n).fill_null(0).to_numpy(False) for n in names], 1)

    def score_common(batches):
        for b in merged(batches):
            c = b.column("c").to_numpy()
            found = model.full(c, numbers(b, counts), lattice.value.score([b" " + w.encode() for w in b.column("word").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(model.base(c)), *map(pa.array, found.T)], names=["word", "base", *full])

    top = words.filter(level >= step) if step is not None else words.limit(0)
    rows = top.mapInArrow(score_common, f"word string, base double, {columns(full)}").toPandas()
    common = spark.sparkContext.broadcast(({w.encode(): i for i, w in enumerate(rows["word"])}, rows[["base", *full]].to_numpy(float)))

    def scan(batches):
        """A row of sums for each document, under a name that no word can have, and a row for each of its other words."""
        place, known = common.value
        for batch in batches:
            docs, keys, words, n, sure, sums = [], [], [], [], [], []
            start = np.concatenate([[model.base(model.ends)], model.end()])
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")):
                tokens = words_of(text.as_py())
                at = [place.get(w, -1) for w in tokens]
                rest = Counter(w for w, i in zip(tokens, at) if i < 0)
                at = np.array(at, np.int64)
                at = at[at >= 0]
                docs += [doc] * (1 + len(rest))
                keys += [key] * (1 + len(rest))
                words += [f" {key}", *(w.decode() for w in rest)]
                n += [len(tokens) + 1, *rest.values()]
                sure += [len(at) + (model.ends > 0), *[None] * len(rest)]
                sums += [known[at].sum(0) + start, *[[0.0] * len(start)] * len(rest)]
            arrays = [pa.array(docs, batch.schema.field("doc_id").type), pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(sure, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, np.array(sums, float).reshape(-1, size + 1).T)], names=["doc_id", "key", "word", "n", "known", "base", *full])

    def score_rest(batches):
        for b in merged(batches):
            rest = b.column("known").is_null().to_numpy(False)
            n, c = b.column("n").to_numpy(), b.column("c").fill_null(0).to_numpy()
            tokens, known = np.where(rest, 0, n), b.column("known").fill_null(0).to_numpy() + np.where(rest & (c > 0), n, 0)
            sums = numbers(b, ["base", *full])
            at = np.flatnonzero(rest)
            if len(at):
                word = b.column("word").take(pa.array(at)).dictionary_encode()
                found = lattice.value.score([b" " + w.encode() for w in word.dictionary.to_pylist()])[word.indices.to_numpy()]
                sums[at, 0] = n[at] * model.base(c[at])
                sums[at, 1:] = n[at, None] * model.full(c[at], numbers(b, counts)[at], found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(tokens), pa.array(known), *map(pa.array, sums.T)], names=["doc_id", "key", "tokens", "known", "base", *full])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("key"))
    seen = keyed.select("doc_id", "key", "text").mapInArrow(scan, f"doc_id {kind}, key long, word string, n long, known long, base double, {columns(full)}")
    rated = seen.join(words, "word", "left").mapInArrow(score_rest, f"doc_id {kind}, key long, tokens long, known long, base double, {columns(full)}")
    sums = rated.groupBy("doc_id", "key").agg(F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), *(F.sum(f).alias(f) for f in full))
    each = [F.col(f) + float(p) for f, p in zip(full, model.prior)]
    most = F.greatest(*each) if size > 1 else each[0]
    total = most + F.log10(sum((F.pow(F.lit(10.0), e - most) for e in each), F.lit(0.0)))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", total.alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    held = F.coalesce(remainder == 2, F.lit(False))
    out = score_documents(docs, docs.filter(~held), label="lang")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
