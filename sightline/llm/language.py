"""Language identification by hierarchical discrimination.

A linear support vector machine for each family against the rest finds the language family of a text; machines of one
language against another then separate the languages within it. Features are hashed byte trigrams of the whole text.

The machines are fitted in one task on a bounded sample of labelled rows: of the `most_languages` languages with most
texts, at most `per_language` different texts each, those with the least hashes, and at most `most_rows` in all. Everything else
covers all rows. A language beyond the bound is not learned; its texts get the learned language that is nearest.

Defined cases: null texts and texts without letters (characters that Unicode calls letters; numbers are none) are `und`
with score 0; without labelled rows every text is `und`; with one language all texts are that language; equal texts count
once in the sample; very long texts are read whole; an empty table gives no rows; clashing extra columns are replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline.llm.common import table

WIDTH = 4096

#: Codes of closely related languages; a language that stands nowhere is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic"}

_CLASS = np.full(256, 32, np.uint32)
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(texts: list[str]) -> np.ndarray:
    """Square roots of trigram shares, so that each row has length 1, and a constant."""
    x = np.zeros((len(texts), WIDTH + 1), np.float32)
    for row, text in zip(x, texts):
        b = _CLASS[np.frombuffer(f" {text} ".encode(), np.uint8)]
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
        key = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        n = np.bincount(key, minlength=WIDTH)
        row[:WIDTH] = np.sqrt(n / max(1, n.sum()))
        row[WIDTH] = 1
    return x


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """Weights by dual coordinate descent on the squared hinge loss; classes weigh alike. y: 1 or -1."""
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * cost
    w, a = np.zeros(x.shape[1]), np.zeros(len(y))
    norm = np.einsum("ij,ij->i", x, x) + 0.5 / weight
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1 + a[i] * 0.5 / weight[i]
            new = max(0.0, a[i] - gradient / norm[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w.astype(np.float32)


def fit_machines(x: np.ndarray, lang: np.ndarray) -> list[tuple[str | None, str, str | None, np.ndarray]]:
    """(family, language, other language, weights): a family against the rest has no languages, a pair of one family has both;
    a language without others in its family has no weights."""
    family = np.array([FAMILIES.get(v, v) for v in lang], object)
    families, out = sorted(set(family)), []
    for f in families:
        out.append((f, None, None, linear_svm(x, np.where(family == f, 1, -1)) if len(families) > 1 else np.empty(0, np.float32)))
        langs = sorted(set(lang[family == f]))
        out += [(f, v, None, np.empty(0, np.float32)) for v in langs]
        for a, b in combinations(langs, 2):
            rows = (lang == a) | (lang == b)
            out.append((f, a, b, linear_svm(x[rows], np.where(lang[rows] == a, 1, -1))))
    return out


class Hierarchy:
    """families: names; langs: names of each; the weights of a family against the rest, and of pairs of languages."""

    def __init__(self, machines):
        self.families = [f for f, a, _, _ in machines if a is None]
        self.langs = {f: [a for g, a, b, _ in machines if g == f and a is not None and b is None] for f in self.families}
        self.family_w = np.stack([w for _, a, _, w in machines if a is None], 1) if len(self.families) > 1 else None
        self.pair_w = {(a, b): w for _, a, b, w in machines if b is not None}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        share = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        if self.family_w is None:
            best, sure = np.zeros(len(x), int), np.ones(len(x))
        else:
            p = share(x @ self.family_w)
            best, sure = p.argmax(1), p.max(1)
        out, score = np.empty(len(x), object), np.empty(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            votes = np.zeros((len(rows), len(self.langs[f])))
            for (i, a), (j, b) in combinations(enumerate(self.langs[f]), 2):
                p = share(x[rows] @ self.pair_w[a, b])
                votes[:, i] += p
                votes[:, j] += 1 - p
            votes = votes / (len(self.langs[f]) - 1) if len(self.langs[f]) > 1 else votes + 1
            out[rows] = np.array(self.langs[f], object)[votes.argmax(1)] if len(rows) else []
            score[rows] = votes.max(1) * sure[rows] if len(rows) else []
        return list(out), score


def residue(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def fit(docs: DataFrame, per_language: int = 800, most_languages: int = 100, most_rows: int = 20_000) -> Hierarchy | None:
    """Learns from `text` and `lang` of `docs`; the bounds are told above. The driver gets the weights only."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    known = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages)
    each = F.least(F.lit(per_language), F.floor(F.lit(most_rows) / F.count(F.lit(1)).over(Window.partitionBy())))
    # Hashes below the share that is wanted, and a little more; the task that fits cuts at the bound. 100 rows at most.
    part = F.least(F.lit(1.0), 1.3 * F.col("each") / F.col("n"))
    shares = known.withColumn("each", each).select("lang", "each", ((part - 0.5) * float(1 << 64)).cast("long").alias("least"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            vectors = [features([t])[0].astype(np.float16).tobytes() if has_letter(t) else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), batch.column("each"), pa.array(vectors, pa.binary())], names=["lang", "h", "each", "x"])

    def fitted(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["lang", "h"])
        sample = sample[sample.groupby("lang").cumcount() < sample["each"]]
        x = np.stack([np.frombuffer(v, np.float16) for v in sample["x"]]).astype(np.float32)
        return pd.DataFrame([(*names, w.tobytes()) for *names, w in fit_machines(x, sample["lang"].to_numpy())], columns=["family", "one", "other", "w"])

    wanted = rows.join(F.broadcast(shares), "lang").filter("h <= least").dropDuplicates(["lang", "h"]).select("text", "lang", "h", F.col("each").cast("int").alias("each"))
    vectors = wanted.mapInArrow(run, "lang string, h long, each int, x binary").filter("length(x) > 0")
    got = vectors.withColumn("k", F.lit(0)).groupBy("k").applyInPandas(fitted, "family string, one string, other string, w binary").collect()
    return Hierarchy([(r["family"], r["one"], r["other"], np.frombuffer(r["w"], np.float32)) for r in got]) if got else None


def predict_language(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """`docs` with lang_pred and score (replaced where they stood)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*kept)
    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t.as_py() for t in part.column("text")]
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if t and has_letter(t)]
                if model is not None and rows:
                    found, sure = model.predict(features([texts[i] for i in rows]))
                    score[rows] = sure
                    for i, v in zip(rows, found):
                        lang[i] = v
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=out.names)

    return docs.mapInArrow(run, out)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(residue(3) != 1))
    held = F.coalesce(residue(3) == 1, F.lit(False)).alias("held_out")
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held, "lang_pred", "score")
