"""Best-fit packing, ranked search and spelling variants against brute force on small tables, with odd rows among them."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm import best_fit, ranked_search, spelling, tokens
from sightline.llm.common import table

SF = "/root/testdata/sf0.001"
CLASHING = "node string, first string, label string, ends string, w string, word string, n int, rank string, score string, terms string, norm string, part int, nth int, length string, piece string, ids string, q int, h string"
SCHEMA = f"doc_id long, text string, {CLASHING}"
WIDTH = len(CLASHING.split(", "))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, *[None] * WIDTH) for i, t in rows], schema)


def prose(rng, words):
    return " ".join(rng.choice(["", "", "Ä", "x"]) + "".join(rng.choice("th er on an re Ed é".split()) for _ in range(rng.randint(1, 6))) + rng.choice(["", "", ".", "\n", "-"]) for _ in range(words))


def odd():
    rng = random.Random(4)
    same = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n"), (None, same), (None, prose(rng, 30)), (5, same), (5, same), (6, prose(rng, 4000)), (7, "<|endoftext|>"), (8, "x" * 60_000), (8, "x" * 59_999 + "y")]
    return rows + [(20 + i, prose(rng, rng.randint(1, 90))) for i in range(90)] + [(500 + i, "the same words again") for i in range(80)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- op11 -----------------------------------------------------------------------------------------------------------


def piece_by_piece(lengths, size):
    """Room left in each sequence, by trying all of them for each piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        open_ = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if open_:
            rooms[min(open_)[1]] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=150))))
def test_runs_are_best_fit_decreasing(case):
    size, lengths = case
    counts = [0] * (size + 1)
    for n in lengths:
        counts[n] += 1
    held, placed = collections.defaultdict(list), [0] * (size + 1)
    for length, rank, pieces, first, each, offset in best_fit.best_fit_decreasing(counts, size):
        assert placed[length] == rank
        placed[length] += pieces
        for j in range(pieces):
            assert sum(held[first + j // each]) == offset + j % each * length
            held[first + j // each].append(length)
    assert placed == counts
    assert sorted(size - sum(x) for x in held.values()) == piece_by_piece(lengths, size)


@pytest.mark.parametrize("size", [16, 1024])
def test_best_fit_packing(docs, size):
    got = best_fit.best_fit_pack(docs, size).toPandas()
    paths = tokens.vocabulary()
    ids = [[*tokens.encode(t or "", paths), 2] for _, t in odd()]
    cut = [[x[: len(x) % size or size], *(x[i : i + size] for i in range(len(x) % size or size, len(x), size))] for x in ids]
    want = sorted((float("nan") if i is None else i, k, sum(map(len, c[:k])), tuple(p)) for (i, _), c in zip(odd(), cut) for k, p in enumerate(c))
    mine = sorted((i, k, a, tuple(p)) for i, k, a, p in zip(got["doc_id"], got["piece"], got["start"], got["ids"]))
    key = lambda rows: sorted(repr(r) for r in rows)
    assert key([(str(r[0]).replace(".0", ""), *map(int, r[1:3]), tuple(map(int, r[3]))) for r in mine]) == key([(str(r[0]).replace(".0", ""), *r[1:]) for r in want])
    assert all(n == len(p) and c == zlib.crc32(np.array(p, "<u4").tobytes()) for n, c, p in zip(got["length"], got["ids_crc32"], got["ids"]))
    rooms = []
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows["offset"]) == list(rows["length"].cumsum() - rows["length"])
        rooms.append(size - rows["length"].sum())
    assert sorted(rooms) == piece_by_piece(got["length"], size)


def test_best_fit_packing_is_the_same_however_dealt_and_empty(docs, empty, spark):
    assert best_fit.best_fit_pack(empty).count() == 0
    count = lambda df: best_fit.best_fit_pack(df, 64, keep_ids=False).select("sequence_id").distinct().count()
    assert count(docs) == count(docs.repartition(7))
    named = spark.createDataFrame([("b", "one two"), ("a", None), (None, "three")], "doc_id string, text string")
    assert {r.doc_id for r in best_fit.best_fit_pack(named).collect()} == {"a", "b", None}


# --- op12 -----------------------------------------------------------------------------------------------------------


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def all_scores(rows, asked, k):
    held = [(i, collections.Counter(split(t))) for i, t in rows if split(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in asked:
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def asked_texts():
    rng = random.Random(9)
    texts = [odd()[9][1], prose(rng, 30), prose(rng, 8), None, "", "the same words again", odd()[30][1], "nothing of this 123", prose(rng, 3)]
    return [*enumerate(texts), (1, prose(rng, 12)), (None, odd()[40][1])]


@pytest.mark.parametrize("k,limits", [(50, {}), (3, {"bucket_rows": 7, "focus": 2}), (5, {"bucket_rows": 16, "focus": 0, "block_bytes": 400}), (50, {"focus": 1000, "first_share": 0.5})])
def test_ranked_search_is_exact(spark, docs, k, limits):
    asked = frame(spark, asked_texts()).withColumnRenamed("doc_id", "item_id")
    got = ranked_search.ranked_search(docs, asked, k=k, **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == all_scores(odd(), asked_texts(), k)


def test_ranked_search_of_copies_and_of_nothing(spark, docs, empty):
    asked = frame(spark, asked_texts()).withColumnRenamed("doc_id", "item_id")
    assert ranked_search.ranked_search(empty, asked).count() == 0
    assert ranked_search.ranked_search(docs, empty.withColumnRenamed("doc_id", "item_id")).count() == 0
    copies = [(i, "one two three four") for i in range(3000)] + [(5000 + i, f"one other {i}") for i in range(300)]
    got = ranked_search.ranked_search(frame(spark, copies), asked.limit(0).union(frame(spark, [(1, "Four one")])))
    assert [(r.rank, r.doc_id) for r in sorted(got.collect())] == [(i + 1, i) for i in range(50)]


def test_search_buckets_bound_and_prune(spark, docs):
    """A bucket gives exact scores of all that reach what is asked, and leaves out others before rescoring."""
    rng = np.random.default_rng(2)
    weights = rng.integers(0, 9000, 40)
    sizes = rng.integers(1, 20, 300)
    terms = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in sizes])
    impact = rng.integers(0, 10**6, len(terms))
    at = np.concatenate([[0], np.cumsum(sizes)])
    norm = np.sqrt([float((weights[terms[a:z]] * impact[a:z].astype(float) ** 2).sum()) for a, z in zip(at, at[1:])])
    bucket = ranked_search.Bucket(at, terms, impact, norm, weights)
    query = np.array(sorted(rng.choice(40, 9, replace=False), key=lambda t: -weights[t]))
    exact = np.array([sum(int(weights[t]) * int(i) for t, i in zip(terms[a:z], impact[a:z]) if t in query) for a, z in zip(at, at[1:])])
    for least in (1, int(np.median(exact)), int(exact.max()), int(exact.max()) + 1):
        for focus in (0, 3, 9):
            rows, scores = bucket.scores(query, weights, focus, least)
            assert list(rows) == list(np.flatnonzero(exact >= least)) and list(scores) == list(exact[rows])


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables")
def test_ranked_search_beside_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = ranked_search.op12_ranked_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ranked_search.OP12_SQL).fetchall())


# --- op13 -----------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    d = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[d + 1 :] == (b[d + 1 :] if len(a) == len(b) else b[d:])


def all_variants(counts, ratio=10):
    near = collections.defaultdict(list)
    holes = collections.defaultdict(set)  # by each word with one letter left out, and by itself
    for w in counts:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    for a, b in {tuple(sorted(p)) for ws in holes.values() for p in itertools.combinations(ws, 2)}:
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda x: (-counts[x], x))
        if counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("letters,longest,seed", [("ab", 9, 1), ("abcé", 7, 2)])
def test_spelling_variants_of_dense_vocabularies(spark, letters, longest, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(400)}
    counts = {w: rng.choice([1, 2, 3, 30, 400, 5000]) for w in words | {"a" * n for n in range(1, 20)}}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.spelling_variants(df)) == all_variants(counts)


def test_spelling_variants_of_long_words(spark):
    """A level is a fork, so words of many thousand letters with many forks' distance take few rounds."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    counts = {base: 5000}
    for i in range(12):
        at = rng.randrange(len(base))
        counts[base[:at] + base[at + 1 :]] = 3
        counts[base[:at] + "z" + base[at + 1 :]] = 400
        counts[base[:at] + "z" + base[at:]] = 40
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {(min(a, b), max(a, b)) for a, b in itertools.combinations(counts, 2) if one_edit(a, b)}
    words = df.select(F.monotonically_increasing_id().alias("w"), "word", "n").cache()
    word = {r.w: r.word for r in words.collect()}
    assert {tuple(sorted((word[r.a], word[r.b]))) for r in spelling.near_words(words).collect()} == near


def typed(rows, every=31):
    total = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def test_corpus_words(docs, empty):
    assert dict(spelling.corpus_words(docs, typo_every=31).collect()) == typed(odd())
    assert dict(spelling.corpus_words(docs, typo_every=2).collect()) == typed(odd(), 2)
    assert spelling.spelling_variants(spelling.corpus_words(empty)).count() == 0
    assert spelling.spelling_variants(spelling.corpus_words(empty)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables")
def test_spelling_variants_of_the_tables(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = rows_of(spelling.op13_spelling_variants(spark, SF))
    assert got == all_variants(typed(rows)) and any(r[1] for r in got)
