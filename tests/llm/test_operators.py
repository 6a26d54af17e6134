"""The text operators against brute force on small tables, with odd rows among them."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import decontamination, fingerprints, jaccard_join, language, license_scan, line_dedup, lm_scoring, packing, sharding, token_counts, tokens
from sightline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, score string, lang_pred string, n_lines string, h1 string, c string, word string, key string, bucket int, spans string, record string, n int, items string, k_t string, wanted string, copies int, first int, bases string, t long"
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ung ein ich der die zu ge ß ü".split(), "fr": "eau ou é à ch ment tion en la qu".split(), "es": "ción ado os as ñ ll el que ía rr".split()}
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def prose(rng, lang="en", words=80):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(words))


def odd():
    rng = random.Random(1)
    same = prose(rng)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "12345 !!"), (5, prose(rng, words=30_000)), (6, same), (7, same), (7, same), (None, prose(rng)), (8, "Ä ö ﬁ  É é 　x\U0001f600"), (9, "one two"), (10, "x" * 100_000), (11, "a\nb\nc\nd\n" * 20)]
    return rows + [(100 + i, prose(rng, lang, rng.randint(5, 200))) for i, lang in enumerate(list(SYLLABLES) * 10)]


def frame(spark, rows, lang=None):
    return spark.createDataFrame([(i, t, lang, "s", None, *[None] * 20) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- op1 ------------------------------------------------------------------------------------------------------------


def test_shards(docs, empty):
    got = sharding.shard_documents(docs, 5, bucket_bytes=20_000).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(odd(), key=repr)
    sizes = collections.Counter(r.shard for r in got)
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    again = sharding.shard_documents(docs, 5, bucket_bytes=20_000).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert sharding.shard_documents(empty, 5).count() == 0


def test_shards_do_not_depend_on_partitions(spark, docs):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in [*settings, "spark.sql.shuffle.partitions"]}
    found = []
    try:
        for n in (3, 8, 211):
            for k, v in {**settings, "spark.sql.shuffle.partitions": str(n)}.items():
                spark.conf.set(k, v)
            for rows in (docs, docs.repartition(n)):
                found.append(sorted(((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard_documents(rows, 5, bucket_bytes=20_000).select("doc_id", "text", "shard", "slot").collect()), key=repr))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert all(f == found[0] for f in found)


def test_equal_rows_are_scattered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = frame(spark, [(1, "same")] * 500 + [(i, f"text {i}") for i in range(2, 102)]).repartition(3)
    hashes = sharding.numbered_records(rows.select("doc_id", "text"), 17)
    assert hashes.count() == hashes.select("h").distinct().count() == 600
    got = sharding.shard_documents(rows, 10, bucket_bytes=1000).select("doc_id", "shard", "slot").collect()
    assert len(got) == 600 and collections.Counter(r.doc_id for r in got)[1] == 500
    assert set(collections.Counter(r.shard for r in got).values()) == {60} and len({r.shard for r in got if r.doc_id == 1}) == 10
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    again = sharding.shard_documents(rows, 10, bucket_bytes=1000).select("doc_id", "shard", "slot").collect()
    assert sorted(got) == sorted(again)


def test_rows_whose_nulls_stand_elsewhere_stay_apart(spark, monkeypatch):
    rows = [tuple("x" if bits >> i & 1 else None for i in range(3)) for bits in range(8)] * 3 + [(None, "x", "y"), ("x", None, "y"), ("x", "y", None)]
    schema = "doc_id string, text string, lang string"
    got = sharding.shard_documents(spark.createDataFrame(rows, schema).repartition(3), 4, bucket_bytes=100)
    assert sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=repr) == sorted(rows, key=repr)
    assert sorted(collections.Counter(r.shard for r in got.collect()).values()) == [6, 7, 7, 7]
    # Nulls inside nested columns.
    nested = [(1, (None, "x")), (1, ("x", None)), (1, None), (1, (None, None)), (1, ("x", None))]
    df = spark.createDataFrame(nested, "doc_id int, deep struct<a: string, b: string>").withColumn("text", F.lit("t"))
    back = [(r.doc_id, r.deep and tuple(r.deep)) for r in sharding.shard_documents(df, 2).collect()]
    assert sorted(back, key=repr) == sorted(nested, key=repr)
    # Records whose hashes agree are told apart by what they are.
    monkeypatch.setattr(sharding, "_told_apart", lambda docs: [F.lit(1)])
    all_alike = sharding.shard_documents(spark.createDataFrame(rows, schema), 4)
    assert sorted(((r.doc_id, r.text, r.lang) for r in all_alike.collect()), key=repr) == sorted(rows, key=repr)


def test_sharding_is_native(docs):
    plan = sharding.shard_documents(docs, 5)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_more_shards_than_rows(spark):
    got = sharding.shard_documents(frame(spark, [(1, "a"), (2, "b")]), 7).collect()
    assert sorted(r.slot for r in got) == [0, 0] and len({r.shard for r in got}) == 2


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_documents(docs, 3), str(tmp_path / "out"), file_rows=5)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(odd())
    files = out.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"), (F.max("slot") - F.min("slot") + 1).alias("span"), F.countDistinct("shard").alias("shards")).collect()
    assert all(f.n == f.span <= 5 and f.shards == 1 for f in files) and len(files) >= len(odd()) / 5


# --- op2 ------------------------------------------------------------------------------------------------------------


def labelled(spark, n=120):
    rng = random.Random(2)
    return spark.createDataFrame([(i, prose(rng, lang, rng.randint(10, 60)), lang) for i, lang in enumerate(list(SYLLABLES) * n)], "doc_id long, text string, lang string")


def test_language_on_held_out_texts(spark):
    rows = labelled(spark)
    model = language.fit(rows.filter(language.residue(3) != 1))
    got = language.predict_language(rows.filter(language.residue(3) == 1), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert model.families == ["germanic", "romance"] and set(model.pair_w) == {("de", "en"), ("es", "fr")}


def test_language_of_odd_rows(spark, docs, empty):
    model = language.fit(labelled(spark, 20))
    got = language.predict_language(docs, model)
    by = {r.doc_id: r for r in got.collect()}
    assert {i for i, r in by.items() if r.lang_pred == "und"} == {1, 2, 3, 4} and all(by[i].score == 0 for i in (1, 2, 3, 4))
    assert got.count() == len(odd()) and language.predict_language(empty, model).count() == 0
    assert language.fit(docs) is None and {r.lang_pred for r in language.predict_language(docs, None).collect()} == {"und"}


def test_letters_are_unicode_letters():
    assert not any(map(language.has_letter, ["", "12 ²½①Ⅷ", "_-!", "\u0301"])) and all(map(language.has_letter, ["1a", "中", "ª", "١ا"]))


def brute_language(text, machines):
    """Plain sums over trigrams of bytes and machine by machine, with dictionaries."""
    bucket = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    b = [bucket(x) for x in f" {text} ".encode()]
    b = [x for i, x in enumerate(b) if not i or x != 32 or b[i - 1] != 32]
    grams = collections.Counter((((x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % 2**32) >> 20) for x, y, z in zip(b, b[1:], b[2:]))
    value = {k: math.sqrt(n / sum(grams.values())) for k, n in grams.items()}
    share = lambda w: 1 / (1 + math.exp(-4 * (sum(v * float(w[k]) for k, v in value.items()) + float(w[-1]))))
    sure, family = max((share(w), f) for f, one, _, w in machines if one is None)
    votes = collections.Counter()
    for f, one, other, w in machines:
        if f == family and other is not None:
            votes[one] += share(w)
            votes[other] += 1 - share(w)
    lang, n = votes.most_common(1)[0]
    return lang, n / (len(votes) - 1) * sure


def test_language_against_brute_force(spark):
    rows = [(r.text, r.lang) for r in labelled(spark, 30).collect()]
    machines = language.fit_machines(language.features([t for t, _ in rows]), np.array([v for _, v in rows], object))
    got = language.predict_language(labelled(spark, 30), language.Hierarchy(machines)).collect()
    for r in got:
        lang, score = brute_language(r.text, machines)
        assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-3)


def test_bounds_of_the_language_sample(spark):
    model = language.fit(labelled(spark, 10), most_languages=2)
    assert sum(map(len, model.langs.values())) == 2
    same = spark.createDataFrame([(None, "eau ou la", "fr")] * 500 + [(1, f"ich der die {i}", "de") for i in range(40)], "doc_id long, text string, lang string")
    assert language.predict_language(same, language.fit(same, most_rows=20)).filter("lang <> lang_pred").count() == 0


# --- op3 ------------------------------------------------------------------------------------------------------------


def test_patience_alignment_finds_common_words():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
    assert len(license_scan.align(list("xabcydefz"), list("abcdef"))) == 6


def test_licenses(spark, docs, empty):
    texts = [(1, f"{prose(random.Random(5))}\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "this WORK is licensed under: the GNU General Public License, version 3"), (3, "the license of the work is general"), (4, "All rights reserved."), (5, None)]
    got = {r.doc_id: r.license for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert got == {1: "Apache-2.0", 2: "GPL-3.0", 3: None, 4: "All-rights-reserved", 5: None}
    whole = {r.doc_id: r.license for r in license_scan.scan_licenses(spark.createDataFrame([(n, f"Copyright 2020 someone. {t} end") for n, t in license_scan.TEMPLATES.items()], "doc_id string, text string")).collect()}
    assert whole == {n: n for n in license_scan.TEMPLATES}
    assert license_scan.scan_licenses(docs).count() == len(odd()) and license_scan.scan_licenses(empty).count() == 0


def test_repeated_notices(spark):
    rng = random.Random(4)
    common = "the of and this is by to in a it for with work under as".split()
    running = lambda: " ".join(rng.choice(common) for _ in range(60))
    notices = license_scan.TEMPLATES
    texts = [(f"{name}|{times}", " ".join([running(), *(f"{notice} {running()}" for _ in range(times))])) for name, notice in notices.items() for times in (1, 2, 3)]
    texts += [(f"{name}|close", f"the {notice} {notice} {notice} the") for name, notice in notices.items()]
    texts += [("None|prose", " ".join(running() for _ in range(20)))]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    for key, row in got.items():
        name = key.split("|")[0]
        assert (row.license is None and not row.licenses) if name == "None" else (name in row.licenses and row.coverage == 1.0), key


def test_licences_that_share_words_are_told_apart(spark):
    """A template alone names itself alone, once or several times, amid prose or not; two that stand apart, or side by side, are both named."""
    rng = random.Random(9)
    t, other = license_scan.TEMPLATES, "lorem ipsum dolor sit amet".split()
    between = lambda: " ".join(rng.choice(other) for _ in range(40))
    texts = [(f"{n}|{k}", " ".join([between(), *(f"{t[n]} {between()}" for _ in range(k))])) for n in t for k in (1, 2, 3)]
    texts += [(f"{n}|near", t[n].replace("version", "release")) for n in ("GPL-2.0-header", "GPL-3.0-header", "LGPL-3.0-header")]
    pairs = [("CC-BY-SA-4.0", "CC-BY-NC-4.0"), ("GPL-2.0-header", "GPL-3.0-header"), ("GPL-3.0-header", "LGPL-3.0-header"), ("MIT-text", "MIT-full"), ("Apache-2.0", "Apache-2.0-header")]
    texts += [(f"{a},{b}|{gap}", f"{t[a]} {between() if gap else ''} {t[b]}") for a, b in pairs for gap in (0, 1)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    for key, row in got.items():
        assert row.licenses == sorted(key.split("|")[0].split(",")), (key, row)
        assert row.license in row.licenses


@pytest.mark.parametrize("times", [1, 2, 3])
def test_verbatim_notices_in_prose_are_found(times):
    rng = random.Random(times)
    english = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    sets = {n: license_scan.words(t) for n, t in license_scan.TEMPLATES.items()}
    for k in range(200):
        name = list(sets)[k % len(sets)]
        running = lambda: [rng.choice(english) for _ in range(rng.randint(0, 300))]
        text = running()
        for _ in range(times):
            text += sets[name] + running()
        assert license_scan.coverage(text, sets[name]) == 1.0, name


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def test_coverage_against_brute_force():
    rng = random.Random(16)
    for _ in range(200):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 10))]
        text = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 60))]
        got, size = license_scan.coverage(text, template) * len(template), len(template)
        # Every stretch of one and a half times the template's length lies whole in one that is aligned.
        least = max((longest_common(text[i : i + size + size // 2], template) for i in range(len(text))), default=0)
        assert least - 1e-9 <= got <= longest_common(text, template) + 1e-9


def test_common_words_are_the_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert license_scan.common_words(a, {w: sum(1 << i for i, x in enumerate(b) if x == w) for w in set(b)}) == best[-1][-1]


# --- op4 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separators_across_blocks(spark, block):
    rng = np.random.default_rng(block)
    files, want = [], {}
    for f in range(6):
        sizes = rng.integers(0, 9, rng.integers(0, 8)).tolist()
        ids = np.concatenate([np.append(rng.integers(0, 50000, s), token_counts.END) for s in sizes] or [[]]).astype("<u2")
        tail = int(rng.integers(0, 3))
        ids = np.concatenate([ids, np.full(tail, 9, "<u2")])
        files.append((f"f{f}", ids.tobytes()))
        want |= {(f"f{f}", i): (s, False) for i, s in enumerate(sizes)} | ({(f"f{f}", len(sizes)): (tail, True)} if tail else {})
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    got = {(r.path, r.doc_no): (r.n_tokens, r.open) for r in token_counts.count_tokens(df, block_tokens=block).collect()}
    assert got == want


@pytest.mark.parametrize("stored", [True, False])
def test_token_files(spark, docs, empty, tmp_path, stored):
    rows = docs.drop("slot").dropDuplicates(["doc_id"]).withColumn("path", F.lit("x"))
    if stored:
        rows.repartition(3).write.option("parquet.block.size", 1 << 14).parquet(str(tmp_path / "docs"))
        rows = spark.read.parquet(str(tmp_path / "docs"))
    want = {r.doc_id: len(tokens.encode(r.text or "", tokens.vocabulary(), names_are_text=True)) for r in rows.collect()}
    index = token_counts.write_token_files(rows, str(tmp_path / "t"), docs_per_file=4)
    files = spark.read.format("binaryFile").load(str(tmp_path / "t"))
    assert files.count() > 10
    # The partitions of the second reading are others.
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = token_counts.name_documents(token_counts.count_tokens(files), index).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == len(want) and {r.doc_id: r.n_tokens for r in got} == want


def test_token_files_of_a_part_of_a_table(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    some = spark.read.parquet(str(tmp_path / "docs")).filter("doc_id % 3 = 0")
    index = token_counts.write_token_files(some, str(tmp_path / "t"))
    got = token_counts.name_documents(token_counts.count_tokens(spark.read.format("binaryFile").load(str(tmp_path / "t"))), index).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tokens.encode(t or "", tokens.vocabulary(), names_are_text=True)) for i, t in odd() if i and i % 3 == 0}


def test_ids_are_the_library_s_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    full, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    for text in ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "é<|endoftext|>中"]:
        assert tokens.encode(text, tokens.vocabulary()) == full.encode(text, add_special_tokens=False).ids
        assert token_counts.END not in tokens.encode(text, tokens.vocabulary(), names_are_text=True)
    alphabet = "abc XYZ 0123 \n\t.,!'-_ÄÖüßéñ’“” ­́ĀğŻ"[:40]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(60))
        assert tokens.encode(text, tokens.vocabulary()) == full.encode(text, add_special_tokens=False).ids


# --- op5 ------------------------------------------------------------------------------------------------------------


def line(rng, words=9):
    return prose(rng, words=words).replace("\n", " ")


def runs_of_two(text):
    """Pairs of lines with words that follow one another, as text from the first to the second."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    return ["\n".join(lines[i : j + 1]) for i, j in itertools.pairwise(at)]


def check_removal(rows, got):
    """Brute force, without cuts: what goes is repeated and stands somewhere still."""
    held = collections.Counter(p for _, t in rows for p in set(runs_of_two(t or "")))
    lines = collections.Counter(x for _, t in rows for x in set((t or "").split("\n")))
    left = {x for t in got.values() for x in (t or "").split("\n")}
    for i, text in rows:
        before, after = (text or "").split("\n"), (got[i] or "").split("\n")
        gone = collections.Counter(before) - collections.Counter(after)
        assert set(gone) <= left | {""} and not collections.Counter(after) - collections.Counter([*before, ""])
        paired = {x for p in runs_of_two(text or "") if held[p] > 1 or runs_of_two(text).count(p) > 1 for x in p.split("\n")}
        assert set(gone) <= paired | {x for x in lines if line_dedup.count_words(x) > 50}


@pytest.mark.parametrize("k", [2, 3, 4, 6, 10, 30])
def test_repeated_passages_of_any_length_go(spark, k):
    rng = random.Random(k)
    rows, words_of, later = [], collections.Counter(), collections.Counter()
    for j in range(150):
        passage = [f"{line(rng, 6)} {j}" for _ in range(k)]
        for copy in range(2):
            rows.append((2 * j + copy, "\n".join([*(line(rng) for _ in range(rng.randint(1, 5))), *passage, *(line(rng) for _ in range(rng.randint(1, 5)))])))
        words_of.update({x: len(x.split()) for x in passage})
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    check_removal(rows, got)
    kept = collections.Counter(x for t in got.values() for x in t.split("\n"))
    gone = sum(n for x, n in words_of.items() if kept[x] == 1)
    assert min(kept[x] for x in words_of) == 1 and gone > 0.9 * sum(words_of.values())


def test_repeated_chunks(spark):
    rng = random.Random(7)
    passage = "\n".join(line(rng) for _ in range(12))
    rows = [(i, "\n".join([*(line(rng, 6) for _ in range(rng.randint(1, 9))), passage, *(line(rng, 6) for _ in range(rng.randint(1, 9)))])) for i in range(12)]
    rows += [(20, "a\nb\nc\nd\n" * 20), (21, None), (22, ""), (23, "one line"), (24, "one line"), (25, passage + "\n" + passage), (26, "x\n\n\n"), (27, "x\n\n\n")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    check_removal(rows, {i: r.text for i, r in got.items()})
    middle = passage.split("\n")[5]
    assert sum(middle in (r.text or "") for r in got.values()) == 1 and got[20].text.count("b") == 1
    assert got[21].n_lines == 0 and got[23].text == got[24].text == "one line" and got[26].text == got[27].text == "x\n\n\n"


def test_rows_that_share_a_doc_id(spark):
    rng = random.Random(17)
    passage = "\n".join(line(rng) for _ in range(10))
    rows = [(5, f"a\n{passage}\nb"), (5, f"c\n{passage}\nd"), (None, f"e\n{passage}\nf"), (None, f"g\n{passage}\nh"), (4, f"i\n{passage}\nj"), (4, f"i\n{passage}\nj")]
    got = [r.text for r in line_dedup.dedup_lines(frame(spark, rows), 50).collect()]
    assert sum(passage in t for t in got) == 2 and sorted(t for t in got if passage not in t) == ["a\nb", "c\nd", "e\nf", "g\nh"]
    alone = line_dedup.dedup_lines(frame(spark, rows[2:4]), 50).collect()
    assert sum(passage in r.text for r in alone) == 1


def test_cuts_move_only_beside_an_insertion():
    lines = [f"line {i * 7919 % 1009}" for i in range(300)]

    def found(lines):
        at, n = line_dedup.chunks_of(line_dedup.line_hashes(lines)[:, 0])
        return {(i, j) for i, j in zip(at.tolist(), n.tolist())}

    for at in range(1, 300, 17):
        moved = {(i + (i >= at), n) for i, n in found(lines) if i >= at or i + n <= at}
        new = found([*lines[:at], "new", *lines[at:]])
        # Chunks that do not touch the place stay; all that is new lies about it.
        assert {(i, n) for i, n in moved if i + n < at or i > at + 1} <= new and all(i <= at + 1 and i + n >= at for i, n in new - moved)
    assert all(len(x) == 0 for x in line_dedup.looked_up([""], 50)) and line_dedup.cuttings(line_dedup.line_hashes(lines)[:, 0]).mean() > 0.7


def test_covering_takes_few_spans():
    rng = random.Random(18)
    for _ in range(300):
        spans = [(rng.randrange(40), rng.randint(1, 9)) for _ in range(rng.randint(0, 25))]
        taken = [spans[i] for i in line_dedup.covering(spans)]
        lines = lambda some: {x for i, n in some for x in range(i, i + n)}
        assert lines(taken) == lines(spans) and all(lines(taken) != lines(taken[:k] + taken[k + 1 :]) for k in range(len(taken)))


def test_whole_passages_go(spark):
    rng = random.Random(8)
    short = lambda: prose(rng, words=rng.randint(1, 9)).replace("\n", " ")
    one, several = prose(rng, words=60).replace("\n", " "), "\n".join([short(), "", *(prose(rng, words=9).replace("\n", " ") for _ in range(9)), "", short()])
    unspaced = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(60))
    # Each copy has neighbours of its own; a copy that stands again in its keeper goes too.
    rows = [(i, "\n".join([f"{i} {short()}", p, f"{i} {short()}", *([p] if not k else []), f"{i} end"])) for j, p in enumerate((one, several, unspaced)) for k, i in enumerate(range(10 * j, 10 * j + 8))]
    rows += [(None, f"null\n{one}"), (40, f"40\n{one[:-1]}?"), (41, "few words\n41"), (42, "few words\n42")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows).repartition(3), line_dedup.OVER_WORDS).collect()}
    for i, text in rows:
        first = i is not None and i in (0, 10, 20)
        for p in (one, several, unspaced):
            if p in text:
                assert got[i].count(p) == (1 if first else 0)
                if not first:
                    assert not any(x and x in got[i].split("\n") for x in p.split("\n"))
    assert all(f"{i} end" in got[i] for i in (1, 11, 21)) and got[None] == "null" and got[40] == rows[-3][1] and got[42] == rows[-1][1]


def test_passages_cover_shared_runs():
    rng = random.Random(9)
    for _ in range(200):
        lines = [" ".join("w" * rng.choice([0, 0, 1, 3, 7])) for _ in range(30)]
        spans = line_dedup.passages(list(map(line_dedup.count_words, lines)), 8)
        a, b = sorted(rng.sample(range(31), 2))
        full = [i for i in range(a, b) if lines[i]]
        if sum(len(lines[i].split()) for i in full) > 8:
            inside = {i for first, n in spans if a <= first and first + n <= b for i in range(first, first + n)}
            assert inside == set(range(full[0], full[-1] + 1))
    assert len(line_dedup.passages([0] * 100_000 + [9] + [0] * 100_000, 8)) == 1


def test_odd_rows_of_lines(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.count() == len(odd()) and set(docs.columns) <= set(got.columns) and line_dedup.dedup_lines(empty).count() == 0


# --- op6 ------------------------------------------------------------------------------------------------------------


def test_first_fit_decreasing_is_the_plain_one():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 57, 300):
        lengths, free, want = rng.integers(1, 1024, n), [], {}
        for i in np.argsort(-lengths, kind="stable"):
            b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(1024)
            want[i] = (b, 1024 - free[b])
            free[b] -= lengths[i]
        bins, offsets = packing.first_fit_decreasing(lengths, 1024)
        assert [(b, o) for b, o in zip(bins, offsets)] == [want[i] for i in range(n)]


def test_packing_is_a_round_trip(docs, empty):
    paths = tokens.vocabulary()
    got = packing.pack_documents(docs, size=64, group_docs=10).collect()
    made, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        made[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in odd():
        if i != 7:
            assert sum((p[1] for p in sorted(made[i])), []) == [*tokens.encode(text or "", paths), 0]
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert packing.pack_documents(empty).count() == 0


# --- op7 ------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_copies(rng, text, n, edits):
    out = []
    for _ in range(n):
        w = text.split(" ")
        for _ in range(edits):
            w[rng.randrange(len(w))] = prose(rng, words=1)
        out.append(" ".join(w))
    return out


def jaccard_truth(rows, threshold=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows]
    classes = {}
    for i, s in sets:
        if s:
            classes.setdefault(s, []).append(i)
    keys, links = list(classes), collections.Counter()
    parent = {s: s for s in keys}

    def top(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in itertools.combinations(keys, 2):
        both = len(a & b)
        if both * 1000 >= round(threshold * 1000) * (len(a) + len(b) - both):
            links[a] += 1
            links[b] += 1
            parent[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for s in keys:
        groups[top(s)] += classes[s]
    return {i: (min(groups[top(s)]), min(classes[s]), links[s]) if s else (i, i, 0) for i, s in sets}


@pytest.mark.parametrize("leaf", [64, 4])
def test_near_duplicates(spark, leaf):
    rng = random.Random(9)
    base = [prose(rng, words=rng.randint(40, 160)) for _ in range(30)]
    texts = base + [t for b in base[:12] for t in near_copies(rng, b, 4, rng.randint(1, 3))] + near_copies(rng, base[0], 150, 1) + [base[1]] * 40 + ["", None, "two words", "Two, words!", "12 !!"]
    common = prose(rng, words=60)
    texts += [f"{common} {prose(rng, words=120)}" for _ in range(40)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in jaccard_join.jaccard_join(frame(spark, rows), leaf=leaf, recall=0.9999).collect()}
    assert got == jaccard_truth(rows)


def test_blocks_of_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(10)
    text = prose(rng, words=120)
    rows = list(enumerate(near_copies(rng, text, 90, 1)))
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in jaccard_join.jaccard_join(frame(spark, rows), leaf=8, recall=0.9999).collect()}
    assert got == jaccard_truth(rows)


def test_odd_rows_of_near_duplicates(docs, empty):
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(odd()) and jaccard_join.jaccard_join(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[6].copy_of == by[7].copy_of == 6 and by[6].copies == 3 and by[1].n_links == by[2].n_links == 0


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if top(x) != x}


# --- op8 ------------------------------------------------------------------------------------------------------------


def leak_truth(rows, items, n=10):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1)) if w else []:
            grams[tuple(w[i : i + n])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[g]
        ids = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaks():
    rng = random.Random(12)
    items = [(i, prose(rng, words=rng.randint(11, 40))) for i in range(12)] + [(20, "tiny item here"), (21, None), (22, "!!"), (23, "the of"), (24, "a a a a a a a a a a a a a")]
    rows = odd()
    for i in range(30):
        w = items[i % 12][1].split()
        k = rng.randint(0, len(w))
        rows.append((300 + i, f"{prose(rng, words=20)} {' '.join(w[:k]).upper()}; {prose(rng, words=20)} {' '.join(w[k:])}"))
    return [*rows, (400, "Tiny  ITEM-here tiny item"), (401, "a " * 30), (402, "tiny item here"), (402, "tiny item")], items


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_contamination(spark, limit):
    rows, items = leaks()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame(spark, rows), bench, broadcast_windows=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == leak_truth(rows, items)


def test_decontamination_takes_effect(spark, docs, empty):
    rows, items = leaks()
    bench, table = spark.createDataFrame(items, "item_id long, text string"), frame(spark, rows)
    clean = [(i, t) for (i, t) in rows if not leak_truth([(i, t)], items)[0][5]]
    assert sorted(((r.doc_id, r.text) for r in decontamination.decontaminate(table, bench).collect()), key=repr) == sorted(clean, key=repr)
    cut = decontamination.decontaminate(table, bench, remove="spans")
    assert cut.count() == len(rows) and cut.columns == table.columns
    assert {r.text for r in cut.filter("doc_id = 400").collect()} == {"tiny item"} and cut.filter("doc_id = 100").first().text == dict(rows)[100]
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0 and decontamination.contamination(empty, bench).count() == 0


def test_scan_is_native(spark):
    rows, items = leaks()
    plan = decontamination.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op9 ------------------------------------------------------------------------------------------------------------


def brute_word(word, pieces):
    best = [0.0] * (len(word) + 1)
    best[0] = 1.0
    for j in range(1, len(word) + 1):
        best[j] = sum(best[i] * pieces.get(word[i:j], 0.0) for i in range(j))
    return best[-1]


def test_forward_recursion_sums_all_segmentations():
    rng = random.Random(13)
    pieces = sorted({bytes([b]) for b in b" abc"} | {b" a", b"ab", b"bc", b"abc", b" ab"})
    p = np.array([rng.random() for _ in pieces])
    p /= p.sum()
    lattice = lm_scoring.Lattice(pieces, np.log(p)[None])
    table = dict(zip(pieces, p))
    found = [(" " + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))).encode() for _ in range(100)]
    assert np.allclose(np.exp(lattice.score(found)[:, 0]), [brute_word(w, table) for w in found])
    # Expected uses weigh the bytes that they cover: the word's length.
    uses = lattice.expected(found, 0)
    assert math.isclose(sum(u * len(x) for u, x in zip(uses, pieces)), sum(map(len, found)), rel_tol=1e-9)


def test_long_words_are_scored_alike(monkeypatch):
    rng = random.Random(15)
    pieces, logp = lm_scoring.unigram_pieces()
    lattice = lm_scoring.Lattice(pieces, np.stack([logp, np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces))))]))
    found = [(" " + "".join(rng.choice(SYLLABLES["de"]) for _ in range(rng.randint(1, 12)))).encode() for _ in range(50)]
    short = lattice.score(found), lattice.expected(found, 1)
    monkeypatch.setattr(lm_scoring, "LONG", 0)
    assert np.allclose(short[0], lattice.score(found)) and np.allclose(short[1], lattice.expected(found, 1))


def brute_pieces(seen, rounds, prior):
    pieces, logp = lm_scoring.unigram_pieces()
    first = dict(zip(pieces, np.exp(logp)))
    p = first
    for _ in range(rounds):
        uses = {k: v * prior for k, v in first.items()}
        for w in seen:
            w = b" " + w
            ahead = [brute_word(w[:i], p) for i in range(len(w) + 1)]
            behind = [brute_word(w[i:], p) for i in range(len(w) + 1)]
            for i, j in itertools.combinations(range(len(w) + 1), 2):
                if w[i:j] in p:
                    uses[w[i:j]] += ahead[i] * p[w[i:j]] * behind[j] / ahead[-1]
        total = sum(uses.values())
        p = {k: v / total for k, v in uses.items()}
    return p


def brute_scores(train, rows, rounds, prior, labels=(None,)):
    """Counts, expected uses and sums over all segmentations, with dictionaries. train: (text, label); labels: a component each, null for all others."""
    seen = collections.Counter(w for t, _ in train for w in lm_scoring.words_of(t))
    ends, n, v = len(train), sum(seen.values()) + len(train), len(seen) + bool(train)
    shared = 0.3 if len(labels) > 1 else 0.0
    parts = []
    for label in labels:
        own = [t for t, x in train if (x if x in labels else None) == label]
        c = collections.Counter(w for t in own for w in lm_scoring.words_of(t))
        once, twice = (sum(k == m for k in c.values()) for m in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        size = max(sum(c.values()) + len(own), 1)
        parts.append((c, d, size, max(d * len(c), 0.5) / size, max(len(own), 0.5), brute_pieces(c, rounds, prior)))
    out = []
    for i, t in rows:
        w = lm_scoring.words_of(t)
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        logs = []
        for c, d, size, left, own_ends, p in parts:
            word = lambda x: max(c[x] - d, 0) / size + left * (shared * seen[x] / max(n, 1) + (1 - shared) * brute_word(b" " + x, p))
            logs.append(math.log10(own_ends / sum(x[4] for x in parts)) + math.log10(own_ends / size) + sum(math.log10(word(x)) for x in w))
        score = max(logs) + math.log10(sum(10 ** (x - max(logs)) for x in logs))
        out.append((i, len(w) + 1, sum(x in seen for x in w) + (ends > 0), n, base, score))
    return sorted(out, key=repr)


def same_scores(got, want):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(math.isclose(a, b, rel_tol=1e-6) for x, y in zip(got, want) for a, b in zip(x[4:], y[4:]))


@pytest.mark.parametrize("common, rounds, label", [(1 << 17, 0, None), (5, 1, None), (0, 1, "lang"), (1 << 17, 1, "lang")])
def test_scores(spark, docs, empty, common, rounds, label):
    train = labelled(spark, 4).filter("doc_id % 7 <> 2").withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    rows = [(i, t) for i, t in odd() if t is None or len(t) < 700]
    got = lm_scoring.score_documents(frame(spark, rows).repartition(3), train, label=label, components=2, common_words=common, rounds=rounds).collect()
    pairs = [(r.text, r.lang) for r in train.collect()]
    by = sorted(collections.Counter(x for _, x in pairs if x).items(), key=lambda kv: (-kv[1], kv[0]))
    same_scores(got, brute_scores(pairs, rows, rounds, 100.0, (by[0][0], by[1][0], None) if label else (None,)))
    if common == 5:
        every = lm_scoring.score_documents(docs, train, common_words=common, rounds=0).collect()
        assert len(every) == len(odd()) and all(math.isfinite(r.score) and r.score < 0 for r in every)
        assert lm_scoring.score_documents(empty, train, rounds=0).count() == 0


def test_scores_without_training(spark, docs, empty):
    rows = [(i, t) for i, t in odd() if t is None or len(t) < 700]
    for label in (None, "lang"):
        same_scores(lm_scoring.score_documents(frame(spark, rows), empty, label=label, rounds=1).collect(), brute_scores([], rows, 0, 1.0))


# --- op10 -----------------------------------------------------------------------------------------------------------


def canon(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", text).casefold())
    return re.sub(r"\s+", " ", folded).strip(" ")


def test_canonical_form(spark):
    texts = ["", " A  b\n\tC ", "É é ﬁ Straße   x", "Ｆｕｌｌ", "ǅ İ ς", "\U0001f600　z"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprints.canonical(F.col("text")).alias("c")).collect()]
    assert got == [canon(t) for t in texts]


@pytest.mark.parametrize("bits", [128, 4])
def test_fingerprints(spark, bits):
    rows = [(i, t) for i, t in odd() if i is not None and i != 7] + [(50, "Same Text"), (51, "same  text"), (52, "ab"), (53, "abc"), (54, "abd")]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, rows), bits).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canon(text) == canon(edited)), float(canon(text) == canon(after)))
    same = collections.defaultdict(set)
    for i, text in order:
        same[canon(text)].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len({f for v in same.values() for f in v}) == len(same)


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, "a null"), (None, None), (7, "seven b"), (7, "seven a"), (7, "seven a"), (3, "three"), (9, ""), (-5, "minus five")] + odd()
    rows = [(i, t) for i, t in rows if t is None or len(t) < 3000]
    got = fingerprints.edited_fingerprints(frame(spark, rows).repartition(3)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]), reverse=True)
    want = []
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canon(text) == canon(edited)), float(canon(text) == canon(after))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=repr) == sorted(want, key=repr)


def test_fingerprints_are_native(spark, docs, monkeypatch):
    plans = []
    monkeypatch.setattr(fingerprints, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or df)
    plans.append(fingerprints.edited_fingerprints(frame(spark, odd()))._jdf.queryExecution().toString())
    assert len(plans) > 2 and not any(re.search("Python|Pandas|Arrow", x) for x in plans)


def test_fingerprints_of_odd_tables(spark, docs, empty):
    assert fingerprints.edited_fingerprints(docs).count() == len(odd()) and fingerprints.edited_fingerprints(empty).count() == 0
    for kind, ids in (("string", ["doc-a", "doc-b", "doc-", "doc-ä", "doc-b1", None, "doc-a"]), ("double", [1.5, -2.0, 1e300, float("inf"), 1.25, None, 1.5]), ("date", ["2024-01-02", "1960-01-01", "2024-01-03", "1999-12-31", "2000-01-01", None, "2024-01-02"])):
        rows = [(i, chr(97 + k) * 9) for k, i in enumerate(ids)]
        df = spark.createDataFrame([(str(i) if i is not None else None, t) for i, t in rows], "doc_id string, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
        got = sorted((str(r.doc_id), r.edited_sha256) for r in fingerprints.edited_fingerprints(df.repartition(3)).collect())
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0].encode() if isinstance(r[0], str) else r[0] or 0, r[1]), reverse=True)
        assert got == sorted((str(i), hashlib.sha256((t[:6] + order[(k + 1) % len(order)][1][:3]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    alone = fingerprints.edited_fingerprints(frame(spark, [(1, "abcdef")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    groups = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert groups[6].group_id == groups[7].group_id == 6 and groups[6].copies == 3


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(14)
    item = prose(rng, words=30)
    # In one line each, so that line dedup leaves the near copy whole.
    rows = [(i, prose(rng, lang, 60).replace("\n", " "), lang) for i, lang in enumerate(list(SYLLABLES) * 15)]
    rows += [(200, f"{prose(rng, words=30)} {item}", "en"), (201, "123 456", "en"), (202, None, "en"), (203, rows[0][1], "en"), (204, near_copies(rng, rows[4][1], 1, 1)[0], "en")]
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame(rows, schema).selectExpr("*", "'s' as source", "cast(char_length(text) as long) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert not kept & {200, 201, 202, 203} and kept >= set(range(60)) - {0, 4} and len(kept & {4, 204}) == 1
    # Null and repeated doc_ids: whole copies go, different texts stay.
    some = [(None, rows[1][1]), (None, rows[2][1]), (None, rows[1][1]), (7, rows[5][1]), (7, rows[6][1]), (7, rows[6][1]), (9, rows[5][1]), (11, ""), (12, None)]
    some = spark.createDataFrame([(i, t, "x", "y") for i, t in some], "doc_id long, text string, _key string, key string")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, some, str(tmp_path)).collect()), key=repr)
    assert left == sorted([(None, rows[1][1]), (None, rows[2][1]), (7, rows[5][1]), (7, rows[6][1]), (11, ""), (12, None)], key=repr)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
