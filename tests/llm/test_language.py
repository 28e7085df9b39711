"""Language identification against sums over listed segmentations, and accuracy on held-out documents."""

import math
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from regionwatch.llm import language

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOY = [b" a", b"ab", b"abc", b"bc", b" abca"] + [bytes([b]) for b in range(256)]


def segmentations(word, pieces):
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
            if all(p in pieces for p in parts):
                yield [pieces[p] for p in parts]


def test_forward_sums_all_segmentations():
    order = sorted(TOY)
    pieces, place = language.Pieces.of(order), {p: i for i, p in enumerate(order)}
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(len(order)), 3)).T
    words = [b" abcabc", b" a", b" x", b" cabab", "é".encode()]
    want = [[math.log(sum(math.exp(sum(logs[i, k] for i in s)) for s in segmentations(w, place))) for k in range(3)] for w in words]
    assert np.allclose(language.Lattice(words, pieces).scores(logs), want)


def test_expected_counts_are_those_of_listed_segmentations():
    order = sorted(TOY)
    pieces, place = language.Pieces.of(order), {p: i for i, p in enumerate(order)}
    logs = np.log(np.random.default_rng(2).dirichlet(np.ones(len(order))))
    words, counts = [b" abcab", b" bc"], np.array([3, 5])
    want = np.zeros(len(order))
    for w, n in zip(words, counts):
        found = [(s, math.exp(logs[s].sum())) for s in segmentations(w, place)]
        for s, weight in found:
            np.add.at(want, s, n * weight / sum(x for _, x in found))
    lattice = language.Lattice(words, pieces)
    got = np.zeros(len(order))
    np.add.at(got, lattice.piece, lattice.expected(logs, counts) / language.UNIT)
    assert np.allclose(got, want, atol=1e-4)


def test_every_lower_cased_word_has_a_segmentation():
    pieces = language.pieces_of(PATH)
    words = [w for t in ("Straße 日本語 naïve", "x" * 300, "ΣΑΣ ΌΣ") for c in language.chunks_of(t) for w in language.words_of(c)]
    assert max(map(len, words)) <= 1 + 4 * language.LONGEST and np.isfinite(language.Lattice(words, pieces).scores(np.full((pieces.n, 1), -3.0))).all()


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs, PATH)
    return docs, model, language.predict(docs, model)


def test_held_out_documents_are_told_apart(judged):
    docs, _, found = judged
    rows = docs.join(found, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    told = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and r["lang"]]
    assert len(told) > 200 and sum(r["lang"] == r["lang_pred"] for r in told) / len(told) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_model_and_predictions_do_not_depend_on_partitions_or_other_columns(spark, judged):
    docs, model, found = judged
    again = language.learn(docs.repartition(7), PATH)
    assert again.langs == model.langs and (again.logs == model.logs).all()
    bare = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit(0).alias("source")).repartition(5)
    assert sorted(map(tuple, language.predict(bare, model).collect())) == sorted(map(tuple, found.collect()))


def test_held_out_languages_are_not_learned(spark):
    fold = {r: next(i for i in range(50) if zlib.crc32(str(i).encode()) % 3 == r) for r in (0, 1)}
    docs = spark.createDataFrame([(fold[0], "eins zwei drei", "de"), (fold[1], "uno dos tres", "es"), (None, "one two", "en"), (-1, "x", None)], "doc_id long, text string, lang string")
    assert language.learn(docs, PATH).langs == ["de", "en"]


def test_odd_rows(spark, odd, none):
    model = language.learn(odd, PATH)
    assert model.langs == ["en"]
    got = language.predict(odd, model).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] is not None}
    assert by[4] == by[5] == by[6] == ("und", 0.0) and by[7] == ("en", 1.0) and by[11] == ("en", 1.0)
    assert language.predict(none, model).count() == 0
    nothing = language.learn(none, PATH)
    assert nothing.langs == [] and {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


def test_texts_without_letters_are_undetermined(spark):
    rows = [(1, "12 345 !?"), (2, "½ ² — …"), (3, "x"), (4, "12 é"), *((i, "y") for i in range(100, 110))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.learn(docs, PATH)).collect() if r["doc_id"] < 100}
    assert got == {1: "und", 2: "und", 3: "en", 4: "en"}
