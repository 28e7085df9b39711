"""Quality statistics, trees, and license notices."""

from __future__ import annotations

import re

import numpy as np
import pytest

from regionwatch.llm import licenses, quality, queries

# --- quality ------------------------------------------------------------------


def plain_base(text):
    """The base counts, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 3_000 else None
    if inside is None:
        seen = {}
        for i, w in enumerate(windows):
            seen.setdefault(w, []).append(i)
        inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


TEXTS = [None, "", "a", "a b c d e", "a b c d e a b c d e", "x\nx\n\n \nx", "é#*| <ü>\x0b\x0c\r\x1f y", "a a a a a a a", "one two three four five six seven eight nine ten eleven"]


def test_counts_equal_plain_ones(spark, small):
    for t in TEXTS:
        assert quality.statistics(t)[0] == plain_base(t), t
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op6_quality(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain_base(docs[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs.where("doc_id % 2 = 0"), labels)
    rows = quality.judge(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 2] + 0.3 * rng.random(600) < 0.6) ^ (rng.random(600) < 0.05)).astype(float)
    trees = quality.boost(x, y)
    for k, sign in enumerate(quality.STATISTICS.values()):
        if sign < 0:
            grid = np.repeat(x[:50], 21, axis=0)
            grid[:, k] = np.tile(np.linspace(-0.5, 1.5, 21), 50)
            assert (np.diff(trees.scores(grid).reshape(50, 21), axis=1) <= 1e-9).all()
    assert np.mean((trees.scores(x) > 0) == (y == 1)) > 0.9


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x, y = rng.random((300, len(quality.STATISTICS))), (rng.random(300) < 0.5).astype(float)
    t = quality.boost(x, y)
    for row, score in zip(x[:40], t.scores(x[:40])):
        total = t.start
        for at in t.roots:
            while t.low[at] != at:
                at = t.low[at] if row[t.feature[at]] <= t.cut[at] else t.high[at]
            total += t.value[at]
        assert total == pytest.approx(score)


def test_odd_documents_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (7, None, 0), (999, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(odd, labels) is None  # one class only
    assert quality.train(none, labels) is None and quality.train(odd, labels.limit(0)) is None
    judged = quality.judge(odd, None).collect()
    assert len(judged) == odd.count() and all(r["kept"] != r["base_failed"] for r in judged)
    kept = quality.keep_good(odd, None)
    assert kept.schema == odd.schema and kept.count() == sum(r["kept"] for r in judged)
    assert quality.judge(none, None).isEmpty() and quality.keep_good(none, None).isEmpty()


# --- licenses -----------------------------------------------------------------


def plain_scan(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        places = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += places
        labels |= {label} if places else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


ODD_TEXTS = [
    None, "", "MIT License", "mit-license mit\nlicense", "MIT LicenseMIT License mit license", "éMIT License", "submit license", "mit licenses",
    "apache license general public license apache license", "MİT license", "\x7fmit\x00license", "mit license " * 3_000,
]


def test_base_places_equal_plain_ones(spark, small):
    frame = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    for df, texts in ((licenses.scan(frame), dict(enumerate(ODD_TEXTS))), (queries.op1_licenses(spark, small), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()})):
        rows = df.collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(texts[r["doc_id"]])
            assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
            assert 0 <= r["score"] <= 1


@pytest.mark.parametrize(("text", "label", "edits"), [
    ("released undr the MIT licence", "mit", 2), ("Licensed under the Apache Licence", "apache", 1), ("GNU Lesser General Public Licens", "lgpl", 1),
    ("mozila public license", "mpl", 1), ("Permission is hereby granted, free of charge, to any persn obtaning a copy", "mit", 2),
])
def test_edits_are_found(text, label, edits):
    words = text.encode().translate(licenses.CANONICAL).split()
    found = licenses.search(b" pad " + b" ".join(words) + b" end ")
    best = min((f for f in found if f.label == label), key=lambda f: f.edits)
    assert best.edits == edits and best.first_word == 1


def test_other_texts_have_no_notice():
    for text in ("the license of the committee", "released under the mpl license of old", "creative uncommon attributes", "general republic licence"):
        assert not [f for f in licenses.search(b" " + text.encode() + b" ") if f.label in ("mit", "apache", "cc")]


def test_pieces_lose_no_place():
    """Every place that bounded-error matching finds in the whole text lies in a window."""
    import random

    rng = random.Random(6)
    n = next(x for x in licenses.ALL_NOTICES if x.phrase == b"licensed under the apache license")
    for _ in range(300):
        t = bytearray(n.phrase)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice((b"", b"x", b"q", b" "))
        text = b" aa " + b" ".join(bytes(t).split()) + b" zz "
        whole = n.pattern.search(text)
        whole = whole and n.key in text[whole.start() - 1 : whole.end() + 1]
        assert bool(whole) == bool(licenses.search(text, (n,)))


@pytest.mark.parametrize(("text", "label", "starts"), [
    ("creative commons atributon creative common attribution", "cc", [0]),
    ("gnu lesser genral publc licence or gnu leser general public license", "lgpl", [0]),
    ("licensed under teh apache licence licensed under the apache license", "apache", [0, 5]),
    ("licensed under the apache license and licensed under teh apache licence or licensd under the apache license", "apache", [0, 6, 12]),
])
def test_notices_side_by_side(text, label, starts):
    found = [f for f in licenses.search(b" " + text.encode() + b" ") if f.label == label and not f.base]
    assert sorted({f.first_word for f in found}) == starts


def test_notices_side_by_side_equal_brute_force():
    """Each copy stands among others; one that is found alone is found there, too, or a place that overlaps it is."""
    import random

    rng = random.Random(7)
    for n in (x for x in licenses.ALL_NOTICES if not x.base):
        for _ in range(25):
            copies = []
            for _ in range(4):
                t = bytearray(n.phrase)
                for _ in range(rng.randint(0, n.edits + 1)):
                    k = rng.randrange(len(t))
                    t[k : k + 1] = rng.choice((b"", b"x"))
                copies.append(bytes(t).split())
            found = licenses.search(b" " + b" ".join(w for c in copies for w in c) + b" ", (n,))
            at = 0
            for c in copies:
                if licenses.search(b" " + b" ".join(c) + b" ", (n,)):
                    assert any(f.first_word < at + len(c) and at < f.first_word + f.n_words for f in found)
                at += len(c)


def test_odd_documents_licenses(odd, none):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and {r["base_labels"] for r in rows if r["doc_id"] == 12} == {"mit"}
    assert licenses.scan(none).isEmpty()
