"""Source divergence against plain counting and against SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from regionwatch.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(docs, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        within = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in within.items() if n >= min_docs)
        count = {}
        for d in docs:
            if d[0] == lang:
                count.setdefault(d[1], Counter()).update(t for t in d[2] if t in set(kept))
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + divergence.SCALE * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(r, sum(abs(p[s][t] - p[r][t]) for t in kept)) for r in count if r != s]
            over = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", over)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def found(frame, **options):
    return sorted(map(tuple, divergence.audit(frame, **options).collect()))


@pytest.mark.parametrize("shape", [(1, 1, 1, 1), (4, 4, 8, 8), (32, 5, 64, 64), (8, 8, 16, 11)])
def test_joint_walk_of_two_trees(shape):
    high, _, wide, real = shape
    rng = np.random.default_rng(high)
    tiles = [np.where(rng.random((high, wide)) < 0.1, rng.integers(1, 1000, (high, wide)), -1) for _ in range(2)]
    for t in tiles:
        t[:, real:] = -1
    zeros = [rng.integers(1, 50, high) for _ in range(2)]
    full = [np.where(t < 0, z[:, None], t)[:, :real] for t, z in zip(tiles, zeros)]
    want = np.abs(full[0][:, None, :] - full[1][None, :, :]).sum(axis=2)
    assert (divergence.joint_distances(*tiles, *zeros, real) == want).all()
    same = divergence.joint_distances(tiles[0], tiles[0], zeros[0], zeros[0], real, True)
    assert (np.triu(same, 1) == np.triu(np.abs(full[0][:, None, :] - full[0][None, :, :]).sum(axis=2), 1)).all()


def test_table_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(base.sql(queries.ORACLES["op13_divergence"]).fetchall())
    assert sorted(map(tuple, queries.op13_divergence(spark, folder).collect())) == want and len(want) > 1000


@pytest.mark.parametrize("sources", [3, 80])
def test_small_corpora_against_counting(spark, sources):
    rng = np.random.default_rng(sources)
    terms = [f"{a}{b}" for a in "abcdefghÉé日" for b in "xyzXY"]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(terms, rng.integers(0, 12))) + rng.choice(["", ".", " 12-ax", "\nAX_by"])
        rows.append((text if i % 17 else None, rng.choice(["en", "de", None, ""]), f"s{rng.integers(sources)}" if i % 13 else None))
    rows += rows[:40]
    frame = spark.createDataFrame([(i, t, None if lang is None else str(lang), s) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    want = plain(rows, 4, 5)
    assert found(frame, min_docs=4, top=5) == want
    assert {w[5] for w in want if w[2] == "term"} <= {1, 2, 3, 4, 5}


def test_counts_beyond_a_long_product_stay_exact(spark):
    rows = [(7_000_000_000_000, 9_000_000_000_001, 7), (0, 0, 7), (0, 5, 0)]
    frame = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r["p"] for r in frame.collect()] == [1 + 10**9 * (7 * 10**12 + 5) // (9 * 10**12 + 1 + 35), 1 + 10**9 * 5 // 35, 1 + 10**9]


def test_odd_rows(spark, odd, none):
    assert found(none) == []
    got = found(odd, min_docs=1)
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert got == plain(rows, 1, divergence.TOP_TERMS)
    assert found(odd.withColumn("source", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), min_docs=99)[0][2:5] == ("pair", "1", 0)
