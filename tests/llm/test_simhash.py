"""Fingerprints and components against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from odd_rows import COPY, LONG
from regionwatch.llm import queries, simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable over pairs that differ in at most 4 bits; prints: (id, fingerprint), ids not null."""
    label = {i: i for i, _ in prints}
    moved = True
    while moved:
        moved = False
        for i, f in prints:
            for j, g in prints:
                if (f ^ g).bit_count() <= 4 and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def test_query_equals_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op4_simhash(spark, small).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in docs.items()]
    want = plain_components(prints)
    assert len(got) == len(docs)
    for i, f in prints:
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == want[i]


def test_odd_documents(odd):
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(map(repr, (g[0] for g in got))) == sorted(repr(r["doc_id"]) for r in odd.collect())
    by = {}
    for i, f, c in got:
        by.setdefault(i, set()).add((f, c))
    assert by[1] == by[2] == {(plain_fingerprint(COPY), 1)}
    assert by[4] == by[5] == by[6] == {(0, 4)}
    assert by[7] == {(plain_fingerprint(LONG), 7)}
    assert by[None] == {(plain_fingerprint(COPY), 1), (0, 4)}


def test_empty_table(none):
    assert simhash.near_duplicates(none).isEmpty() and simhash.keep_one(none).isEmpty()


def test_one_of_each_stays_with_all_columns(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(4) == 1 and not {5, 6} & set(ids)
    assert ids.count(None) == 2


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("per_cell", [500_000, 40])
def test_links_find_every_pair_within_four_bits(spark, monkeypatch, per_cell):
    """Random prints, clusters around centres, and a chain; with many cells too."""
    monkeypatch.setattr(simhash, "FINGERPRINTS_PER_CELL", per_cell)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {rng.getrandbits(64) for _ in range(150)} | {near(rng, c, rng.randint(1, 5)) for c in centres for _ in range(12)}
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain = near(rng, chain, 4)
        prints.add(chain)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    roots = simhash.components(simhash.links(frame, len(prints)))
    got = {r["node"] % 2**64: r["root"] for r in roots.collect()}
    want = plain_components([(p, p) for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(want[p], []).append(p)
    for members in groups.values():
        if len(members) == 1:
            assert members[0] not in got
        else:
            assert len({got[m] for m in members}) == 1
    assert len({got[g[0]] for g in groups.values() if len(g) > 1}) == sum(len(g) > 1 for g in groups.values())


def test_cells_bound_their_slices(monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_AT_A_TIME", 50)
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fps[100:] = fps[:100] ^ np.uint64(0b1011)
    pairs = set()
    for cell in range(64):
        a, b = simhash.link_cell(cell, fps, 0)
        pairs |= {frozenset((int(x), int(y))) for x, y in zip(a, b)}
    assert pairs == {frozenset((int(x), int(y))) for x, y in zip(fps[:100], fps[100:])}


def test_components_of_long_paths_and_stars(spark):
    path = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(300).select(F.lit(10_000).alias("a"), (F.col("id") + 10_001).alias("b"))
    got = simhash.components(path.union(star)).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == [301, 401]
