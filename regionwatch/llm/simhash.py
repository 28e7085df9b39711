"""Near-duplicates by SimHash fingerprints, linked by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 4 bits have a common neighbour within 2 bits of each. So every distinct
fingerprint stands for its 2,081 variants within radius 2, variants meet in a shuffle, and owners of one variant
are linked. All owners of a variant differ in at most 4 bits, so linking each to one of them loses nothing.

The shuffle is by a linear hash of the variant (64 syndromes of 6 bits, and some plain bits when there are many
fingerprints). Being linear, it tells from a fingerprint which cells its variants fall into and, in a cell, which
flips lead there; so a cell is sent the 8 bytes of the fingerprint and makes the variants itself. Cells get equally
many rows however alike the fingerprints are. A cell makes its variants in slices of bounded number and keeps a
spanning forest of what it has linked, at most one edge for each fingerprint it was sent.

Defined results: a null text is empty; a text without words has fingerprint zero, which links like any other; rows
with a null doc_id get a fingerprint and the component of their group (null if nobody there has an id); repeated
rows stay repeated; an empty table gives an empty one; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import join_unique, materialise, slices, words_of

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BITS = 64

#: Hashes whose bits are counted at a time, variants made at a time, and fingerprints in a shuffled block.
HASHES_AT_A_TIME = 1 << 16
VARIANTS_AT_A_TIME = 1 << 20
BLOCK = 1 << 15
#: Beyond so many distinct fingerprints a plain bit more tells cells apart, again for each doubling.
FINGERPRINTS_PER_CELL = 500_000


# --- fingerprints -------------------------------------------------------------


def shingle_hashes(words: list[bytes]) -> list[int]:
    """XXH64 of every run of SHINGLE_WORDS words; of the whole sequence if it is shorter; none without words."""
    if len(words) <= SHINGLE_WORDS:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    first = [0, *ends]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(first, ends[SHINGLE_WORDS - 1 :])]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One fingerprint a text, as uint64."""
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    spans: list[tuple[int, int, int]] = []

    def flush() -> None:
        if spans:
            hashes = np.array(held, np.uint64)
            at, starts, sizes = (np.array(x) for x in zip(*spans))
            out[at] = _pack(_bit_counts(hashes, starts), sizes)
            held.clear()
            spans.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(words_of(text))
        if len(hashes) > HASHES_AT_A_TIME:
            parts = (np.array(hashes[a : a + HASHES_AT_A_TIME], np.uint64) for a in range(0, len(hashes), HASHES_AT_A_TIME))
            counts = sum(_bit_counts(p, np.array([0])).astype(np.int64) for p in parts)
            out[i] = _pack(counts, np.array([len(hashes)]))[0]
        elif hashes:
            if len(held) + len(hashes) > HASHES_AT_A_TIME:
                flush()
            spans.append((i, len(held), len(hashes)))
            held += hashes
    flush()
    return out


def _pack(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    over = counts * 2 > sizes[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# --- ball hashing -------------------------------------------------------------


def _patterns(plain: int) -> tuple[np.ndarray, np.ndarray]:
    """All flips of at most RADIUS / 2 = 2 bits, and the cell each leads to from cell 0."""
    one = [1 << i for i in range(BITS)]
    flips = [0, *one, *(one[i] | one[j] for i in range(BITS) for j in range(i))]
    flips = np.array(flips, np.uint64)
    return flips, cell_of(flips, plain)


def cell_of(values: np.ndarray, plain: int) -> np.ndarray:
    """Linear: the xor of the numbers of the set bits (6 bits), beside the lowest ``plain`` bits themselves."""
    syndrome = np.zeros(values.shape, np.uint64)
    for k in range(6):
        mask = np.uint64(sum(1 << i for i in range(BITS) if i >> k & 1))
        syndrome |= (np.bitwise_count(values & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return (syndrome << np.uint64(plain) | values & np.uint64((1 << plain) - 1)).astype(np.int64)


def to_cells(fps: np.ndarray, plain: int) -> Iterator[tuple[int, bytes]]:
    """(cell, fingerprints that have variants in it)."""
    _, leads = _patterns(plain)
    own = cell_of(fps, plain)
    order = np.argsort(own, kind="stable")
    cells, starts = np.unique(own[order], return_index=True)
    for cell, part in zip(cells, np.split(fps[order], starts[1:])):
        raw = part.tobytes()
        for target in np.unique(leads ^ cell):
            yield int(target), raw


def link_cell(cell: int, fps: np.ndarray, plain: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the fingerprints that share a variant in this cell: (fingerprint, root)."""
    fps = np.unique(fps)
    flips, leads = _patterns(plain)
    needs = cell_of(fps, plain) ^ cell
    order = np.argsort(leads, kind="stable")
    low, high = np.searchsorted(leads[order], needs), np.searchsorted(leads[order], needs, "right")
    most = int((high - low).max(initial=0))
    parts = max(1, -(-int((high - low).sum()) // VARIANTS_AT_A_TIME))
    root = np.arange(len(fps))
    for part in range(parts):
        made, owners = [], []
        for k in range(most):
            who = np.flatnonzero(low + k < high)
            variant = fps[who] ^ flips[order[low[who] + k]]
            if parts > 1:
                mine = (variant * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts) == part
                who, variant = who[mine], variant[mine]
            made.append(variant)
            owners.append(who.astype(np.int32))
        if made:
            a, b = _stars(np.concatenate(made), np.concatenate(owners))
            near = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
            root = _merge(root, a[near], b[near])
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def _stars(variants: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner of a variant with one of the same variant's."""
    order = np.argsort(variants, kind="stable")
    variants, owners = variants[order], owners[order]
    same = variants[1:] == variants[:-1]
    return owners[1:][same], owners[:-1][same]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after more edges; every root is the smallest index of its component."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        root = root.copy()
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def links(fps: DataFrame, n: int) -> DataFrame:
    """Distinct edges (a, b) that connect exactly the fingerprints which differ in at most RADIUS bits.

    ``fps`` has one column, fp, of n distinct values.
    """
    plain = (max(0, n - 1) // FINGERPRINTS_PER_CELL).bit_length()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            for cell, raw in to_cells(np.concatenate(held), plain):
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([raw], pa.binary())], ["cell", "block"])

        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= BLOCK:
                yield from blocks()
                held.clear()
        if held:
            yield from blocks()

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = link_cell(int(key[0]), np.frombuffer(b"".join(rows["block"]), np.uint64), plain)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = fps.select("fp").mapInArrow(send, "cell long, block binary")
    return sent.groupBy("cell").applyInPandas(link, "a long, b long").distinct()


# --- components ---------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), by random contraction.

    Each round every node moves to that neighbour, or itself, with the smallest hash of the round; edges between
    what is left go to the next round. The expected number of rounds is logarithmic in the largest component.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    left = materialise(both.where("a != b").distinct(), "edges")
    labels: DataFrame | None = None
    for turn in range(10_000):
        total = left.count()
        if not total:
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
        moved = left.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count("*").alias("n"))
        step = materialise(moved.select("a", F.least(rank("a"), F.col("m"))["to"].alias("to"), "n"), "moves")
        once = join_unique(left, step, "a", "n", total).select("to", F.col("b").alias("a"))
        twice = join_unique(materialise(once, "half"), step.withColumnRenamed("to", "to2"), "a", "n", total)
        left = materialise(twice.where("to != to2").select(F.col("to").alias("a"), F.col("to2").alias("b")).distinct(), "edges")
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            labels = materialise(_follow(labels, step), "labels")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    sizes = labels.groupBy("root").agg(F.count("*").alias("w"))
    moves = materialise(sizes.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("root", F.coalesce("to", "root").alias("to"), "w"), "follow")
    total = moves.agg(F.sum("w")).first()[0] or 0
    return join_unique(labels, moves, "root", "w", total).select("node", F.col("to").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id linked to it, directly or not."""
    prints = materialise(with_fingerprints(docs), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    n, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(distinct, n)).withColumnRenamed("node", "fp")
    rooted = materialise(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "rooted")
    groups = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("w")), "groups")
    named = join_unique(rooted, groups, "root", "w", n)
    named = materialise(named.select("fp", "component_id", "n"), "named")
    return join_unique(prints, named, "fp", "n", total).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of every component, the document with its smallest doc_id; repeated rows of that document become one.

    Documents without a doc_id cannot be named and stay.
    """
    named = near_duplicates(docs.where("doc_id IS NOT NULL"))
    kept = named.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    found = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    # dropDuplicates partially aggregates, so a doc_id with many repeated rows is one row a task
    return found.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))
