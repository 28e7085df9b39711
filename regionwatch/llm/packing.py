"""Packs token ids into sequences of at most 2,048: overlong documents are first cut into full windows, then
best-fit decreasing places pieces, with a segment tree over remaining capacity that finds the tightest open window.

Pieces are dealt to groups by a number that each row got when it was written, so a group has its bounded share of
any mixture, whatever ids or texts repeat; groups are packed apart from each other. Sequence numbers hold the group
in their upper bits. Packing is a function of the stored pieces alone: a lost task gives the same again.

Defined results: a null or empty text is one piece, the end id alone; repeated rows and null ids are packed like any
others, one set of pieces a row; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, slices
from .tokens import encoded_pieces, text_pieces, vocabulary

WINDOW = 2048
END_ID = 1
#: Pieces that are packed together.
GROUP = 50_000
#: Distinct pieces of text whose ids a task remembers; the table starts anew beyond it.
REMEMBERED = 800_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Numbers(dict[bytes, int]):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: bytes) -> int:
        self[piece] = number = len(self)
        return number


class Encoder:
    """Token ids of texts, as the tokenizers library gives them; each distinct piece is encoded once and remembered.

    No pre-token spans two pieces, so the ids of a text are those of its pieces in a row. A full table takes some 200 MB,
    so it belongs to a task and goes with it: a worker that kept it would hold it through all later stages.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Adds the ids of the pieces that were numbered last."""
        odd = [i for i, w in enumerate(new) if b"<|" in w]  # may hold special tokens: the library encodes them
        plain = [w for w in new if b"<|" not in w] if odd else new
        ids, sizes = encoded_pieces(vocabulary(self.path), plain)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        if odd:
            got = [e.ids for e in tokenizer(self.path).encode_batch([new[i].decode("utf-8", "surrogatepass") for i in odd], add_special_tokens=False)]
            more = np.fromiter(map(len, got), np.int64, len(got))
            places = np.array(odd) - np.arange(len(odd))  # among the plain pieces
            starts = np.insert(starts, places, len(self.ids) + len(ids) + np.cumsum(more) - more)
            sizes = np.insert(sizes, places, more)
            ids = np.concatenate([ids, *(np.array(g, np.uint32) for g in got)])
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _numbers(self, words: list[list[bytes]]) -> list[np.ndarray]:
        """The number of each piece, text after text; one look into the table for each."""
        return [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in words]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        words = [text_pieces(t.encode("utf-8", "surrogatepass")) if t else [] for t in texts]
        numbers = self._numbers(words)
        if len(self.known) > REMEMBERED and len(self.sizes):
            self._forget()
            numbers = self._numbers(words)
        if len(self.known) > len(self.sizes):
            self._learn(list(islice(self.known, len(self.sizes), None)))
        for at in numbers:
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            shift = np.repeat(self.starts[at] - (ends - sizes), sizes)
            yield self.ids[shift + np.arange(len(shift))]


def encoder(path: str) -> Encoder:
    """A new one, for one task."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """One row a piece: full windows from the start of each document, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = encoder(path)
        for b in slices(batches):
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc, ids in zip(b.column(0).to_pylist(), task.encode(b.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), WINDOW):
                    part = ids[at : at + WINDOW]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, PIECES)


class Capacities:
    """Open windows by remaining capacity, in a segment tree that says which capacities have any."""

    def __init__(self, most: int) -> None:
        self.width = 1 << most.bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = self.width + room
        while node:
            self.tree[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room that is at least ``need``: (room, window)."""
        node = self.width + need
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.width
        self._count(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], most: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each length; the lengths come in descending order."""
    windows, offsets = [], []
    free = Capacities(most)
    used = 0
    for n in lengths:
        found = free.tightest(n)
        if found is None:
            found, used = (most, used), used + 1
        room, window = found
        windows.append(window)
        offsets.append(most - room)
        if room > n:
            free.add(room - n, window)
    return windows, offsets


def pack(docs: DataFrame, path: str) -> DataFrame:
    """The pieces with (sequence_id, offset)."""
    cut = materialise(pieces(docs, path).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = -(-cut.count() // GROUP) or 1

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_row"], ascending=[False, True], ignore_index=True)
        windows, offsets = best_fit(rows["length"].tolist())
        return rows.assign(sequence_id=np.array(windows, np.int64) + (int(key[0]) << 32), offset=np.array(offsets, np.int64)).drop(columns=["_row", "_group"])

    # row numbers of one task are consecutive, so the remainder deals its rows out evenly
    dealt = cut.withColumn("_group", F.pmod("_row", F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
