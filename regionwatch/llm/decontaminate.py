"""Benchmark decontamination: BM25 over an inverted index of test items, queried with every training passage.

A document is cut into overlapping passages, twice as long as the longest item and half overlapping, so that every
stretch as long as an item lies whole in one. A passage is a query of its distinct words. Items stand in blocks of
similar best scores; for each word the index keeps its highest impact in every block. The commonest words are left
out of the search as long as all of them together give a block at most the share COMMON of the score it needs; the
maxima of the other words are summed for many passages at once, and only in blocks whose bound reaches the least
score that an entry there needs are entries scored (block-max WAND: nothing that reaches its threshold is lost).
An item's entry needs the share CANDIDATE of the score that its own text would get. Where half of the shingles of the
question, of the answer (the last sentence) or of the whole text may score less than that, this part is an entry of its
own, which needs a lower bound of what any half of its shingles scores; so no passage is dropped that the check would
accept. Candidates are verified: shares of the five-word shingles of the item's question, answer and whole text that
stand in the passage, one of which must be OVERLAP. A part of fewer than SHINGLE words proves nothing alone; such a
question counts only where the item's entry has its score, such an answer never. The kind of a leak is full (question and
answer, or a question without an answer), question, answer, or text (neither, but the whole).

The index holds shards of bounded size, each broadcast for a pass over the documents: a stated query set in blocks.
Word statistics are over all items.

Defined results: null or empty texts and items without words have no leaks; repeated rows are reported each; a null
doc_id or item_id is carried along; an empty table gives no leaks; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

CANDIDATE = 0.4
OVERLAP = 0.5
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK_ITEMS = 2
COMMON = 0.3
#: Shares of the positions that cost less than each price tried in the lower bound.
PRICES = np.linspace(0, 1, 33)
#: Sums of passages and blocks that are held at a time.
SUMS_AT_A_TIME = 1 << 21
#: Words of the items in one shard; the broadcast index is some 100 bytes for each.
SHARD_WORDS = 200_000

#: ASCII but digits and letters becomes a blank; other characters belong to words.
BLANKS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(BLANKS).split() if text else []


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence; an item of one sentence is a question without an answer."""
    parts = [w for s in SENTENCE_END.split(text) if (w := words_of(s))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(ids: np.ndarray) -> set[bytes]:
    """Runs of SHINGLE words, as bytes; of the whole sequence if it is shorter."""
    ids = np.ascontiguousarray(ids, np.int32)
    n = min(SHINGLE, len(ids))
    raw = ids.tobytes()
    return {raw[4 * k : 4 * (k + n)] for k in range(len(ids) - n + 1)} if n else set()


def least_score(ids: np.ndarray, impacts: dict[int, float]) -> float:
    """At most what the words of any OVERLAP of the sequence's shingles score together.

    A word's impact is shared out over its places, so places that chosen shingles cover cost no more than their words.
    The cheapest choice of a number of shingles is bounded from below by giving each one a price back (Lagrange).
    """
    places, times = np.unique(ids, return_inverse=True, return_counts=True)[1:]
    weight = np.array([impacts[t] for t in ids.tolist()]) / times[places]
    price = np.quantile(weight, PRICES)
    total = np.concatenate(([0.0], np.cumsum(weight)))
    before = np.zeros(len(price))  # the cheapest choice that ends apart from this shingle
    least = np.full(len(price), np.inf)
    ends: deque[np.ndarray] = deque(maxlen=SHINGLE)  # the cheapest choices that end with each of the last shingles
    for k in range(len(ids) - SHINGLE + 1):
        if len(ends) == SHINGLE:
            before = np.minimum(before, ends[0])
        cost = before + (total[k + SHINGLE] - total[k])
        for gap in range(1, min(SHINGLE, len(ends) + 1)):
            cost = np.minimum(cost, ends[-gap] + (total[k + SHINGLE] - total[k + SHINGLE - gap]))
        ends.append(cost - price)
        least = np.minimum(least, ends[-1])
    return float((least + price * math.ceil(OVERLAP * len(shingles(ids)))).max())


class Item(NamedTuple):
    item_id: int | None
    impacts: dict[int, float]  # of its words
    best: float
    question: set[bytes]
    answer: set[bytes]
    text: set[bytes]
    question_words: int  # of a shingle
    answer_words: int
    text_words: int


class Entry(NamedTuple):
    n: int  # of its item
    impacts: dict[int, float]
    need: float
    part: bool = False  # proved by shingles alone


class Index:
    """Items of one shard. Built from (item_id, text) and, for their words, the number of all items that hold each."""

    def __init__(self, rows: list[tuple[int | None, str]], df: dict[bytes, int], n_items: int, mean_words: float) -> None:
        cut = [(i, *question_and_answer(t)) for i, t in rows]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, q, a in cut for w in (*q, *a)}))}
        ids = lambda ws: np.array([self.vocab[w] for w in ws], np.int32)
        items, parts = [], []
        for i, q, a in cut:
            tf = Counter(self.vocab[w] for w in (*q, *a))
            if not tf:
                continue
            terms = np.array(sorted(tf), np.int32)
            freq = np.array([tf[t] for t in terms.tolist()], np.float64)
            seen = np.array([df[w] for w in sorted({*q, *a})], np.float64)
            idf = np.log1p((n_items - seen + 0.5) / (seen + 0.5))
            norm = K1 * (1 - B + B * (len(q) + len(a)) / mean_words)
            impacts = idf * freq * (K1 + 1) / (freq + norm)
            items.append(Item(i, dict(zip(terms.tolist(), impacts.tolist())), float(impacts.sum()), *(shingles(ids(p)) for p in (q, a, q + a)), *(min(SHINGLE, len(p)) for p in (q, a, q + a))))
            parts.append([ids(p) for p in ((q, a, q + a) if a else (q,)) if len(p) >= SHINGLE])
        order = sorted(range(len(items)), key=lambda n: items[n].best)
        self.items = [items[n] for n in order]
        entries = []
        for n, (item, own) in enumerate(zip(self.items, (parts[n] for n in order))):
            entries.append(Entry(n, item.impacts, CANDIDATE * item.best * (1 - 1e-9)))
            for p in own:
                need = least_score(p, item.impacts) * (1 - 1e-9)
                if need < CANDIDATE * item.best:
                    entries.append(Entry(n, {t: item.impacts[t] for t in set(p.tolist())}, need, True))
        entries.sort(key=lambda e: e.need)
        self.blocks = [entries[k : k + BLOCK_ITEMS] for k in range(0, len(entries), BLOCK_ITEMS)]
        self.needed = np.array([block[0].need for block in self.blocks])
        self.stride = max((len(q) + len(a) for _, q, a in cut), default=1) or 1
        self._post()

    def _post(self) -> None:
        """Lists of (block, highest impact there) of the words, but for the commonest, whose bound lowers the need."""
        maxima: list[dict[int, float]] = [{} for _ in self.vocab]
        for k, block in enumerate(self.blocks):
            for entry in block:
                for t, impact in entry.impacts.items():
                    maxima[t][k] = max(maxima[t].get(k, 0.0), impact)
        left_out = np.zeros(len(self.blocks))
        for t in sorted(range(len(maxima)), key=lambda t: -len(maxima[t])):
            if all(left_out[k] + v <= COMMON * self.needed[k] for k, v in maxima[t].items()):
                for k, v in maxima[t].items():
                    left_out[k] += v
                maxima[t] = {}
        self.needed -= left_out
        self.listed = np.array([len(m) for m in maxima], np.int64)
        self.list_start = np.cumsum(self.listed) - self.listed
        self.list_block = np.array([k for m in maxima for k in m], np.int64)
        self.list_value = np.array([v for m in maxima for v in m.values()])

    def search(self, words: list[list[bytes]], parts: bool = False) -> Iterator[tuple[int, int | None, float, float, float | None, str]]:
        """(document, item, share of the best score, question overlap, answer overlap, kind) of all verified leaks.

        Of several passages the one with the question goes first, then the best share. Without parts only items that have
        the share CANDIDATE of their score.
        """
        if not self.items:
            return
        ids = [np.fromiter((self.vocab.get(w, -1) for w in ws), np.int64, len(ws)) for ws in words]
        sizes = np.array([max(1, -(-len(x) // self.stride)) for x in ids])
        first = np.cumsum(sizes) - sizes
        document = np.repeat(np.arange(len(ids)), sizes)  # of each half passage
        at = [np.flatnonzero(x >= 0) for x in ids]
        half = np.concatenate([f + a // self.stride for f, a in zip(first, at)])
        term = np.concatenate([x[a] for x, a in zip(ids, at)])
        listed = self.listed[term] > 0
        key = np.unique(half[listed] * len(self.vocab) + term[listed])
        half, term = key // len(self.vocab), key % len(self.vocab)
        found: dict[tuple[int, int], tuple] = {}
        last, window, terms = -1, ids[0], set()
        for passage, block in self._candidates(half, term, document):
            doc = int(document[passage])
            if passage != last:
                start = (passage - first[doc]) * self.stride
                last, window = passage, ids[doc][start : start + 2 * self.stride].astype(np.int32)
                terms = set(window.tolist())
            for entry in self.blocks[block]:
                if entry.part and not parts or sum(v for t, v in entry.impacts.items() if t in terms) < entry.need:
                    continue
                item = self.items[entry.n]
                score = sum(v for t, v in item.impacts.items() if t in terms)
                got = (self._proof if entry.part else self._verify)(item, window, score / item.best)
                place = (doc, entry.n)
                if got and (place not in found or (got[1] >= OVERLAP, got) > (found[place][1] >= OVERLAP, found[place])):
                    found[place] = got
        for (doc, n), (share, question, answer) in sorted(found.items()):
            by_answer = answer >= OVERLAP and self.items[n].answer_words == SHINGLE
            kind = ("full" if not 0 <= answer < OVERLAP else "question") if question >= OVERLAP else "answer" if by_answer else "text"
            yield doc, self.items[n].item_id, share, question, None if answer < 0 else answer, kind

    def _candidates(self, half: np.ndarray, term: np.ndarray, document: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, block) whose bound reaches what the block needs; passage p is the halves p and p + 1.

        half and term are distinct pairs in order. A word in both halves counts twice, so the sum stays a bound.
        """
        width = len(self.blocks)
        step = max(1, SUMS_AT_A_TIME // width)
        for a in range(0, len(document), step):
            n = min(step, len(document) - a)
            low, high = np.searchsorted(half, [a, a + n + 1])  # one half more, for the last passage
            size = self.listed[term[low:high]]
            entry = np.repeat(self.list_start[term[low:high]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat(half[low:high] - a, size) * width + self.list_block[entry]
            sums = np.bincount(cell, self.list_value[entry], (n + 1) * width).reshape(n + 1, width)
            together = sums[:-1].copy()
            same = np.flatnonzero(document[a + 1 : a + n + 1] == document[a : a + n][: len(document) - a - 1])
            together[same] += sums[1:][same]
            for p, k in np.argwhere(together >= self.needed):
                yield a + int(p), int(k)

    def _verify(self, item: Item, window: np.ndarray, share: float) -> tuple[float, float, float] | None:
        """The share and the overlaps, if they tell of a leak."""
        return self._proof(item, window, share, 1)

    def _proof(self, item: Item, window: np.ndarray, share: float, least_words: int = SHINGLE) -> tuple[float, float, float] | None:
        """The same for parts without the item's score: a question of fewer words proves nothing."""
        raw = window.tobytes()

        def overlap(wanted: set[bytes], size: int) -> float:
            there = {raw[4 * k : 4 * (k + size)] for k in range(len(window) - size + 1)}
            return len(wanted & there) / len(wanted)

        question = overlap(item.question, item.question_words)
        answer = overlap(item.answer, item.answer_words) if item.answer else -1.0
        proved = question >= OVERLAP and item.question_words >= least_words
        proved = proved or answer >= OVERLAP and item.answer_words == SHINGLE
        proved = proved or item.text_words == SHINGLE and overlap(item.text, SHINGLE) >= OVERLAP
        return (share, question, answer) if proved else None


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The shards of the index, one after the other; each reads at most about SHARD_WORDS words to the driver."""
    items = benchmark.selectExpr("CAST(item_id AS LONG) AS item_id", "text").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = [words_of(t) for t in b.column(0).to_pylist()]
            rows = [(w, k == 0, len(ws)) for ws in held for k, w in enumerate(sorted(set(ws)))]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else ((), (), ()), (pa.binary(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "first", "words"])

    # one row for each distinct word of an item; the first carries the item's length
    held = items.select("text").mapInArrow(run, "word binary, first boolean, words long")
    n_items, n_words = held.where("first").agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    if not n_items:
        return
    shards = -(-n_words // SHARD_WORDS)
    counted = held.groupBy("word").agg(F.count("*").alias("df"))
    for k in range(shards):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        own = mine.select("text").mapInArrow(run, "word binary, first boolean, words long").select("word").distinct()
        df = {bytes(r["word"]): r["df"] for r in counted.join(own, "word", "left_semi").toLocalIterator()}
        yield Index([(r["item_id"], r["text"]) for r in mine.collect()], df, n_items, n_words / n_items)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it leaks, with the overlaps that prove it."""
    spark = docs.sparkSession
    fields = "doc_id long, item_id long, score_share double, question_overlap double, answer_overlap double, kind string"
    out = spark.createDataFrame([], fields)
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ids = b.column(0).to_pylist()
                found = shared.value.search([words_of(t) for t in b.column(1).to_pylist()], parts=True)
                rows = [(ids[d], *leak) for d, *leak in found]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 6, kinds)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

        out = out.unionByName(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, fields))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item."""
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in shared.value.search([words_of(t) for t in b.column(at).to_pylist()], parts=True)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
