"""Language identification: unigrams over a fixed public vocabulary, summed over all segmentations.

A text is its runs of letters and their marks, lower-cased. A language gives each piece of the vocabulary a probability, and a word's is
the sum, over every way to cut it into pieces, of the product of theirs: the forward algorithm over the word's bytes.
Probabilities are learned by expectation maximisation over all words of all learned documents, the expected counts coming
from the forward and the backward sums; every single byte is a piece, so each word has a segmentation. A text's score for
a language is the sum over its words, the prediction the language with the highest, its score the share among all.

Expected counts and logarithms are whole millionths, so sums do not depend on how Spark deals the rows. The model holds a
number a language and a piece that can stand in a word.

Defined results: the language is ``und`` with score 0 for a null text, one without a letter, and where nothing was
learned; of equal languages the first in order is predicted; a run of over LONGEST letters is cut into words of so many;
a null doc_id is learned from and not held out; repeated rows count each; an empty table gives an empty one; other
columns are not looked at.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, slices

FOLDS, HELD_OUT = 3, 1
ROUNDS = 2  # of expectation maximisation, from equal probabilities
SMOOTH = 0.01  # added to a piece's expected count
UNIT = 1_000_000  # counts and logarithms are whole numbers of 1 / UNIT
LONGEST = 64
UNKNOWN = "und"
HELD = 300_000  # distinct words that a task counts before it lets them go
REMEMBERED = 400_000  # words whose scores a task keeps
AT_A_TIME = 20_000  # words whose segmentations are summed together
STRETCH = 500_000  # words that are held and added together

WORD = regex.compile(rf"[\p{{L}}\p{{M}}]{{1,{LONGEST}}}")
LETTER = regex.compile(r"\p{L}")
#: Lower-cases A-Z and makes every other ASCII character a blank.
CHUNKS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def chunks_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of whatever is not ASCII; every word lies in one."""
    return text.encode("utf-8", "surrogatepass").translate(CHUNKS).split() if text else []


def words_of(chunk: bytes) -> list[bytes]:
    """Lower-cased words of a chunk, a blank before each."""
    if chunk.isascii() and len(chunk) <= LONGEST:
        return [b" " + chunk]
    return [b" " + w.encode("utf-8", "surrogatepass") for w in WORD.findall(chunk.decode("utf-8", "surrogatepass").lower())]


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


# --- segmentations ------------------------------------------------------------


@dataclass
class Pieces:
    """A trie over pieces: child of a node by node * 256 + byte, and the piece that ends in a node, or -1."""

    n: int
    keys: np.ndarray
    children: np.ndarray
    piece: np.ndarray
    longest: int

    @staticmethod
    def of(pieces: list[bytes]) -> "Pieces":
        nodes: dict[bytes, int] = {b"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        edges = sorted((nodes[p[:-1]] * 256 + p[-1], k) for p, k in nodes.items() if p)
        ends = np.full(len(nodes), -1, np.int64)
        ends[[nodes[p] for p in pieces]] = np.arange(len(pieces))
        return Pieces(len(pieces), np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), ends, max(map(len, pieces)))


def pieces_of(path: str) -> Pieces:
    """Pieces of a vocabulary of ranks that may stand in a lower-cased word, and every byte; a word begins with a blank."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    letter = frozenset(range(97, 123)) | frozenset(range(128, 256))
    fits = {p for p in found if p and letter.issuperset(p[1:]) and (p[0] == 32 or p[0] in letter)}
    return Pieces.of(sorted(fits | {bytes([b]) for b in range(256)}))


class Lattice:
    """All segmentations of some words: edges between places of words, each a piece."""

    def __init__(self, words: list[bytes], pieces: Pieces) -> None:
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.cumsum(sizes) - sizes
        stop = (offset + sizes)[word]  # where each place's word ends
        at, node, found = np.arange(len(flat)), np.zeros(len(flat), np.int64), []
        for depth in range(pieces.longest):
            wanted = node * 256 + flat[at + depth]
            i = np.minimum(np.searchsorted(pieces.keys, wanted), len(pieces.keys) - 1)
            known = pieces.keys[i] == wanted
            at, node = at[known], pieces.children[i[known]]
            piece = pieces.piece[node]
            ends = piece >= 0
            found.append((at[ends], np.full(int(ends.sum()), depth + 1), piece[ends]))
            more = at + depth + 1 < stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        begin, length, self.piece = (np.concatenate(x) for x in zip(*found))
        self.word = word[begin]
        self.nodes = len(flat) + len(words)  # a word has a place more than bytes
        self.first = offset + np.arange(len(words))
        self.last = self.first + sizes
        self.source = begin + self.word
        self.target = self.source + length
        level = begin - offset[self.word]
        self.forth = self._steps(level + length, self.target)
        self.back = self._steps(level.max(initial=0) - level, self.source)

    def _steps(self, level: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges of one level after the other, by node, and where the next node begins."""
        order = np.argsort(level * self.nodes + node, kind="stable")
        cuts = np.flatnonzero(np.diff(level[order])) + 1
        return [(edges, np.concatenate([[0], np.flatnonzero(np.diff(node[edges])) + 1])) for edges in (np.split(order, cuts) if len(order) else [])]

    def _sums(self, start: np.ndarray, steps: list, here: np.ndarray, there: np.ndarray, logs: np.ndarray) -> np.ndarray:
        total = np.full((self.nodes, logs.shape[1]), -np.inf)
        total[start] = 0.0
        for edges, begins in steps:
            x = total[there[edges]] + logs[self.piece[edges]]
            most = np.maximum.reduceat(x, begins, axis=0)
            sizes = np.diff(np.append(begins, len(edges)))
            total[here[edges[begins]]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, sizes, axis=0)), begins, axis=0))
        return total

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations up to each place; logs has a row a piece, a column a language."""
        return self._sums(self.first, self.forth, self.target, self.source, logs)

    def scores(self, logs: np.ndarray) -> np.ndarray:
        return self.forward(logs)[self.last]

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected count of each edge's piece under one language, in units, as whole numbers."""
        forth = self.forward(logs[:, None])[:, 0]
        back = self._sums(self.last, self.back, self.source, self.target, logs[:, None])[:, 0]
        share = np.exp(forth[self.source] + logs[self.piece] + back[self.target] - forth[self.last][self.word])
        return np.rint(share * UNIT).astype(np.int64) * counts[self.word]


# --- learning -----------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all documents that are learned from; tasks count before anything is shuffled."""
    names = ["lang", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, chunks in langs.items():
                rows = [(lang, w, n) for chunk, n in chunks.items() for w in words_of(chunk)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64()))], names)
            langs.clear()

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if has_letter(text):
                    langs.setdefault(lang, Counter()).update(chunks_of(text))
            if sum(map(len, langs.values())) > HELD:
                yield from counted()
        yield from counted()

    learned = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return learned.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(words: DataFrame, langs: list[str], logs: np.ndarray, pieces: Pieces) -> DataFrame:
    """(lang, piece, amount): one round's expected counts, a row a task for each language and piece it met."""
    held = words.sparkSession.sparkContext.broadcast((langs, logs, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, pieces = held.value
        place = {lang: k for k, lang in enumerate(langs)}
        total: dict[int, np.ndarray] = {}
        for b in slices(batches, AT_A_TIME):
            lang = np.array([place[x] for x in b.column(0).to_pylist()])
            raw, n = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), np.int64)
            for k in np.unique(lang):
                mine = np.flatnonzero(lang == k)
                lattice = Lattice([raw[i] for i in mine], pieces)
                amounts = total.setdefault(int(k), np.zeros(pieces.n, np.int64))
                np.add.at(amounts, lattice.piece, lattice.expected(logs[:, k], n[mine]))
        for k, amounts in total.items():
            met = np.flatnonzero(amounts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), k, np.int32)), pa.array(met.astype(np.int32)), pa.array(amounts[met])], ["lang", "piece", "amount"])

    found = words.mapInArrow(run, "lang int, piece int, amount long")
    return found.groupBy("lang", "piece").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))


@dataclass
class Model:
    """Languages, and the logarithm of each piece's probability, a column a language."""

    langs: list[str]
    pieces: Pieces
    logs: np.ndarray


def learn(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> Model:
    """Learns from documents with a language outside the held-out fold."""
    pieces = pieces_of(vocabulary)
    words = materialise(word_counts(docs), "language-words")
    langs = sorted((r["lang"] for r in words.select("lang").distinct().collect()), key=str.encode)
    logs = np.full((pieces.n, len(langs)), -np.log(pieces.n))
    for _ in range(rounds if langs else 0):
        amounts = np.zeros(logs.shape)
        found = expected_counts(words, langs, logs, pieces).withColumn("amount", F.col("amount").cast("double")).toPandas()
        amounts[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["amount"].to_numpy() / UNIT
        amounts += SMOOTH
        logs = np.rint(np.log(amounts / amounts.sum(axis=0)) * UNIT) / UNIT
    return Model(langs, pieces, logs)


# --- prediction ---------------------------------------------------------------


class Scorer:
    """Scores of texts under all languages, remembering chunks."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, len(model.langs)), np.int64)

    def learn_chunks(self, new: list[bytes]) -> None:
        parts = [self.table]
        for at in range(0, len(new), AT_A_TIME):
            some = new[at : at + AT_A_TIME]
            words = [words_of(c) for c in some]
            sums = np.zeros((len(some), len(self.model.langs)), np.int64)
            if any(words):
                lattice = Lattice([w for ws in words for w in ws], self.model.pieces)
                owner = np.repeat(np.arange(len(some)), [len(ws) for ws in words])
                np.add.at(sums, owner, np.rint(lattice.scores(self.model.logs) * UNIT).astype(np.int64))
            parts.append(sums)
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
        self.table = np.concatenate(parts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """For each text the sum of its words' logarithms in units, a column a language."""
        totals = np.zeros((len(texts), len(self.model.langs)), np.int64)
        held: list[tuple[int, list[bytes]]] = []

        def flush() -> None:
            new = [c for c in dict.fromkeys(c for _, cs in held for c in cs) if c not in self.known]
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                self.table = self.table[:0]
                new = list(dict.fromkeys(c for _, cs in held for c in cs))
            self.learn_chunks(new)
            for i, chunks in held:
                for at in range(0, len(chunks), STRETCH):
                    some = chunks[at : at + STRETCH]
                    totals[i] += self.table[np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))].sum(axis=0)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            chunks = chunks_of(text)
            held.append((i, chunks))
            size += len(chunks)
            if size >= STRETCH:
                flush()
                size = 0
        flush()
        return totals

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        totals = self.scores(texts)
        best = totals.argmax(axis=1)
        shares = 1 / np.exp((totals - totals[np.arange(len(texts)), best][:, None]) / UNIT).sum(axis=1)
        return [(self.model.langs[k], float(s)) if has_letter(t) else (UNKNOWN, 0.0) for t, k, s in zip(texts, best, shares)]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in slices(batches):
            found = scorer.predict(b.column(2).to_pylist())
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
