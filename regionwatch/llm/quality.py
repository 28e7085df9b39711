"""Document quality: gradient-boosted trees over text statistics, beside a fixed base rule.

Trees are grown on histograms of a bounded sample of labelled documents (TRAIN_ROWS, the rows with the smallest hash
of their id), kept as flat numpy arrays of nodes and applied to whole batches at once. Statistics whose rise can only
speak against a document are constrained: raising one never raises the score.

A document is rejected if the base rule fails or its score is below a threshold, set on a held-out part of the sample
so that at most CLEAN_LOSS of the good documents go.

Defined results: a null text has no words and fails the base rule; repeated rows and null ids are judged like any
others; an empty table gives an empty result; without usable labels (both classes) only the base rule decides; a
label row with a null, or whose document is missing, is not used; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

TRAIN_ROWS = 4_000
HELD_OUT = 4  # every 4th row of the sample
CLEAN_LOSS = 0.002
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2
LEAST_ROWS, RIDGE = 10, 1.0

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Statistics and their constraint: -1 never raises the score, 0 is free.
STATISTICS = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "top_word_share": -1,
    "distinct_share": 0,
    "upper_share": -1,
    "digit_share": -1,
    "exclaim_per_word": -1,
    "bar_per_word": -1,
    "letter_share": 0,
}

DELETE_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
CONTINUATION = bytes(range(0x80, 0xC0))
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
NOT_LETTER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))


# --- statistics ---------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == n:
        return 0
    times: dict[tuple, int] = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered, upto = 0, 0
    for at, w in enumerate(windows):
        if times[w] > 1:
            covered += at + WINDOW - max(at, upto)
            upto = at + WINDOW
    return covered


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The counts of BASE, and STATISTICS in order."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, CONTINUATION))
    symbols = len(raw.translate(None, DELETE_SYMBOLS))
    seen: set[bytes] = set()
    lines = dup_lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    letters = len(joined.translate(None, NOT_LETTER).translate(None, CONTINUATION))
    upper = len(joined.translate(None, NOT_UPPER))
    per = max(n, 1)
    values = [
        float(np.log1p(n)),
        chars / per,
        symbols / per,
        dup_lines / max(lines, 1),
        repeats / per,
        max(count.values(), default=0) / (per + 20),
        len(count) / per,
        upper / max(letters, 1),
        len(joined.translate(None, NOT_DIGIT)) / max(chars, 1),
        joined.count(b"!") / per,
        joined.count(b"|") / per,
        letters / max(chars, 1),
    ]
    return (n, chars, symbols, dup_lines, repeats), values


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


# --- boosted trees ------------------------------------------------------------


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    threshold: float = field(default=-np.inf)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of being good."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.low[at], self.high[at])
        return self.start + self.value[at].sum(axis=1)


class _Grower:
    """Grows trees on binned statistics by second-order gain."""

    def __init__(self, x: np.ndarray, y: np.ndarray, signs: list[int]) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], axis=1)
        self.y, self.signs = y, signs
        self.nodes: list[list] = []

    def tree(self, score: np.ndarray) -> tuple[int, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        self.g, self.h = self.y - p, p * (1 - p)
        self.step = np.zeros(len(score))
        return self._node(np.arange(len(score)), DEPTH, -np.inf, np.inf), self.step

    def _weight(self, g, h, least: float, most: float):
        return np.clip(g / (h + RIDGE), least, most)

    def _node(self, rows: np.ndarray, depth: int, least: float, most: float) -> int:
        """Values of the subtree stay between least and most, so constrained splits hold below too."""
        g, h = self.g[rows], self.h[rows]
        mine = float(self._weight(g.sum(), h.sum(), least, most))
        me = len(self.nodes)
        self.nodes.append([0, 0.0, me, me, RATE * mine])
        found = self._split(rows, g, h, mine, least, most) if depth and len(rows) >= 2 * LEAST_ROWS else None
        if found is None:
            self.step[rows] = RATE * mine
            return me
        k, b, a, c = found
        middle = (a + c) / 2
        low, high = self.signs[k] < 0, self.signs[k] > 0
        left = self.bins[rows, k] <= b
        lower = self._node(rows[left], depth - 1, middle if low else least, middle if high else most)
        upper = self._node(rows[~left], depth - 1, middle if high else least, middle if low else most)
        self.nodes[me] = [k, float(self.cuts[k][b]), lower, upper, 0.0]
        return me

    def _split(self, rows, g, h, mine, least, most):
        gain_of = lambda gs, hs, w: gs * w - 0.5 * (hs + RIDGE) * w * w
        best, found = gain_of(g.sum(), h.sum(), mine) + 1e-6, None
        for k, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            size = len(cuts) + 1
            at = self.bins[rows, k]
            gs, hs, ns = (np.cumsum(np.bincount(at, w, size))[:-1] for w in (g, h, None))
            wl, wr = self._weight(gs, hs, least, most), self._weight(g.sum() - gs, h.sum() - hs, least, most)
            gain = gain_of(gs, hs, wl) + gain_of(g.sum() - gs, h.sum() - hs, wr)
            bad = (ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS) | (self.signs[k] * (wr - wl) < 0)
            gain = np.where(bad, -np.inf, gain)
            b = int(gain.argmax())
            if gain[b] > best:
                best, found = gain[b], (k, b, float(wl[b]), float(wr[b]))
        return found


def boost(x: np.ndarray, y: np.ndarray, signs: list[int] | None = None) -> Trees:
    """Fits TREES trees to labels 0 and 1, of which both occur."""
    grower = _Grower(x, y, signs or list(STATISTICS.values()))
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    roots = []
    for _ in range(TREES):
        root, step = grower.tree(score)
        roots.append(root)
        score += step
    feature, cut, low, high, value = (np.array(c) for c in zip(*grower.nodes))
    return Trees(feature, cut, low, high, value, np.array(roots), start)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Fits the trees to at most ``rows`` labelled documents; None if they do not hold both classes."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_good")).where("_id IS NOT NULL AND _good IN (0, 1)")
    usable = usable.groupBy("_id").agg(F.min("_good").alias("_good"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # a top-k: each task sends at most ``rows`` pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = [statistics(t)[1] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stats, pa.list_(pa.float64()))], ["_id", "_good", "x"])

    joined = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), "_id").select("_id", "_good", "text")
    # a row each: repeated rows of a document count once; at most ``rows`` short rows reach the driver
    stated = joined.mapInArrow(run, "_id long, _good int, x array<double>").groupBy("_id").agg(F.min("_good").alias("y"), F.min("x").alias("x"))
    got = sorted(stated.collect(), key=lambda r: r["_id"])
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    held = np.arange(len(got)) % HELD_OUT == 0
    if len({*y[~held]}) < 2 or not (good := held & (y == 1)).any():
        return None
    trees = boost(x[~held], y[~held])
    trees.threshold = min(float(np.quantile(trees.scores(x[good]), CLEAN_LOSS)) - 1e-9, 0.0)
    return trees


# --- judging ------------------------------------------------------------------


def judge(docs: DataFrame, model: Trees | None) -> DataFrame:
    """(doc_id, counts of BASE, score, base_failed, kept) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = [statistics(t) for t in b.column(1).to_pylist()]
            counts = np.array([c for c, _ in stats], np.int64)
            score = model.scores(np.array([x for _, x in stats])) if model else np.zeros(len(stats))
            failed = np.array([base_fails(c[0], c[4]) for c in counts])
            kept = ~failed & (score >= (model.threshold if model else -np.inf))
            columns = [b.column(0), *(pa.array(c) for c in counts.T), pa.array(score), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "score", "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double, base_failed boolean, kept boolean"
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = [statistics(t) for t in b.column(at).to_pylist()]
            score = model.scores(np.array([x for _, x in stats])) if model else np.zeros(len(stats))
            kept = [not base_fails(c[0], c[4]) and s >= (model.threshold if model else -np.inf) for (c, _), s in zip(stats, score)]
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
