"""License scans: fuzzy search for short notices in whole texts.

A text becomes its words, joined by single blanks. A notice of n characters may have a bounded number of edits, k;
cut into k + 1 pieces, at least one piece of it stands unchanged (pigeonhole), so exact search for the pieces finds
every place where the notice may be. Around each such place the regex library's bounded-error matching verifies the
edits and gives the span. The base phrases are notices without edits: their one piece is the phrase itself.

Defined results: a null or empty text has no words, places or labels and score 0; first_word and last_word are null
without base places; repeated rows and null ids pass through; an empty table gives an empty one; other columns of the
input are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Phrases that count exactly, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices that may have edits, their label, and a word that must stand unchanged within the span.
NOTICES = (
    ("released under the mit license", "mit", "mit"),
    ("licensed under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "granted"),
    ("apache license version 2 0", "apache", "2"),
    ("licensed under the apache license", "apache", "apache"),
    ("gnu general public license version", "gpl", "general"),
    ("licensed under the gnu general public license", "gpl", "gnu"),
    ("gnu lesser general public license", "lgpl", "lesser"),
    ("gnu affero general public license", "agpl", "affero"),
    ("redistribution and use in source and binary forms", "bsd", "binary"),
    ("licensed under the bsd license", "bsd", "bsd"),
    ("mozilla public license", "mpl", "public"),
    ("creative commons attribution", "cc", "commons"),
)
#: One edit may occur in so many characters.
CHARACTERS_PER_EDIT = 10

#: Lower-cases A-Z and makes every other ASCII character but digits and letters a blank.
CANONICAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Notice(NamedTuple):
    phrase: bytes
    label: str
    key: bytes
    edits: int
    base: bool
    seeds: tuple[tuple[bytes, int], ...]  # pieces and where they stand in the phrase
    pattern: regex.Pattern


class Found(NamedTuple):
    label: str
    first_word: int
    n_words: int
    edits: int
    length: int
    base: bool


def cut_evenly(phrase: bytes, parts: int) -> tuple[tuple[bytes, int], ...]:
    at = [len(phrase) * k // parts for k in range(parts + 1)]
    return tuple((phrase[a:b], a) for a, b in zip(at, at[1:]))


def notice(phrase: str, label: str, key: str = "", base: bool = False) -> Notice:
    raw = phrase.encode()
    edits = 0 if base else len(raw) // CHARACTERS_PER_EDIT
    # whole words only; (?b) asks for the match with the fewest edits
    pattern = regex.compile(rb"(?b)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(raw, literal_spaces=True), edits))
    return Notice(raw, label, b" %s " % key.encode() if key else b"", edits, base, cut_evenly(raw, edits + 1), pattern)


ALL_NOTICES = tuple(notice(p, label, base=True) for p, label in BASE_PHRASES.items()) + tuple(notice(*n) for n in NOTICES)


def windows(text: bytes, n: Notice) -> Iterator[tuple[int, int]]:
    """Stretches of the text, apart from each other, that hold every place where the notice may stand."""
    starts = set()
    for seed, offset in n.seeds:
        at = text.find(seed)
        while at >= 0:
            starts.add(at - offset)
            at = text.find(seed, at + 1)
    low = high = None
    for start in sorted(starts):
        a, b = max(0, start - n.edits - 1), start + len(n.phrase) + n.edits + 1
        if high is not None and a <= high:
            high = max(high, b)
        else:
            if high is not None:
                yield low, high
            low, high = a, b
    if high is not None:
        yield low, high


def places(text: bytes, n: Notice, a: int, b: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice in a window, apart from each other: the best first, then both sides of it.

    A match without the key word gives way to others that overlap it.
    """
    found, todo, seen = [], [(a, b)], set()
    while todo:
        at, end = stretch = todo.pop()
        if stretch in seen or not (m := n.pattern.search(text, at, end)):
            continue
        seen.add(stretch)
        s, e = m.span()
        if n.key not in text[s - 1 : e + 1]:
            todo += [(at, e), (s + 1, end)]
            continue
        found.append((s, e, sum(m.fuzzy_counts)))
        todo += [(max(e, s + 1) - 1 if n.base else max(e, s + 1), end)] + ([] if n.base else [(at, s)])
    apart: list[tuple[int, int, int]] = []
    for place in sorted(set(found), key=lambda f: (f[2], f[0])):
        k = bisect.bisect(apart, place)
        if (k == 0 or apart[k - 1][1] <= place[0]) and (k == len(apart) or place[1] <= apart[k][0]):
            apart.insert(k, place)
    return apart


def search(text: bytes, notices: tuple[Notice, ...] = ALL_NOTICES) -> list[Found]:
    """All notices of a text that is words, each with a blank before and after it."""
    found = []
    for n in notices:
        for a, b in windows(text, n):
            for s, e, edits in places(text, n, a, min(b, len(text))):
                found.append(Found(n.label, text.count(b" ", 0, s) - 1, text.count(b" ", s, e) + 1, edits, len(n.phrase), n.base))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: counts, labels, score and the spans of all notices, by word."""
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())])
    kinds = {
        "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
        "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span),
    }

    def row(doc: int | None, text: str | None) -> tuple:
        words = text.encode("utf-8", "surrogatepass").translate(CANONICAL).split(b" ") if text else []
        words = [w for w in words if w]
        found = search(b" " + b" ".join(words) + b" ") if words else []
        base = [f.first_word for f in found if f.base]
        joined = lambda labels: ",".join(sorted(set(labels)))
        spans = [{"label": f.label, "first_word": f.first_word, "n_words": f.n_words, "edits": f.edits} for f in sorted(found, key=lambda f: (f.first_word, f.label, f.length))]
        score = max((1 - f.edits / f.length for f in found), default=0.0)
        return (
            doc, len(words), len(base), min(base, default=None), max(base, default=None),
            joined(f.label for f in found if f.base), joined(f.label for f in found), score, spans,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [row(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label string, first_word long, n_words long, edits long>>",
    )
