"""Token counts and packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from regionwatch.llm import common, packing, queries, tokens

PATH = queries.vocabulary_path()


def library_ids(texts):
    return [e.ids for e in packing.tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|> End.", "a" * 3_000, "ab" * 2_000, "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "aaaa aaaaa", "it's I'LL we'd", "x. y, z.\n", "12 3٣", "İstanbul ǅ", "\x1c\x85\xa0 \u2003.", "e\u0301 E\u0301", ""]


def test_counts_equal_the_library():
    assert tokens.Counter(PATH).counts(ODD)[1] == list(map(len, library_ids(ODD)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcé ß'sStreLl09.,!Σσİ\n\t日🙂<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_counts_and_ids_equal_the_library_on_any_text(texts):
    want = library_ids(texts)
    assert tokens.counter(PATH).counts(texts)[1] == list(map(len, want))
    assert [x.tolist() for x in packing.encoder(PATH).encode(texts)] == want


def test_every_code_point():
    for first in range(0, 0x110000, 0x10000):
        chars = [chr(i) for i in range(first, first + 0x10000) if not 0xD800 <= i < 0xE000]
        texts = [form.format(c) for c in chars for form in (":{0}", "a{0}b{0}")] if first < 0x40000 else [":{0}".format(c) for c in chars[:100]]
        want = library_ids(texts)
        assert [x.tolist() for x in packing.Encoder(PATH).encode(texts)] == want
        assert tokens.Counter(PATH).counts(texts)[1] == list(map(len, want))


def test_tables_start_anew_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    counter, encoder = tokens.Counter(PATH), packing.Encoder(PATH)
    for texts in (ODD, ["many other words that are new here", "and more of them"], ODD):
        want = library_ids(texts)
        assert counter.counts(texts)[1] == list(map(len, want))
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_token_query_equals_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(ids), len(ids) > 2048) for r, ids in zip(docs, library_ids([r["text"] for r in docs]))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op2_tokens(spark, small).collect()}
    assert got == want


def test_token_counts_of_odd_documents(odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(i)) for r, i in zip(rows, library_ids([r["text"] for r in rows])))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(odd, PATH).collect())
    assert got == want and tokens.count_tokens(none, PATH).isEmpty()


def check_packing(rows, docs):
    """Every id in one piece, crc and totals right, sequences gapless and never over the window."""
    ids = sorted(((d, np.array([*i, packing.END_ID], "<u4")) for (d, _), i in zip(docs, library_ids([t for _, t in docs]))), key=lambda x: repr(x[0]))
    want = sorted((repr(d), at, len(p), zlib.crc32(p.tobytes()), len(x)) for d, x in ids for at in range(0, len(x), 2048) for p in [x[at : at + 2048]])
    assert sorted((repr(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return sum(r["length"] for r in rows) / (len(by) * packing.WINDOW)


def test_packing_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert check_packing(queries.op9_packing(spark, small).collect(), docs) > 0.97


@pytest.mark.parametrize("group", [50_000, 4])
def test_packing_odd_documents(odd, none, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    check_packing(packing.pack(odd, PATH).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(none, PATH).isEmpty()


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    windows, offsets = packing.best_fit(lengths, 100)
    room, plain = [], []
    for n in lengths:
        fits = [(r, w) for w, r in enumerate(room) if r >= n]
        if not fits:
            room.append(100)
            fits = [(100, len(room) - 1)]
        tight = min(fits)[0]
        plain.append(tight)
        room[min(fits)[1]] -= n
    used = {}
    for n, w, o, tight in zip(lengths, windows, offsets, plain):
        assert o == used.get(w, 0) and 100 - o == tight
        used[w] = o + n
    assert len(used) == len(room)


def test_a_worker_keeps_neither_the_table_nor_spare_memory(monkeypatch):
    released = []

    class Pool:
        def release_unused(self):
            released.append(True)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_pydict({"text": ["some words"] * 5})
    assert [b.num_rows for b in common.slices(iter([batch, batch]), 3)] == [3, 2, 3, 2] and released == [True]
    first = packing.encoder(PATH)
    list(first.encode(["some words"]))
    assert first.known and not packing.encoder(PATH).known


def test_a_known_piece_is_looked_up_once(monkeypatch):
    asked = []

    class Piece(bytes):
        def __hash__(self):
            asked.append(self)
            return bytes.__hash__(self)

    task, text = packing.Encoder(PATH), "some words and some more <|endoftext|>x words. End."
    want = library_ids([text, None])
    assert [x.tolist() for x in task.encode([text, None])] == want
    monkeypatch.setattr(packing, "text_pieces", lambda raw: list(map(Piece, tokens.text_pieces(raw))))
    assert [x.tolist() for x in task.encode([text, None])] == want
    assert len(asked) == len(tokens.text_pieces(text.encode()))
