"""Exact round trips of archives and chats."""

from __future__ import annotations

import base64
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from regionwatch.llm import chat, queries, warc

PAGES = [
    (1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, "<p>y</p>"), (3, None, "<p>y</p>"), (4, "u\r\nv", None),
    (5, "http://e", ""), (None, "http://f", "<p>x</p>"), (None, "http://g", "only here"), (6, "http://h", "é🙂" * 100_000), (7, "u", "<p>y</p>"),
]


def pages_of(spark, rows=PAGES):
    out = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("payload", "key", "n", "first", "revisit", "refers_to"):
        out = out.withColumn(c, F.lit("clash"))
    return out


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        known = first.get(h or "")
        revisit = len(raw) >= least and known is not None and known != i
        out.append((repr(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", repr(known if revisit else None)))
    return sorted(out)


def found(df):
    return sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], repr(r["refers_to"])) for r in df.collect())


@pytest.mark.parametrize("least", [0, 9])
def test_odd_pages_round_trip(spark, least):
    got = warc.round_trip(pages_of(spark), least)
    assert found(got) == expected(PAGES, least)
    payloads = {(r["page_id"], bytes(r["payload"]).decode()) for r in got.where("record_type = 'response'").collect()}
    assert (6, "é🙂" * 100_000) in payloads and (1, "<p>x</p>") in payloads


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], pages_of(spark).schema)).isEmpty()


def test_warc_query(spark, small):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert found(queries.op5_warc(spark, small)) == expected(rows)


def archive():
    return [warc.record_bytes(1, "u", b"abc" * 50_000, None, False), warc.record_bytes(2, "v", b"", None, False), warc.record_bytes(3, "w", b"abc", 1, True)]


def test_reader_takes_one_member_a_record(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    got = list(warc.read_archive(io.BytesIO(b"".join(archive()))))
    assert [(r.page_id, r.record_type, r.refers_to, len(r.payload), r.payload_bytes) for r in got] == [(1, "response", None, 150_000, 150_000), (2, "response", None, 0, 0), (3, "revisit", 1, 0, 3)]


def test_reader_rejects_what_is_cut_or_changed():
    import zlib

    whole = b"".join(archive())
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(whole[:-5])))
    raw = zlib.decompress(warc.record_bytes(1, "u", b"abcdef", None, False), warc.GZIP)
    for bad in (raw.replace(b"abcdef", b"abcdeg"), raw.replace(b"Content-Length: 6", b"Content-Length: 5")):
        press = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(press.compress(bad) + press.flush())))


# --- chats --------------------------------------------------------------------

MARKS = ["\\", "\\s", "\\l", "\\b", "<s>", "</s>", "[INST]", "[/INST]", "é", "🙂", " ", "\n", "a"]


def turns(n_long):
    rng = random.Random(3)
    texts = [None, "", *("".join(rng.choices(MARKS, k=rng.randint(0, 9))) for _ in range(40))]
    roles = ["user", "assistant", "system", "<s>[INST]", None]
    rows = [(c, rng.choice([t, t, 1, None]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(120)] for t in range(rng.randint(1, 9))]
    return rows + rows[:5] + [(9_999, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(n_long)]


def digests(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, v in by.items():
        v.sort()
        loss = "".join(x for _, r, x in v if r == "assistant")
        out[c] = (len(v), sha("".join(f"{r}\n{x}\n" for _, r, x in v)), len(loss), sha(loss))
    return out


def seen(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_odd_chats_come_back(spark):
    rows = turns(1_000)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("turns", "runs", "places", "ends", "loss", "starts")})
    assert seen(chat.digest(chat.read_back(chat.format_chats(frame)))) == digests(rows)


def test_adjacent_turns_of_a_role_are_one_run(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "</s>")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got["formatted"] == "<s>user[INST]a[/INST][INST]b[/INST]</s><s>assistant[INST]\\l/s>[/INST]</s>"
    assert [got["formatted"][s["start"] : s["start"] + s["length"]] for s in got["loss"]] == ["\\l/s>"]


def test_no_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.read_back(chat.format_chats(none))).isEmpty()


def test_chat_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = queries.op7_chat(spark, small)
    assert seen(df) == digests(rows + probe)
    assert "Python" not in df._jdf.queryExecution().toString()
