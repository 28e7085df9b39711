"""Personal data against plain patterns, terms that reveal, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from regionwatch.llm import common, packing, privacy, queries, quality, simhash

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in each) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(kind, m[0]))


def check_base(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (r["doc_id"], said, r["spans"])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[3] == k for w in want) for k in PLAIN]
        assert [s for s in r["spans"].split(",") if not s.startswith("term")] == said.split(",")


PARTS = ["a@b.cd", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "4845168114407329", " ", ".", "@", "+", "12", "-", "é", "🙂", "x", "0", "000001.2.3.255", "\n", "9 9"]
HARD = [None, "", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8", "a" * 30_000, "1" * 30_000, "1.1." * 3_000, "a@b" + ".c" * 6_000, "+1" * 3_000, "+1 " + "2." * 5_000, "é🙂 x@y.z " * 700]


def test_patterns_equal_plain_ones(spark):
    rng = random.Random(5)
    texts = dict(enumerate(HARD + ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(1_500)]))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_base(privacy.digest(privacy.find(frame)).collect(), texts)


def test_privacy_query_is_native_and_right(spark, small):
    df = queries.op3_privacy(spark, small)
    check_base(df.collect(), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()})
    assert "Python" not in df._jdf.queryExecution().toString()


def people(spark):
    """Ten documents name Zaphodine near one address, in different words; other documents share all other words."""
    common_words = "today morning evening river mountain garden winter summer letter answer".split()
    rng = random.Random(2)
    said = lambda: " ".join(rng.choices(common_words, k=12))
    rows = [(i, f"{said()} Zaphodine wrote from z{'' if i % 2 else 'Z'}.b@mail.example about {said()}") for i in range(10)]
    rows = [(i, t.replace("zZ.b", "z.b")) for i, t in rows]
    rows += [(i, f"{said()} wrote from home about {said()}") for i in range(10, 200)]
    rows += [(i, "Ask Qwertyone via copy@mail.example today") for i in range(200, 240)]  # copies: one surrounding only
    rows += [(300, "Zaphodine is a word here, without an address")]
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


def test_terms_that_reveal_an_entity(spark):
    frame, texts = people(spark)
    for r in privacy.digest(privacy.find(frame)).collect():
        i = r["doc_id"]
        terms = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")]
        assert [texts[i][a:b] for a, b in terms] == (["Zaphodine"] if i < 10 else [])
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(frame).collect()}
    for i, t in clean.items():
        if i < 10:
            assert "Zaphodine" not in t and "<EMAIL>" in t and "@" not in t
        elif 200 <= i < 240:
            assert t == "Ask Qwertyone via <EMAIL> today"
        else:
            assert t == texts[i]


def test_terms_seen_in_one_or_two_documents(spark):
    """A name beside one address and nowhere else goes; words that others use too stay."""
    said = lambda i: f"letter from {'abcdefghij'[i % 10] * 5} about the garden"
    rows = [(i, f"{said(i)} in winter") for i in range(400)]
    rows += [(400, "letter from Zaphodine at one@mail.example about the garden"), (401, "winter letter: Qwertyone, two@mail.example"), (402, "Ask Qwertyone about garden letter, two@mail.example")]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[400] == "letter from <TERM> at <EMAIL> about the garden"
    assert "Qwertyone" not in clean[401] + clean[402] and "letter" in clean[401] and "garden letter" in clean[402]
    assert all(clean[i] == t for i, t in rows[:400])


def test_terms_far_from_the_mention(spark):
    """The whole text is judged: a name far from the address, at any edge and beside a number, goes as a near one does."""
    filler = "letter about the garden in winter and summer "
    rows = [(i, filler * 20) for i in range(400)]
    rows += [(400, f"Zaphodine {filler * 9}one@mail.example {filler * 9}Qwertyone"), (401, f"{filler}éééétwo@mail.example Müllerone+1 (555) 123-4567")]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[400] == f"<TERM> {filler * 9}<EMAIL> {filler * 9}<TERM>"
    assert clean[401] == f"{filler}éééé<EMAIL> <TERM><PHONE>"
    assert all(clean[i] == t for i, t in rows[:400])


def plain_terms(rows):
    """(row, start, end) of the terms that disclose, from a table of all entities and words."""
    n, spans, words, first = len(rows), {}, {}, {}
    for i, t in rows:
        spans[i] = plain_spans(t)
        first[i] = {(k, re.sub("[^0-9]", "", t[a:b]) if k > 1 else t[a:b].lower()) for a, k, b, _ in spans[i]}
        words[i] = [m for m in re.finditer(r"[^\W_]+", t) if len(m[0]) > 3 and m[0].isalpha() and not any(a < m.end() and m.start() < b for a, _, b, _ in spans[i])]
    out = set()
    for i, t in rows:
        for e in first[i]:
            with_e = [j for j, _ in rows if e in first[j]]
            for m in words[i]:
                term = m[0].lower()
                n_t = sum(term in re.findall(r"[^\W_]+", u.lower()) for _, u in rows)
                both = [j for j in with_e if any(w[0].lower() == term for w in words[j])]
                contexts = len({dict(rows)[j] for j in both})
                n_te = len(both) * (1 - 0.5 / contexts if contexts < 3 else 1)
                ic = math.log(n / len(with_e))
                if ic > 0 and math.log(n * n_te / (n_t * len(with_e))) / ic >= 0.85:
                    out.add((i, m.start(), m.end()))
    return out


def test_terms_equal_a_plain_table(spark):
    rng = random.Random(8)
    names, mails = [f"Name{c}" for c in "abcdefghij"], [f"{c}@mail.example" for c in "pqrst"]
    said = lambda: " ".join(rng.choices([*names[:2], "garden", "winter", "letter", "abc"], k=rng.randint(0, 40)))
    rows = [(i, said()) for i in range(150)]
    rows += [(150 + i, f"{said()} {rng.choice(names)} {said()} {rng.choice(mails)} {said()} {rng.choice([*mails, '1.2.3.4'])}") for i in range(40)]
    rows += [(190 + i, "Nameq and Namer wrote to q@mail.example") for i in range(3)]
    found = privacy.digest(privacy.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    got = {(r["doc_id"], *map(int, s.split(":")[1:])) for r in found for s in r["spans"].split(",") if s.startswith("term")}
    assert got == plain_terms(rows) and got


def test_odd_documents(odd, none):
    rows = privacy.digest(privacy.find(odd)).collect()
    assert len(rows) == odd.count()
    assert {(r["n_email"], r["n_phone"], r["n_ip"], r["n_card"]) for r in rows if r["doc_id"] == 12} == {(1, 1, 1, 1)}
    clean = privacy.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[12]["text"] == "Released under the MIT License. mail <EMAIL> and <PHONE>, <IP>, <CARD>"
    assert got[12]["n_chars"] == len(got[12]["text"]) and got[4]["text"] is None and got[12]["key"] == "clash"
    assert privacy.digest(privacy.find(none)).isEmpty() and privacy.sanitise(none).isEmpty()


def test_overlapping_spans_leave_nothing(spark):
    frame = spark.createDataFrame([(1, "+1 (555) 123-45.67.8.9 end")], "doc_id long, text string")
    text = privacy.sanitise(frame).first()["text"]
    assert text == "<PHONE> end"


def test_prefix_sums(spark):
    frame = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 255, 256, 257, 700)], "v array<bigint>")
    for r in frame.select("v", common.prefix_sums(F.col("v")).alias("p")).collect():
        assert r["p"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))]


def test_a_bound_value_is_computed_once(spark):
    """A mention's text is searched once a pattern, and a row of a mention does not carry its document's spans."""
    drawn = spark.range(20).select(common.bound(F.rand(), lambda v: F.array(v, v + 0, F.lit(1.0) * v)).alias("v")).collect()
    assert all(len(set(r["v"])) == 1 for r in drawn) and len({r["v"][0] for r in drawn}) > 1
    plan = spark.range(1).select(privacy.matches(F.col("id").cast("string"), privacy.WORD).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
    base = privacy._with_base(spark.createDataFrame([("mail a@b.cd garden",)], "text string").withColumn("_row", F.lit(0)))
    assert "explode(_base" not in privacy._mentions(base)._jdf.queryExecution().analyzed().toString()


# --- pipeline -----------------------------------------------------------------


def test_stages_keep_what_they_should(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.judge(docs, model).where("kept").collect()}
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, small), name)
        results[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {n: [r["doc_id"] for r in rows] for n, rows in results.items() if n != "packing"}
    assert sorted(ids["quality"]) == sorted(kept)
    named = simhash.near_duplicates(spark.read.parquet(f"{small}/documents.parquet").where(F.col("doc_id").isin(list(kept)))).collect()
    assert sorted(ids["near_duplicates"]) == sorted({r["component_id"] for r in named})
    assert set(ids["decontamination"]) <= set(ids["near_duplicates"])
    assert sorted(ids["personal_data"]) == sorted(ids["decontamination"])
    for r in results["personal_data"]:
        assert not plain_spans(r["text"]) and (r["text"] == before[r["doc_id"]]) == (not plain_spans(before[r["doc_id"]]))
    assert {r["doc_id"] for r in results["packing"]} == set(ids["personal_data"])
    again = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, again.drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in results["packing"])


def test_stages_take_odd_and_empty_tables(spark, odd, none, small, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialise(stage(spark, docs, str(tmp_path)), name)
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, none, small).columns == none.columns


def test_registry():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and packing.WINDOW == 2048
