"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, divergence, extract, language, licenses, packing, privacy, quality, repair, simhash, tokens, warc
from .common import table

VOCABULARY = "word_bpe_49k.json"
PIECES = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


def op2_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), vocabulary_path())


def op3_privacy(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.digest(privacy.find(table(spark, folder, "documents")))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    named = simhash.near_duplicates(table(spark, folder, "documents"))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    model = quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return quality.judge(table(spark, folder, "documents"), model)


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr(
        "CAST(-1 AS LONG) AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text"
    )
    return chat.digest(chat.read_back(chat.format_chats(said.unionByName(probe))))


def op8_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.main_text(table(spark, folder, "pages"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary_path())


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predict(docs, language.learn(docs, vocabulary_path(PIECES)))


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_licenses,
        op2_tokens,
        op3_privacy,
        op4_simhash,
        op5_warc,
        op6_quality,
        op7_chat,
        op8_extract,
        op9_packing,
        op10_decontaminate,
        op11_language,
        op12_repair,
        op13_divergence,
    )
}

OP13 = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
said AS (SELECT lang, source, n, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM said GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
langs AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.c), 0) AS n FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
counts AS (SELECT s.lang, s.source, s.term, count(*) AS c FROM said s JOIN kept USING (lang, term) GROUP BY s.lang, s.source, s.term),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source),
cells AS (SELECT t.lang, t.source, k.term, coalesce(c.c, 0) AS c,
    (1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // (t.n + 5 * l.v))::BIGINT AS p, (1 + (CAST(1000000000 AS HUGEINT) * (k.c + 5)) // (l.n + 5 * l.v))::BIGINT AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
items AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM items)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: DuckDB twins of the queries that SQL can express.
ORACLES: dict[str, str] = {"op13_divergence": OP13}
