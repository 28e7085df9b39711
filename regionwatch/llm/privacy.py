"""Personal data: patterns for four kinds, and terms that reveal whom they belong to. DataFrame functions only.

The patterns give the protected entities. The words of a document are terms of the entities it names, wherever they
stand in it. Over the whole corpus, co-occurrence says how much of an entity's information a term carries: with N
documents, n(t) of them with term t, n(e) with entity e, and n(t, e) with both,

    disclosure = PMI(t; e) / IC(e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e)),

which is 1 for a term that never occurs without the entity. Copies of one text are one context; where a term was seen
with the entity in c < CONTEXTS different ones, n(t, e) counts as (c - DISCOUNT) / c of itself, so little evidence needs
a rarer entity, and none is left out unasked. A term is generalised from a disclosure of GENERALISE on, and removed from
REMOVE on; only in documents that name that entity, so documents without protected entities stay as they are.

Offsets are in code points: the text is split at a pattern's matches, and lengths of pieces and matches are summed.
The patterns are written so that they find what the plain ones find in time linear in the text: a match can start
only at the start of a run of its first class, or where the match before it ended.

Defined results: a null or empty text has no spans; repeated rows and null ids are handled like any others; an empty
table gives an empty one; other columns are kept by ``sanitise`` and not looked at by ``find``. Spans that overlap are
all reported; ``sanitise`` replaces their union, labelled by the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bound, join_unique, materialise, prefix_sums

KINDS = ("email", "ip", "card", "phone", "term")
TERM = len(KINDS) - 1

#: The letters that a term has at least.
TERM_LETTERS = 4
CONTEXTS = 3
DISCOUNT = 0.5
GENERALISE, REMOVE = 0.85, 0.95

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{TERM_LETTERS},}}+(?![\p{{L}}\p{{N}}])"


def matches(text: Column, pattern: str) -> Column:
    """All matches in order: array of (start, end, value), end exclusive."""
    return bound(text, lambda t: bound(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: _spans(t, pattern, found)))


def _spans(text: Column, pattern: str, found: Column) -> Column:
    """The matches ``found`` with their places; a text without any is not split."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("long"))
    gaps, sizes = prefix_sums(between), prefix_sums(F.transform(found, lambda m: F.char_length(m).cast("long")))
    both = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), sizes.alias("s"))
    spans = F.transform(
        both,
        lambda z: F.struct((z["g"] + z["s"] - F.char_length(z["m"])).alias("start"), (z["g"] + z["s"]).alias("end"), z["m"].alias("value")),
    )
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digit string passes the check sum that doubles every second digit from the right."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    total = F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def _byte(part: Column) -> Column:
    significant = F.regexp_replace(part, "^0+", "")
    return (F.char_length(significant) < 3) | (F.char_length(significant) == 3) & (significant <= "255")


def valid_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), _byte)


def valid_card(value: Column) -> Column:
    number = digits(value)
    return F.when(F.char_length(number).between(14, 19), luhn(number)).otherwise(False)


def valid_phone(value: Column) -> Column:
    return F.char_length(digits(value)).between(10, 15)


def _of_kind(text: Column, kind: str) -> Column:
    pattern, gate, valid = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, F.rlike(text, F.lit("[0-9]")), valid_ip),
        "card": (CARD, F.rlike(text, F.lit("[0-9]")), valid_card),
        "phone": (PHONE, F.contains(text, F.lit("+")), valid_phone),
    }[kind]
    spans = matches(F.when(gate, text).otherwise(""), pattern)
    if valid:
        spans = F.filter(spans, lambda s: valid(s["value"]))
    return F.transform(spans, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("kind"), s["end"], s["value"]))


def _with_base(docs: DataFrame) -> DataFrame:
    """Adds _text, the text without nulls, and _base, the pattern spans by start and kind."""
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind in KINDS[:TERM]:
        out = out.withColumn(f"_{kind}", _of_kind(F.col("_text"), kind))
    every = F.sort_array(F.concat(*(F.col(f"_{kind}") for kind in KINDS[:TERM])))
    return out.withColumn("_base", every).drop(*(f"_{kind}" for kind in KINDS[:TERM]))


def _entity(s: Column) -> Column:
    """Names the entity behind a span: numbers by their digits, addresses in lower case."""
    return F.concat_ws(":", s["kind"].cast("string"), F.when(s["kind"] >= KINDS.index("card"), digits(s["value"])).otherwise(F.lower(s["value"])))


def _mentions(private: DataFrame) -> DataFrame:
    """(_row, entity, context): the entities that each document names; copies of one text are one context."""
    return private.select("_row", F.xxhash64("_text").alias("context"), F.explode(F.array_distinct(F.transform("_base", _entity))).alias("entity"))


def _outside(text: Column, base: Column) -> Column:
    """The text with zeros for the letters of its spans, so that no word overlaps one; only addresses hold letters."""
    found = F.transform(F.filter(base, lambda s: s["kind"] == KINDS.index("email")), lambda s: F.regexp_replace(s["value"], r"\p{L}", "0"))
    pieces = lambda m: F.zip_with(F.split(text, EMAIL, -1), m, lambda t, v: F.concat(t, F.coalesce(v, F.lit(""))))
    return bound(found, lambda m: F.when(F.size(m) > 0, F.array_join(pieces(m), "")).otherwise(text))


def _words(private: DataFrame) -> DataFrame:
    """(_row, term): the words of each whole text, once each; none that a span overlaps."""
    words = F.regexp_extract_all(_outside(F.col("_text"), F.col("_base")), F.lit(WORD), F.lit(0))
    return private.select("_row", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("term"))


def _near(docs: DataFrame, n: int, mentions: DataFrame, words: DataFrame) -> DataFrame:
    """(_row, entity, term, context, n_t, n_e) of each document's entities and terms, as far as they may disclose.

    A term in n(t) documents reaches GENERALISE only if n(t) <= n(e) ** GENERALISE * N ** (1 - GENERALISE), as n(t, e) is
    n(e) at most. What is more frequent goes before the document's words are paired with its entities.
    """
    cap = F.pow(F.col("n_e").cast("double"), GENERALISE) * (max(n, 1) ** (1 - GENERALISE) * (1 + 1e-9))
    n_e = materialise(mentions.groupBy("entity").agg(F.count("*").alias("n_e")).withColumn("w", F.col("n_e")), "entity_counts")
    held = materialise(join_unique(mentions, n_e, "entity", "w", mentions.count()), "held")
    # the words of all documents; each task adds its own up before the shuffle
    every = F.filter(F.array_distinct(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+")), lambda w: F.char_length(w) >= TERM_LETTERS)
    n_t = docs.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    # an inner join of unique terms: a semi join would be moved below the aggregation, to every word of every text
    n_t = materialise(n_t.join(words.groupBy("term").agg(F.count("*").alias("w")), "term"), "term_counts")
    rare = join_unique(words, n_t, "term", "w", words.count()).join(held.groupBy("_row").agg(F.max(cap).alias("cap")), "_row").where(F.col("n_t") <= F.col("cap"))
    pairs = rare.drop("cap").join(held, "_row").where(F.col("n_t") <= cap)
    return pairs.select("_row", "entity", "term", "context", "n_t", "n_e")


def disclosing(near: DataFrame, n: int) -> DataFrame:
    """(entity, term, disclosure, w) of the terms over the threshold, found in w documents; statistics are over all n documents."""
    counts = [F.max(c).alias(c) for c in ("n_t", "n_e")]
    apart = near.groupBy("entity", "term", "context").agg(F.count("*").alias("rows"), *counts)
    pairs = apart.groupBy("entity", "term").agg(F.sum("rows").alias("w"), F.count("*").alias("contexts"), *counts)
    n_te = F.col("w") * F.when(F.col("contexts") < CONTEXTS, 1 - DISCOUNT / F.col("contexts")).otherwise(1.0)
    pmi = F.log(F.lit(float(n)) * n_te / (F.col("n_t") * F.col("n_e")))
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    return pairs.where(ic > 0).withColumn("disclosure", pmi / ic).where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure", "w")


def _with_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(_row, _terms): spans of disclosing terms, as (start, kind, end, value), value naming what happens to them."""
    private = base.where(F.size("_base") > 0)
    n = docs.count()
    mentions, words = materialise(_mentions(private), "mentions"), materialise(_words(private), "words")
    near = materialise(_near(docs, n, mentions, words), "near")
    pair = F.concat_ws("\n", "entity", "term")
    value = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("value")
    terms = materialise(disclosing(near, n).select(pair.alias("pair"), value, "w"), "terms")
    total = terms.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    found = join_unique(near.select("_row", "term", pair.alias("pair")), terms, "pair", "w", total)
    found = materialise(found.groupBy("_row", "term").agg(F.max("value").alias("value")), "found")  # remove goes before generalise
    # only now the places of words, in the documents that have such terms
    texts = private.join(found.select("_row").distinct(), "_row", "left_semi")
    each = texts.select("_row", F.explode(matches(_outside(F.col("_text"), F.col("_base")), WORD)).alias("m"))
    placed = each.select("_row", F.lower("m.value").alias("term"), F.col("m.start").alias("start"), F.col("m.end").alias("end")).join(found, ["_row", "term"])
    span = F.struct(F.col("start"), F.lit(TERM).alias("kind"), F.col("end"), F.col("value"))
    return placed.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("_terms"))


def _scanned(docs: DataFrame, everything: bool) -> DataFrame:
    """The documents with _row, _base and _terms; texts of documents without mentions are kept only if asked for."""
    base = _with_base(docs).withColumn("_row", F.monotonically_increasing_id())
    if not everything:
        base = base.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text")))
    base = materialise(base, "scanned")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return base.join(_with_terms(docs, base), "_row", "left").withColumn("_terms", F.coalesce("_terms", none))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, terms): spans of the patterns, and of disclosing terms, for every row."""
    return _scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), False).select("doc_id", F.col("_base").alias("base"), F.col("_terms").alias("terms"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and spans as text."""
    names = F.array(*(F.lit(k) for k in KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *(count(k) for k in range(TERM)),
        F.sha2(F.encode(said(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        said(F.sort_array(F.concat("base", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows with their columns; spans are replaced by their kind in the text, removed terms by nothing."""
    scanned = _scanned(docs, True)
    labels = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    spans = F.sort_array(F.concat("_base", "_terms"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["value"].eqNullSafe("remove") & (s["kind"] == TERM), F.lit("")).otherwise(F.get(labels, s["kind"]))
        before = F.substr(F.col("_text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(before, label))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("_text"), (acc["at"] + 1).cast("int")))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(F.col("text"))
    out = scanned.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
