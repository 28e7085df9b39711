"""Chat formatting with Spark expressions only, and the way back.

Turn structs of a conversation are collected and sorted, adjacent turns of one role are merged into a run, and runs
are concatenated. ``<s>`` opens a run and is followed by its role, ``[INST]`` and ``[/INST]`` enclose each text of the
run, ``</s>`` closes it. So that a text cannot be taken for a mark, its backslash, ``<`` and ``[`` become backslash and
a letter, which is undone exactly. The loss mask is the spans of the assistant's texts, in code points.

Defined results: a null role or text is empty; turns are in the order of (turn, role, text), nulls first, so ties and
repeated rows have a fixed place; rows with a null conv_id are a conversation of their own; an empty table gives an
empty one; other columns of the input are not looked at. A conversation is one string, so it is as large as its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import prefix_sums

OPEN, CLOSE, TEXT, END = "<s>", "</s>", "[INST]", "[/INST]"
LOSS_ROLE = "assistant"

#: Order matters: the first to be escaped is the last to be undone.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))


def escaped(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss is an array of (start, length) within formatted."""
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    sorted_turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    runs = sorted_turns.withColumn("starts", starts)

    def run(start: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        texts = F.transform(F.slice("turns", start, upto - start), lambda t: escaped(t["text"]))
        return F.struct(escaped(F.get("turns", start - 1)["role"]).alias("role"), texts.alias("texts"))

    def rendered(r: Column) -> Column:
        texts = F.transform(r["texts"], lambda t: F.concat(F.lit(TEXT), t, F.lit(END)))
        return F.concat(F.lit(OPEN), r["role"], F.array_join(texts, ""), F.lit(CLOSE))

    def places(r: Column, k: Column) -> Column:
        """Each text's length, and the characters from the end of the text before it to its own start."""
        opening = F.char_length(r["role"]) + F.lit(len(OPEN + TEXT)) + F.when(k > 0, F.lit(len(END + CLOSE))).otherwise(F.lit(0))

        def place(t: Column, i: Column) -> Column:
            gap = F.when(i == 0, opening).otherwise(F.lit(len(END + TEXT)))
            return F.struct(gap.cast("long").alias("gap"), F.char_length(t).cast("long").alias("length"), (r["role"] == LOSS_ROLE).alias("counts"))

        return F.transform(r["texts"], place)

    runs = runs.select("conv_id", F.transform("starts", run).alias("runs"))
    runs = runs.select("conv_id", F.array_join(F.transform("runs", rendered), "").alias("formatted"), F.flatten(F.transform("runs", places)).alias("places"))
    runs = runs.withColumn("steps", F.transform("places", lambda p: p["gap"] + p["length"])).withColumn("ends", prefix_sums(F.col("steps")))
    spans = F.transform(F.arrays_zip("places", "ends"), lambda z: F.struct((z["ends"] - z["places"]["length"]).alias("start"), z["places"]["length"].alias("length"), z["places"]["counts"].alias("counts")))
    loss = F.transform(F.filter(spans, lambda s: s["counts"]), lambda s: F.struct(s["start"], s["length"]))
    return runs.select("conv_id", "formatted", loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns is an array of (role, text), loss_text what the mask covers."""

    def parsed(run: Column) -> Column:
        role = F.substring_index(run, TEXT, 1)
        texts = F.split(F.substr(run, F.char_length(role) + 1), r"\[/INST\]")
        texts = F.slice(texts, 1, F.size(texts) - 1)
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(F.substr(t, F.lit(len(TEXT) + 1))).alias("text")))

    runs = F.split("formatted", CLOSE)
    runs = F.transform(F.slice(runs, 1, F.size(runs) - 1), lambda r: F.substr(r, F.lit(len(OPEN) + 1)))
    covered = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", F.flatten(F.transform(runs, parsed)).alias("turns"), F.array_join(covered, "").alias("loss_text"), "formatted")


def digest(read: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    long = lambda c: c.cast("long")
    return read.select(
        "conv_id",
        long(F.size("turns")).alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        long(F.char_length("loss_text")).alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        long(F.char_length("formatted")).alias("formatted_chars"),
    )
