"""Conversation structure repair: the cheapest edits that give each conversation its turns in order.

Every row is one symbol: its role's initial and its first fault. Symbols are compressed by Re-Pair: the most frequent
pair of neighbours becomes a rule, again and again, over all sequences of a task at once. A symbol or rule has one
min-plus matrix over the four states of the wanted grammar ``(s?(ua)+)?``: for each state before and after it the least
cost, and the audit, the edits' initials. Matrices are evaluated bottom-up, once a rule, for whatever conversations hold
it. The audit is a rope: each entry only names the state between its two parts, and has a rank among its matrix's
audits. Within a matrix every audit ends with the edit of the last row, inserts standing before a row, so none is a
prefix of another and ranks of parts order the whole: letters are written out only for the result.

Conversations of any length are cut into stretches of BLOCK rows, which tasks of a range partitioning hold apart; a
conversation's own step sees a few numbers and audits a stretch. The digest of the repaired text reads its rows in
order and keeps none: a digest is sequential, so one task streams one conversation.

Defined results: null texts, roles and ids in the damage's key are one space; a null conv_id is a conversation of its
own; rows of one turn are in the order of role, then of the text's SHA-256, so ties and repeated rows have a fixed place;
roles with other initials than s, u and a cannot be kept; an empty table gives an empty one; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, slices

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Inserts that end a conversation, by the state it is in.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

#: A row's symbol is four times its fault plus its role's kind.
KINDS = "sua?"
CLEAN, CUT_OFF, GONE = range(3)
SYMBOLS = 12

BLOCK = 65_536  # rows of a stretch
PENDING = 1_000_000  # symbols that are compressed at a time
RULES = 256  # rules of one such time
RARE = 4  # a pair seen less often makes no rule

SPACES = r"[ \t\n\x0B\f\r]"


# --- matrices -----------------------------------------------------------------


class Matrix(NamedTuple):
    """Entries by (state before, state after); absent if that cannot be."""

    cost: dict[tuple[int, int], int]
    rank: dict[tuple[int, int], int]
    middle: dict[tuple[int, int], int]  # of a pair: the state between its parts
    audit: dict[tuple[int, int], str]  # of a single row


def ranked(keys: dict[tuple[int, int], object]) -> dict[tuple[int, int], int]:
    order = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    return {at: order[k] for at, k in keys.items()}


@lru_cache(maxsize=SYMBOLS)
def of_row(symbol: int) -> Matrix:
    """Inserts before the row, then its own edit."""
    fault, kind = divmod(symbol, 4)
    extra = TRUNCATED if fault == CUT_OFF else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int | None, cost: int, audit: str) -> None:
        if after is not None:
            best[before, after] = min(best.get((before, after), (cost, audit)), (cost, audit))

    for before in STATES:
        reached, inserts = {before}, 0
        while inserts < len(STATES):
            for state in reached:
                cost, lead = INSERT * inserts, "I" * inserts
                offer(before, state, cost + DELETE, lead + "D")
                if fault != GONE:
                    offer(before, STEPS.get((state, KINDS[kind])), cost + extra, lead + "K")
                    for role in "ua":
                        offer(before, STEPS.get((state, role)), cost + extra + REROLE, lead + "R")
            reached = {STEPS[s, r] for s in reached for r in "ua" if (s, r) in STEPS}
            inserts += 1
    audit = {at: a for at, (_, a) in best.items()}
    return Matrix({at: c for at, (c, _) in best.items()}, ranked(audit), {}, audit)


def joined(left: Matrix, right: Matrix) -> Matrix:
    """Least cost, of equal ones the least audit."""
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for (before, middle), cost in left.cost.items():
        rank = left.rank[before, middle]
        for after in STATES:
            further = right.cost.get((middle, after))
            if further is not None:
                key = (cost + further, rank, right.rank[middle, after], middle)
                if (before, after) not in best or key < best[before, after]:
                    best[before, after] = key
    return Matrix({at: k[0] for at, k in best.items()}, ranked({at: k[1:3] for at, k in best.items()}), {at: k[3] for at, k in best.items()}, {})


class Grammar:
    """Rules over symbols, each with its matrix; equal pairs are one rule."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, int] | None] = [None] * SYMBOLS
        self.matrices: list[Matrix] = [of_row(s) for s in range(SYMBOLS)]
        self.rules: dict[tuple[int, int], int] = {}

    def rule(self, left: int, right: int) -> int:
        found = self.rules.get((left, right))
        if found is None:
            found = self.rules[left, right] = len(self.parts)
            self.parts.append((left, right))
            self.matrices.append(joined(self.matrices[left], self.matrices[right]))
        return found

    def whole(self, symbols: list[int]) -> int:
        """One rule for a sequence, halving it, so that ropes stay shallow."""
        while len(symbols) > 1:
            odd = symbols[len(symbols) & ~1 :]
            symbols = [self.rule(a, b) for a, b in zip(symbols[::2], symbols[1::2])] + odd
        return symbols[0]

    def audit(self, symbol: int, before: int, after: int) -> str:
        """Writes a rope out."""
        out: list[str] = []
        todo = [(symbol, before, after)]
        while todo:
            s, a, b = todo.pop()
            if self.parts[s] is None:
                out.append(self.matrices[s].audit[a, b])
                continue
            left, right = self.parts[s]
            middle = self.matrices[s].middle[a, b]
            todo += [(right, middle, b), (left, a, middle)]
        return "".join(out)


def compressed(grammar: Grammar, sequences: list[bytes]) -> list[list[int]]:
    """Re-Pair: replaces the most frequent pair of neighbours by a rule until none is frequent."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    symbols = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(sequences)), lengths)
    for _ in range(RULES):
        together = owner[:-1] == owner[1:]
        wide = len(grammar.parts)
        pairs = np.where(together, symbols[:-1] * wide + symbols[1:], wide * wide)
        counts = np.bincount(pairs, minlength=wide * wide + 1)[:-1]
        pair = int(counts.argmax())
        if counts[pair] < RARE:
            break
        at = np.flatnonzero(pairs == pair)
        left, right = divmod(pair, wide)
        if left == right:  # of a run of neighbours every other one
            fresh = np.concatenate([[True], np.diff(at) > 1])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        symbols[at] = grammar.rule(left, right)
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, owner = symbols[stays], owner[stays]
    ends = np.searchsorted(owner, np.arange(len(sequences) + 1))
    listed = symbols.tolist()
    return [listed[a:b] for a, b in zip(ends, ends[1:])]


# --- damage and faults --------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: (conv_id, turn, role, text, copies); a dropped row has no copies, so its id stays."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), known("role").alias("role"), known("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that ``repair`` takes."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), known("role"), known("text"), F.lit(1).alias("copies"))


def text_key() -> Column:
    return F.unhex(F.sha2("text", 256))


def symbols(rows: DataFrame) -> DataFrame:
    """One row for equal ones, without its text: (conv_id, turn, role, key, copies, kind, fault).

    ``fault`` is that of the first copy; the others are blank as well, or duplicates.
    """
    blank = ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    whole = F.col("text").rlike(rf"[.!?]{SPACES}*\z")
    light = rows.select("conv_id", "turn", "role", text_key().alias("key"), "copies", blank.alias("blank"), whole.alias("whole"))
    one = light.groupBy("conv_id", "turn", "role", "key").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("whole").alias("whole"))
    said = one.where("copies > 0").groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times"))
    # few texts return in a later turn; the side that may have a hot key is not the one that is held
    again = said.where("times > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("key").alias("_key"), "first")
    met = one.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key")), "left")
    repeated = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), "b").when(repeated, "d").when(~F.col("whole"), "t").otherwise("-")
    return met.select("conv_id", "turn", "role", "key", "copies", kind.alias("kind"), fault.alias("fault"))


# --- stretches ----------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
STRETCH = (
    "conv_id long, part int, place int, blank long, duplicate long, truncated long, illegal long, turns long, first_kind int, last_kind int, "
    "first_turn long, last_turn long, entries array<struct<before: int, after: int, cost: long, rank: int, audit: string>>"
)
NAMES = [f.split(" ")[0] for f in STRETCH.split(", ")[:13]]
LEGAL = {(0, 1), (1, 2), (2, 1)}
TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Stretch:
    """Rows of a conversation that follow each other, as counts and symbols."""

    def __init__(self, conv: int | None) -> None:
        self.conv = conv
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_kind = self.last_kind = None
        self.first_turn = self.last_turn = None

    def add(self, turn: int | None, kind: int, fault: str, copies: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        first = {"b": GONE, "d": GONE, "t": CUT_OFF, "-": CLEAN}[fault]
        self.symbols.append(4 * first + kind)
        self.symbols += bytes([4 * GONE + kind]) * (copies - 1)
        self.blank += copies if fault == "b" else 0
        self.truncated += fault == "t"
        self.duplicate += 0 if fault == "b" else copies - 1 + (fault == "d")
        if self.last_kind is not None:
            self.illegal += (self.last_kind, kind) not in LEGAL
        self.illegal += copies - 1  # no role may follow itself
        self.first_kind = kind if self.first_kind is None else self.first_kind
        self.last_kind = kind


def solved(pending: list[Stretch], part: int, place: int) -> pa.RecordBatch:
    """The stretches with the entries of their matrices, audits written out."""
    grammar = Grammar()
    distinct = list({bytes(s.symbols) for s in pending if s.symbols})
    entries: dict[bytes, list[dict]] = {b"": []}
    for raw, short in zip(distinct, compressed(grammar, distinct) if distinct else []):
        top = grammar.whole(short)
        m = grammar.matrices[top]
        entries[raw] = [
            {"before": a, "after": b, "cost": c, "rank": m.rank[a, b], "audit": grammar.audit(top, a, b)} for (a, b), c in sorted(m.cost.items())
        ]
    entry = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
    long, small = pa.int64(), pa.int32()
    columns = [
        pa.array([s.conv for s in pending], long), pa.array([part] * len(pending), small), pa.array(range(place, place + len(pending)), small),
        *(pa.array([getattr(s, n) for s in pending], long) for n in COUNTS),
        *(pa.array([getattr(s, n) for s in pending], k) for n, k in (("first_kind", small), ("last_kind", small), ("first_turn", long), ("last_turn", long))),
        pa.array([entries[bytes(s.symbols)] for s in pending], pa.list_(entry)),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def stretches(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """Solved stretches; ranges of (conversation, turn) are dealt, so a long conversation is in many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pending: list[Stretch] = []
        place = size = 0
        for b in batches:
            for conv, turn, kind, fault, copies in zip(*(b.column(i).to_pylist() for i in range(5))):
                while True:  # many copies of one row fill several stretches
                    if not pending or pending[-1].conv != conv or len(pending[-1].symbols) >= block:
                        if size >= PENDING:
                            yield solved(pending, part, place)
                            place += len(pending)
                            pending, size = [], 0
                        pending.append(Stretch(conv))
                    some = min(copies, block)
                    if some:
                        pending[-1].add(turn, kind, fault, some)
                    size += some
                    copies -= some
                    fault = "b" if fault == "b" else "d"
                    if not copies:
                        break
        if pending:
            yield solved(pending, part, place)

    dealt = found.repartitionByRange("conv_id", "turn", "role", "key").sortWithinPartitions("conv_id", "turn", "role", "key")
    return dealt.select("conv_id", "turn", "kind", "fault", "copies").mapInArrow(run, STRETCH)


CONVERSATION = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def concluded(parts: list[dict]) -> dict:
    """One conversation from its stretches, in order."""
    counts = {n: sum(p[n] for p in parts) for n in COUNTS}
    low = high = kind = None
    steps: list[dict[int, tuple[int, str]]] = []  # per stretch: state after it -> (state before it, audit)
    cost, rank = {START: 0}, {START: 0}
    for p in parts:
        if p["last_kind"] is not None:
            counts["illegal"] += kind is not None and (kind, p["first_kind"]) not in LEGAL
            kind = p["last_kind"]
        if p["first_turn"] is not None:
            counts["turns"] -= p["first_turn"] == high
            low, high = p["first_turn"] if low is None else low, p["last_turn"]
        if not p["entries"]:
            continue
        best: dict[int, tuple] = {}
        for e in p["entries"]:
            if e["before"] in cost:
                key = (cost[e["before"]] + e["cost"], rank[e["before"]], e["rank"], e["before"], e["audit"])
                if e["after"] not in best or key < best[e["after"]]:
                    best[e["after"]] = key
        order = {k: i for i, k in enumerate(sorted({k[1:3] for k in best.values()}))}
        steps.append({after: k[3:] for after, k in best.items()})
        cost, rank = {after: k[0] for after, k in best.items()}, {after: order[k[1:3]] for after, k in best.items()}
    state = min(cost, key=lambda s: (cost[s] + INSERT * len(TAILS[s]), rank[s], TAILS[s]))
    total, audit = cost[state] + INSERT * len(TAILS[state]), [TAILS[state]]
    for step in reversed(steps):
        state, letters = step[state]
        audit.append(letters)
    gaps = 0 if low is None else high - low + 1 - counts["turns"]
    return {"gaps": gaps, **counts, "cost": total, "audit": "".join(reversed(audit))}


def conversations_of(solved_stretches: DataFrame) -> DataFrame:
    """One row a conversation with its counts, cost and audit."""
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = [c.split(" ")[0] for c in CONVERSATION.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in slices(batches):
            yield from b.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv, parts in together(rows(batches)):
            out.append({"conv_id": conv, **concluded(parts)})
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names)

    dealt = solved_stretches.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return dealt.mapInArrow(run, CONVERSATION)


def together(rows: Iterable[dict]) -> Iterator[tuple[int | None, list[dict]]]:
    """Neighbours of one conversation."""
    parts: list[dict] = []
    for r in rows:
        if parts and parts[0]["conv_id"] != r["conv_id"]:
            yield parts[0]["conv_id"], parts
            parts = []
        parts.append(r)
    if parts:
        yield parts[0]["conv_id"], parts


# --- the repaired text --------------------------------------------------------


class Editor:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at = audit, 0
        self.turn = "user"  # whose turn it is

    def _next(self) -> str:
        role, self.turn = self.turn, "assistant" if self.turn == "user" else "user"
        return role

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def edits(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of inserts before a row and of the row itself."""
        yield from self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            yield "R", self._next(), text
        elif letter == "K":
            if not role.startswith("s"):
                self._next()
            yield "K", role, text
        else:
            yield "D", role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()


def _told(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation, in order, after its counts and audit; a conversation is in one partition."""
    none = lambda kind: F.lit(None).cast(kind)
    audits = found.select(
        "conv_id", F.array(*TOLD).alias("counts"), none("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("key"), F.col("audit").alias("text"), F.lit(1).alias("copies")
    )
    said = rows.where("copies > 0").select("conv_id", none("array<long>").alias("counts"), "turn", "role", text_key().alias("key"), "text", "copies")
    dealt = audits.unionByName(said).withColumn("row", F.col("counts").isNull())
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "key")
    return dealt.select("conv_id", "counts", "turn", "role", "text", "copies")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, edit, role, text) of every edit; a conversation begins with (conv_id, counts, '', '', audit)."""
    editor = conv = None
    for b in slices(batches):
        for conv_id, counts, turn, role, text, copies in zip(*(b.column(i).to_pylist() for i in range(6))):
            if counts is not None:
                if editor:
                    yield from ((conv, None, *e) for e in editor.end())
                editor, conv = Editor(text), conv_id
                yield conv, counts, "", "", text
                continue
            for _ in range(copies):
                yield from ((conv, turn, *e) for e in editor.edits(role, text))
    if editor:
        yield from ((conv, None, *e) for e in editor.end())


def edited_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text) of every edit, deleted rows among them."""
    names = ["conv_id", "place", "edit", "turn", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place = 0
        for conv, turn, edit, role, text in _edited(batches):
            if not edit:
                place = 0
                continue
            out.append((conv, place, edit, turn, role, text))
            place += 1
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return _told(rows, found).mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows in the form that ``damaged`` gives.

    Written once, as the rows' edits read it.
    """
    return materialise(conversations_of(materialise(stretches(symbols(rows), block), "repair-stretches")), "repair-audits")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation of ``audits`` with the digest of its repaired rows as lines ``role:text``."""
    names = ["conv_id", *TOLD, "audit", "repaired_sha256"]
    kinds = [pa.int64()] * (1 + len(TOLD)) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        digest, empty = hashlib.sha256(), True

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for conv, counts, edit, role, text in _edited(batches):
            if not edit:
                if out:
                    out[-1].append(digest.hexdigest())
                if len(out) == 1000:
                    yield told()
                    out = []
                out.append([conv, *counts, text])
                digest, empty = hashlib.sha256(), True
            elif edit != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if out:
            out[-1].append(digest.hexdigest())
            yield told()

    counts = ", ".join(f"{n} long" for n in TOLD)
    return _told(rows, found).mapInArrow(run, f"conv_id long, {counts}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every conversation with its counts, cost, audit and the digest of its repaired rows."""
    return digests(rows, audits(rows, block))
