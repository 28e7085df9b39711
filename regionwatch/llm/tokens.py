"""Token counts by rank-synchronous merging of ragged numpy arrays, for a word-level BPE vocabulary file.

The file names its merges in rank order. A batch of pre-tokens is one flat array of symbols with an owner for each;
in each round every pre-token applies its own lowest-ranked pair at all its places at once, left to right without
overlap, until no pair is left. What survives is counted. A merge's product is first used by a later merge (checked
when the file is read), so this gives what merging one pair at a time gives.

Text is cut where no token can span, and each distinct piece is counted once a worker: a bounded table keeps the
counts of pieces seen before.

Defined results: a null text is empty and has 0 bytes and tokens; repeated rows and null ids pass through; an empty
table gives an empty one; other columns are not looked at. The strings of special tokens inside a text count as that
one token, the library's default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

CONTEXT = 2048
#: Pieces of text whose counts a worker remembers; the table starts anew beyond it.
REMEMBERED = 800_000
#: Bytes of pre-tokens merged at a time, unless one is longer.
MERGED_AT_A_TIME = 1 << 20
NEVER = np.int64(1) << 40

#: Unicode's White_Space.
SPACE = "\t-\r \\x85\\xa0  -     　"


def unknown_letters(path: str) -> str:
    """Letters and numbers of the regex library's Unicode that the file's own pre-tokenizer does not know, as ranges
    for a pattern. Only what Python's older tables lack can be among them."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    found = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
    unknown = {ord(c) for c in found if unicodedata.category(c) == "Cn" and len(split("!" + c)) == 1}
    starts, ends = (sorted(c for c in unknown if c + step not in unknown) for step in (-1, 1))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def pre_token_pattern(path: str) -> regex.Pattern:
    """The file format's fixed pattern for pre-tokens, with the letters and numbers that it knows."""
    less = f"--[{unknown}]" if (unknown := unknown_letters(path)) else ""
    return regex.compile(
        rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}{less}]+|[\p{{N}}{less}]|[^{SPACE}[\p{{L}}{less}][\p{{N}}{less}]]+"
    )


#: Begins with what is rare, so a search skips to it.
STOP_AFTER_LETTER = re.compile(rb"[.,](?<=[a-z][.,])(?=[ \n])")


def text_pieces(raw: bytes) -> list[bytes]:
    """Cuts a text where the pre-token pattern always cuts: at ASCII white space, and before one stop between a
    letter and white space. Case goes here already, but for texts that may hold special tokens."""
    return (raw if b"<|" in raw else STOP_AFTER_LETTER.sub(rb" \g<0>", raw.lower())).split()


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Vocabulary:
    """Merges as sorted arrays of pairs, with rank and product."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        symbols = byte_symbols()
        self.pattern = pre_token_pattern(path)
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + end] for s in symbols], np.int64)
        self.size = max(ids.values()) + 1
        pairs = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        products = np.array([ids[a + b] for a, b in merges], np.int64)
        born = {ids[a + b]: i for i, (a, b) in enumerate(merges)}
        if len(born) < len(merges) or any(born.get(ids[x], -1) >= i for i, m in enumerate(merges) for x in m):
            raise ValueError("a product must come from one merge and be used by later ones only")
        order = np.argsort(pairs)
        self.pairs, self.ranks, self.products = pairs[order], order.astype(np.int64), products[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NEVER if it has none, and the symbol that it becomes."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], NEVER), self.products[at]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merged(vocab: Vocabulary, pre_tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that survive, pre-token after pre-token, and how many each has; no pre-token is empty."""
    lengths = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
    raw = np.frombuffer(b"".join(pre_tokens), np.uint8)
    symbols = vocab.inner[raw]
    ends = np.cumsum(lengths) - 1
    symbols[ends] = vocab.last[raw[ends]]
    owner = np.repeat(np.arange(len(pre_tokens)), lengths)
    ready: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank, product = vocab.find(symbols, np.r_[symbols[1:], 0])
        rank[np.r_[starts[1:], len(symbols)] - 1] = NEVER  # no pair goes beyond its pre-token
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        done = np.repeat(best == NEVER, sizes)
        ready.append((owner[done], symbols[done]))
        # x x x: neighbouring hits overlap; every second one of a run, from its start, is applied
        at = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank < NEVER))
        fresh = np.r_[True, np.diff(at) > 1]
        run = at[fresh][np.cumsum(fresh) - 1] if len(at) else at
        at = at[(at - run) % 2 == 0]
        symbols[at] = product[at]
        keep = ~done
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    owner, symbols = (np.concatenate(x) for x in zip(*ready)) if ready else (owner, symbols)
    return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pre_tokens))


#: Lower case of letters that came with Unicode 16 and 17, for an older table in Python.
LATER_LOWER = {0xA7CB: 0x264, 0xA7DC: 0x19B, **{c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}}
LATER_LOWER |= {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}


def normal(piece: str) -> str:
    """NFC and lower case letter by letter, without rules that look at neighbours."""
    piece = unicodedata.normalize("NFC", piece)
    if not piece.isascii():
        piece = piece.translate(LATER_LOWER)
    return piece.lower() if "Σ" not in piece else "".join(map(str.lower, piece))


def pre_tokens_of(vocab: Vocabulary, piece: str) -> list[str]:
    """A piece of letters alone is one pre-token; any other is split by the pattern."""
    piece = normal(piece)
    return [piece] if piece.isalpha() else vocab.pattern.findall(piece)


def encoded_pieces(vocab: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces without special tokens, piece after piece, and how many each has."""
    ids: list[np.ndarray] = []
    sizes = np.zeros(len(pieces), np.int64)
    held: list[bytes] = []
    of: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            symbols, counts = merged(vocab, held)
            ids.append(symbols.astype(np.uint32))
            np.add.at(sizes, of, counts)
            held.clear()
            of.clear()
            size = 0

    for i, raw in enumerate(pieces):
        if raw.isalpha() and raw.islower():
            tokens = (raw,)
        else:
            tokens = [t.encode("utf-8", "surrogatepass") for t in pre_tokens_of(vocab, raw.decode("utf-8", "surrogatepass"))]
        for t in tokens:
            if size + len(t) > MERGED_AT_A_TIME:
                flush()
            held.append(t)
            of.append(i)
            size += len(t)
    flush()
    return np.concatenate([np.zeros(0, np.uint32), *ids]), sizes


def count_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[int]:
    """Tokens of each piece of text; a special token's string is one."""
    parts: list[bytes] = []
    of: list[int] = []
    counts = np.zeros(len(pieces), np.int64)
    for i, raw in enumerate(pieces):
        if b"<|" in raw:
            cut = vocab.cut.split(raw.decode("utf-8", "surrogatepass"))
            counts[i] += len(cut) - 1
            parts += [c.encode("utf-8", "surrogatepass") for c in cut]
            of += [i] * len(cut)
        else:
            parts.append(raw)
            of.append(i)
    np.add.at(counts, of, encoded_pieces(vocab, parts)[1])
    return counts.tolist()


class Counter:
    """Counts tokens of texts, remembering pieces."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.known: dict[bytes, int] = {}

    def counts(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Bytes and tokens of each text."""
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        pieces = [text_pieces(r) for r in raw]
        new = list({p for ps in pieces for p in ps if p not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({p for ps in pieces for p in ps})
        self.known.update(zip(new, count_pieces(self.vocab, new)))
        tokens = [sum(map(self.known.__getitem__, ps)) for ps in pieces]
        return list(map(len, raw)), tokens


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = CONTEXT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size, tokens = counter(path).counts(b.column(1).to_pylist())
            over = [n > limit for n in tokens]
            columns = [b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
