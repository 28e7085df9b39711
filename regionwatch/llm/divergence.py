"""Source divergence: how far the term shares of a language's sources lie apart, and which terms a source overuses.

The count matrix of a language has a row for each source and a column for each kept term. It is cut into tiles of ROWS
sources and about COLUMNS terms, and a task holds the tiles of two blocks of sources over one block of terms. Each tile
is a k-squared tree of which only the quadrants with a count are kept. Both trees are walked jointly, level by level: a
quadrant that is empty in both is priced at once, its width times the distance of two zero counts, for all pairs of its
sources; others are opened, and single cells with a count on either side are compared. Tiles give partial sums a pair of
sources, which are added exactly.

Defined results: a null text, lang or source is ''; a text without terms still makes its group occur; a language with
one source has no pairs; repeated rows count each; an empty table gives an empty one; other columns are not looked at.
Shares are exact in long integers: products are made in decimals. A language's sources are compared in pairs, as the
result has a row for each pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, slices

MIN_DOCS = 30  # documents of its language that a kept term is in
SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50
K = 2  # quadrants a side
ROWS = 32  # sources of a tile; a power of K
COLUMNS = 512  # terms of a tile, about; tiles are padded to a power of K
HELD = 300_000  # distinct terms of all groups that a task counts before it lets them go

#: Lower-cases A-Z and makes every other ASCII character a blank.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of every group and term; term '' stands for the group itself.

    Tasks count before anything is shuffled, so a hot source or term sends a row a task.
    """
    names = ["lang", "source", "term", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, within) in groups.items():
                k = len(count) + 1
                columns = [[lang] * k, [source] * k, [b"", *count], [0, *count.values()], [0, *(within[t] for t in count)]]
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            groups.clear()

        for b in slices(batches):
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                count, within = groups.setdefault((lang, source), (Counter(), Counter()))
                terms = _terms(text)
                count.update(terms)
                within.update(set(terms))
            if sum(len(c) for c, _ in groups.values()) + len(groups) > HELD:
                yield from counted()
        yield from counted()

    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    partial = docs.select(known("lang"), known("source"), known("text")).mapInArrow(run, "lang string, source string, term binary, count long, docs long")
    # one exchange serves the sums here and those over a language's sources
    dealt = partial.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """Counts of kept terms with ``all`` of the language and ``first`` on one row a term, and the rows of term ''."""
    of_term = Window.partitionBy("lang", "term")
    wide = counts.withColumns(
        {
            "in_docs": F.sum("docs").over(of_term),
            "all": F.sum("count").over(of_term),
            "first": F.row_number().over(of_term.orderBy("source")) == 1,
        }
    )
    return wide.where((F.col("in_docs") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "count", "all", "first")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly; null where no term is kept."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTH)
    return F.call_function("div", above, F.nullif(wide(total + terms * SMOOTH), F.lit(0).cast("decimal(19,0)"))) + 1


# --- the trees ----------------------------------------------------------------


def levels(cells: np.ndarray, rows: int, columns: int) -> list[np.ndarray]:
    """Occupied quadrants of each level as flags, from single cells up to the quadrant that holds the whole tile."""
    out = [cells]
    while rows > 1 or columns > 1:
        high, wide = min(K, rows), min(K, columns)
        rows, columns = rows // high, columns // wide
        out.append(out[-1].reshape(rows, high, columns, wide).any(axis=(1, 3)))
    return out


def padded(n: int) -> int:
    side = 1
    while side < n:
        side *= K
    return side


def joint_distances(
    left: np.ndarray, right: np.ndarray, left_zero: np.ndarray, right_zero: np.ndarray, width: int, same: bool = False
) -> np.ndarray:
    """Sums of distances between the rows of two tiles of shares, -1 where the count is 0.

    ``left_zero`` and ``right_zero`` are the shares of a zero count, a row each; ``width`` columns are real. If both
    tiles are the same, only pairs above the diagonal are summed.
    """
    one, two = (levels(t >= 0, *t.shape) for t in (left, right))
    rows, columns = left.shape
    total = np.zeros((rows, rows), np.int64)
    empty = np.zeros((1, 1), np.int64)  # columns in which both are empty, by pair of row blocks
    a = b = c = np.zeros(1, np.int64)
    for depth in range(len(one) - 1, -1, -1):
        occupied = one[depth][a, c] | two[depth][b, c]
        span = columns // one[depth].shape[1]
        plain = ~occupied
        begin = c[plain] * span
        np.add.at(empty, (a[plain], b[plain]), np.clip(width - begin, 0, span))
        a, b, c = a[occupied], b[occupied], c[occupied]
        if depth:
            below = one[depth - 1]
            high, wide = below.shape[0] // one[depth].shape[0], below.shape[1] // one[depth].shape[1]
            x, y, z = (v.ravel() for v in np.meshgrid(np.arange(high), np.arange(high), np.arange(wide), indexing="ij"))
            a, b, c = ((v[:, None] * f + o[None, :]).ravel() for v, f, o in ((a, high, x), (b, high, y), (c, wide, z)))
            if same:
                upper = a <= b
                a, b, c = a[upper], b[upper], c[upper]
            empty = empty.repeat(high, 0).repeat(high, 1)
    p, q = left[a, c], right[b, c]
    apart = np.abs(np.where(p < 0, left_zero[a], p) - np.where(q < 0, right_zero[b], q))
    np.add.at(total, (a, b), apart)
    return total + empty * np.abs(left_zero[:, None] - right_zero[None, :])


def _tile_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one pair of source blocks over one block of terms; rows of term '' list the sources.

    Terms that stand in neither block are no columns here: ``width`` says how many are, ``zero`` what another one adds.
    """
    lang, upper, lower = pdf["lang"].iloc[0], pdf["upper"].iloc[0], pdf["lower"].iloc[0]
    heads, cells = pdf[pdf["term"] == ""], pdf[pdf["term"] != ""]
    column, terms = pd.factorize(cells["term"])
    columns = padded(max(1, len(terms)))
    zero, tiles, names = {}, {}, {}
    for block in {upper, lower}:
        head = heads[heads["block"] == block].sort_values("source")
        names[block] = head["source"].to_numpy()
        zero[block] = head["p"].to_numpy(np.int64)
        here = (cells["block"] == block).to_numpy()
        tile = np.full((padded(max(1, len(head))), columns), -1, np.int64)
        row = pd.Index(names[block]).get_indexer(cells["source"][here])
        tile[row, column[here]] = cells["p"].to_numpy(np.int64)[here]
        tiles[block] = tile
    high = max(t.shape[0] for t in tiles.values())
    for block in tiles:
        tiles[block] = np.pad(tiles[block], ((0, high - tiles[block].shape[0]), (0, 0)), constant_values=-1)
        zero[block] = np.pad(zero[block], (0, high - len(zero[block])))
    sums = joint_distances(tiles[upper], tiles[lower], zero[upper], zero[lower], len(terms), upper == lower)
    i, j = np.meshgrid(np.arange(len(names[upper])), np.arange(len(names[lower])), indexing="ij")
    wanted = (i < j) if upper == lower else np.ones_like(i, bool)
    i, j = i[wanted], j[wanted]
    apart = np.abs(zero[upper][i] - zero[lower][j])
    return pd.DataFrame({"lang": lang, "source": names[upper][i], "item": names[lower][j], "value": sums[i, j], "width": len(terms), "zero": apart})


def pair_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of both orders of every two sources of a language.

    cells: (lang, source, term, p) of counted terms; groups: (lang, source, p, terms, sources), p that of a zero count.
    """
    row_block = F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / ROWS)).alias("block")
    column_blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / COLUMNS)).cast("long")
    blocks = F.ceil(F.col("sources") / ROWS).cast("long")
    heads = groups.select(
        "lang", "source", F.lit("").alias("term"), "p", row_block, blocks.alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), column_blocks - 1)).alias("part")
    )
    sized = groups.select("lang", "source", "terms", "sources")
    found = cells.join(sized, ["lang", "source"]).select(
        "lang", "source", "term", "p", row_block, blocks.alias("blocks"), F.pmod(F.xxhash64("term"), column_blocks).alias("part")
    )
    both = heads.unionByName(found).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = both.select("lang", "source", "term", "p", "block", "part", F.least("block", "other").alias("upper"), F.greatest("block", "other").alias("lower"))
    partial = met.groupBy("lang", "part", "upper", "lower").applyInPandas(
        _tile_sums, "lang string, source string, item string, value long, width long, zero long"
    )
    sums = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("width").alias("width"), F.first("zero").alias("zero"))
    of_lang = groups.groupBy("lang").agg(F.first("terms").alias("terms"))
    sums = sums.join(of_lang, "lang").select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("width")) * F.col("zero")).alias("value"))
    return sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms a source overuses."""
    kept = materialise(kept_terms(term_counts(docs), min_docs), "divergence")
    is_term = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang").agg(
        F.sum("count").alias("lang_total"),
        F.count_if(is_term & F.col("first")).alias("terms"),
        F.count_if(~is_term).alias("sources"),
    )
    groups = groups.join(langs, "lang")
    groups = materialise(groups.withColumn("p", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))), "divergence-groups")
    cells = kept.where(is_term).join(groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    cells = cells.select(
        "lang", "source", "term",
        share(F.col("count"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    pairs = pair_distances(cells.drop("q"), groups.select("lang", "source", "p", "terms", "sources"))
    over = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(over.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
