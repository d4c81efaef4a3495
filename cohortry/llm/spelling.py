"""Spelling variants: words one inserted, deleted or replaced letter apart, found by dense tiles of block pairs.

Two words are one edit apart exactly if their common prefix and common suffix together reach the longer length
minus one. A tile holds two blocks of words as padded code-point matrices and computes both lengths for all its
pairs at once, column by column.

Blocks: let s be the shorter length of a pair and h = s // 2. One edit leaves the first h or the last h code points
of both words alone, so a pair meets in the block of its beginning or of its end; in both, only the first counts. A
block whose words would make more than ``TILE`` pairs is not paired out: its words are dealt again by the place of
the edit, all code points but that one being equal. Such a block holds at most one word of length s for each letter.
Every pair of near words is met exactly once, and a word sends on one row from each block it is in: its number of
near words there and the best of them. Nothing is capped.

Nulls: a null text has no words; a null id is written as the empty string where the contract names it. Repeated rows
count as often as they occur. Empty tables give no words. Texts are cut into words inside the JVM, and no column but
id and text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.llm.common import keep, text_of

#: The word pattern, the divisor of the contract's hash, least length and count, and the ratio of a form.
RUN = "[A-Za-zÀ-ÿ]+"
DIVISOR = 199
SHORTEST = 6
OFTEN = 5
RATIO = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of words that a block may make, and cells of a tile held at once.
TILE = 1 << 20
CELLS = 1 << 22
#: Blocks in an Arrow batch.
BATCH = 200
FRONT, BACK = 0, 1
_FOUND = "word string, n_near long, best_n long, best string"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns word, n: the runs of letters with the contract's deletions, long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(text_of(text), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).where(F.length("run") >= SHORTEST)
    code = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    size = F.length("run")
    at = (F.pmod(code, size.cast("bigint")) + 1).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at - 1), F.substring(F.col("run"), at + 1, size))
    words = each.select(F.when(F.pmod(code, F.lit(DIVISOR)) == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def _half(s: Column) -> Column:
    return F.floor(s / 2).cast("int")


def _dealt(words: DataFrame) -> DataFrame:
    """A row for each block of a word: key, s (the shorter length of its pairs), side, word, n."""
    size = F.length("word")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("s"))
    h = _half(F.col("s"))
    part = lambda side: F.substring(F.col("word"), F.lit(1), h) if side == FRONT else F.substring(F.col("word"), size - h + 1, h)
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.xxhash64(F.col("s"), F.lit(x), part(x)).alias("key")) for x in (FRONT, BACK)]))
    return both.select("word", "n", "s", sides.alias("b")).select("b.key", "s", "b.side", "word", "n")


def _sizes(rows: DataFrame) -> DataFrame:
    """Words of both lengths in each block that can make a pair."""
    short = F.length("word") == F.col("s")
    sizes = rows.groupBy("key").agg(F.count_if(short).alias("na"), F.count("*").alias("nb"))
    return sizes.where((F.col("na") > 0) & (F.col("nb") > 1))


def _by_place(rows: DataFrame) -> DataFrame:
    """The words of large blocks once for each place of the edit in the half that may differ."""
    size, h = F.length("word"), _half(F.col("s"))
    places = F.when(F.col("side") == FRONT, F.sequence(h, F.col("s") - 1)).otherwise(F.sequence(F.lit(0), F.greatest(h - 1, F.lit(0))))
    each = rows.select("key", "s", "side", "word", "n", F.explode(places).alias("at"))
    before, after = F.substring(F.col("word"), F.lit(1), F.col("at")), F.substring(F.col("word"), size - (F.col("s") - F.col("at") - 1) + 1, F.col("s"))
    return each.select(F.xxhash64("key", "at", before, after).alias("key"), "s", "side", "at", "word", "n")


def _matrix(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points from the front and from the back, padded with zero; a row for each place, a column for each word."""
    front, back = ("".join(x.ljust(width, "\0") for x in side) for side in (words, [w[::-1] for w in words]))
    kind, code = (np.uint8, "latin-1") if front.isascii() or max(front) < "\u0100" else (np.dtype("<u4"), "utf-32-le")
    return tuple(np.ascontiguousarray(np.frombuffer(x.encode(code), dtype=kind).reshape(len(words), width).T) for x in (front, back))


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of all pairs of two padded matrices; padding counts as equal."""
    same = np.ones((left.shape[1], right.shape[1]), dtype=bool)
    total = np.zeros(same.shape, dtype=np.int32)
    for a, b in zip(left, right):
        same &= a[:, None] == b[None, :]
        if not same.any():
            break
        total += same
    return total


def near_pairs(words: list[str], s: int, side: int | None = None, at: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one edit among words of length s and s + 1, i of length s, each once.

    ``side`` and ``at`` are those of the block: pairs that another block also meets are left to it.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    short = np.flatnonzero(sizes == s)
    front, back = _matrix(words, s + 1)
    step = max(1, int(CELLS // max(1, len(words))))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for lo in range(0, len(short), step):
        rows = short[lo : lo + step]
        ahead = np.minimum(_common(front[:, rows], front), s)
        behind = np.minimum(_common(back[:, rows], back), s)
        longer = np.maximum(s, sizes)[None, :]
        # two words of one length meet twice in the tile and are taken once; a word is not near itself
        near = (ahead + behind >= longer - 1) & ((sizes[None, :] > s) | (rows[:, None] < np.arange(len(words))[None, :]))
        if side is not None:
            near &= (ahead >= s // 2) == (side == FRONT)
        if at is not None:
            near &= np.minimum(ahead, s - 1) == at
        i, j = np.nonzero(near)
        found.append((rows[i], j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _best(words: list[str], counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """For every word of the pairs: number of near words and the one of largest count, smallest in code-point order."""
    order = np.array(sorted(range(len(words)), key=lambda k: (-counts[k], words[k])), dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    best = np.full(len(words), len(words), dtype=np.int64)
    np.minimum.at(best, a, rank[b])
    near = np.bincount(a, minlength=len(words))
    for k in np.flatnonzero(near):
        top = order[best[k]]
        yield words[k], int(near[k]), int(counts[top]), words[top]


def _tiles(blocks: DataFrame, placed: bool) -> DataFrame:
    """Near words inside each block of (key, s, side[, at], list of word and n)."""

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                words = list(row.words)
                i, j = near_pairs(words, row.s, row.side, row.at if placed else None)
                if len(i):
                    out.extend(_best(words, np.asarray(row.counts, dtype=np.int64), i, j))
            yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])

    lists = [F.col("members.word").alias("words"), F.col("members.n").alias("counts")]
    return blocks.select("s", "side", *["at"] * placed, *lists).mapInPandas(compare, _FOUND)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Columns word, n_near, best_n, best for words (word, n) that have a near word."""
    rows = keep(_dealt(words), "blocks")
    sizes = keep(_sizes(rows), "sizes")
    gather = F.collect_list(F.struct("word", "n")).alias("members")
    small, large = sizes.where(F.col("na") * F.col("nb") <= tile).select("key"), sizes.where(F.col("na") * F.col("nb") > tile).select("key")
    blocks = rows.join(small, "key", "left_semi").groupBy("key", "s", "side").agg(gather)
    again = _by_place(rows.join(large, "key", "left_semi"))
    placed = again.groupBy("key", "s", "side", "at").agg(F.count_if(F.length("word") == F.col("s")).alias("na"), gather).where((F.col("na") > 0) & (F.size("members") > 1))
    found = _tiles(blocks, False).union(_tiles(placed, True))
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Columns word, root of (word, form): forms are followed to the last by doubling; counts grow along them, so there is no ring."""
    ahead = keep(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = keep(ahead.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ahead


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n."""
    words = keep(word_counts(docs, doc_id, text), "words")
    near = near_words(words, tile)
    strong = F.col("best_n") >= RATIO * F.col("n")
    joined = keep(words.join(near, "word", "left").select("word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(strong, F.col("best_n")).alias("form_n")), "near", BATCH)
    last = roots(joined.where("form is not null").select("word", "form"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
