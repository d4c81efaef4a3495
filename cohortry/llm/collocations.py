"""Phrase collocations, counted in quotient filters of packed word numbers.

Texts are cut into pieces and words once, and written as shards: at most ``SHARD`` words of one language, coded by
the shard's own word list. Word counts are summed over the lists of all shards; words that are frequent enough for a
phrase get dense numbers, and each shard's list is joined with them. A word that is too rare for any candidate ends
a phrase like a piece border does, so nothing is lost by leaving it out.

A phrase of m words packs m numbers of b bits. A Feistel permutation of the packed value, which can be inverted,
spreads phrases evenly: its first bits name a part, the next ones the slot (quotient), and all others are kept in full
as the remainder. A shard's filter for a part stores the number of entries of each slot, the remainders in order, and
their counts; with slot and remainder the phrase is known exactly, so counts are exact at any size. The filters of
a part are merged in sorted order, one task for each part, and phrases are read back through the inverse. Parts are
as many as ``PART`` phrases each need. A very common phrase is one entry of each shard.

Results: pieces, words, counts, cuts and ranks are those of the contract; a piece that is longer than a shard is
carried over with its last two words. Products are decimals of 38 digits, which hold counts up to 1e15.

Nulls: a null language is ``und``, a null text empty. Repeated rows count as often as they occur. Empty tables give
no phrases. Only language and text are read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortry.llm.common import TEXT_BATCH, discard, keep

#: Least count of a candidate, share of a longer one that drops it (percent), score unit, rows a language.
LEAST = 10
SHARE = 50
UNIT = 1_000_000
TOP = 2000
UNKNOWN = "und"
#: Words of a shard, and phrases of a part of all filters (before equal ones are merged).
SHARD = 1 << 21
PART = 1 << 21
#: Ranked lists of a language that are cut to TOP before they meet.
SALTS = 16

_BORDER = b"\n"
_SPACE = re.compile(rb"[ \n]")
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\x09", _BORDER * 9 + b" ")
_SHARDS = "shard long, lang string, skip int, words array<binary>, counts array<long>, codes binary"
_SHARD_NAMES = ["shard", "lang", "skip", "words", "counts", "codes"]
_FILTERS = "size int, part int, filter binary"
_PHRASES = "g1 long, g2 long, g3 long, a long"
_ROUNDS = 4
#: Bits of a word's code in a shard, which holds fewer words than that even where a slice runs over.
CODE_BITS = 24


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Open:
    """The shard of one language that a task is filling."""

    def __init__(self, carried: list[bytes] = ()):  # type: ignore[assignment]
        self.numbers = _Numbers({b"": 0, _BORDER: 1})
        self.codes = [np.array([self.numbers[w] for w in carried], dtype=np.uint32)]
        self.skip = len(carried)

    def add(self, words: list[bytes]) -> int:
        """Codes the words and tells how many there are, borders included."""
        codes = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.uint32, count=len(words))
        codes = codes[codes > 0]
        self.codes.append(codes)
        return len(codes)

    def row(self, shard: int, lang: str) -> tuple:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes[self.skip :], minlength=len(self.numbers)).astype(np.int64)
        return shard, lang, self.skip, list(self.numbers)[2:], counts[2:], _narrow(codes, CODE_BITS)

    def tail(self) -> list[bytes]:
        """The last words of an open piece, at most two."""
        codes, words = np.concatenate(self.codes)[-2:], list(self.numbers)
        after = np.flatnonzero(codes == 1)
        return [words[c] for c in codes[after[-1] + 1 if len(after) else 0 :]]


def _slices(text: str, size: int) -> Iterator[list[bytes]]:
    """Words, piece borders and empty strings, lower-cased A-Z, of about ``size`` bytes of the text at a time."""
    raw = text.encode("utf-8", "replace").lower().translate(_CUTS)
    yield [_BORDER]
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + size)
        stop = end.start() if end else len(raw)
        yield raw[at:stop].replace(_BORDER, b" \n ").split(b" ")
        at = stop
    yield [_BORDER]


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SHARD) -> DataFrame:
    """Rows of about ``size`` words at most: shard, lang, skip (words carried over), words, counts, codes."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filling: dict[str, _Open] = {}
        held, made = 0, itertools.count(TaskContext.get().partitionId() << 32)
        for part in parts:
            for name, t in zip(part["lang"], part["text"]):
                for k, words in enumerate(_slices(t, size)):
                    if held >= size:
                        carried = filling[name].tail() if k else []
                        yield pd.DataFrame([x.row(next(made), y) for y, x in filling.items()], columns=_SHARD_NAMES)
                        filling, held = ({name: _Open(carried)} if carried else {}), 0
                    if name not in filling:
                        filling[name] = _Open()
                    held += filling[name].add(words)
        if filling:
            yield pd.DataFrame([x.row(next(made), y) for y, x in filling.items()], columns=_SHARD_NAMES)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, _SHARDS)


def vocabulary(words: DataFrame, least: int) -> DataFrame:
    """Columns lang, word, f, id for frequent words; ids are dense, from 1, and fixed once the table is written."""
    many = keep(words.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "frequent")
    placed = many.withColumn("place", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
    placed = keep(placed, "placed")
    discard(many)
    sizes = placed.groupBy("place").agg(F.count("*").alias("n"), F.min("nth").alias("first")).orderBy("place").collect()
    start, offsets = 1, []
    for r in sizes:
        offsets.append((r["place"], start - r["first"]))
        start += r["n"]
    shift = placed.sparkSession.createDataFrame(offsets, "place int, shift long")
    return placed.join(shift, "place").select("lang", "word", "f", (F.col("nth") + F.col("shift")).alias("id"))


class Permutation:
    """Feistel network over packed phrases of ``m`` numbers of ``bits`` bits, as two halves of equal width."""

    def __init__(self, m: int, bits: int):
        self.m, self.bits = m, bits
        self.width = -(-m * bits // 2)
        if self.width > 63:
            raise ValueError("numbers of more than 42 bits")
        self.mask = np.uint64((1 << self.width) - 1)

    def _mix(self, x: np.ndarray, turn: int) -> np.ndarray:
        x = (x + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def pack(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Permuted halves of phrases given as one array for each place."""
        hi, lo = np.zeros(len(numbers[0]), dtype=np.uint64), np.zeros(len(numbers[0]), dtype=np.uint64)
        for g in numbers:
            hi = ((hi << np.uint64(self.bits)) | (lo >> np.uint64(self.width - self.bits))) & self.mask
            lo = ((lo << np.uint64(self.bits)) | g.astype(np.uint64)) & self.mask
        for turn in range(_ROUNDS):
            hi, lo = lo, hi ^ self._mix(lo, turn)
        return hi, lo

    def unpack(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        for turn in reversed(range(_ROUNDS)):
            hi, lo = lo ^ self._mix(hi, turn), hi
        out = []
        for _ in range(self.m):
            out.append((lo & np.uint64((1 << self.bits) - 1)).astype(np.int64))
            lo = (lo >> np.uint64(self.bits)) | ((hi << np.uint64(self.width - self.bits)) & self.mask)
            hi = hi >> np.uint64(self.bits)
        return out[::-1]


def _summed(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct halves in order, with their summed counts."""
    if not len(hi):
        return hi, lo, np.empty(0, dtype=np.int64)
    if 2 * width <= 64:
        keys, where = np.unique((hi << np.uint64(width)) | lo, return_inverse=True) if counts is not None else np.unique((hi << np.uint64(width)) | lo, return_counts=True)
        total = np.zeros(len(keys), dtype=np.int64) if counts is not None else where.astype(np.int64)
        if counts is not None:
            np.add.at(total, where, counts)
        return keys >> np.uint64(width), keys & np.uint64((1 << width) - 1), total
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.ones(len(hi), dtype=bool)
    first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    at = np.flatnonzero(first)
    total = np.add.reduceat(counts[order], at) if counts is not None else np.diff(np.append(at, len(hi)))
    return hi[at], lo[at], total.astype(np.int64)


def _narrow(values: np.ndarray, bits: int) -> bytes:
    """Values of at most ``bits`` bits in whole bytes, little-endian."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _wide(raw: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : -(-bits // 8)] = np.frombuffer(raw, dtype=np.uint8).reshape(n, -1)
    return out.view("<u8")[:, 0].astype(np.uint64)


def encode_filter(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, width: int, part_bits: int) -> bytes:
    """A part's filter: entries per slot, remainders (rest of the first half, whole second half) and counts.

    ``hi``, ``lo`` are sorted and share the first ``part_bits`` bits of ``hi``. There is about a slot for each entry.
    """
    slots = min(width - part_bits, max(0, int(len(hi)).bit_length() - 1))
    rest = width - part_bits - slots
    inner = hi & np.uint64((1 << (width - part_bits)) - 1)
    runs = np.bincount((inner >> np.uint64(rest)).astype(np.int64), minlength=1 << slots)
    run_bits, count_bits = (max(1, int(x.max()).bit_length()) for x in (runs, counts))
    head = np.array([len(hi), slots, run_bits, count_bits], dtype="<u8").tobytes()
    return head + _narrow(runs, run_bits) + _narrow(inner & np.uint64((1 << rest) - 1), rest) + _narrow(lo, width) + _narrow(counts, count_bits)


def decode_filter(raw: bytes, part: int, width: int, part_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, slots, run_bits, count_bits = (int(x) for x in np.frombuffer(raw[:32], dtype="<u8"))
    rest, at, columns = width - part_bits - slots, 32, []
    for bits, size in ((run_bits, 1 << slots), (rest, n), (width, n), (count_bits, n)):
        stop = at + -(-bits // 8) * size
        columns.append(_wide(raw[at:stop], bits, size) if bits else np.zeros(size, dtype=np.uint64))
        at = stop
    slot = np.repeat(np.arange(1 << slots, dtype=np.uint64), columns[0].astype(np.int64))
    hi = (np.uint64(part) << np.uint64(width - part_bits)) | (slot << np.uint64(rest)) | columns[1]
    return hi, columns[2], columns[3].astype(np.int64)


def merge_filters(filters: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted filter of all, equal phrases summed."""
    hi, lo, counts = (np.concatenate(x) for x in zip(*filters))
    return _summed(hi, lo, counts, width)


def _phrases(numbers: np.ndarray, m: int, skip: int) -> list[np.ndarray]:
    """The phrases of ``m`` frequent words in a row; those that lie in the carried words were counted before."""
    n = len(numbers) - m + 1
    if n <= 0:
        return [np.empty(0, np.int64)] * m
    whole = np.ones(n, dtype=bool)
    for k in range(m):
        whole &= numbers[k : n + k] > 0
    whole[: max(0, skip - m + 1)] = False
    return [numbers[k : n + k][whole] for k in range(m)]


def _filters(codes: DataFrame, numbers: DataFrame, bits: int, part_bits: dict[int, int]) -> DataFrame:
    """Filters of every shard: size (words of a phrase), part, filter."""

    def count(shard: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in shard.itertuples(index=False):
            local = _wide(row.codes, CODE_BITS, len(row.codes) // (CODE_BITS // 8)).astype(np.int64)
            ids = np.zeros(int(local.max(initial=0)) + 1, dtype=np.int64)
            at = known["code"].to_numpy()
            ids[at[at < len(ids)]] = known["id"].to_numpy()[at < len(ids)]
            here = ids[local]
            for m, p in part_bits.items():
                perm = Permutation(m, bits)
                hi, lo, n = _summed(*perm.pack(_phrases(here, m, row.skip)), None, perm.width)
                part = (hi >> np.uint64(perm.width - p)).astype(np.int64)
                edges = np.flatnonzero(np.diff(part, prepend=-1))
                for a, b in zip(edges, np.append(edges[1:], len(part))):
                    out.append((m, int(part[a]), encode_filter(hi[a:b], lo[a:b], n[a:b], perm.width, p)))
        return pd.DataFrame(out, columns=["size", "part", "filter"])

    return codes.withColumnRenamed("shard", "of_shard").groupBy("of_shard").cogroup(numbers.groupBy("shard")).applyInPandas(count, _FILTERS)


def _merged(filters: DataFrame, bits: int, part_bits: dict[int, int], least: int) -> DataFrame:
    """Phrases of all parts with at least ``least`` occurrences; g3 is null for two words."""

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple] = {}
        for part in parts:
            for row in part.itertuples(index=False):
                perm = Permutation(row.size, bits)
                key = (row.size, row.part)
                if key not in held and held:
                    yield phrases(*held.popitem())
                held.setdefault(key, ([], [0, 0]))
                waiting, n = held[key]
                waiting.append(decode_filter(row.filter, row.part, perm.width, part_bits[row.size]))
                n[0] += len(waiting[-1][0])
                if n[0] > 2 * n[1] + (1 << 16):  # merge when the waiting entries have doubled
                    waiting[:] = [merge_filters(waiting, perm.width)]
                    n[0] = n[1] = len(waiting[0][0])
        while held:
            yield phrases(*held.popitem())

    def phrases(key: tuple[int, int], state: tuple) -> pd.DataFrame:
        perm = Permutation(key[0], bits)
        hi, lo, n = merge_filters(state[0], perm.width)
        often = n >= least
        ids = perm.unpack(hi[often], lo[often])
        third = pd.array(ids[2], dtype="Int64") if len(ids) > 2 else pd.array([None] * len(ids[0]), dtype="Int64")
        return pd.DataFrame({"g1": ids[0], "g2": ids[1], "g3": third, "a": n[often]})

    return filters.repartition("size", "part").sortWithinPartitions("size", "part").mapInPandas(merge, _PHRASES)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shard: int = SHARD, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of two words, candidates of three words, and the number of words of each language.

    Every part of a candidate is frequent too, so three words find their parts among the pairs.
    """
    if 2 * shard >= 1 << CODE_BITS:
        raise ValueError(f"shards are limited to {1 << CODE_BITS - 1} words")
    cut = keep(shards(docs, text, lang, shard), "shards", TEXT_BATCH)
    zipped = F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("f"))).alias("nth", "w")
    listed = cut.select("shard", "lang", zipped).select("shard", "lang", (F.col("nth") + 2).alias("code"), F.col("w.word").alias("word"), F.col("w.f").alias("f"))
    known = keep(vocabulary(listed.select("lang", "word", "f"), least), "vocabulary")
    sizes = keep(cut.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n")), "sizes")
    bits = max(1, int(known.agg(F.max("id").alias("top")).first()["top"] or 0).bit_length())
    parts = int((sizes.agg(F.sum("n").alias("n")).first()["n"] or 0) // part).bit_length()
    part_bits = {m: min(parts, Permutation(m, bits).width) for m in (2, 3)}
    numbers = listed.join(known.select("lang", "word", "id"), ["lang", "word"]).select("shard", "code", "id")
    filters = _filters(cut.select("shard", "skip", "codes"), numbers, bits, part_bits)
    found = keep(_merged(filters, bits, part_bits, least), "phrases")
    discard(cut)
    word = lambda k: known.select(F.col("id").alias(f"g{k}"), F.col("word").cast("string").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    two = found.where("g3 is null").select("g1", "g2", "a")
    two = keep(two.join(word(1).join(known.select(F.col("id").alias("g1"), "lang"), "g1"), "g1").join(word(2), "g2"), "pairs")
    front = two.select("g1", "g2", "lang", "w1", "w2", "f1", F.col("a").alias("f12"))
    back = two.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    three = keep(found.where("g3 is not null").join(front, ["g1", "g2"]).join(back, ["g2", "g3"]), "triples")
    return two, three, sizes


_CUT = "cast(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * {unit}BD div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0))) as bigint)"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, shard: int = SHARD, part: int = PART) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    two, three, sizes = phrases(docs, text, lang, least, shard, part)
    score = lambda left, right: F.expr(_CUT.format(unit=UNIT, l=left, r=right))
    longer = three.select(F.explode(F.array(F.struct("g1", "g2"), F.struct(F.col("g2").alias("g1"), F.col("g3").alias("g2")))).alias("p"), "a").groupBy("p.g1", "p.g2").agg(F.max("a").alias("longest"))
    free = two.join(longer, ["g1", "g2"], "left").where(F.coalesce(100 * F.col("longest") < SHARE * F.col("a"), F.lit(True)))
    cut_two = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    scored = three.select("*", score("f1", "f23").alias("s1"), score("f12", "f3").alias("s2"))
    late = F.col("s2") < F.col("s1")
    pick = lambda early, other: F.when(late, F.col(other)).otherwise(F.col(early))
    cut_three = scored.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), pick("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = cut_two.union(cut_three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
