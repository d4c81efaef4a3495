"""Removal of long byte strings that occur more than once, across documents and within one.

A byte goes if some ``WINDOW``-byte string that covers it also starts elsewhere. Instead of sorting all
suffixes, equal windows are found in exact steps that each shrink the data:

1. The pick of a window is the least hash among its ``GRAM``-byte strings. Equal windows have equal picks in
   the same place, and neighbouring windows mostly share one, so a text is a short list of runs of windows with
   the same pick (about one for 185 bytes). Runs whose pick occurs in one place only hold no repeated window.
2. A remaining run whose whole text occurs elsewhere as a run is repeated throughout.
3. The other runs are cut into blocks of ``BLOCK`` windows by the distance to the pick. Blocks whose common
   text occurs once hold no repeated window; those whose whole text occurs elsewhere as a block are repeated
   throughout.
4. The windows of what is left, at the ends of repeated passages, are hashed one by one and counted.

Grouped minima and maxima of places tell "occurs twice" and combine before the shuffle, so a passage in
millions of documents costs one row a task. Windows are compared by pick and a second 64-bit hash.

The Burrows-Wheeler form of this job is ``bwt.py``; the README has its figures and why it is not used here.

Nulls: a null text is empty; texts under ``WINDOW`` bytes lose nothing. Copies of a whole text (of WINDOW
bytes or more) lose all of it, repeated rows included. Null ids are kept. Empty tables give empty results.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.llm.common import keep, text_of

WINDOW = 400
GRAM = 32
BLOCK = 16
_SLICE = 1 << 20
_RNG = np.random.default_rng(5)
_TABLE = _RNG.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Low bits of a hash that give way to the place of its gram within a slice.
_PLACE = np.uint64((1 << 21) - 1)
_BACK = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse, modulo 2**64, up to a length seen."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(size, b, dtype=np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _BACK))
        return self.up, self.down


_POWERS = Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Prefix sums of a byte string that give the hash of any part of it."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _POWERS.upto(len(raw))
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[raw] * self.up[: len(raw)], out=self.sums[1:])

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(a)
    full = np.full(-(-n // width) * width, np.iinfo(a.dtype).max, dtype=a.dtype)
    full[:n] = a
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pick, hash of the whole text, first and last window and place of the pick of every run.

    The pick of a window is its leftmost gram of least leading hash bits; slices bound the memory of long texts.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    out = []
    for lo in range(0, len(data) - window + 1, _SLICE):
        part = data[lo : lo + _SLICE + window - 1]
        hashed = Hashed(part)
        grams = hashed.grams(gram)
        order = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(order, window - gram + 1) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        at = place[first]
        out.append((grams[at], hashed.parts(first, last + window), first + lo, last + lo, at + lo))
    if not out:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def blocks_of(raw: bytes, first: np.ndarray, last: np.ndarray, place: np.ndarray, pick: np.ndarray, window: int = WINDOW, step: int = BLOCK) -> tuple[np.ndarray, ...]:
    """Key, hash of the whole text, first and last window of the blocks of the given runs.

    A block holds the windows whose distance to their pick falls into one stretch of ``step``. The text that all
    windows of the stretch share is the same wherever one of them occurs, so it makes the key with the pick.
    """
    low, high = (place - last) // step, (place - first) // step
    count = high - low + 1
    run = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + low[run]
    top = place[run] - nth * step
    begin, end = np.maximum(first[run], top - step + 1), np.minimum(last[run], top)
    # hashed from a slice's own start, which the hash of a part does not depend on
    data, key, whole = np.frombuffer(raw, dtype=np.uint8), np.zeros(len(run), np.uint64), np.zeros(len(run), np.uint64)
    for lo in range(0, len(data), _SLICE):
        mine = np.flatnonzero((begin >= lo) & (begin < lo + _SLICE))
        if len(mine):
            hashed = Hashed(data[lo : lo + _SLICE + 2 * window + step])
            key[mine] = hashed.parts(top[mine] - lo, top[mine] - step + 1 + window - lo)
            whole[mine] = hashed.parts(begin[mine] - lo, end[mine] + window - lo)
    key = _mixed(key ^ _mixed(pick[run] + nth.astype(np.uint64)))
    return key, whole, begin, end


def window_hashes(raw: bytes, first: np.ndarray, last: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window of the given runs."""
    data = np.frombuffer(raw, dtype=np.uint8)
    at, codes = [], []
    for lo in range(0, len(data) - window + 1, _SLICE):
        hi = min(lo + _SLICE, len(data) - window + 1)
        mine = [np.arange(max(a, lo), min(b + 1, hi)) for a, b in zip(first.tolist(), last.tolist(), strict=True) if a < hi and b >= lo]
        if mine:
            starts = np.concatenate(mine)
            at.append(starts)
            codes.append(Hashed(data[lo : hi + window - 1]).parts(starts - lo, starts - lo + window))
    return (np.concatenate(at), np.concatenate(codes)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def cut(raw: bytes, first: np.ndarray, last: np.ndarray, window: int = WINDOW) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs and the SHA-256 of the rest, when the given windows are repeated."""
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
    rest = np.frombuffer(raw, dtype=np.uint8)[~gone]
    return int(gone.sum()), spans, hashlib.sha256(rest.tobytes()).hexdigest()


def _key() -> list[Column]:
    """Two independent 64-bit hashes that stand for a text."""
    text = text_of("text")
    return [F.xxhash64(text).alias("b1"), F.xxhash64(F.lit(1), text).alias("b2")]


def _twice(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Keys with the smallest and largest of their places."""
    return rows.groupBy(*keys).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))


def _busy(rows: DataFrame) -> DataFrame:
    """Rows whose key occurs in two places, without repeats; ``full`` if their whole text does as well.

    ``look`` marks rows to look into: all that are not full, and one of each full text whose key also has a row
    that is not, for that row to be compared with.
    """
    place = F.xxhash64("b1", "b2", "first")
    whole = keep(_twice(rows, ["key", "whole"], place), "whole")
    full = F.col("lo") != F.col("hi")
    keys = whole.groupBy("key").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.bool_or(~full).alias("mixed")).where("least <> most")
    busy = keep(whole.join(keys, "key").select("key", "whole", full.alias("full"), F.when(F.col("mixed"), F.col("lo")).alias("shown")), "busy")
    look = ~F.col("full") | F.coalesce(F.col("shown") == place, F.lit(False))
    return keep(rows.join(busy, ["key", "whole"]).withColumn("look", look).drop("whole", "shown").distinct(), "marked")


def _frames(found: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))


def _collect(texts: DataFrame, names: list[str], make) -> DataFrame:
    """Apply ``make(bytes, row)``, which gives equally long arrays, to every text; adds b1 and b2."""
    columns = ["b1", "b2", *names]

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            found, size = [], 0
            for row in frame.itertuples(index=False):
                arrays = make((row.text or "").encode("utf-8", "replace"), row)
                n = len(arrays[0])
                if n:
                    found.append((np.full(n, row.b1), np.full(n, row.b2), *(a.view(np.int64) for a in arrays)))
                    size += n
                if size > 50_000:
                    yield _frames(found, columns)
                    found, size = [], 0
            if found:
                yield _frames(found, columns)

    return texts.mapInPandas(find, ", ".join(f"{c} long" for c in columns))


def _arrays(items, *names: str) -> list[np.ndarray]:
    return [np.array([x[c] for x in items], dtype=np.int64) for c in names]


def _for_text(rows: DataFrame, *columns: str) -> DataFrame:
    """One list per text; its length is bounded by the text's."""
    return rows.groupBy("b1", "b2").agg(F.collect_list(F.struct(*columns)).alias("items")).select(F.col("b1").alias("w1"), F.col("b2").alias("w2"), "items")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, step: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    keyed = texts.select("text", *_key())
    here = (F.col("b1") == F.col("w1")) & (F.col("b2") == F.col("w2"))

    runs = keep(_collect(keyed.where(F.octet_length("text") >= window), ["key", "whole", "first", "last", "place"], lambda raw, row: runs_of(raw, window, gram)), "runs")
    marked = _busy(runs)
    todo = keep(_for_text(marked, "first", "last", "place", "key", "full", "look"), "todo")
    held = keep(keyed.join(todo.hint("shuffle_hash"), here).select("text", "b1", "b2", "items"), "held")

    def blocks(raw: bytes, row) -> tuple[np.ndarray, ...]:
        first, last, place, key = _arrays([x for x in row.items if x["look"]], "first", "last", "place", "key")
        return blocks_of(raw, first, last, place, key.view(np.uint64), window, step)

    parts = _busy(keep(_collect(held, ["key", "whole", "first", "last"], blocks), "blocks"))
    ends = keep(_for_text(parts.where("look"), "first", "last", "key"), "ends")

    def windows(raw: bytes, row) -> tuple[np.ndarray, ...]:
        first, last, key = _arrays(sorted(row.items, key=lambda x: x["first"]), "first", "last", "key")
        at, code = window_hashes(raw, first, last, window)
        own = key[np.searchsorted(first, at, side="right") - 1].view(np.uint64)
        return _mixed(code ^ own * np.uint64(_BASE)), at

    single = keep(_collect(held.drop("items").join(ends.hint("shuffle_hash"), here).select("text", "b1", "b2", "items"), ["key", "at"], windows), "windows")
    shared = _twice(single, ["key"], F.xxhash64("b1", "b2", "at")).where("lo <> hi").select("key")
    hits = single.join(shared, "key", "left_semi").select("b1", "b2", F.col("at").alias("first"), F.col("at").alias("last")).distinct()
    found = keep(_for_text(hits.union(parts.where("full").select("b1", "b2", "first", "last")), "first", "last"), "found").withColumnRenamed("items", "more")
    one = held.join(found.hint("shuffle_hash"), here, "left").select("b1", "b2", "text", F.filter("items", lambda r: r["full"]).alias("items"), "more")

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            out = []
            for row in frame.itertuples(index=False):
                first, last = _arrays([*row.items, *([] if row.more is None else row.more)], "first", "last")
                out.append((row.b1, row.b2, *cut((row.text or "").encode("utf-8", "replace"), first, last, window)))
            yield pd.DataFrame(out, columns=["c1", "c2", "n_removed", "n_spans", "kept_sha256"])

    done = one.mapInPandas(finish, "c1 long, c2 long, n_removed long, n_spans long, kept_sha256 string")
    done = keep(done.where("n_removed > 0").dropDuplicates(["c1", "c2"]), "done")
    rows = texts.select("doc_id", *_key(), F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    copies = keep(rows.where(F.col("n_bytes") >= window).groupBy("b1", "b2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    facts = keep(copies.select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), "copies").join(done, ["c1", "c2"], "full"), "facts")
    joined = rows.join(facts, (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")), "left")
    copied = F.col("copies").isNotNull()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )
