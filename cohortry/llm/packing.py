"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

The packing depends only on how many pieces have each length. Lengths are whole numbers up to the
capacity, so the plan is made from one count per length (at most 4096 numbers, whatever the corpus):
pieces go, longest first, into the open bin with the least room that still takes them. A segment tree over
the room left finds that bin in logarithmic time. Bins that look alike are handled as one range, which gives
exactly the bins of the piece-by-piece algorithm. The plan maps ranges of ranks within a length to bins
and offsets; the pieces themselves are ranked and placed by Spark.

Nulls: a null text is empty and becomes the closing id alone; null ids are kept. Empty tables give empty
results, repeated rows are packed each. Other columns are not read.
"""

from __future__ import annotations

import codecs
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.llm.common import TEXT_BATCH, keep, remembered

CAPACITY = 4096
END_ID = 1
#: Pieces of one length are ranked in so many independent parts.
PARTS = 512
#: Words remembered in each of two generations.
_CACHE = 300_000
#: Punctuation that closes a word (no apostrophe, which starts pieces of its own), the first letter
#: beyond the Latin blocks, the one Latin capital whose lower case is two characters.
_CLOSING = ".,;:!?#$%&*()[]{}/|-_\"+=@~^"
_LATIN_END, _DOTTED = "\u0250", "\u0130"
#: First bytes of UTF-8 that only characters from U+0240 on have.
_BEYOND_LATIN = bytes(range(0xC9, 0x100))
#: Kinds of bytes: word, blank, full stop or comma, other mark.
_KINDS = bytes(32 if c in b" \t\n\r\x0b\x0c" else 46 if c in b".," else 97 if c >= 128 or chr(c).isalnum() else 35 for c in range(256))


def _plain_latin(raw: bytes) -> bool:
    """Whether all characters are below U+0240 and none changes its length when lowered."""
    return raw.isascii() or (len(raw.translate(None, _BEYOND_LATIN)) == len(raw) and b"\xc4\xb0" not in raw)


def _lone_marks(raw: bytes) -> bool:
    """Whether no full stop or comma before a blank follows another mark (or a sign beyond ASCII)."""
    kinds = raw.translate(_KINDS)
    return b"#. " not in kinds and b".. " not in kinds and b"\xc2" not in raw and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw


def _byte_letters() -> str:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return "".join(chr(256 + rest.index(b)) if b in rest else chr(b) for b in range(256))


_BYTE_LETTERS = _byte_letters()
_PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered(dict):
    """A dictionary that asks a function for what it does not hold.

    It holds a young and an old generation of at most ``limit`` entries each. What is asked for moves to the young
    one; once that is full it becomes the old one, so words met again and again stay and the others go.
    """

    def __init__(self, make, limit: int = _CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordEncoder:
    """Ids of texts as packed little-endian 32-bit numbers, remembered per white-space-free word.

    The tokenizer splits at white space before anything else, so a text's ids are its words' ids in order. A word
    of Latin letters with closing punctuation is one or two pieces for the tokenizer's BPE model, which is then
    asked directly; any other word goes through the whole tokenizer. Texts that may hold the tokenizer's special
    strings are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Remembered(self._word)

    def _piece(self, letters: str) -> bytes:
        """Ids of one lower-case piece, spelled in the byte alphabet of the model."""
        spelled = letters if letters.isascii() else codecs.charmap_decode(letters.encode("utf-8"), "strict", _BYTE_LETTERS)[0]
        return pack_ids([t.id for t in self.model.tokenize(spelled)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        core = text.rstrip(_CLOSING)
        if core.isalpha() and (core.isascii() or (max(core) < _LATIN_END and _DOTTED not in core and unicodedata.is_normalized("NFC", core))):
            ids = self._piece(core.lower())
            if len(core) < len(text):
                ids += self._piece(text[len(core) :])
        else:
            ids = self._ids(text)
        return ids

    def _ids(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._ids(text)
        raw = text.encode("utf-8", "replace")
        if _plain_latin(raw):
            raw = raw.lower() if raw.isascii() else text.lower().encode("utf-8", "replace")  # letter by letter, as the tokenizer does next
            if _lone_marks(raw):  # then such a mark is a piece of its own
                raw = raw.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n")
        return b"".join(map(self.known.__getitem__, raw.split()))


_PACKERS = [struct.Struct(f"<{n}I") for n in range(32)]


def pack_ids(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)].pack(*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


def encoder_for(path: str) -> WordEncoder:
    """One encoder a worker process, so that tasks share what it remembers."""
    return remembered(("packing", path), lambda: WordEncoder(path))


def pieces_of(ids: bytes, capacity: int = CAPACITY, end_id: int = END_ID) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's packed ids after the closing id is added."""
    data = ids + int(end_id).to_bytes(4, "little")
    n = len(data) // 4
    return [(k, s, min(capacity, n - s), zlib.crc32(data[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]


def _cutter(path: str | None, capacity: int, end_id: int):
    @F.pandas_udf(_PIECES)
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_for(path or default_tokenizer())
        names = ("piece", "start", "length", "ids_crc32")
        for texts in parts:
            yield pd.Series([[dict(zip(names, p, strict=True)) for p in pieces_of(encoder.encode(t), capacity, end_id)] for t in texts])

    return cut


class RoomTree:
    """Segment tree over the room left in open bins: which rooms occur, and the least one that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.used = bytearray(2 * self.size)

    def mark(self, room: int, present: bool) -> None:
        i = room + self.size
        self.used[i] = present
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] | self.used[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Least marked room of at least ``need``."""
        i = need + self.size
        if self.used[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.used[2 * i] else 2 * i + 1
        return i - self.size


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (length, first_rank, per_bin, first_bin, offset), by length and rank.

    Ranks from ``first_rank`` on fill bins from ``first_bin`` on, ``per_bin`` pieces each from ``offset``.
    """
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a piece must have between one token and the capacity")
    tree, free, rows, bins = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not free.setdefault(room, []):
                tree.mark(room, True)
            free[room].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first = capacity, bins
                n = -(-left // (capacity // size))
                bins += n
            else:
                first, n = free[room].pop()
                if not free[room]:
                    tree.mark(room, False)
            each = room // size
            whole = min(n, left // each)
            if whole:
                took, used = whole * each, whole
            else:
                each = took = left
                used = 1
            rows.append((size, rank, each, first, capacity - room))
            put(room - each * size, first, used)
            put(room, first + used, n - used)
            rank += took
            left -= took
    return sorted(rows)


def _placer(plan: list[tuple[int, int, int, int, int]]):
    table = np.array(plan, dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(keys, (size << 48) + nth, side="right") - 1]
        inside = nth - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + inside // row[:, 2], "offset": row[:, 4] + inside % row[:, 2] * size})

    return place


def cut_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    cut: Column = _cutter(tokenizer, capacity, end_id)(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), cut.alias("p")).select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with their sequence_id and offset; a sequence's pieces follow each other without gaps from 0."""
    pieces = keep(cut_documents(docs, doc_id, text, tokenizer, capacity, end_id).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")), "pieces", TEXT_BATCH)
    parts = keep(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = keep(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("length").alias("l"), F.col("part").alias("k"), "base"), "base")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    place = _placer(pack_counts(counts, capacity))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("nth", F.row_number().over(order))
    ranked = numbered.join(base, (F.col("length") == F.col("l")) & (F.col("part") == F.col("k"))).withColumn("rank", F.col("base") + F.col("nth") - 1)
    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
