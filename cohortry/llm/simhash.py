"""Near-duplicate documents: SimHash fingerprints linked through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to fixed reference fingerprints once (the pivot
table). Distances to one reference differ by at most the distance of the two fingerprints, so a candidate
pair whose largest coordinate difference exceeds the limit is discarded without being compared; survivors
are verified on the fingerprints themselves.

Candidates share two of four 16-bit blocks: two fingerprints that differ in at most two bits agree on at
least two blocks. A bucket of more than ``BUCKET`` members (a family of near copies) is not paired out.
Its members go another, equally exact way: two fingerprints differ in at most two bits exactly if some
value lies within one bit of both, so each member meets the smallest member at the 65 values around it;
at most 65 members share such a value. Components are the same, and no group is ever paired out.

Near duplicates are dropped on another contract, by the same steps: sets of five-word shingles with a Jaccard similarity
of at least 0.8. Their fingerprints have ``BITS`` bits, since two sets this alike differ in 15 to 19 % of the bits, and
``WIDE`` is the limit: such a pair stays within it but for one in 10**9, strangers do once in a million. Blocks of
fingerprint bits find nothing at this width. The blocks are shingles instead: two such sets share one among the first
fifth of the larger and the first ninth of the smaller one in any common order, so those that share one are all
candidates. Coordinates of the pivot table discard candidates, then fingerprints do, where the members of a block meet;
sizes and parity bits discard those left that cannot reach the similarity, and the sets of the others are compared.

Nulls: a null text has no words and fingerprint zero, like an empty one. Null ids never become a component
id unless no member has one. Empty tables give empty results; repeated rows are kept and share a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.llm.common import TEXT_BATCH, components, discard, free_name, join_on, keep, release, remembered, text_of

SHINGLE = 3
SEED = 42
LIMIT = 2
BUCKET = 48
BLOCK_BITS = 16
_SLICE = 1 << 16

#: Dropping near duplicates: words a shingle and the least Jaccard similarity, as a fraction.
WIDTH = 5
ALIKE = (4, 5)
#: Members of a shingle that are paired out, leaders that the members of a larger one meet first, fewest and most bits of
#: the parities, texts of the sample and the most common shingles it names.
CROWD = 8
LEADERS = 3
#: Turns in which members meet leaders, the last being the one in which all that are still apart meet.
TURNS = 4
PARITY = (256, 8192)
SAMPLE = 5000
#: Bits of the fingerprint of a shingle set, and the most in which the fingerprints of two sets may differ to be compared.
BITS = 256
WIDE = 88
COMMON = 100_000


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


#: Reference fingerprints, derived from their number.
PIVOTS = [_signed(int.from_bytes(hashlib.sha256(f"reference {i}".encode()).digest()[:8], "big")) for i in range(10)]
#: The same for fingerprints of sets, in 64-bit words; a word of a fingerprint takes the hashes of its shingles mixed with one of the seeds.
SET_PIVOTS = [np.frombuffer(hashlib.sha256(f"reference {i}".encode()).digest(), dtype="<i8").tolist() for i in range(10)]
_WORD_SEEDS = np.frombuffer(hashlib.sha256(b"words of a fingerprint").digest(), dtype="<u8")
_PRINT = [f"f{j}" for j in range(BITS // 64)]
_PLACES = [f"p{i}" for i in range(len(SET_PIVOTS))]


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes: lowers A-Z only, splits at the six separators
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _SLICE):
        hi = min(n, lo + _SLICE)
        shingles = map(joined.__getitem__, map(slice, starts[lo:hi].tolist(), last[lo:hi].tolist()))
        codes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=hi - lo)
        counts += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: str = "text") -> Column:
    @F.pandas_udf("long")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered(("simhash",))
        for texts in parts:
            yield pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")

    return prints(F.col(text))


def pivot_table(prints: DataFrame) -> DataFrame:
    """Distances of every distinct ``fp`` to the reference fingerprints, columns p0, p1, ..."""
    near = {f"p{i}": F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for i, p in enumerate(PIVOTS)}
    return prints.select("fp").distinct().withColumns(near)


def _bucketed(table: DataFrame) -> DataFrame:
    """A row for each pair of blocks, which must agree exactly: key, fp, p*."""
    block = [F.shiftrightunsigned("fp", i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(64 // BLOCK_BITS)]
    keys = [F.lit(k << 32) + F.shiftleft(block[a], BLOCK_BITS) + block[b] for k, (a, b) in enumerate(combinations(range(len(block)), 2))]
    return table.select(F.explode(F.array(*keys)).alias("key"), "*")


def fingerprint_links(prints: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """Links ``a < b`` that connect all fingerprints within ``limit`` (at most 2) differing bits."""
    if not 0 <= limit <= 2:
        raise ValueError("blocks and neighbourhoods are laid out for up to two differing bits")
    table = keep(pivot_table(prints), "pivots")
    rows = _bucketed(table)
    sizes = keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    live = keep(rows.join(sizes.where(F.col("n") <= bucket).select("key"), "key", "left_semi"), "live")
    left = live.select("key", F.col("fp").alias("a"), *[F.col(f"p{i}").alias(f"a{i}") for i in range(len(PIVOTS))])
    right = live.select(F.col("key").alias("key_b"), F.col("fp").alias("b"), *[F.col(f"p{i}").alias(f"b{i}") for i in range(len(PIVOTS))])
    apart = F.greatest(*[F.abs(F.col(f"a{i}") - F.col(f"b{i}")) for i in range(len(PIVOTS))])
    pairs = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (apart <= limit))
    verified = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit).select("a", "b")
    crowd = rows.join(sizes.where(F.col("n") > bucket).select("key"), "key", "left_semi").select("fp").distinct()
    return verified.union(_crowd_links(crowd, limit)).distinct()


def _crowd_links(prints: DataFrame, limit: int) -> DataFrame:
    """The same links for members of large buckets, through the values at most one bit away from each."""
    flips = [0] + ([_signed(1 << i) for i in range(64)] if limit else [])
    around = keep(prints.select("fp", F.explode(F.array(*[F.lit(x).cast("bigint") for x in flips])).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("spot")), "around")
    least = around.groupBy("spot").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1")
    met = around.join(least, "spot").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b"))
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """A row per document: doc_id, text_hash, fp (signed), component_id."""
    rows = keep(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), fingerprint_column(text).alias("fp")), "prints", TEXT_BATCH)
    roots = components(fingerprint_links(rows, limit, bucket))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_print = keep(placed.select("fp", "root").join(heads, "root").select("fp", "component_id"), "by_print")
    return rows.join(by_print, "fp").select("doc_id", "text_hash", "fp", "component_id")


def shingle_codes(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; a shorter text is one shingle, no words are none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[a : a + width]), seed) for a in range(n)), dtype=np.uint64, count=n))


def set_print(codes: np.ndarray) -> np.ndarray:
    """Majority bits of a set of shingle hashes, as ``BITS`` / 64 signed words."""
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(codes), _SLICE >> 3):
        x = codes[lo : lo + (_SLICE >> 3), None] ^ _WORD_SEEDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(codes), bitorder="little").view(np.int64)


def set_pivots(sets: DataFrame) -> DataFrame:
    """The pivot table of ``sets``: distances of their fingerprints to the reference fingerprints, columns p0, p1, ..."""
    far = lambda words: sum((F.bit_count(F.col(f).bitwiseXOR(F.lit(w))) for f, w in zip(_PRINT, words, strict=True)), F.lit(0))
    return sets.withColumns({p: far(words).cast("smallint") for p, words in zip(_PLACES, SET_PIVOTS, strict=True)})


def _close(other: Callable[[str], Column]) -> Column:
    """Are two sets within WIDE bits, by their places in the pivot table and then by their fingerprints?"""
    coordinate = F.greatest(*[F.abs(F.col(p) - other(p)) for p in _PLACES])
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(other(f))) for f in _PRINT), F.lit(0))
    return (coordinate <= WIDE) & (apart <= WIDE)


def parity_bits(n: int) -> int:
    """Bits of the parity of a set of ``n`` elements: a power of two, so that a longer parity folds to a shorter one."""
    return min(PARITY[1], max(PARITY[0], 1 << (2 * n).bit_length()))


def _least_shared(n: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set of Jaccard similarity ALIKE."""
    return -(-n * ALIKE[0] // ALIKE[1])


def _least_shared_by_smaller(n: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set of similarity ALIKE that is no smaller."""
    return -(-2 * n * ALIKE[0] // (ALIKE[0] + ALIKE[1]))


def _sketches(common: np.ndarray) -> Callable[[Column], Column]:
    """Set hash, size, fingerprint, parities, prefix and number of lead shingles of a text.

    Parity bits of two sets differ in at most as many places as the sets have elements of their own; there are at least
    twice as many bits as shingles, up to the most, so that sets with little in common differ in many. The prefix
    holds the first shingles in one order for all texts, ``common`` ones last: so many that two sets as alike as
    ALIKE share one of them. In the set that is no larger it is one of the fewer ``lead`` ones.
    """
    where = np.argsort(common)
    ordered = common[where]

    @F.pandas_udf(f"sig long, n int, {', '.join(f'{f} long' for f in _PRINT)}, parity array<long>, prefix array<long>, lead int")
    def sketch(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remembered(("simhash",))
        for texts in parts:
            out = []
            for t in texts:
                codes = shingle_codes(t)
                m = parity_bits(len(codes))
                bits = np.bincount((codes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
                parity = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
                rank = np.full(len(codes), -1, dtype=np.int64)
                if len(ordered) and len(codes):
                    at = np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)
                    rank = np.where(ordered[at] == codes, where[at], -1)
                first = codes[np.lexsort((codes, rank))][: len(codes) - _least_shared(len(codes)) + 1]
                lead = len(codes) - _least_shared_by_smaller(len(codes)) + 1
                out.append((_signed(xxhash.xxh64_intdigest(codes.tobytes(), SEED)), len(codes), *set_print(codes), parity, first.view(np.int64), lead))
            yield pd.DataFrame(out, columns=["sig", "n", *_PRINT, "parity", "prefix", "lead"])

    return sketch


def _codes_column(text: str) -> Column:
    @F.pandas_udf("array<long>")
    def codes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered(("simhash",))
        for texts in parts:
            yield pd.Series([shingle_codes(t).view(np.int64) for t in texts], dtype="object")

    return codes(F.col(text))


def _common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """The commonest shingles of a sample, rarest first. They set the order of the prefixes only: any order finds the same pairs."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.select(text_of(text).alias("text")).where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(step)) == 0).distinct()
    each = keep(some.select(_codes_column("text").alias("codes")), "sample", TEXT_BATCH).select(F.explode("codes").alias("h"))
    top = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "h").limit(COMMON).collect()
    return np.array([r.h for r in reversed(top)], dtype=np.int64).view(np.uint64)


def _fits(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """Do sizes and parities of two sets allow the similarity?"""
    xor = lambda x, y: F.zip_with(x, y, lambda v, w: v.bitwiseXOR(w))
    half = lambda p: xor(F.slice(p, F.lit(1), (F.size(p) / 2).cast("int")), F.slice(p, (F.size(p) / 2).cast("int") + 1, F.size(p)))
    # sizes within the similarity have parities of one length, or one of them twice as long
    folded = F.when(F.size(pa) > F.size(pb), xor(half(pa), pb)).when(F.size(pa) < F.size(pb), xor(pa, half(pb))).otherwise(xor(pa, pb))
    apart = F.aggregate(folded, F.lit(0), lambda total, v: total + F.bit_count(v))
    near = F.least(na, nb) * ALIKE[1] >= F.greatest(na, nb) * ALIKE[0]
    # a Jaccard similarity of s leaves (1 - s) / (1 + s) of the summed sizes as elements of one set only
    return F.when(near, apart * (ALIKE[1] + ALIKE[0]) <= (na + nb) * (ALIKE[1] - ALIKE[0])).otherwise(False)


def _possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct ``a < b`` of candidates whose sizes and parities (``marks``) allow the similarity."""
    side = lambda x: marks.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    met = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    return met.where(_fits(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"))).select("a", "b")


def _meet(rows: DataFrame, other: DataFrame, apart: Column | None = None) -> DataFrame:
    """Pairs (a, b) that share a shingle h which is a lead one of a, a being no larger than b and not too small for it."""
    right = other.select(F.col("h").alias("k"), F.col("sig").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"other_{c}") for c in other.columns if c not in ("h", "sig", "n", "lead")])
    fits = (F.col("h") == F.col("k")) & (F.col("n") <= F.col("nb")) & (F.col("n") * ALIKE[1] >= F.col("nb") * ALIKE[0]) & (F.col("sig") != F.col("b"))
    return rows.where("lead").join(right, fits if apart is None else fits & apart).select(F.col("sig").alias("a"), "b")


def _led(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of each member of a shingle with those of LEADERS of its members that are close, others in every turn; members that have a root meet those of other roots."""
    grouped = "root" in rows.columns
    who = F.struct("sig", *_PRINT, *_PLACES, *["root"] * grouped)
    chosen = rows.groupBy("h").agg(F.array(*[F.min_by(who, F.xxhash64("sig", F.lit(turn * LEADERS + i))) for i in range(LEADERS)]).alias("chosen"))
    met = rows.join(chosen.withColumnRenamed("h", "k"), F.col("h") == F.col("k")).withColumn("leader", F.explode("chosen"))
    met = met.where(F.col("root") != F.col("leader.root")) if grouped else met
    return met.where(_close(lambda c: F.col("leader").getField(c))).select(F.col("sig").alias("a"), F.col("leader.sig").alias("b"))


def _alike(pairs: DataFrame, heads: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The candidates that are alike, by the shingles of one document for each set."""
    pairs = keep(pairs, "candidates")
    sigs = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = keep(heads.join(sigs, "sig", "left_semi").select("sig", "doc_id", "text_hash"), "compared")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), F.col(text).alias("text"))
    found = join_on(texts, wanted, ["doc_id", "text_hash"]).select("sig", "text")
    codes = keep(found.select("sig", _codes_column("text").alias("codes")), "codes", TEXT_BATCH)
    sets = codes.dropDuplicates(["sig"])
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("codes").alias("ca")), "a").join(sets.select(F.col("sig").alias("b"), F.col("codes").alias("cb")), "b")
    shared = F.size(F.array_intersect("ca", "cb"))
    alike = keep(both.where(shared * (ALIKE[0] + ALIKE[1]) >= (F.size("ca") + F.size("cb")) * ALIKE[0]).select("a", "b"), "alike")
    discard(pairs, wanted, codes)
    release(docs.sparkSession)
    return alike


def alike_roots(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, sig) of ``docs`` and one row for each shingle set: sig, head's doc_id and text_hash, root.

    Sets share a root if pairs of a Jaccard similarity of at least ALIKE connect them. Candidates share a prefix
    shingle that is a lead one of the smaller set, and their places in the pivot table and their fingerprints differ
    by WIDE at most. The members of a shingle with more than ``bucket`` of them
    first meet LEADERS members each, turn by turn others while there are several groups of them; after that only pairs
    across groups are compared, so a family of near copies is not paired out.
    """
    sketch = _sketches(_common_shingles(docs, text))
    sketched = keep(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), sketch(F.col(text)).alias("s")).select("doc_id", "text_hash", "s.*"), "shingles", TEXT_BATCH)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("head")
    whole = keep(sketched.groupBy("sig").agg(first, F.first("n").alias("n"), *[F.first(f).alias(f) for f in _PRINT], F.first("parity").alias("parity"), F.first("prefix").alias("prefix"), F.first("lead").alias("lead")).select("sig", "head.doc_id", "head.text_hash", "n", *_PRINT, "parity", "prefix", "lead"), "heads")
    rows = keep(sketched.select("doc_id", "text_hash", "sig"), "rows")
    discard(sketched)
    spots = whole.select("sig", "n", F.posexplode("prefix").alias("at", "h"), F.col("lead").alias("leads")).select("h", "sig", "n", (F.col("at") < F.col("leads")).alias("lead"))
    shared = keep(spots.groupBy("h").agg(F.count("*").alias("c"), F.max("lead").alias("any")).where("c > 1 and any").select(F.col("h").alias("k"), "c"), "shared")
    met = keep(spots.join(shared, F.col("h") == F.col("k")).drop("k"), "met")
    live = keep(met.join(set_pivots(whole.select("sig", *_PRINT)), "sig"), "live")
    heads = keep(whole.drop("prefix", "lead", *_PRINT), "sets")
    discard(shared, met, whole)
    marks = heads.select("sig", "n", "parity")
    few, many = live.where(F.col("c") <= bucket).drop("c"), live.where(F.col("c") > bucket).drop("c")
    placed = lambda d: d.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    links = _alike(_possible(_meet(few, few, _close(lambda c: F.col(f"other_{c}"))).union(_led(many, 0)), marks), heads, docs, doc_id, text)
    roots = keep(components(links), "roots")
    for turn in range(1, TURNS + 1):
        whole = placed(many)
        split = whole.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
        crowd = keep(whole.join(split, "h", "left_semi"), "crowd")
        if crowd.isEmpty():
            break
        if turn < TURNS:  # strangers to all leaders so far meet others
            met = _possible(_led(crowd, turn), marks)
        else:  # what is still apart meets where fingerprints and parities allow it, and nowhere else
            rest = crowd.join(marks.select("sig", "parity"), "sig")
            strangers = (F.col("root") != F.col("other_root")) & _close(lambda c: F.col(f"other_{c}")) & _fits(F.col("n"), F.col("parity"), F.col("nb"), F.col("other_parity"))
            met = _meet(rest, rest, strangers).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = _alike(met, heads, docs, doc_id, text)
        if not more.isEmpty():
            links = links.union(more)
            roots = keep(components(links), "roots")
    return rows, placed(heads.select("sig", "doc_id", "text_hash"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = CROWD) -> DataFrame:
    """One row of ``docs`` for each component of texts with a Jaccard similarity of at least ALIKE; all columns are kept.

    It is a row with the component's smallest id, nulls last, and among these the smallest text hash. Rows without an
    id are rows like others, and so are different texts under one id. Repeated rows count as copies.
    """
    rows, placed = alike_roots(docs, doc_id, text, bucket)
    heads = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("head"))
    staying = keep(heads.select("head.doc_id", "head.text_hash"), "staying")
    twice = rows.groupBy("doc_id", "text_hash").count().where("count > 1").drop("count")
    again = join_on(staying, twice, ["doc_id", "text_hash"], "left_semi").limit(1).count()
    h = free_name("text_hash", docs.columns)
    kept = docs.withColumn(h, F.xxhash64(text_of(text)))
    wanted = staying.select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(h)).hint("shuffle_hash")
    kept = join_on(kept, wanted, [doc_id, h], "left_semi")
    return (kept.dropDuplicates([doc_id, h]) if again else kept).drop(h)
