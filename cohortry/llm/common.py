"""Helpers shared by the corpus operators: null-safe joins, written tables, folds, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.session import cut_lineage

#: Fixed value: the word separators of every contract (space, tab, line feed, vertical tab, form feed, return).
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Fixed value: the same set as a regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls included; the keys and all columns of the left keep their names.

    The right side must have no other column name in common with the left.
    """
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = one if cond is None else cond & one
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def free_name(wish: str, columns: Sequence[str]) -> str:
    """``wish`` with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder inside the checkpoint folder that the cluster names in ``spark.checkpoint.dir``."""
    root = spark.sparkContext.getCheckpointDir()
    if root is None:
        cut_lineage(spark.range(1))  # makes the setting take effect
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_REMEMBERED: dict[tuple, object] = {}


def remembered(owner: tuple, make: Callable[[], object] = dict) -> object:
    """What a Python worker keeps between tasks of one operator.

    Workers live on from stage to stage: the first task of another operator drops what the one before it kept.
    """
    if owner not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[owner] = make()
    return _REMEMBERED[owner]


#: Documents in an Arrow batch; a batch of whole texts is held by the JVM and by the Python worker.
TEXT_BATCH = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keep(df: DataFrame, name: str = "table", batch: int | None = None) -> DataFrame:
    """Write a derived table once to the shared folder and read it from there: no lineage, known size.

    ``batch`` is the number of rows of the Arrow batches while the table is written.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_BATCH_KEY, None)
    _MADE.get().append(path)
    if batch is not None:
        spark.conf.set(_BATCH_KEY, str(batch))
    try:
        df.write.parquet(path)
    finally:
        if batch is not None and before is None:
            spark.conf.unset(_BATCH_KEY)
        elif batch is not None:
            spark.conf.set(_BATCH_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


#: Folders that the work under way has written.
_MADE: ContextVar[list[str]] = ContextVar("made", default=[])


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.kept_path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "table", batch: int | None = None) -> DataFrame:
    """``keep`` what ``make`` returns, then delete all tables that were written on the way to it."""
    token = _MADE.set([])
    try:
        out = keep(make(), name, batch)
        made = _MADE.get()
    finally:
        _MADE.reset(token)
    _MADE.get().append(made.pop())
    for path in made:
        _delete(spark, path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Have the driver drop what nothing refers to any more; Spark then deletes the shuffle files behind it."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)).cast("int")


def drawn(key: str, bound: int, size: int) -> Column:
    """Is the key in a sample by hash of about ``bound`` of ``size`` keys? All 64 bits of the hash count, so the share is right at any size."""
    return F.lit(True) if bound >= size else F.xxhash64(key) < F.lit(hash_limit(bound, size))


def hash_limit(bound: int, size: int) -> int:
    """The signed 64-bit number below which a share of bound / size of all hashes lies."""
    return (bound << 64) // size - (1 << 63)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of the undirected ``links(a, b)``: columns node, root.

    Alternates the two star operations until a round changes nothing. Both send a node's neighbours to
    its smallest one through a grouped minimum and a join, so no neighbour list is ever gathered. Rounds
    grow with the logarithm of a chain's length; exceeding ``rounds`` is an error, not a cut.
    """
    nodes = edges = keep(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b").distinct()
        large = keep(large, "large")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        last, edges = edges, keep(small.select("e.a", "e.b").where("a <> b").distinct(), "small")
        discard(large, *([last] if last is not nodes else []))
        # a finished set of stars is fixed under both steps
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            return roots.join(edges.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("root"))
        before = state
    raise RuntimeError(f"components not settled after {rounds} rounds")
