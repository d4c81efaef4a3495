"""Input views derived from the given tables, once as DataFrames, once as SQL.

``V`` builds the DataFrame side; ``with_views`` prefixes an oracle statement with
the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.functions.hashing import hash_bucket, hash_key, hash_mod
from cohortry.functions.ordering import row_index
from cohortry.sources.tables import read_table, spread

FEATURES = ["quantity", "price", "discount", "tax", "shipday", "net"]
CHANNELS = ["quantity", "price", "discount", "tax"]
VECTOR = [f"e{i}" for i in range(64)]
EPOCH = 64
STATE_EPOCH = 32
N_STATES = 4
#: Orders of which a task makes predictions, where those of a value are kept together.
ORDERS_A_TASK = 100_000


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def day_number(c: str) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")


def line_key() -> Column:
    """Digest of a row of ``lineitem`` that has its ``day``."""
    return hash_key(
        *[F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        *[cents(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        *[F.col(c) for c in ("l_returnflag", "l_linestatus", "day")],
    )


class V:
    """Views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    def matrix(self, moved: bool = False) -> DataFrame:
        """row_id, group_id, y and the feature columns of ``lineitem``; not spread where they are ``moved`` by group at once."""
        t = self.table("lineitem")
        t = (t if moved else spread(t, "l_orderkey", "l_partkey")).withColumn("day", day_number("l_shipdate"))
        return t.select(
            line_key().alias("row_id"),
            F.col("l_suppkey").alias("group_id"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("day").cast("double").alias("shipday"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
            "l_returnflag",
            "l_linestatus",
        )

    def missing(self) -> DataFrame:
        """``matrix`` with prices and taxes removed by hash."""
        m = self.matrix()
        return m.withColumn("price", F.when(hash_mod(11, "price", F.col("row_id")) != 0, F.col("price"))).withColumn(
            "tax", F.when(hash_mod(13, "tax", F.col("row_id")) != 0, F.col("tax"))
        )

    def categorical(self) -> DataFrame:
        """Orders as subjects with string attributes, some missing."""
        o = spread(self.table("orders"), "o_orderkey")
        k = F.col("o_orderkey")
        return o.select(
            k.alias("row_id"),
            F.col("o_custkey").alias("group_id"),
            F.when(hash_mod(17, "status", k) != 0, F.col("o_orderstatus")).alias("status"),
            F.when(hash_mod(19, "priority", k) != 0, F.col("o_orderpriority")).alias("priority"),
            F.concat(F.lit("site"), (F.col("o_custkey") % 40).cast("string")).alias("site"),
            F.when(hash_mod(23, "total", k) != 0, F.col("o_totalprice")).alias("total"),
        )

    def predictions(self, together: str | None = None) -> DataFrame:
        """Long predictions of two models, two variants, two trials, train and test.

        With ``together`` (``group_id`` or ``idx``) the orders of a value are in one task before they
        become sixteen rows each, so that groups within it need no shuffle of those rows.
        """
        c = self.table("customer").select("c_custkey", "c_mktsegment")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
        same = F.col("o_custkey") == F.col("c_custkey")
        if together is None:
            d = spread(o, "o_orderkey").join(c, same)
        else:
            tasks = max(self.spark.sparkContext.defaultParallelism, -(-o.count() // ORDERS_A_TASK))
            d = o.join(c, same).repartition(tasks, {"group_id": "o_custkey", "idx": "o_orderkey"}[together])
        cells = [
            (m, v, s, t, t + (10 if s == "train" else 0))
            for m in ("m1", "m2")
            for v in ("uncalib", "platt")
            for s in ("train", "test")
            for t in (0, 1)
        ]
        grid = F.array(
            *[
                F.struct(
                    F.lit(m).alias("model"),
                    F.lit(v).alias("variant"),
                    F.lit(s).alias("split"),
                    F.lit(t).alias("trial"),
                    F.lit(1 if m == "m1" else 3).alias("mul"),
                    F.lit(0 if m == "m1" else 1).alias("mix"),
                    F.lit(shift).alias("shift"),
                    F.lit(0 if v == "uncalib" else 500).alias("base"),
                    F.lit(10 if v == "uncalib" else 9).alias("gain"),
                )
                for m, v, s, t, shift in cells
            ]
        )
        # what an order has in common in all its cells is worked out once
        d = d.select(
            F.col("o_orderkey").alias("idx"),
            F.col("o_custkey").alias("group_id"),
            F.col("c_mktsegment").alias("group_label"),
            F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("subject_id"),
            F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("y"),
            cents("o_totalprice").alias("cents"),
            F.array(*[hash_mod(5, "fold", t, F.col("o_custkey")) for t in (0, 1)]).alias("test_folds"),
        ).select("*", F.inline(grid))
        k1 = (F.col("cents") * F.col("mul") + F.col("shift") * 7919) % 1001
        k2 = (F.expr("cents div 1001") + F.col("shift") * 31) % 1001
        lead = F.when(F.col("y") == 1, F.greatest(k1, k2)).otherwise(F.least(k1, k2))
        k = F.call_function("div", lead + F.col("mix") * (k1 + k2), 1 + 2 * F.col("mix"))
        p = (F.col("base") + F.col("gain") * k) / F.lit(10000.0)
        test_fold = F.get("test_folds", F.col("trial"))
        fold = 1 + (test_fold + (F.col("split") == "train").cast("int")) % 5
        return d.select(
            "model", "variant", "split", "trial", fold.cast("int").alias("outer_fold"), "idx", "group_id",
            "group_label", "subject_id", "y", p.alias("p"),
        )

    def samples(self) -> DataFrame:
        """recording, t_idx and a column per channel: one recording per supplier.

        The rows of a recording move once, as they are; the digest that orders them is worked out where they meet.
        """
        t = self.table("lineitem").withColumn("day", day_number("l_shipdate")).drop("l_shipdate").withColumn("recording", F.col("l_suppkey"))
        t = row_index(t, ["recording"], ["day", line_key()], F.col("day"), "t_idx", order_late=True)
        return t.select("recording", "t_idx", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))

    def signal(self) -> DataFrame:
        """recording, channel, t_idx, value: the samples with a row per channel."""
        return self.samples().unpivot(["recording", "t_idx"], CHANNELS, "channel", "value")

    def epochs(self) -> DataFrame:
        """Complete 64-sample epochs of ``signal``."""
        from cohortry.operators.signal import fixed_epochs

        return fixed_epochs(self.signal(), EPOCH)

    def states(self) -> DataFrame:
        """recording, epoch_id, t_idx, state: events of a user in time order."""
        e = spread(self.table("events"), "event_id").withColumn("day", F.to_date("ts").cast("string"))
        t = row_index(e, ["user_id"], ["ts", "event_id"], F.col("day"), "t_idx")
        state = (
            F.when(F.col("event_type") == "signup", 0)
            .when(F.col("event_type") == "purchase", 1)
            .when(F.col("event_type") == "view", 2)
            .when(F.col("event_type") == "click", 3)
        )
        return t.select(
            F.col("user_id").alias("recording"),
            F.floor(F.col("t_idx") / STATE_EPOCH).alias("epoch_id"),
            "t_idx",
            state.alias("state"),
        )

    def vectors(self) -> DataFrame:
        """vec_id, label and the numbers of each vector as columns e0, e1, ..."""
        e = spread(self.table("embeddings"), "vec_id")
        return e.select("vec_id", F.col("label").cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTOR)])

    def documents(self) -> DataFrame:
        """Labelled documents: group = source."""
        d, l = spread(self.table("documents"), "doc_id"), self.table("labels")
        return d.join(l, "doc_id").select(
            "doc_id",
            F.col("source").alias("label"),
            F.col("quality").alias("y"),
            "toxic",
            "lang",
            F.col("n_chars").cast("double").alias("n_chars"),
            F.length("text").cast("double").alias("n_text"),
        )


VIEW_SQL = {
    # name: (views it needs, body)
    "mx": (
        [],
        """SELECT md5(concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber,
             CAST(round(l_quantity*100) AS BIGINT), CAST(round(l_extendedprice*100) AS BIGINT),
             CAST(round(l_discount*100) AS BIGINT), CAST(round(l_tax*100) AS BIGINT), l_returnflag, l_linestatus,
             date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))) AS row_id,
           l_suppkey AS group_id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity AS quantity,
           l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
           CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS shipday,
           l_extendedprice * (1 - l_discount) AS net, l_returnflag, l_linestatus FROM lineitem""",
    ),
    "mxn": (
        ["mx"],
        """SELECT * REPLACE (
             CASE WHEN ('0x'||substr(md5('price:'||row_id),1,8))::BIGINT % 11 <> 0 THEN price END AS price,
             CASE WHEN ('0x'||substr(md5('tax:'||row_id),1,8))::BIGINT % 13 <> 0 THEN tax END AS tax) FROM mx""",
    ),
    "cat": (
        [],
        """SELECT o_orderkey AS row_id, o_custkey AS group_id,
             CASE WHEN ('0x'||substr(md5('status:'||o_orderkey),1,8))::BIGINT % 17 <> 0 THEN o_orderstatus END AS status,
             CASE WHEN ('0x'||substr(md5('priority:'||o_orderkey),1,8))::BIGINT % 19 <> 0 THEN o_orderpriority END AS priority,
             'site' || (o_custkey % 40) AS site,
             CASE WHEN ('0x'||substr(md5('total:'||o_orderkey),1,8))::BIGINT % 23 <> 0 THEN o_totalprice END AS total
           FROM orders""",
    ),
    "pred": (
        [],
        """SELECT model, variant, split, trial,
             CAST(CASE WHEN split = 'test' THEN tf ELSE 1 + tf % 5 END AS INTEGER) AS outer_fold, idx, group_id,
             group_label, 'S' || group_id AS subject_id, y,
             CASE WHEN variant = 'uncalib' THEN k / 1000.0::DOUBLE ELSE (500 + 9 * k) / 10000.0::DOUBLE END AS p
           FROM (SELECT *, CASE WHEN model = 'm1' THEN ld ELSE (2 * ld + rs) // 3 END AS k FROM (
             SELECT *, CASE WHEN y = 1 THEN greatest(k1, k2) ELSE least(k1, k2) END AS ld,
               CASE WHEN y = 1 THEN least(k1, k2) ELSE greatest(k1, k2) END AS rs FROM (
               SELECT *, 1 + ('0x'||substr(md5('fold:'||trial||':'||group_id),1,8))::BIGINT % 5 AS tf,
                 (cents * CASE WHEN model = 'm1' THEN 1 ELSE 3 END + sh * 7919) % 1001 AS k1,
                 (cents // 1001 + sh * 31) % 1001 AS k2
               FROM (SELECT o_orderkey AS idx, o_custkey AS group_id, c_mktsegment AS group_label,
                 CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INTEGER) AS y,
                 CAST(round(o_totalprice * 100) AS BIGINT) AS cents, model, variant, split, trial,
                 trial + CASE WHEN split = 'train' THEN 10 ELSE 0 END AS sh
                 FROM orders JOIN customer ON o_custkey = c_custkey,
                   (VALUES ('m1'), ('m2')) a(model), (VALUES ('uncalib'), ('platt')) b(variant),
                   (VALUES ('train'), ('test')) c(split), (VALUES (0), (1)) d(trial)))))""",
    ),
    "sig": (
        ["mx"],
        """SELECT recording, t_idx, channel, value FROM (SELECT group_id AS recording,
             row_number() OVER (PARTITION BY group_id ORDER BY shipday, row_id) - 1 AS t_idx,
             quantity, price, discount, tax FROM mx)
           UNPIVOT (value FOR channel IN (quantity, price, discount, tax))""",
    ),
    "ep": (
        ["sig"],
        """SELECT recording, t_idx // 64 AS epoch_id, channel, t_idx % 64 AS s_idx, value FROM sig
           JOIN (SELECT recording AS r_, max(t_idx) + 1 AS n_ FROM sig GROUP BY 1) ON recording = r_
           WHERE (t_idx // 64 + 1) * 64 <= n_""",
    ),
    "st": (
        [],
        """SELECT user_id AS recording, t_idx // 32 AS epoch_id, t_idx, CASE event_type WHEN 'signup' THEN 0
             WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS state
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t_idx FROM events)""",
    ),
    "vec": (
        [],
        "SELECT vec_id, CAST(label AS INTEGER) AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(VECTOR)) + " FROM embeddings",
    ),
    "doc": (
        [],
        """SELECT d.doc_id, source AS label, quality AS y, toxic, lang, CAST(n_chars AS DOUBLE) AS n_chars,
             CAST(length(text) AS DOUBLE) AS n_text FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
}


def with_views(names: str, body: str, more: str = "") -> str:
    """Oracle statement: the needed views, then ``more`` expressions, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEW_SQL[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({VIEW_SQL[n][1]})" for n in order]
    if more:
        parts.append(more)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
