"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

A sketch counts values in buckets whose bounds grow by a fixed factor, so every quantile is known to a
relative error of half that factor. Sketches merge by adding counts, in any order with the same result:
thresholds do not change when a task is run again. Groups with too few documents use the merged sketch of
their language, then the merged sketch of all.

A document is an outlier if a ratio lies beyond ``q75 + FENCE * max(q75 - q25, floor)`` of its group, or for
word length also below the mirrored bound.

Nulls: a null text has no words; null lang and source form groups of their own. Empty tables give empty
results. Repeated rows are judged one by one. Only doc_id, text, lang and source are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.llm.common import BLANKS, join_on, keep

#: Growth of the bucket bounds: quantiles are right to 1 %.
GROWTH = 1.02
FENCE = 3.0
#: Documents a group needs for thresholds of its own.
LEAST_DOCS = 50
WINDOW = 8
#: Ratio -> least spread. It keeps a group whose values are nearly all equal from rejecting the slightest change.
FLOORS = {"symbol_ratio": 0.05, "upper_ratio": 0.05, "dup_line_ratio": 0.2, "repeat_ratio": 0.1, "word_length": 0.75}
TWO_SIDED = ("word_length",)
#: Fixed value: the symbols of the contract.
SYMBOLS = b"#*$%&|<>"
_ALL_BUT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs at least twice in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(window):
            total = total * factor + codes[k : k + n]
    order = np.argsort(total, kind="stable")
    ranked = total[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of one text in the order of the result columns."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at exactly the six separators
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = len(raw.translate(None, _ALL_BUT_SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper


def stats_column(text: str = "text") -> Column:
    """Struct of the counts of a text."""
    names = [x.split()[0] for x in _STATS.split(", ")]

    @F.pandas_udf(_STATS)
    def stats(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([text_stats(t) for t in texts], columns=names).astype("int64")

    return stats(F.col(text))


def ratios() -> dict[str, Column]:
    """The judged ratios as expressions over the counts; null for a text without words."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "upper_ratio": F.col("n_upper") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
        "dup_line_ratio": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines")),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def sketch(rows: DataFrame, keys: list[str], names: list[str], growth: float = GROWTH) -> DataFrame:
    """Quantile sketch per keys and ratio: keys, name, bucket, n. Nulls are left out; zero has bucket null."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x"))
    value = F.col("x.value")
    bucket = F.when(value > 0, F.ceil(F.log(value) / float(np.log(growth))).cast("int"))
    return long.where(value.isNotNull()).groupBy(*keys, F.col("x.name").alias("name"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches down to ``keys`` by adding their counts."""
    return sketches.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], points: dict[str, float], growth: float = GROWTH) -> DataFrame:
    """Values at the given ranks, one column a point, and the number of values as ``size``."""
    group = [*keys, "name"]
    upto = Window.partitionBy(*group).orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    ranked = sketches.withColumns({"upto": F.sum("n").over(upto), "size": F.sum("n").over(whole)})
    middle = F.coalesce(F.pow(F.lit(growth), F.col("bucket") - 0.5), F.lit(0.0))
    return ranked.groupBy(*group).agg(F.first("size").alias("size"), *[F.min(F.when(F.col("upto") >= F.col("size") * q, middle)).alias(c) for c, q in points.items()])


def thresholds(rows: DataFrame, names: list[str], fence: float = FENCE, least: int = LEAST_DOCS) -> DataFrame:
    """Bounds ``low_<ratio>`` and ``high_<ratio>`` for every (lang, source) of ``rows``."""
    points = {"q25": 0.25, "q75": 0.75}
    base = keep(sketch(rows, ["lang", "source"], names), "sketch")
    own = quantiles(base, ["lang", "source"], points)
    by_lang = quantiles(merge(base, ["lang"]), ["lang"], points)
    overall = quantiles(merge(base, []), [], points)
    wide = join_on(own, by_lang.selectExpr("lang", "name", "size as lang_size", "q25 as lang_q25", "q75 as lang_q75"), ["lang", "name"], "left")
    wide = join_on(wide, overall.selectExpr("name", "q25 as all_q25", "q75 as all_q75"), ["name"], "left")
    pick = lambda q: F.when(F.col("size") >= least, F.col(q)).when(F.col("lang_size") >= least, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv]), F.col("name"))
    spread = F.greatest(pick("q75") - pick("q25"), floor) * fence
    bounds = wide.select("lang", "source", "name", (pick("q25") - spread).alias("low"), (pick("q75") + spread).alias("high"))
    cols = []
    for n in names:
        cols.append(F.max(F.when(F.col("name") == n, F.col("high"))).alias(f"high_{n}"))
        if n in TWO_SIDED:
            cols.append(F.max(F.when(F.col("name") == n, F.col("low"))).alias(f"low_{n}"))
    return bounds.groupBy("lang", "source").agg(*cols)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts, base verdict and final verdict of every document, with the first failed ratio as ``reason``."""
    stats = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), stats_column(text).alias("s")).select("doc_id", "lang", "source", "s.*")
    named = ratios()
    rows = keep(stats.withColumns(named), "stats")
    names = list(named)
    bounds = keep(thresholds(rows, names), "bounds")
    joined = join_on(rows, bounds, ["lang", "source"], "left")
    reason = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.col(n) > F.col(f"high_{n}")
        if n in TWO_SIDED:
            out = out | (F.col(n) < F.col(f"low_{n}"))
        reason = F.when(F.coalesce(out, F.lit(False)), F.lit(n)).otherwise(reason)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.withColumn("base_failed", base_failed).withColumn("reason", F.when(F.col("base_failed"), F.lit("base")).otherwise(reason)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("reason").isNull().alias("kept"), "reason"
    )
