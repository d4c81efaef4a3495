"""Finding recording files, cutting subject ids and joining labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.functions.rows import keep_first

# ------------------------------------------------------------------- files


def glob_regex(glob: str) -> str:
    """Regular expression of one path segment pattern (*, ?, [set])."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            body = glob[i + 1 : close]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return out


def hint_regex(folder_hints: Sequence[str], file_pattern: str) -> str:
    """Folders matching the hints in order, anywhere apart, above a matching file."""
    between = "(?:[^/]+/)*"
    return "^" + "".join(between + glob_regex(h) + "/" for h in folder_hints) + between + glob_regex(file_pattern) + "$"


def match_hints(paths: DataFrame, folder_hints: Sequence[str], file_pattern: str, path: str = "path") -> DataFrame:
    """Paths (relative to the root) below the hinted folders, without repeats."""
    return paths.where(F.col(path).rlike(hint_regex(folder_hints, file_pattern))).dropDuplicates([path])


def scan_files(spark: SparkSession, root: str, folder_hints: Sequence[str] = (), file_pattern: str = "*") -> DataFrame:
    """(path, relative, length, modified) of the files below ``root``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_pattern)
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    base = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    relative = F.element_at(F.split("path", re.escape(base), 2), -1)
    return match_hints(files.withColumn("relative", relative), folder_hints, file_pattern, "relative")


# --------------------------------------------------------------------- ids


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def subject_id_from_borders(stem: Column, borders: Sequence[str]) -> Column:
    """The stem before the last border, borders found left to right; whole if one is missing."""
    if not borders:
        return stem
    start, missing, cut = F.lit(1), F.lit(False), F.lit(0)
    for b in borders:
        at = F.call_function("locate", F.lit(b), stem, start)
        missing = missing | (at == 0)
        cut, start = at, at + F.lit(len(b))
    return F.when(missing, stem).otherwise(F.substring(stem, F.lit(1), cut - 1))


def normalize_id(c: Column) -> Column:
    """First run of digits without leading zeros; else the trimmed text; blank is null."""
    text = F.trim(c.cast("string"))
    digits = F.regexp_extract(text, r"(\d+)", 1)
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(text == "", None).when(digits != "", bare).otherwise(text)


def _spans(text: Column) -> tuple[Column, Column]:
    """Pieces of a text, and every substring from a token start to a token end."""
    pieces = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    word = lambda i: F.regexp(F.element_at("__p", i), F.lit("^[A-Za-z0-9]"))
    n = F.size("__p")
    starts = F.filter(F.sequence(F.lit(1), n), word)
    spans = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(F.filter(F.sequence(i, n), word), lambda j: F.array_join(F.slice("__p", i, j - i + 1), "")),
        )
    )
    return pieces, F.array_distinct(spans)


def _with_spans(ids: DataFrame, column: str) -> DataFrame:
    pieces, spans = _spans(F.col(column))
    d = ids.withColumn("__p", pieces).where(F.size("__p") > 0)
    return d.withColumn("__span", F.explode(spans)).drop("__p")


def resolve_ids(file_ids: DataFrame, meta_ids: DataFrame, file_col: str = "file_id", meta_col: str = "meta_id") -> DataFrame:
    """(file_id, meta_id): exact match, else a metadata id inside the file id at token
    boundaries, else the reverse; of several the unique longest, a tie gives null.

    Token spans are exploded and joined by equality, so no pair is tested by pattern.
    """
    files = file_ids.select(F.col(file_col).alias("f")).where(F.col("f").isNotNull()).distinct()
    metas = meta_ids.select(F.col(meta_col).alias("m")).where(F.col("m").isNotNull()).distinct()
    exact = files.join(metas, F.col("f") == F.col("m")).select("f", "m", F.lit(0).alias("tier"))
    inside = _with_spans(files, "f").join(metas, F.col("__span") == F.col("m")).select("f", "m", F.lit(1).alias("tier"))
    around = _with_spans(metas, "m").join(files, F.col("__span") == F.col("f")).select("f", "m", F.lit(2).alias("tier"))
    found = exact.unionByName(inside).unionByName(around)
    # per file: best tier, then longest; a struct maximum combines on the map side
    best = found.groupBy("f", "tier", F.length("m").alias("len")).agg(F.count_distinct("m").alias("n"), F.min("m").alias("m"))
    top = best.groupBy("f").agg(F.max(F.struct(-F.col("tier"), "len", "n", "m")).alias("t"))
    chosen = top.select("f", F.when(F.col("t.n") == 1, F.col("t.m")).alias("m"))
    return files.join(chosen, "f", "left").select(F.col("f").alias(file_col), F.col("m").alias(meta_col))


# -------------------------------------------------------------------- labels


def label_mapping(spark: SparkSession, path: str, id_col: str, label_col: str) -> DataFrame:
    """(subject_id, label) from a CSV with a header; values are kept as text."""
    d = spark.read.option("header", True).csv(path)
    if missing := {id_col, label_col} - set(d.columns):
        raise KeyError(f"no columns {sorted(missing)} in {path}")
    return d.select(F.col(id_col).alias("subject_id"), F.col(label_col).alias("label"))


def join_status(files: DataFrame, metadata: DataFrame, key: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """Files with their label and match status, and the files without one."""
    meta = metadata.withColumn("__hit", F.lit(True))
    d = files.join(meta, key, "left")
    status = F.when(F.col("__hit"), "matched").otherwise("unmatched_file_id")
    return d.withColumn("match_status", status).drop("__hit"), files.join(metadata, key, "left_anti")


def clean_metadata(metadata: DataFrame, id_col: str, label_col: str, order: str, normalize: bool = True) -> DataFrame:
    """(subject_id_key, label): usable ids and labels, the first row of each key."""
    key = normalize_id(F.col(id_col)) if normalize else F.nullif(F.trim(F.col(id_col).cast("string")), F.lit(""))
    d = metadata.select(key.alias("subject_id_key"), F.col(label_col).alias("label"), F.col(order).alias("__order"))
    d = d.where(F.col("subject_id_key").isNotNull() & F.col("label").isNotNull() & (F.trim(F.col("label").cast("string")) != ""))
    return keep_first(d, ["subject_id_key"], [F.col("__order")]).drop("__order")


def id_collisions(metadata: DataFrame, id_col: str) -> DataFrame:
    """Normalised ids that stand for several raw ids."""
    d = metadata.select(normalize_id(F.col(id_col)).alias("subject_id_key"), F.col(id_col).alias("raw"))
    d = d.where(F.col("subject_id_key").isNotNull()).groupBy("subject_id_key").agg(F.count_distinct("raw").alias("n_raw"))
    return d.where("n_raw > 1")


def keep_labelled(files: DataFrame, clean: DataFrame, id_col: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """Files whose normalised id has metadata, labelled from it, and the rest."""
    d = files.withColumn("subject_id_key", normalize_id(F.col(id_col)))
    return d.join(clean, "subject_id_key"), d.join(clean, "subject_id_key", "left_anti")


# ------------------------------------------------------------------- ledger


def block_ledger(files: DataFrame, existing: DataFrame, n_blocks: int, require: bool = True, key: str = "subject_id") -> DataFrame:
    """What happens to each file: converted, skipped_exists, skipped_insufficient_blocks or failed.

    ``files`` has key, label, n_found (null where the file cannot be read).
    """
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("UNLABELED"))
    there = existing.select(key).distinct().withColumn("__there", F.lit(True))
    d = files.withColumn("label", label).join(there, key, "left")
    status = F.when(F.col("__there"), "skipped_exists").when(F.col("n_found").isNull(), "failed")
    if require:
        status = status.when(F.col("n_found") < n_blocks, "skipped_insufficient_blocks")
    d = d.withColumn("convert_status", status.otherwise("converted")).drop("__there")
    return d.withColumn("n_blocks_used", F.when(F.col("convert_status") == "converted", F.least(F.col("n_found"), F.lit(n_blocks))))


def infer_dims(shape: Column, max_channels: int, max_segments: int, max_times: int | None = None) -> Column:
    """Struct (n_segments, n_times, n_channels) of an array shape; null where ambiguous."""
    axes = F.sequence(F.lit(1), F.size(shape))
    at = lambda i: F.try_element_at(shape, i)
    small = lambda limit: F.filter(axes, lambda i: at(i) <= limit)
    seg = F.when(F.size(shape) == 3, F.get(small(max_segments), F.lit(0))).otherwise(F.lit(0))
    one_segment = (F.size(shape) == 2) | ((F.size(shape) == 3) & (F.size(small(max_segments)) == 1))
    channels = F.filter(axes, lambda i: (i != seg) & (at(i) <= max_channels))
    chan = F.get(channels, F.lit(0))
    times = F.filter(axes, lambda i: (i != seg) & (i != chan))
    n_times = at(F.get(times, F.lit(0)))
    dims = F.struct(
        F.when(F.size(shape) == 3, at(seg)).alias("n_segments"), n_times.alias("n_times"), at(chan).alias("n_channels")
    )
    ok = one_segment & (F.size(channels) == 1)
    if max_times is not None:
        ok = ok & (n_times <= max_times)
    return F.when(ok, dims)


def durations(n_times: Column, n_segments: Column, sfreq: Column) -> tuple[Column, Column]:
    """Seconds per segment and in total; bad sizes give null, a bad segment count is 1."""
    ok = (sfreq > 0) & (n_times > 0)
    n = F.when(n_segments > 0, n_segments).otherwise(F.lit(1))
    return F.when(ok, n_times / sfreq), F.when(ok, n_times * n / sfreq)
