"""Secret scans over a blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. Only (blob, rule version)
pairs that the ledger does not list are scanned, each blob once however many paths hold it. Their findings
are stored beside the ledger; stored and new ones together are joined back to all paths.

Positions come from the text between the matches: the n-th match starts after the n pieces that a
split at the pattern leaves before it and the n-1 earlier matches. Offsets count code points, ends are
exclusive.

Nulls: null content is the empty text. Empty texts and tables give no findings. Repeated rows are versions
of their own with equal findings. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.llm.common import free_name, keep, text_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; one counts if its ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules. For the last two the length test is part of the pattern, which finds the
#: same matches because a shorter run cannot hold a longer one.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Rules beyond the base: key blocks and prefixed service tokens.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("service", 1, r"(?:ghp|gho|ghs|ghu|xoxb|xoxp)[_-][A-Za-z0-9-]{20,}"),
)
RULES = BASE + MORE
MARK = "[secret]"


def address(versions: DataFrame, content: str = "text") -> Column:
    """Content address of a version."""
    return F.sha2(text_of(content), 256)


def _matches(rule: Rule) -> Column:
    """Piece lengths, match lengths and tested lengths of one rule; an empty array where nothing matches."""
    text, pattern = F.col("content"), F.lit(rule.pattern)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else hits
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    return F.when(text.rlike(rule.pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("tested")))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of ``blobs(blob, content, seen)``: blob, kind, version, rank, start, end.

    ``seen`` lists the rule tags already run on the blob; those rules are skipped.
    """
    cases = []
    for rank, rule in enumerate(rules):
        fresh = F.col("seen").isNull() | ~F.array_contains("seen", rule.tag)
        cases.append(F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), F.when(fresh, _matches(rule)).alias("found")))
    each = blobs.select("blob", F.explode(F.array(*cases)).alias("r")).where("r.found is not null")
    rows = each.select("blob", "r.rank", "r.kind", "r.version", "r.least", F.posexplode("r.found").alias("pos", "m"))
    rows = rows.select("blob", "rank", "kind", "version", "least", "pos", "m.gap", "m.hit", "m.tested")
    so_far = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.where("hit is not null").withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far))
    return ends.where("tested >= least").select("blob", "kind", "version", "rank", (F.col("end") - F.col("hit")).alias("start"), "end")


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES, content: str = "text") -> DataFrame:
    """Distinct contents that some rule version has not seen: blob, content, seen.

    ``ledger(blob, kind, version)`` may repeat rows; null or unknown entries match nothing.
    """
    blobs = versions.select(address(versions, content).alias("blob"), text_of(content).alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
    if ledger is None:
        return blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    tags = F.concat_ws("@", F.col("kind"), F.col("version").cast("string"))
    wanted = [r.tag for r in rules]
    seen = ledger.select("blob", tags.alias("tag")).where(F.col("tag").isin(wanted)).groupBy("blob").agg(F.collect_set("tag").alias("seen"))
    return blobs.join(seen, "blob", "left").where(F.col("seen").isNull() | (F.size("seen") < len(wanted)))


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, content: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of the unseen pairs and the ledger rows to append once they are stored."""
    todo = unseen_blobs(versions, ledger, rules, content)
    found = scan_blobs(todo, rules)
    pairs = todo.select("blob", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.tag).alias("tag")) for r in rules])).alias("r"), "seen")
    added = pairs.where(F.col("seen").isNull() | ~F.array_contains("seen", F.col("r.tag"))).select("blob", "r.kind", "r.version")
    return found, added


def per_blob(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """One row per blob with findings: counts, the span lists and the stretches between merged spans.

    A blob's findings are bounded by its own text, so they may meet in one list.
    """
    earlier = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("reach", F.max("end").over(earlier))
    clear = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.struct(F.coalesce("reach", F.lit(0)).alias("from"), F.col("start").alias("to")))
    item = F.struct("start", "rank", "kind", "end")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    grouped = rows.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in base],
        F.sort_array(F.collect_list(item)).alias("items"),
        F.sort_array(F.collect_list(clear)).alias("clear"),
        F.max("end").alias("tail"),
    )
    kinds = [r.kind for r in base]
    return grouped.select(
        "blob", *[f"n_{k}" for k in kinds], named(F.filter("items", lambda s: s["kind"].isin(kinds))).alias("base_spans"), named(F.col("items")).alias("spans"), "clear", "tail"
    )


def stored_findings(versions: DataFrame, ledger: DataFrame, findings: DataFrame, rules: Sequence[Rule] = RULES, content: str = "text") -> DataFrame:
    """Findings of earlier runs for the contents of ``versions`` and ``rules``, in the columns of ``scan_blobs``.

    Only pairs that the ledger lists count: findings stored without their ledger rows are scanned again. Repeats are one.
    """
    tag = F.concat_ws("@", F.col("kind"), F.col("version").cast("string"))
    order = F.create_map(*[F.lit(x) for rank, r in enumerate(rules) for x in (r.tag, rank)])
    mine = findings.where(tag.isin([r.tag for r in rules])).select("blob", "kind", F.col("version").cast("int").alias("version"), order[tag].alias("rank"), "start", "end").distinct()
    listed = ledger.select("blob", "kind", F.col("version").cast("int").alias("version"))
    here = versions.select(address(versions, content).alias("blob"))
    return mine.join(listed, ["blob", "kind", "version"], "left_semi").join(here, "blob", "left_semi")


def scan_versions(
    versions: DataFrame, path: str = "doc_id", content: str = "text", ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, findings: DataFrame | None = None
) -> DataFrame:
    """Every row of ``versions`` with its findings: path, counts, base_sha256, spans, blob.

    With a ledger only unseen pairs are scanned, and ``findings``, the stored results of ``scan_new`` for the pairs
    that it lists, give the others.
    """
    if ledger is not None and findings is None:
        raise ValueError("pairs that the ledger lists are not scanned again: their stored findings are needed")
    found, _ = scan_new(versions, ledger, rules, content)
    if ledger is not None:
        found = found.unionByName(stored_findings(versions, ledger, findings, rules, content))
    summary = keep(per_blob(found).drop("clear", "tail"), "findings")
    rows = versions.select(F.col(path), address(versions, content).alias("blob"))
    joined = rows.join(summary.withColumnRenamed("blob", "__blob"), F.col("blob") == F.col("__blob"), "left")
    base = F.coalesce("base_spans", F.lit(""))
    return joined.select(
        path,
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(base, 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        "blob",
    )


def scan_in_runs(versions: DataFrame, path: str = "doc_id", content: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``scan_versions`` as a corpus that grows is scanned: half of the versions first, then all of them.

    The ledger and the findings of the first run are written tables; the second run reads them, scans only the
    contents that they do not list, and joins stored and new findings back to all paths.
    """
    early = versions.where(F.pmod(F.xxhash64(path), F.lit(2)) == 0)
    found, added = scan_new(early, None, rules, content)
    findings, ledger = keep(found, "findings"), keep(added, "ledger")
    return scan_versions(versions, path, content, ledger, rules, findings)


def redact(docs: DataFrame, content: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The same rows with every found span replaced by a mark; overlapping and touching spans share one.

    Rows without findings, null texts included, come back unchanged; all columns are kept.
    """
    found, _ = scan_new(docs, None, rules, content)
    blob, clear, tail = (free_name(c, docs.columns) for c in ("blob", "clear", "tail"))
    cuts = keep(per_blob(found).select(F.col("blob").alias(blob), F.col("clear").alias(clear), F.col("tail").alias(tail)), "cuts")
    text = F.col(content)
    parts = F.array_join(F.transform(clear, lambda s: F.concat(F.substring(text, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")), F.lit(MARK))), "")
    rest = F.substring(text, (F.col(tail) + 1).cast("int"), F.length(text))
    joined = docs.join(cuts, F.sha2(text_of(content), 256) == F.col(blob), "left")
    clean = F.when(F.col(blob).isNull(), text).otherwise(F.concat(parts, rest))
    return joined.withColumn(content, clean).select(*docs.columns)
