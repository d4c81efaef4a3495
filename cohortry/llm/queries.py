"""The numbered queries, each applying its operator to its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.llm import collocations, decontam, language, packing, quality_model, quality_rules, repeats, secrets, simhash, spelling, toxicity, url_filter, warc
from cohortry.plans.registry import Query
from cohortry.sources.tables import read_table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_in_runs(_table(spark, folder, "documents")).drop("blob")


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents"))


@query("op3_simhash_pivots")
def op3_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    placed = simhash.near_duplicates(_table(spark, folder, "documents"))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.score_all(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query("op5_toxicity_pu")
def op5_toxicity_pu(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_all(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query("op6_repeated_bytes")
def op6_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, folder, "documents")).withColumn("repeated", F.col("n_removed") > 0)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_all(_table(spark, folder, "documents"))


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
w as (select payload_digest, max(page_id) as winner from d where payload_bytes >= 1000 group by payload_digest)
select d.page_id, cast(payload_bytes as bigint) as payload_bytes, d.payload_digest,
  case when winner is null or winner = page_id then 'response' else 'revisit' end as record_type,
  case when winner <> page_id then winner end as refers_to
from d left join w using (payload_digest)
"""


@query("op10_warc_segments", WARC_SQL)
def op10_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.round_trip(_table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


COLLOCATION_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
c1 as (select lang, word, count(*) as f from (select lang, unnest(ws) as word from w) group by all),
sizes as (select lang, cast(sum(f) as bigint) as n from c1 group by lang),
c2 as (select lang, a1, a2, count(*) as f from (select lang, ws[i] as a1, ws[i + 1] as a2 from (select lang, ws, unnest(range(1, len(ws))) as i from w)) group by all having count(*) >= 10),
c3 as (select lang, a1, a2, a3, count(*) as f from (select lang, ws[i] as a1, ws[i + 1] as a2, ws[i + 2] as a3 from (select lang, ws, unnest(range(1, len(ws) - 1)) as i from w)) group by all having count(*) >= 10),
inside as (select lang, a1, a2, max(f) as longest from (select lang, a1, a2, f from c3 union all select lang, a2, a3, f from c3) group by all),
two as (select c2.lang, c2.a1 || ' ' || c2.a2 as phrase, c2.f as a, x.f as l, y.f as r, 1000000 * c2.f::hugeint * c2.f // (x.f::hugeint * y.f) as score
  from c2 join c1 x on x.lang = c2.lang and x.word = c2.a1 join c1 y on y.lang = c2.lang and y.word = c2.a2
  left join inside i on i.lang = c2.lang and i.a1 = c2.a1 and i.a2 = c2.a2 where coalesce(100 * i.longest < 50 * c2.f, true)),
cuts as (select c3.lang, c3.a1 || ' ' || c3.a2 || ' ' || c3.a3 as phrase, c3.f as a, x.f as l1, yz.f as r1, xy.f as l2, z.f as r2,
    1000000 * c3.f::hugeint * c3.f // (x.f::hugeint * yz.f) as s1, 1000000 * c3.f::hugeint * c3.f // (xy.f::hugeint * z.f) as s2
  from c3 join c1 x on x.lang = c3.lang and x.word = c3.a1 join c1 z on z.lang = c3.lang and z.word = c3.a3
  join c2 xy on xy.lang = c3.lang and xy.a1 = c3.a1 and xy.a2 = c3.a2 join c2 yz on yz.lang = c3.lang and yz.a1 = c3.a2 and yz.a2 = c3.a3),
both_ as (select * from two union all select lang, phrase, a, if(s2 < s1, l2, l1), if(s2 < s1, r2, r1), if(s2 < s1, s2, s1) from cuts),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from both_)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join sizes using (lang) where rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def _glob_sql(glob: str) -> str:
    """The regular expression of a glob, as an SQL string."""
    literals, loops = url_filter.tokens(glob)
    runs = ["", "[^/]*", ".*"]
    parts = [runs[loops[0]]]
    for c, loop in zip(literals, loops[1:]):
        parts.append(("." if c is None else c if c.isalnum() else f"[{c}]") + runs[loop])
    return f"'(?s){''.join(parts)}'"


def _url_sql() -> str:
    hosts = url_filter.ranked(url_filter.HOST_RULES)
    fits = [f"when ends_with('.' || host, '.{r.host}') and starts_with(path, '{r.path}')" for r in hosts]
    globs = "\n    ".join(f"when regexp_full_match('.' || host || path, {_glob_sql(g.pattern)})" + " then {}" for g in url_filter.GLOBS)
    given = lambda of: globs.format(*[f"'{of(g)}'" for g in url_filter.GLOBS])
    rule = " ".join(f"{x} then '{r.name}'" for x, r in zip(fits, hosts))
    verdict = " ".join(f"{x} then '{r.verdict}'" for x, r in zip(fits, hosts))
    return f"""
with r as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, case {rule} end as rule,
  case {verdict}
    {given(lambda g: g.verdict)} else '{url_filter.ALLOW}' end as verdict,
  case when {" or ".join(x[5:] for x in fits)} then null
    {given(lambda g: g.pattern)} end as glob
from h
"""


@query("op13_url_filter", _url_sql())
def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"))


def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES["pipeline"] = _pipeline
