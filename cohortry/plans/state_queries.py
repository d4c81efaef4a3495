"""State sequences: event types of a user in time order, 32-sample epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.operators import states as st
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.views import N_STATES, V, with_views

FS = 8.0
K = "recording, epoch_id"
NAMES = ["A", "B", "C", "D"]


def states(spark, folder):
    return V(spark, folder).states()


def _rounded(d):
    return d.withColumns({c: r6(F.col(c)) for c in d.columns if c not in ("recording", "epoch_id")})


COVER = ", ".join(f"{R(f'count(*) FILTER (state = {i})::DOUBLE / nullif(count(state), 0)')} AS cover_{n}" for i, n in enumerate(NAMES))


@query("state_coverage", with_views("st", f"SELECT {K}, {COVER} FROM st GROUP BY {K}"))
def state_coverage(spark, folder):
    return _rounded(st.coverage(states(spark, folder), N_STATES, NAMES))


RUNS = f"""rn AS (SELECT {K}, r, any_value(state) AS state, min(t_idx) AS start, count(*) AS length, max(last) AS last FROM (
    SELECT *, sum(CAST(state IS DISTINCT FROM prev OR prev_t IS NULL AS INTEGER)) OVER (PARTITION BY {K} ORDER BY t_idx) AS r,
      max(t_idx) OVER (PARTITION BY {K}) AS last FROM (SELECT *, lag(state) OVER w AS prev, lag(t_idx) OVER w AS prev_t FROM st
      WINDOW w AS (PARTITION BY {K} ORDER BY t_idx))) GROUP BY {K}, r)"""
DUR = ", ".join(
    f"CASE WHEN count(state) > 0 THEN {R(f'coalesce(avg(length) FILTER (state = {i} AND start < last) / 8.0::DOUBLE, 0)')} END AS mean_dur_{n}"
    for i, n in enumerate(NAMES)
)
OCC = ", ".join(
    f"{R(f'count(*) FILTER (state = {i}) / (sum(length) FILTER (state IS NOT NULL) / 8.0::DOUBLE)')} AS occ_rate_{n}" for i, n in enumerate(NAMES)
)


@query("state_mean_duration", with_views("st", f"SELECT {K}, {DUR} FROM rn GROUP BY {K}", RUNS))
def state_mean_duration(spark, folder):
    return _rounded(st.mean_duration(states(spark, folder), N_STATES, FS, NAMES))


@query("state_occurrence", with_views("st", f"SELECT {K}, {OCC} FROM rn GROUP BY {K}", RUNS))
def state_occurrence(spark, folder):
    return _rounded(st.occurrence(states(spark, folder), N_STATES, FS, NAMES))


ENTROPY = f"""en AS (SELECT {K}, sum(CASE WHEN n > 0 THEN -n / t * ln(n / t) END) AS entropy_nats FROM (
  SELECT {K}, state, count(state)::DOUBLE AS n, sum(count(state)) OVER (PARTITION BY {K}) AS t FROM st GROUP BY {K}, state) GROUP BY {K})"""


@query("state_entropy", with_views("st", f"SELECT {K}, {R('entropy_nats')} AS entropy_nats FROM en", ENTROPY))
def state_entropy(spark, folder):
    return _rounded(st.entropy(states(spark, folder)))


PAIRS = [(i, j) for i in range(N_STATES) for j in range(N_STATES) if i != j]
TP = ", ".join(
    f"{R(f'coalesce(count(*) FILTER (state = {i} AND nxt = {j})::DOUBLE / nullif(count(*) FILTER (state = {i} AND nxt <> {i}), 0), 0)')}"
    f" AS tp_{NAMES[i]}_to_{NAMES[j]}"
    for i, j in PAIRS
)


@query(
    "state_transitions",
    with_views(
        "st",
        f"""SELECT {K}, {TP} FROM (SELECT DISTINCT {K} FROM st) LEFT JOIN (SELECT *, lead(state) OVER (PARTITION BY {K} ORDER BY t_idx) AS nxt
          FROM st WHERE state IS NOT NULL) USING ({K}) GROUP BY {K}""",
    ),
)
def state_transitions(spark, folder):
    return _rounded(st.transitions(states(spark, folder), N_STATES, NAMES))


@query("state_lzc")
def state_lzc(spark, folder):
    return st.lempel_ziv(states(spark, folder))


@query(
    "state_features",
    with_views(
        "st",
        f"SELECT * FROM (SELECT {K}, {COVER} FROM st GROUP BY {K}) JOIN (SELECT {K}, {OCC} FROM rn GROUP BY {K}) USING ({K}) "
        f"JOIN (SELECT {K}, {R('entropy_nats')} AS entropy_nats FROM en) USING ({K})",
        RUNS + ", " + ENTROPY,
    ),
)
def state_features(spark, folder):
    return _rounded(st.state_features(states(spark, folder), N_STATES, FS, ["coverage", "occurrence", "entropy"], NAMES))


GFP = f"gf AS (SELECT {K}, s_idx, stddev_pop(value) AS gfp FROM ep GROUP BY ALL)"


@query(
    "gfp_peaks",
    with_views(
        "ep",
        f"""SELECT {K}, s_idx, {R('gfp', 4)} AS gfp FROM (SELECT *, lag(gfp) OVER w AS a, lead(gfp) OVER w AS b FROM gf
          WINDOW w AS (PARTITION BY {K} ORDER BY s_idx)) WHERE gfp > a AND gfp > b""",
        GFP,
    ),
)
def gfp_peaks(spark, folder):
    return st.gfp_peaks(V(spark, folder).epochs()).withColumn("gfp", r6(F.col("gfp"), 4))


@query("gfp_peaks_spaced")
def gfp_peaks_spaced(spark, folder):
    return st.gfp_peaks(V(spark, folder).epochs(), min_distance=3)
