"""Signals derived from lineitem: recording = supplier, four channels, 64-sample epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.operators import features as ft, signal as sg
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.views import CHANNELS, EPOCH, V, with_views

FS = 64.0
K = "recording, epoch_id, channel"


def _rounded(d, names, digits=4):
    return d.withColumns({c: r6(F.col(c), digits) for c in names})


@query("drop_channels", with_views("sig", "SELECT * FROM sig WHERE channel NOT IN ('tax', 'none')"))
def drop_channels(spark, folder):
    return sg.drop_channels(V(spark, folder).signal(), ["tax", "none"])


@query(
    "demote_channels",
    """SELECT s_suppkey AS channel, s_acctbal AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z,
      CASE WHEN s_acctbal < 0 OR s_suppkey % 5 = 0 THEN 'misc' ELSE 'eeg' END AS type FROM
      (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal, s_acctbal < 0 AS neg FROM supplier)
      WHERE s_acctbal IS NOT NULL UNION ALL
      SELECT s_suppkey, NULL, 0.0, 0.0, 'misc' FROM supplier WHERE s_acctbal < 0""",
)
def demote_channels(spark, folder):
    s = V(spark, folder).table("supplier")
    x = F.when(F.col("s_acctbal") < 0, None).when(F.col("s_suppkey") % 5 == 0, 0.0).otherwise(F.col("s_acctbal"))
    zero = F.lit(0.0)
    d = s.select(F.col("s_suppkey").alias("channel"), x.alias("x"), zero.alias("y"), zero.alias("z"), F.lit("eeg").alias("type"))
    return sg.demote_channels(d)


@query(
    "avg_reference",
    with_views("sig", f"SELECT recording, channel, t_idx, {R('value - avg(value) OVER (PARTITION BY recording, t_idx)')} AS value FROM sig"),
)
def avg_reference(spark, folder):
    return _rounded(sg.re_reference(V(spark, folder).signal()), ["value"], 6)


@query(
    "named_reference",
    with_views(
        "sig",
        f"""SELECT recording, channel, t_idx, {R("value - avg(value) FILTER (channel IN ('tax', 'discount')) OVER (PARTITION BY recording, t_idx)")}
          AS value FROM sig""",
    ),
)
def named_reference(spark, folder):
    return _rounded(sg.re_reference(V(spark, folder).signal(), ["tax", "discount"]), ["value"], 6)


@query(
    "finite_guard",
    with_views(
        "sig",
        """SELECT recording, channel, t_idx, CASE WHEN t_idx % 7 = 0 THEN 0.0 WHEN t_idx % 7 = 1 THEN 1.7976931348623157e308
          WHEN t_idx % 7 = 2 THEN -1.7976931348623157e308 ELSE value END AS value FROM sig WHERE channel = 'price'""",
    ),
)
def finite_guard(spark, folder):
    d = V(spark, folder).signal().where("channel = 'price'")
    bad = (
        F.when(F.col("t_idx") % 7 == 0, float("nan")).when(F.col("t_idx") % 7 == 1, float("inf")).when(F.col("t_idx") % 7 == 2, float("-inf"))
    )
    return sg.finite_guard(d.withColumn("value", bad.otherwise(F.col("value"))))


@query("fixed_epochs", with_views("ep", "SELECT * FROM ep"))
def fixed_epochs(spark, folder):
    return V(spark, folder).epochs()


@query(
    "overlapping_epochs",
    with_views(
        "sig",
        """SELECT recording, e AS epoch_id, channel, t_idx - e * 48 AS s_idx, value FROM sig
          JOIN (SELECT recording AS r, max(t_idx) + 1 AS n FROM sig GROUP BY 1) ON r = recording, range(1000) t(e)
          WHERE channel = 'price' AND t_idx BETWEEN e * 48 AND e * 48 + 64 AND e * 48 + 65 <= n""",
    ),
)
def overlapping_epochs(spark, folder):
    d = V(spark, folder).signal().where("channel = 'price'")
    return sg.fixed_epochs(d, EPOCH, overlap=16, inclusive_end=True)


def fir_sql(taps) -> str:
    """Convolution by join; indices outside a recording are reflected about its ends."""
    values = ", ".join(f"({i - len(taps) // 2}, {float(h)!r}::DOUBLE)" for i, h in enumerate(taps))
    return f"""SELECT recording, channel, t_idx, {R('sum(h * CASE WHEN j < 0 THEN 2 * e.x0 - s.value WHEN j >= e.n THEN 2 * e.xn - s.value ELSE s.value END)')} AS value
      FROM (SELECT g.recording, g.channel, g.t_idx, e.n, e.x0, e.xn, h, g.t_idx - k AS j,
          CASE WHEN g.t_idx - k < 0 THEN k - g.t_idx WHEN g.t_idx - k >= e.n THEN 2 * (e.n - 1) - (g.t_idx - k) ELSE g.t_idx - k END AS jj
        FROM sig g JOIN ends e USING (recording, channel), (VALUES {values}) t(k, h)) e
      JOIN sig s USING (recording, channel) WHERE s.t_idx = jj GROUP BY ALL""".replace(
        "SELECT recording, channel, t_idx, (round", "SELECT recording, channel, e.t_idx AS t_idx, (round"
    )


ENDS = """ends AS (SELECT recording, channel, max(t_idx) + 1 AS n, arg_min(value, t_idx) AS x0, arg_max(value, t_idx) AS xn
  FROM sig GROUP BY ALL)"""
BAND_TAPS = sg.sinc_taps(FS, 4.0, 13.0, 21)
NOTCH_TAPS = sg.sinc_taps(FS, 19.0, 21.0, 21, stop=True)


@query("bandpass", with_views("sig", fir_sql(BAND_TAPS), ENDS))
def bandpass(spark, folder):
    return _rounded(sg.bandpass(V(spark, folder).signal(), FS, 4.0, 13.0, 21, chunk=256), ["value"], 6)


@query("notch", with_views("sig", fir_sql(NOTCH_TAPS), ENDS))
def notch(spark, folder):
    return _rounded(sg.notch(V(spark, folder).signal(), FS, 20.0, 2.0, 21, chunk=256), ["value"], 6)


@query(
    "decimate_mean",
    with_views("sig", f"SELECT recording, channel, t_idx // 4 AS t_idx, {R('avg(value)')} AS value FROM sig GROUP BY ALL HAVING count(*) = 4"),
)
def decimate_mean(spark, folder):
    return _rounded(sg.decimate_mean(V(spark, folder).signal(), 4), ["value"], 6)


@query(
    "resample",
    with_views(
        "sig",
        f"""SELECT recording, channel, m AS t_idx, {R('sum(h * value) / sum(h)')} AS value FROM (
          SELECT recording, channel, m, value, (CASE WHEN d = 0 THEN 1 ELSE sin(pi() * 0.75 * d) / (pi() * 0.75 * d) END) * (0.5 + 0.5 * cos(pi() * d / 11)) AS h FROM (
            SELECT g.recording, g.channel, g.m, s.value, ((g.m * 4) % 3) / 3.0::DOUBLE - (s.t_idx - (g.m * 4) // 3) AS d FROM
              (SELECT recording, channel, unnest(range(0, max(t_idx) * 3 // 4 + 1)) AS m FROM sig GROUP BY recording, channel) g
              JOIN sig s ON s.recording = g.recording AND s.channel = g.channel AND s.t_idx BETWEEN (g.m * 4) // 3 - 11 AND (g.m * 4) // 3 + 12)
          WHERE abs(d) <= 11) GROUP BY ALL""",
    ),
)
def resample(spark, folder):
    return _rounded(sg.resample(V(spark, folder).signal(), 3, 4, chunk=1024), ["value"], 6)


@query(
    "concat_blocks",
    with_views(
        "sig",
        """SELECT recording, channel, t_idx - (t_idx // 50) * 10 AS t_idx, value FROM sig
          WHERE t_idx // 50 < 5 AND t_idx % 50 < 40 AND channel = 'price'""",
    ),
)
def concat_blocks(spark, folder):
    s = V(spark, folder).signal().where("channel = 'price'").where("t_idx % 50 < 40")
    s = s.select("recording", F.expr("t_idx div 50").alias("block"), "channel", (F.col("t_idx") % 50).alias("s_idx"), "value")
    blocks = s.groupBy("recording", "block").agg(F.count(F.lit(1)).alias("length"))
    return sg.concat_blocks(blocks, s, 5)


@query(
    "signal_steps",
    with_views(
        "sig",
        f"""SELECT recording, t_idx // 32 AS epoch_id, channel, t_idx % 32 AS s_idx, {R('value')} AS value FROM (
          SELECT *, max(t_idx) OVER (PARTITION BY recording) + 1 AS n FROM (
          SELECT recording, channel, t_idx // 2 AS t_idx, avg(value) AS value FROM (
            SELECT recording, channel, t_idx, value - avg(value) OVER (PARTITION BY recording, t_idx) AS value FROM sig WHERE channel <> 'tax')
          GROUP BY ALL HAVING count(*) = 2)) WHERE (t_idx // 32 + 1) * 32 <= n""",
    ),
)
def signal_steps(spark, folder):
    steps = [{"drop_channels": {"names": ["tax"]}}, {"re_reference": {}}, {"decimate_mean": {"factor": 2}}, {"fixed_epochs": {"length": 32}}]
    return _rounded(sg.run_steps(V(spark, folder).signal(), steps), ["value"], 6)


# ---------------------------------------------------------- time features

LAGS = f"""l1 AS (SELECT *, lag(value) OVER w AS prev, value - coalesce(lag(value) OVER w, 0) AS d1, first_value(value) OVER w AS x0
    FROM ep WINDOW w AS (PARTITION BY {K} ORDER BY s_idx)),
  l2 AS (SELECT *, d1 - coalesce(lag(d1) OVER (PARTITION BY {K} ORDER BY s_idx), 0) AS d2 FROM l1)"""


def _vz(c):
    return f"((sum({c} * {c}) - sum({c}) * sum({c}) / (count({c}) + 1)) / count({c}))"


MOB = f"stddev_samp(d1) / nullif(sqrt({_vz('value')}), 0)"
MOB1 = f"stddev_samp(d2) / nullif(sqrt({_vz('d1')}), 0)"
STEP = "abs(value - prev)"
KN = f"log10(sum({STEP}) / nullif(avg({STEP}), 0))"
KD = f"log10(nullif(max(abs(value - x0)), 0) / nullif(sum({STEP}), 0))"
TIME_SQL = {
    "std": "stddev_pop(value)",
    "mean": "avg(value)",
    "ptp": "max(value) - min(value)",
    "skew": "skew",
    "var": "var_pop(value)",
    "rms": "sqrt(avg(value * value))",
    "kurt": "kurtosis_pop(value) + 3",
    "zcr": "count(*) FILTER (value * prev < 0)",
    "hj_mob": MOB,
    "hj_com": f"({MOB1}) / nullif({MOB}, 0)",
    "line_length": f"avg({STEP})",
    "katz_fd": f"{KN} / nullif({KN} + {KD}, 0)",
}
# population skewness; DuckDB's skewness() is the sample form
TIME_SQL["skew"] = "(avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) * avg(value) * avg(value)) / nullif(pow(stddev_pop(value), 3), 0)"


def _time_query(name):
    digits = 1 if name == "var" else 4
    expr = TIME_SQL[name] if name == "zcr" else R(TIME_SQL[name], digits)

    @query(f"feat_{name}", with_views("ep", f"SELECT {K}, {expr} AS {name} FROM l2 GROUP BY {K}", LAGS))
    def run(spark, folder):
        d = ft.time_features(V(spark, folder).epochs(), [name])
        return d if name == "zcr" else _rounded(d, [name], digits)


for _n in TIME_SQL:
    _time_query(_n)


@query(
    "feat_quantile",
    with_views(
        "ep",
        f"""SELECT {K}, {R('quantile_cont(value, 0.25)', 4)} AS q25, {R('quantile_cont(value, 0.5)', 4)} AS q50,
          {R('quantile_cont(value, 0.75)', 4)} AS q75 FROM ep GROUP BY {K}""",
    ),
)
def feat_quantile(spark, folder):
    return _rounded(ft.time_features(V(spark, folder).epochs(), ["q25", "q50", "q75"]), ["q25", "q50", "q75"])


# ------------------------------------------------------------ kernels


def _kernel_query(name, columns, sql=None, digits=4, log=False):
    @query(name, sql)
    def run(spark, folder):
        feature = name.removeprefix("feat_")
        d = ft.kernel_features(ft.epoch_arrays(V(spark, folder).epochs()), [feature], FS, EPOCH)
        if log:
            d = d.withColumns({c: F.log10(F.nullif(F.round(c, 9), F.lit(0.0))) for c in columns})
        return _rounded(d, columns or [c for c in d.columns if c not in ft.KEY], digits)


_kernel_query(
    "feat_decorr_time",
    ["decorr_time"],
    with_views(
        "ep",
        f"""SELECT {K}, min(k) FILTER (r < exp(-1) - 0) / 64.0::DOUBLE AS decorr_time FROM (
          SELECT a.recording, a.epoch_id, a.channel, b.s_idx - a.s_idx AS k, sum((a.value - m) * (b.value - m)) / nullif(max(v), 0) AS r
          FROM ep a JOIN ep b USING (recording, epoch_id, channel) JOIN (SELECT {K}, avg(value) AS m, var_pop(value) * count(*) AS v
            FROM ep GROUP BY {K}) c USING (recording, epoch_id, channel) WHERE b.s_idx >= a.s_idx GROUP BY ALL) GROUP BY {K}""",
    ).replace("min(k) FILTER", "round(min(k) FILTER").replace("/ 64.0::DOUBLE AS", "/ 64.0::DOUBLE + 1e-10, 4) + 0.0 AS"),
)
_kernel_query(
    "feat_higuchi_fd",
    ["higuchi_fd"],
    with_views(
        "ep",
        f"""SELECT {K}, {R('regr_slope(ln(l), ln(1.0::DOUBLE / k))', 4)} AS higuchi_fd FROM (
          SELECT {K}, k, avg(s * 63.0::DOUBLE / (c * k) / k) AS l FROM (
            SELECT a.recording, a.epoch_id, a.channel, k, a.s_idx % k AS m, sum(abs(b.value - a.value)) AS s, count(*) AS c
            FROM ep a, range(1, 11) t(k) JOIN ep b ON b.recording = a.recording AND b.epoch_id = a.epoch_id AND b.channel = a.channel
              AND b.s_idx = a.s_idx + k GROUP BY ALL) GROUP BY {K}, k) WHERE l > 0 GROUP BY {K}""",
    ),
)


def _entropy_sql(kind: str) -> str:
    near2 = "abs(a.value - b.value) <= a.tol AND abs(a.v1 - b.v1) <= a.tol"
    pairs = f"""em AS MATERIALIZED (SELECT *, lead(value) OVER w AS v1, lead(value, 2) OVER w AS v2, 0.2 * stddev_samp(value) OVER (PARTITION BY {K}) AS tol
        FROM ep WINDOW w AS (PARTITION BY {K} ORDER BY s_idx)),
      pr AS (SELECT a.recording, a.epoch_id, a.channel, a.s_idx, count(*) FILTER ({near2} AND a.s_idx < 62 AND b.s_idx < 62) AS n2s,
        count(*) FILTER ({near2} AND a.v1 IS NOT NULL AND b.v1 IS NOT NULL) AS n2,
        count(*) FILTER ({near2} AND abs(a.v2 - b.v2) <= a.tol) AS n3
        FROM em a JOIN em b USING (recording, epoch_id, channel) GROUP BY ALL)"""
    if kind == "samp":
        expr = "CASE WHEN sum(n3 - 1) FILTER (s_idx < 62) > 0 THEN -ln((avg(n3 - 1) FILTER (s_idx < 62)) / (avg(n2s - 1) FILTER (s_idx < 62))) END"
    else:
        expr = "avg(ln(n2 / 63.0::DOUBLE)) FILTER (s_idx < 63) - avg(ln(n3 / 62.0::DOUBLE)) FILTER (s_idx < 62)"
    return with_views("ep", f"SELECT {K}, {R(expr, 4)} AS {kind}_entropy FROM pr GROUP BY {K}", pairs)


_kernel_query("feat_samp_entropy", ["samp_entropy"], _entropy_sql("samp"))
_kernel_query("feat_app_entropy", ["app_entropy"], _entropy_sql("app"))
_kernel_query("feat_hurst", None)
_kernel_query("feat_svd", None)
_kernel_query("feat_wavelet_energy", None)
_kernel_query("feat_teager_kaiser", None)

DFT = f"""df AS (SELECT {K}, f, pow(sum(value * cos(2 * pi() * f * s_idx / 64)), 2) + pow(sum(value * sin(2 * pi() * f * s_idx / 64)), 2) AS q
  FROM ep, range(33) t(f) GROUP BY ALL)"""
_kernel_query(
    "feat_band_energy",
    [f"band_energy_B{i + 1}" for i in range(5)],
    with_views(
        "ep",
        f"SELECT {K}, "
        + ", ".join(
            f"{R(f'log10(nullif(round(sum(q * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END) FILTER (f >= {lo} AND f < {hi}) / 64, 9), 0))', 6)} AS band_energy_B{i + 1}"
            for i, (lo, hi) in enumerate(ft.BANDS)
        )
        + f" FROM df GROUP BY {K}",
        DFT,
    ),
    digits=6,
    log=True,
)

# ------------------------------------------------------------ spectra

PSD = f"""sg AS (SELECT {K}, g, s_idx - g * 16 AS i, (value - avg(value) OVER (PARTITION BY {K}, g)) * (0.5 - 0.5 * cos(2 * pi() * (s_idx - g * 16) / 32)) AS v
    FROM ep, range(3) t(g) WHERE s_idx BETWEEN g * 16 AND g * 16 + 31),
  sf AS (SELECT {K}, g, f, pow(sum(v * cos(2 * pi() * f * i / 32)), 2) + pow(sum(v * sin(2 * pi() * f * i / 32)), 2) AS q
    FROM sg, range(17) t(f) GROUP BY ALL),
  ps AS MATERIALIZED (SELECT {K}, f * 2.0::DOUBLE AS freq, avg(q) / (64 * 12) * CASE WHEN f IN (0, 16) THEN 1 ELSE 2 END AS power FROM sf GROUP BY {K}, f)"""


def psd(spark, folder):
    return ft.psd_welch(ft.epoch_arrays(V(spark, folder).epochs()), FS, 32)


@query("psd_welch", with_views("ep", f"SELECT {K}, freq, {R('log10(power)')} AS log_power FROM ps WHERE power > 1e-12", PSD))
def psd_welch(spark, folder):
    d = psd(spark, folder).where("power > 1e-12")
    return d.select(*ft.KEY, "freq", r6(F.log10("power")).alias("log_power"))


BP = "bp AS (SELECT " + K + ", " + ", ".join(
    f"coalesce(sum(power) FILTER (freq >= {lo} AND freq < {hi}), 0) / nullif(sum(power) FILTER (freq >= 0.5 AND freq < 100), 0) AS powB_B{i + 1}"
    for i, (lo, hi) in enumerate(ft.BANDS)
) + f" FROM ps GROUP BY {K})"
BANDS = [f"powB_B{i + 1}" for i in range(5)]


@query("feat_band_power", with_views("ep", f"SELECT {K}, {', '.join(f'{R(b)} AS {b}' for b in BANDS)} FROM bp", PSD + ", " + BP))
def feat_band_power(spark, folder):
    return _rounded(ft.band_power(psd(spark, folder)), BANDS, 6)


PAIRS = [(i, j) for i in range(1, 6) for j in range(i + 1, 6)]


@query(
    "band_ratios",
    with_views("ep", f"SELECT {K}, {', '.join(f'{R(f'powB_B{i} / nullif(powB_B{j}, 0)', 4)} AS ratio_B{i}_B{j}' for i, j in PAIRS)} FROM bp", PSD + ", " + BP),
)
def band_ratios(spark, folder):
    d = ft.band_ratios(ft.band_power(psd(spark, folder)), upper_only=True)
    return _rounded(d, [f"ratio_B{i}_B{j}" for i, j in PAIRS])


@query(
    "feat_spec_slope",
    with_views(
        "ep",
        f"""SELECT {K}, {R('regr_intercept(y, x)', 5)} AS intercept, {R('regr_slope(y, x)', 5)} AS slope,
          {R('greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / count(*)', 5)} AS mse,
          {R('1 - greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / regr_syy(y, x)', 5)} AS r2
          FROM (SELECT {K}, log10(freq) AS x, log10(power) AS y FROM ps WHERE freq > 0.1 AND freq <= 50 AND power > 0) GROUP BY {K}""",
        PSD,
    ),
)
def feat_spec_slope(spark, folder):
    return _rounded(ft.spectral_slope(psd(spark, folder)), ["intercept", "slope", "mse", "r2"], 5)


@query(
    "feat_spec_edge",
    with_views(
        "ep",
        f"""SELECT {K}, min(freq) FILTER (c >= 0.5 * t * (1 - 1e-12)) AS specEdge_E1, min(freq) FILTER (c >= 0.95 * t * (1 - 1e-12)) AS specEdge_E2
          FROM (SELECT *, sum(power) OVER (PARTITION BY {K} ORDER BY freq) AS c, sum(power) OVER (PARTITION BY {K}) AS t FROM ps) GROUP BY {K}""",
        PSD,
    ),
)
def feat_spec_edge(spark, folder):
    return ft.spectral_edges(psd(spark, folder))


MOMENTS = f"""SELECT {K}, {{cols}} FROM (SELECT {K}, freq AS f, power / nullif(sum(power) OVER (PARTITION BY {K}), 0) AS q FROM ps) GROUP BY {K}"""


@query(
    "feat_hj_spect",
    with_views("ep", MOMENTS.format(cols=f"{R('sum(f * f * q)', 4)} AS hj_mob_spect, {R('sum(f * f * f * f * q)', 2)} AS hj_com_spect"), PSD),
)
def feat_hj_spect(spark, folder):
    d = ft.spectral_moments(psd(spark, folder)).drop("spec_entropy")
    return d.withColumns({"hj_mob_spect": r6(F.col("hj_mob_spect"), 4), "hj_com_spect": r6(F.col("hj_com_spect"), 2)})


@query(
    "feat_spec_entropy",
    with_views("ep", MOMENTS.format(cols=f"{R('sum(CASE WHEN q > 0 THEN -q * log2(q) ELSE 0 END)')} AS spec_entropy"), PSD),
)
def feat_spec_entropy(spark, folder):
    return _rounded(ft.spectral_moments(psd(spark, folder)).select(*ft.KEY, "spec_entropy"), ["spec_entropy"], 6)


@query(
    "extract_features",
    with_views(
        "ep",
        "SELECT recording, epoch_id, "
        + ", ".join(
            f"{R(f'{e} FILTER (channel = {c!r})', 4)} AS {n}_{c}"
            for n, e in (("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("line_length", "avg(abs(value - prev))"))
            for c in CHANNELS
        )
        + " FROM l2 GROUP BY recording, epoch_id",
        LAGS,
    ),
)
def extract_features(spark, folder):
    d = ft.extract_features(V(spark, folder).epochs(), CHANNELS, ["mean", "std", "line_length"])
    return _rounded(d, [c for c in d.columns if c not in ("recording", "epoch_id")])


ASKED = {" STD": "std", "Ptp ": "ptp", "mean": "mean"}


@query(
    "feature_help",
    with_views(
        "ep",
        """SELECT feature, meaning, count(value) AS n_values FROM (SELECT recording, epoch_id, channel, stddev_pop(value) AS std, max(value) - min(value) AS ptp, avg(value) AS mean
          FROM ep GROUP BY ALL) UNPIVOT (value FOR feature IN (std, ptp, mean)) JOIN (VALUES """
        + ", ".join(f"('{c}', '{ft.HELP[c]}')" for c in ASKED.values())
        + ") h(feature, meaning) USING (feature) GROUP BY ALL",
    ),
)
def feature_help(spark, folder):
    """Features asked for in any spelling, what they mean, and how many values the signal gives."""
    names = ft.validate_names(list(ASKED))
    d = ft.time_features(V(spark, folder).epochs(), names).unpivot(["recording", "epoch_id", "channel"], names, "feature", "value")
    return d.join(ft.help_table(spark), "feature").groupBy("feature", "meaning").agg(F.count("value").alias("n_values"))
