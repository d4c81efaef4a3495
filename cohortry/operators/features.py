"""Per-epoch signal features: one value per (recording, epoch, channel).

An epoch has a fixed length, so a group is bounded whatever the recording's size.
Time features are one window pass and one aggregate; spectral features are SQL on a
shared density; the rest run on batches of epoch arrays in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry.functions import kernels

KEY = ["recording", "epoch_id", "channel"]
BANDS = [(0.5, 4.0), (4.0, 8.0), (8.0, 13.0), (13.0, 30.0), (30.0, 100.0)]

# ------------------------------------------------------------ time domain


def with_lags(epochs: DataFrame) -> DataFrame:
    """Previous sample, difference and second difference (0 before the first)."""
    w = W.partitionBy(*KEY).orderBy("s_idx")
    d = epochs.withColumn("prev", F.lag("value").over(w))
    d = d.withColumn("d1", F.col("value") - F.coalesce("prev", F.lit(0.0)))
    d = d.withColumn("d2", F.col("d1") - F.coalesce(F.lag("d1").over(w), F.lit(0.0)))
    return d.withColumn("x0", F.first("value").over(w))


def _var_with_zero(c: Column) -> Column:
    """Sample variance of the values and one extra zero."""
    n, s, ss = F.count(c) + 1, F.sum(c), F.sum(c * c)
    return (ss - s * s / n) / (n - 1)


def _mobility(x: Column, dx: Column) -> Column:
    return F.try_divide(F.stddev_samp(dx), F.sqrt(_var_with_zero(x)))


def time_aggregates(quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> dict[str, Column]:
    v, step = F.col("value"), F.abs(F.col("value") - F.col("prev"))
    katz_n = F.log10(F.try_divide(F.sum(step), F.avg(step)))
    katz_d = F.log10(F.try_divide(F.max(F.abs(v - F.col("x0"))), F.sum(step)))
    out = {
        "std": F.stddev_pop(v),
        "mean": F.avg(v),
        "ptp": F.max(v) - F.min(v),
        "skew": F.skewness(v),
        "var": F.var_pop(v),
        "rms": F.sqrt(F.avg(v * v)),
        "kurt": F.kurtosis(v) + 3,
        "zcr": F.count_if(v * F.col("prev") < 0),
        "hj_mob": _mobility(v, F.col("d1")),
        "hj_com": F.try_divide(_mobility(F.col("d1"), F.col("d2")), _mobility(v, F.col("d1"))),
        "line_length": F.avg(step),
        "katz_fd": F.try_divide(katz_n, katz_n + katz_d),
    }
    for q in quantiles:
        out[f"q{round(q * 100)}"] = F.percentile(v, q)
    return out


def time_features(epochs: DataFrame, names: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    aggs = time_aggregates(quantiles)
    if unknown := [n for n in names if n not in aggs]:
        raise KeyError(f"unknown features: {unknown}")
    lagged = {"zcr", "hj_mob", "hj_com", "line_length", "katz_fd"} & set(names)
    d = with_lags(epochs) if lagged else epochs
    return d.groupBy(*KEY).agg(*[aggs[n].alias(n) for n in names])


# ------------------------------------------------------------ epoch arrays


def epoch_arrays(epochs: DataFrame) -> DataFrame:
    """Samples of an epoch in time order as one array (bounded by its length)."""
    pairs = F.sort_array(F.collect_list(F.struct("s_idx", "value")))
    return epochs.groupBy(*KEY).agg(F.transform(pairs, lambda p: p["value"]).alias("x"))


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, part in pdf.groupby(pdf["x"].str.len()):
        yield part, np.stack(part["x"].to_numpy()).astype(float)


def array_features(arrays: DataFrame, columns: Sequence[str], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a batch kernel (rows x samples -> rows x columns); NaN becomes null."""
    types = dict(arrays.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x in _by_length(pdf):
                values = np.asarray(fn(x)).reshape(len(part), -1)
                out = part[KEY].reset_index(drop=True)
                for i, c in enumerate(columns):
                    out[c] = values[:, i] if i < values.shape[1] else np.nan
                yield out

    schema = ", ".join(f"{k} {types[k]}" for k in KEY) + "".join(f", {c} double" for c in columns)
    d = arrays.mapInPandas(run, schema)
    return d.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def kernel_registry(fs: float, length: int, level: float = math.exp(-1), kmax: int = 10, emb: int = 2) -> dict:
    """{feature: (columns, kernel)} for epochs of a given length."""
    levels = min(6, int(math.floor(math.log2(max(length / 7, 1)))))
    return {
        "decorr_time": (["decorr_time"], lambda x: kernels.decorrelation(x, fs, level)),
        "higuchi_fd": (["higuchi_fd"], lambda x: kernels.higuchi(x, kmax)),
        "hurst": (["hurst"], kernels.hurst),
        "samp_entropy": (["samp_entropy"], lambda x: kernels.sample_entropy(x, emb)),
        "app_entropy": (["app_entropy"], lambda x: kernels.approximate_entropy(x, emb)),
        "svd": (["svd_entropy", "svd_fisher"], kernels.svd_measures),
        "band_energy": ([f"band_energy_B{i + 1}" for i in range(len(BANDS))], lambda x: kernels.band_energy(x, fs, BANDS)),
        "wavelet_energy": ([f"wavelet_energy_L{i + 1}" for i in range(levels)], kernels.wavelet_energy),
        "teager_kaiser": ([f"tke_L{i}_C{c}" for i in range(levels + 1) for c in (1, 2)], kernels.teager_kaiser),
    }


def kernel_features(arrays: DataFrame, names: Sequence[str], fs: float, length: int, **options) -> DataFrame:
    """All named kernels in one pass over the arrays."""
    registry = kernel_registry(fs, length, **options)
    if unknown := [n for n in names if n not in registry]:
        raise KeyError(f"unknown features: {unknown}")
    picked = [registry[n] for n in names]
    columns = [c for cols, _ in picked for c in cols]

    def run(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.asarray(fn(x), dtype=float).reshape(len(x), -1) for _, fn in picked], axis=1)

    return array_features(arrays, columns, run)


# -------------------------------------------------------------- frequency


def psd_welch(arrays: DataFrame, fs: float, nperseg: int = 256) -> DataFrame:
    """(key, freq, power) one-sided density."""
    types = dict(arrays.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x in _by_length(pdf):
                f, p = kernels.welch(x, fs, nperseg)
                yield part[KEY].assign(freq=[f] * len(part), power=list(p))

    schema = ", ".join(f"{k} {types[k]}" for k in KEY) + ", freq array<double>, power array<double>"
    d = arrays.mapInPandas(run, schema)
    return d.select(*KEY, F.inline(F.arrays_zip("freq", "power")))


def band_power(psd: DataFrame, bands: Sequence[tuple[float, float]] = BANDS, normalize: bool = True, log: bool = False) -> DataFrame:
    """Power per band [low, high), as a share of the bands' total, one column each."""
    f, p = F.col("freq"), F.col("power")
    sums = [F.sum(F.when((f >= lo) & (f < hi), p).otherwise(0.0)).alias(f"__b{i}") for i, (lo, hi) in enumerate(bands)]
    lo, hi = min(b[0] for b in bands), max(b[1] for b in bands)
    total = F.sum(F.when((f >= lo) & (f < hi), p)).alias("__total")
    d = psd.groupBy(*KEY).agg(*sums, total)
    share = lambda i: F.try_divide(F.col(f"__b{i}"), F.col("__total")) if normalize else F.col(f"__b{i}")
    value = (lambda c: F.log10(c)) if log else (lambda c: c)
    return d.select(*KEY, *[value(share(i)).alias(f"powB_B{i + 1}") for i in range(len(bands))])


def band_ratios(powers: DataFrame, n_bands: int = len(BANDS), upper_only: bool = False) -> DataFrame:
    """Ratios between band powers."""
    pairs = [(i, j) for i in range(1, n_bands + 1) for j in range(1, n_bands + 1) if (i < j if upper_only else i != j)]
    cols = [F.try_divide(F.col(f"powB_B{i}"), F.col(f"powB_B{j}")).alias(f"ratio_B{i}_B{j}") for i, j in pairs]
    return powers.select(*KEY, *cols)


def spectral_slope(psd: DataFrame, fmin: float = 0.1, fmax: float = 50.0) -> DataFrame:
    """Line through log10 power against log10 frequency."""
    d = psd.where((F.col("freq") >= fmin) & (F.col("freq") <= fmax) & (F.col("freq") > 0) & (F.col("power") > 0))
    d = d.select(*KEY, F.log10("freq").alias("x"), F.log10("power").alias("y"))
    fit = d.groupBy(*KEY).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_syy("y", "x").alias("__syy"), F.regr_sxy("y", "x").alias("__sxy"), F.count("y").alias("__n"),
    )
    rest = F.greatest(F.col("__syy") - F.col("slope") * F.col("__sxy"), F.lit(0.0))
    return fit.select(
        *KEY, "intercept", "slope", (rest / F.col("__n")).alias("mse"), (1 - F.try_divide(rest, F.col("__syy"))).alias("r2")
    )


def spectral_edges(psd: DataFrame, edges: Sequence[float] = (0.5, 0.95), ref_freq: float | None = None) -> DataFrame:
    """Lowest frequency at which the cumulative share of power reaches each edge."""
    d = psd if ref_freq is None else psd.where(F.col("freq") <= ref_freq)
    group = W.partitionBy(*KEY)
    run = group.orderBy("freq").rowsBetween(W.unboundedPreceding, 0)
    d = d.select(*KEY, "freq", F.sum("power").over(run).alias("__c"), F.sum("power").over(group).alias("__t"))
    hit = lambda e: F.min(F.when(F.col("__c") >= e * F.col("__t") * (1 - 1e-12), F.col("freq")))
    return d.groupBy(*KEY).agg(*[hit(e).alias(f"specEdge_E{i + 1}") for i, e in enumerate(edges)])


def spectral_moments(psd: DataFrame) -> DataFrame:
    """Second and fourth moment of the normalised density, and its entropy in bits."""
    f, p = F.col("freq"), F.col("power")
    total = F.sum("power").over(W.partitionBy(*KEY))
    d = psd.withColumn("__p", F.try_divide(p, total))
    q = F.col("__p")
    return d.groupBy(*KEY).agg(
        F.sum(f * f * q).alias("hj_mob_spect"),
        F.sum(f * f * f * f * q).alias("hj_com_spect"),
        F.sum(F.when(q > 0, -q * F.log2(q)).otherwise(0.0)).alias("spec_entropy"),
    )


# ---------------------------------------------------------------- registry

HELP = {
    "std": "standard deviation (population)",
    "mean": "mean amplitude",
    "ptp": "largest minus smallest sample",
    "skew": "asymmetry of the amplitudes",
    "var": "variance (population)",
    "rms": "root of the mean square",
    "kurt": "tailedness; 3 for a normal distribution",
    "zcr": "number of sign changes between neighbouring samples",
    "quantile": "linear quantiles of the amplitudes",
    "hj_mob": "spread of the derivative relative to the signal",
    "hj_com": "mobility of the derivative relative to the signal's",
    "decorr_time": "first lag with autocorrelation below a level, seconds",
    "line_length": "mean absolute difference of neighbouring samples",
    "katz_fd": "fractal dimension from path length and extent",
    "higuchi_fd": "fractal dimension from curve lengths at growing steps",
    "hurst": "slope of the rescaled range",
    "samp_entropy": "sample entropy, embedding 2",
    "app_entropy": "approximate entropy, embedding 2",
    "svd": "entropy and Fisher information of embedding singular values",
    "teager_kaiser": "mean and sd of the energy operator per wavelet level",
    "wavelet_energy": "energy of each wavelet detail level",
    "band_energy": "energy inside each frequency band",
    "band_power": "share of spectral power per band",
    "spec_slope": "line through the log-log spectrum",
    "spec_edge": "frequency below which a share of the power lies",
    "hj_spect": "second and fourth spectral moments",
    "spec_entropy": "entropy of the spectrum",
}


def validate_names(names: Sequence[str], known: Sequence[str] = tuple(HELP)) -> list[str]:
    """Registered spelling of each name, whatever its case or blanks."""
    by = {k.strip().lower(): k for k in known}
    if unknown := [n for n in names if n.strip().lower() not in by]:
        raise KeyError(f"unknown features {unknown}; known: {sorted(known)}")
    return [by[n.strip().lower()] for n in names]


def help_table(spark) -> DataFrame:
    return spark.createDataFrame(sorted(HELP.items()), "feature string, meaning string")


# ------------------------------------------------------------------ family


def pivot_channels(features: DataFrame, names: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """One row per epoch, one column per feature and channel."""
    wide = features.groupBy("recording", "epoch_id").pivot("channel", list(channels))
    d = wide.agg(*[F.first(n).alias(n) for n in names])
    if len(names) == 1:
        return d.select("recording", "epoch_id", *[F.col(c).alias(f"{names[0]}_{c}") for c in channels])
    return d.select("recording", "epoch_id", *[F.col(f"{c}_{n}").alias(f"{n}_{c}") for n in names for c in channels])


def extract_features(
    epochs: DataFrame, channels: Sequence[str], time: Sequence[str], kernel: Sequence[str] = (), fs: float = 1.0, length: int = 64
) -> DataFrame:
    """Named features of both kinds, one row per (recording, epoch)."""
    out = time_features(epochs, time)
    names = list(time)
    if kernel:
        more = kernel_features(epoch_arrays(epochs), kernel, fs, length)
        names += [c for c in more.columns if c not in KEY]
        out = out.join(more, KEY)
    return pivot_channels(out, names, channels)
