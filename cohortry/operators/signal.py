"""Preparation of long signal tables (recording, channel, t_idx, value).

Filters look only a fixed number of samples to either side, so a recording is cut
into chunks that carry that margin, and no task ever holds a whole recording.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from cohortry.functions.ordering import row_index

CHUNK = 8192
#: Taps from which on filters are applied by FFT.
LONG_FILTER = 192


def drop_channels(signal: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the named channels; unknown names are ignored."""
    return signal.where(~F.col("channel").isin(list(names)))


def demote_channels(channels: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Channels without a finite, nonzero position become 'misc'."""
    xyz = [F.col(c) for c in ("x", "y", "z")]
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    placed = finite(xyz[0]) & finite(xyz[1]) & finite(xyz[2])
    norm = F.sqrt(xyz[0] * xyz[0] + xyz[1] * xyz[1] + xyz[2] * xyz[2])
    return channels.withColumn("type", F.when(placed & (norm > eps), F.col("type")).otherwise("misc"))


def re_reference(signal: DataFrame, reference: Sequence[str] | None = None) -> DataFrame:
    """Subtract the mean over all (or the reference) channels at every instant."""
    instant = W.partitionBy("recording", "t_idx")
    ref = F.col("value") if reference is None else F.when(F.col("channel").isin(list(reference)), F.col("value"))
    return signal.withColumn("value", F.col("value") - F.avg(ref).over(instant))


def finite_guard(signal: DataFrame, column: str = "value", big: float = float(np.finfo(np.float64).max)) -> DataFrame:
    """NaN becomes 0 and infinities the largest finite numbers; null stays null."""
    v = F.col(column)
    fixed = F.when(F.isnan(v), 0.0).when(v == float("inf"), big).when(v == float("-inf"), -big).otherwise(v)
    return signal.withColumn(column, fixed)


def fixed_epochs(signal: DataFrame, length: int, overlap: int = 0, inclusive_end: bool = False) -> DataFrame:
    """(recording, epoch_id, channel, s_idx, value): complete windows of ``length`` samples.

    With ``inclusive_end`` a window also holds the sample at its end.
    """
    step, width = length - overlap, length + int(inclusive_end)
    if step <= 0:
        raise ValueError("overlap must be smaller than the epoch")
    size = signal.groupBy("recording").agg((F.max("t_idx") + 1).alias("__n"))
    if overlap == 0 and not inclusive_end:
        d = signal.withColumn("epoch_id", F.expr(f"t_idx div {length}"))
    else:
        first = F.greatest(F.ceil((F.col("t_idx") - (width - 1)) / step), F.lit(0)).cast("bigint")
        last = F.expr(f"t_idx div {step}")
        ids = F.when(first <= last, F.sequence(first, last))  # empty in the gap between epochs
        d = signal.withColumn("epoch_id", F.explode(ids))
    s_idx = F.col("t_idx") - F.col("epoch_id") * step
    d = d.join(size, "recording").where(F.col("epoch_id") * step + width <= F.col("__n"))
    return d.select("recording", "epoch_id", "channel", s_idx.alias("s_idx"), "value")


# ----------------------------------------------------------------- filters


def sinc_taps(fs: float, low: float | None, high: float | None, n_taps: int = 33, stop: bool = False) -> np.ndarray:
    """Hamming-windowed sinc band-pass (or, with ``stop``, band-stop) of odd length."""
    if n_taps % 2 == 0:
        raise ValueError("an odd number of taps is needed")
    m = np.arange(n_taps) - n_taps // 2

    def lowpass(f: float) -> np.ndarray:
        h = 2 * f / fs * np.sinc(2 * f / fs * m) * np.hamming(n_taps)
        return h / h.sum()

    unit = (m == 0).astype(float)
    h = (lowpass(high) if high else unit) - (lowpass(low) if low else 0.0)
    return unit - h if stop else h


def _chunks(signal: DataFrame, margin: int, chunk: int) -> DataFrame:
    """Add the chunk of each sample, repeating samples inside a neighbour's margin."""
    lo = F.greatest(F.expr(f"(t_idx - {margin}) div {chunk}"), F.lit(0).cast("bigint"))
    return signal.withColumn("chunk", F.explode(F.sequence(lo, F.expr(f"(t_idx + {margin}) div {chunk}"))))


def _on_chunks(signal: DataFrame, margin: int, chunk: int, work: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``work(t_idx, value, chunk number)`` on every chunk with its margins, as arrays in time order; its results as rows.

    A chunk crosses to Python and back as two arrays, not as a row for each sample.
    """
    d = _chunks(signal.select("recording", "channel", "t_idx", "value"), margin, chunk)
    lists = d.groupBy("recording", "channel", "chunk").agg(F.collect_list(F.struct(F.col("t_idx").cast("bigint").alias("t"), F.col("value").cast("double").alias("x"))).alias("s"))
    arrays = lists.select("recording", "channel", "chunk", F.col("s.t").alias("t"), F.col("s.x").alias("x"))
    fields = StructType([signal.schema["recording"], signal.schema["channel"], StructField("t", ArrayType(LongType())), StructField("y", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("t").value_lengths().to_numpy())
            times, values = batch.column("t").flatten().to_numpy(), batch.column("x").flatten().to_numpy(zero_copy_only=False)
            out, sizes = [(np.empty(0, np.int64), np.empty(0))], [0]
            for k, stop in enumerate(ends):
                start = ends[k - 1] if k else 0
                order = np.argsort(times[start:stop], kind="stable")
                out.append(work(times[start:stop][order], values[start:stop][order], batch.column("chunk")[k].as_py()))
                sizes.append(len(out[-1][0]))
            offsets = pa.array(np.cumsum(sizes), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([o[i] for o in out]))) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("recording"), batch.column("channel"), *lists], names=["recording", "channel", "t", "y"])

    found = arrays.mapInArrow(run, fields)
    return found.select("recording", "channel", F.inline(F.arrays_zip(F.col("t").alias("t_idx"), F.col("y").alias("value"))))


def fir_filter(signal: DataFrame, taps: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """Zero-phase FIR per (recording, channel); ends are extended by point reflection.

    Overlap-save: a chunk is convolved together with the samples around it that its own
    samples need, and keeps those alone.
    """
    taps = np.asarray(taps, dtype=float)
    margin = len(taps) // 2
    if chunk <= 2 * margin:
        raise ValueError("chunk must be longer than the filter")

    def work(t: np.ndarray, x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        inside = (t >= c * chunk) & (t < (c + 1) * chunk)
        if not inside.any():
            return t[:0], x[:0]
        first, own = int(inside.argmax()), int(inside.sum())
        left, right = max(0, margin - first), max(0, margin - (len(t) - first - own))
        if len(x) > 1 and (left or right):
            x = np.pad(x, (left, right), mode="reflect", reflect_type="odd")
        elif left or right:
            x = np.pad(x, (left, right), mode="edge")
        # position of the first own sample in the padded array
        start = first + left - margin
        return t[inside], _convolved(x, taps)[start : start + own]

    return _on_chunks(signal, margin, chunk, work)


def _convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Full-overlap convolution, by FFT where the filter is long."""
    if len(taps) < LONG_FILTER or not np.isfinite(x).all():
        return np.convolve(x, taps, mode="valid")
    n = 1 << (len(x) + len(taps) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(taps, n), n)[len(taps) - 1 : len(x)]


def bandpass(signal: DataFrame, fs: float, low: float | None, high: float | None, n_taps: int = 33, chunk: int = CHUNK) -> DataFrame:
    return fir_filter(signal, sinc_taps(fs, low, high, n_taps), chunk)


def notch(signal: DataFrame, fs: float, freq: float, width: float = 2.0, n_taps: int = 33, chunk: int = CHUNK) -> DataFrame:
    """Band-stop around ``freq``, which must lie below the Nyquist frequency."""
    if freq >= fs / 2:
        raise ValueError(f"notch at {freq} Hz is not below Nyquist ({fs / 2} Hz)")
    high = min(freq + width / 2, fs / 2 * 0.999)
    return fir_filter(signal, sinc_taps(fs, max(freq - width / 2, 1e-6), high, n_taps, stop=True), chunk)


def decimate_mean(signal: DataFrame, factor: int) -> DataFrame:
    """Lower the rate by an integer: mean of each run of ``factor`` samples."""
    t = F.expr(f"t_idx div {factor}").alias("t_idx")
    d = signal.groupBy("recording", "channel", t).agg(F.avg("value").alias("value"), F.count("value").alias("__n"))
    return d.where(F.col("__n") == factor).drop("__n")


def resample(signal: DataFrame, up: int, down: int, zeros: int = 8, chunk: int = CHUNK) -> DataFrame:
    """Rational rate change by a windowed sinc of ``zeros`` crossings each side.

    Output sample m lies at input time m * down / up. A chunk of inputs yields the outputs
    from its first input up to the first input of the next chunk, so borders lose nothing.
    Outputs are computed phase by phase: those whose index agrees modulo ``up`` use
    the same weights at inputs that lie in one piece.
    """
    cutoff = min(1.0, up / down)
    reach = math.ceil(zeros / cutoff)

    def work(t: np.ndarray, x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        own = t[(t >= c * chunk) & (t < (c + 1) * chunk)]
        if len(own) == 0:
            return t[:0], x[:0]
        after = t[t >= (c + 1) * chunk]
        stop = -(-int(after[0]) * up // down) if len(after) else int(own[-1]) * up // down + 1
        m = np.arange(-(-int(own[0]) * up // down), stop)
        base = int(t[0])
        dense, there = np.zeros(int(t[-1]) - base + 1), np.zeros(int(t[-1]) - base + 1)
        dense[t - base], there[t - base] = x, 1.0  # absent inputs weigh nothing
        y = np.full(len(m), np.nan)
        for phase in range(up):
            mine = np.flatnonzero(m % up == phase)
            if not len(mine):
                continue
            whole, part = m[mine] * down // up, (phase * down % up) / up
            steps = np.arange(-reach, reach + 2)
            d = part - steps
            h = np.where(np.abs(d) <= reach, np.sinc(cutoff * d) * (0.5 + 0.5 * np.cos(np.pi * d / reach)), 0.0)
            where = whole[:, None] + steps[None, :] - base
            inside = (where >= 0) & (where < len(dense))
            where = np.where(inside, where, 0)
            weight = (there[where] * inside) @ h
            with np.errstate(invalid="ignore", divide="ignore"):
                y[mine] = ((dense[where] * inside) @ h) / weight
        found = np.isfinite(y)
        return m[found], y[found]

    return _on_chunks(signal, reach, chunk, work)


# ------------------------------------------------------------------ blocks


def concat_blocks(blocks: DataFrame, samples: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """Join the first blocks of each recording end to end in continuous time.

    ``blocks``: (recording, block, length); ``samples``: (recording, block, channel,
    s_idx, value).  Offsets are running sums over the block table only.
    """
    rank = F.row_number().over(W.partitionBy("recording").orderBy("block"))
    before = W.partitionBy("recording").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    kept = blocks.withColumn("__r", rank)
    if n_blocks is not None:
        kept = kept.where(F.col("__r") <= n_blocks)
    offset = kept.withColumn("__off", F.coalesce(F.sum("length").over(before), F.lit(0)))
    d = samples.join(offset.select("recording", "block", "__off"), ["recording", "block"])
    return d.select("recording", "channel", (F.col("__off") + F.col("s_idx")).alias("t_idx"), "value")


# ------------------------------------------------------------------- steps

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {
    "drop_channels": drop_channels,
    "re_reference": re_reference,
    "finite_guard": finite_guard,
    "bandpass": bandpass,
    "notch": notch,
    "decimate_mean": decimate_mean,
    "resample": resample,
    "fixed_epochs": fixed_epochs,
}


def run_steps(signal: DataFrame, steps: Sequence[Mapping[str, Mapping]], more: Mapping[str, Step] | None = None) -> DataFrame:
    """Apply single-key steps {name: params} in order; the last output is returned."""
    known = {**STEPS, **(more or {})}
    for step in steps:
        if len(step) != 1:
            raise ValueError(f"a step is one name with its parameters, got {step}")
        ((name, params),) = step.items()
        if name not in known:
            raise KeyError(f"unknown step {name!r}; known: {sorted(known)}")
        signal = signal.transform(known[name], **(params or {}))
    return signal


def time_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column) -> DataFrame:
    """Sample numbers for tables that carry timestamps instead."""
    return row_index(df, keys, order, bucket, "t_idx")
