"""Filters and spectra whose recursions need the whole signal of a channel: numpy kernels, and the grouped maps that run them.

A block table has one row per recording, segment and channel, with the samples as an array (recording_id, segment, channel, fs,
values). Kernels take one row's array, so a task holds one channel at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(samples: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Samples as one array per group, in order: the way from long rows to a block table."""
    ordered = F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v"))))
    return samples.groupBy(*by).agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def unblocked(df: DataFrame, by: Sequence[str], values: str = "values") -> DataFrame:
    """The way back: one row per sample, idx from 1."""
    return df.select(*by, F.posexplode(values).alias("_p", "value")).select(*by, (F.col("_p") + 1).alias("idx"), "value")


def mapped(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], values: str = "values", out: str = "values") -> DataFrame:
    """Applies a kernel (array to array) to each row's samples, batch by batch; rows stay where they are."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.asarray(kernel(np.array(x, float)), float) for x in column.to_pylist()], pa.list_(pa.float64()))

    return df.withColumn(out, run(F.col(values)))


# --- design -------------------------------------------------------------------------------------


def butterworth(order: int, cut: float, fs: float, high: bool = False) -> np.ndarray:
    """Second-order sections [b0 b1 b2 1 a1 a2] of a digital Butterworth low- or high-pass."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warped = 2 * fs * np.tan(np.pi * cut / fs)
    poles = warped / poles if high else warped * poles
    z = (2 * fs + poles) / (2 * fs - poles)
    sections = []
    for p in sorted(z[np.imag(z) > 1e-12], key=abs):
        sections.append([1, -2 if high else 2, 1, 1, -2 * p.real, abs(p) ** 2])
    for p in z[np.abs(np.imag(z)) <= 1e-12]:
        sections.append([1, -1 if high else 1, 0, 1, -p.real, 0])
    sos = np.array(sections, float)
    at = -1.0 if high else 1.0  # unit gain at the edge of the pass band
    gain = np.prod([(s[0] + s[1] * at + s[2]) / (1 + s[4] * at + s[5]) for s in sos])
    sos[0, :3] /= gain
    return sos


def notch_section(freq: float, q: float, fs: float) -> np.ndarray:
    """A second-order notch of quality q."""
    w = 2 * np.pi * freq / fs
    t = np.tan(w / q / 2)
    g = 1 / (1 + t)
    return np.array([[g, -2 * g * np.cos(w), g, 1, -2 * g * np.cos(w), 2 * g - 1]])


def band_sections(low: float, high: float, fs: float) -> np.ndarray:
    """The two band-pass sections of `spectral.biquad_design`, in numbers."""
    w1, w2 = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
    width, p = w2 - w1, (-1 + 1j) / np.sqrt(2)
    out = []
    for sign in (1, -1):
        s = (p * width + sign * np.sqrt((p * width) ** 2 - 4 * w1 * w2 + 0j)) / 2
        a0 = 1 - 2 * s.real + abs(s) ** 2
        b = width / a0
        out.append([b, 0, -b, 1, 2 * (abs(s) ** 2 - 1) / a0, (1 + 2 * s.real + abs(s) ** 2) / a0])
    return np.array(out)


# --- running ------------------------------------------------------------------------------------


def run_sections(x: np.ndarray, sos: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal filtering; state (sections x 2) lets a later call go on where this one ended."""
    y = np.array(x, float)
    z = np.zeros((len(sos), 2)) if state is None else np.array(state, float)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z1, z2 = z[k]
        for i, v in enumerate(y.tolist()):
            o = b0 * v + z1
            z1 = b1 * v - a1 * o + z2
            z2 = b2 * v - a2 * o
            y[i] = o
        z[k] = z1, z2
    return y, z


def resting_state(sos: np.ndarray) -> np.ndarray:
    """The state in which a constant input of 1 gives a constant output."""
    z, level = np.zeros((len(sos), 2)), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        out = level * (b0 + b1 + b2) / (1 + a1 + a2)
        z[k] = out - b0 * level, b2 * level - a2 * out
        level = out
    return z


def zero_phase(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Forwards, then backwards, with the ends reflected about their last samples and the state at rest there."""
    n = min(len(x) - 1, 3 * (2 * len(sos) + 1))
    if len(x) < 2:
        return np.array(x, float)
    padded = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    rest = resting_state(sos)
    for _ in range(2):
        padded = run_sections(padded, sos, rest * padded[0])[0][::-1]
    return padded[n : n + len(x)]


def bridged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """NaN samples replaced by lines between (and beyond) known ones, and where they were."""
    missing = np.isnan(x)
    known = np.flatnonzero(~missing)
    if not missing.any() or len(known) < 2:
        return np.where(missing, 0.0, x) if len(known) < 2 else x, missing
    y = np.interp(np.arange(len(x)), known, x[known])
    lo, hi = known[:2], known[-2:]
    head, tail = np.arange(known[0]), np.arange(known[-1] + 1, len(x))
    y[head] = x[lo[0]] + (head - lo[0]) * (x[lo[1]] - x[lo[0]]) / (lo[1] - lo[0])
    y[tail] = x[hi[1]] + (tail - hi[1]) * (x[hi[1]] - x[hi[0]]) / (hi[1] - hi[0])
    return y, missing


def fft_filter(x: np.ndarray, fs: float, low: float, high: float, stop: bool = False) -> np.ndarray:
    """Bins outside [low, high] (inside, with stop) set to zero."""
    spectrum, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / fs)
    inside = (f >= max(0, low)) & (f <= min(fs / 2, high))
    return np.fft.irfft(np.where(inside ^ stop, spectrum, 0), len(x))


def frequency_filter(x: np.ndarray, fs: float, cut: Sequence[float], kind: str = "band", method: str = "fft", order: int = 4, reflect: int = 0) -> np.ndarray:
    """low, high, band (or pass), stop and notch filters by "fft", "butter" (zero phase) or "buttercausal".

    Missing samples are bridged before and put back after. With reflect, the ends are continued over that many samples in four ways (odd
    or even reflection at either end) and the result that varies least is kept.
    """
    kind = {"bandpass": "band", "pass": "band"}.get(kind, kind)
    y, missing = bridged(np.asarray(x, float))

    def once(v: np.ndarray) -> np.ndarray:
        if kind == "notch":
            sos = notch_section(cut[0] if len(cut) else 60.0, cut[1] if len(cut) > 1 else 10.0, fs)
            return zero_phase(v, sos) if method != "buttercausal" else run_sections(v, sos)[0]
        if method == "fft":
            lo, hi = {"low": (0, cut[0]), "high": (cut[0], fs / 2)}.get(kind, (cut[0], cut[-1]))
            return fft_filter(v, fs, lo, hi, kind == "stop")
        go = (lambda s, sos: run_sections(s, sos)[0]) if method == "buttercausal" else zero_phase
        if kind in ("low", "high"):
            return go(v, butterworth(order, cut[0], fs, kind == "high"))
        if kind == "band":  # a high-pass and a low-pass in turn
            return go(go(v, butterworth(order, cut[0], fs, True)), butterworth(order, cut[1], fs))
        return go(v, butterworth(order, cut[0], fs)) + go(v, butterworth(order, cut[1], fs, True))

    n = min(reflect, len(y) - 1)
    if n > 0:
        tried = []
        for head in (-1, 1):
            for tail in (-1, 1):
                left, right = y[n:0:-1], y[-2 : -n - 2 : -1]
                left, right = (2 * y[0] - left if head < 0 else left), (2 * y[-1] - right if tail < 0 else right)
                tried.append(once(np.concatenate([left, y, right]))[n : n + len(y)])
        out = min(tried, key=np.std)
    else:
        out = once(y)
    return np.where(missing, np.nan, out)


def notch_bank(x: np.ndarray, fs: float, freqs: Sequence[float] | float = 60.0, q: float = 10.0, split: bool = False) -> np.ndarray:
    """Notches at a frequency's harmonics up to Nyquist (q grows with them), or at the aliases of a list of frequencies.

    With split, a causal pass forwards and one backwards are blended by a sigmoid around the middle.
    """
    harmonics = [(freqs * h, q * h) for h in range(1, int(fs / 2 / freqs) + 1)] if np.isscalar(freqs) else [(abs(f - fs * round(f / fs)), q) for f in freqs]
    y, missing = bridged(np.asarray(x, float))
    for f, qh in harmonics:
        if not 0 < f < fs / 2:
            continue
        sos = notch_section(f, qh, fs)
        if split:
            ahead, back = run_sections(y, sos)[0], run_sections(y[::-1], sos)[0][::-1]
            s = 1 / (1 + np.exp(-(np.arange(len(y)) - len(y) / 2) / max(1.0, fs / 10)))
            y = ahead * s + back * (1 - s)
        else:
            y = zero_phase(y, sos)
    return np.where(missing, np.nan, y)


def detrended(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * ((t @ x) / max(t @ t, 1e-300))


def welch(x: np.ndarray, fs: float, nfft: int | None = None, pieces: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: `pieces` half-overlapping Hamming windows, at least 256 frequencies."""
    size = max(2, int(len(x) / ((pieces + 1) / 2)))
    hop = size - size // 2
    nfft = nfft or max(256, 1 << (size - 1).bit_length())
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    total, n = np.zeros(nfft // 2 + 1), 0
    for at in range(0, len(x) - size + 1, hop):
        seg = x[at : at + size] * window
        if size > nfft:  # longer windows are wrapped, as a transform of the sampled spectrum has it
            seg = np.pad(seg, (0, -size % nfft)).reshape(-1, nfft).sum(0)
        total += np.abs(np.fft.rfft(seg, nfft)) ** 2
        n += 1
    density = total / max(n, 1) / fs / (window @ window)
    density[1 : len(density) - (nfft % 2 == 0)] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), density


def signal_power(x: np.ndarray, fs: float, bands: Sequence[tuple[float, float]], method: str = "welch", nfft: int | None = None) -> np.ndarray:
    """Power in half-open bands [lo, hi) after the line is taken out; a band from 0 also gets the mean's square."""
    y = detrended(x)
    if method == "fft":
        n = len(y)
        f, p = np.fft.rfftfreq(n, 1 / fs), np.abs(np.fft.rfft(y) / n) ** 2
        p[1 : len(p) - (n % 2 == 0)] *= 2
    else:
        f, p = welch(y, fs, nfft)
        p = p * (f[1] - f[0])
    return np.array([p[(f >= lo) & (f < hi)].sum() + (x.mean() ** 2 if lo == 0 else 0) for lo, hi in bands])


def band_pass_power(x: np.ndarray, fs: float, low: float, high: float, passes: int = 1, reflect: bool = True) -> float:
    """Mean square after the two band-pass sections, run `passes` times, with a reflected run-up of five periods."""
    n = min(len(x) - 1, int(round(5 / low * fs))) if reflect else 0
    y = np.concatenate([2 * x[0] - x[n:0:-1], x]) if n > 0 else np.asarray(x, float)
    for _ in range(passes):
        y = run_sections(y, band_sections(low, high, fs))[0]
    return float(np.mean(y[n:] ** 2))


def segmented_power(x: np.ndarray, fs: float, bands: Sequence[tuple[float, float]], t0: float, t1: float, size: float) -> np.ndarray:
    """Mean square per band and segment of `size` seconds between t0 and t1: filtered as a whole, cut afterwards.

    The number of segments is floor((t1 - t0) / size), at least 1; a band open to one side is a low- or high-pass.
    """
    n = max(1, int((t1 - t0) / size + 1e-9))
    out = np.zeros((len(bands), n))
    x = x - np.nanmean(x)
    for b, (lo, hi) in enumerate(bands):
        if lo <= 0 and hi >= fs / 2:
            y = x
        elif lo <= 0:
            y = frequency_filter(x, fs, [hi], "low")
        elif hi >= fs / 2:
            y = frequency_filter(x, fs, [lo], "high")
        else:
            y = frequency_filter(x, fs, [lo, hi], "band")
        for k in range(n):
            a, z = int(round((t0 + k * size) * fs)), int(round(min(t1, t0 + (k + 1) * size) * fs))
            out[b, k] = np.mean(y[max(0, a) : min(len(y), z)] ** 2)
    return out


def stft(x: np.ndarray, fs: float, window: int, nfft: int | None = None, causal: bool = True) -> np.ndarray:
    """Magnitudes (samples x frequencies) of the window that ends at (or is centred on) each sample, less its straight line; NaN where
    it doesn't fit."""
    nfft = nfft or window
    out = np.full((len(x), nfft // 2 + 1), np.nan)
    if len(x) >= window:
        cut = np.lib.stride_tricks.sliding_window_view(x, window)
        first = window - 1 if causal else window // 2
        t = np.arange(window) - (window - 1) / 2
        level = cut - cut.mean(1, keepdims=True)
        out[first : first + len(cut)] = np.abs(np.fft.rfft(level - np.outer(level @ t / max(t @ t, 1e-300), t), nfft))
    return out


# --- cosine codec -------------------------------------------------------------------------------


def _cosines() -> np.ndarray:
    k, i = np.mgrid[:8, :8]
    return np.sqrt(np.where(k == 0, 1, 2) / 8) * np.cos(np.pi * (2 * i + 1) * k / 16)


def dct_compress(x: np.ndarray, keep: float) -> bytes:
    """Header (length, smallest value, range), a bit per coefficient that is kept, and these as bytes: the largest `keep` of all."""
    n = len(x)
    coef = (np.pad(np.asarray(x, float), (0, -n % 8)).reshape(-1, 8) @ _cosines().T).reshape(-1)
    kept = np.zeros(len(coef), bool)
    kept[np.argsort(-np.abs(coef), kind="stable")[: int(np.ceil(len(coef) * keep))]] = True
    some = coef[kept]
    low, span = (np.float32(some.min()), np.float32(np.ptp(some))) if len(some) else (np.float32(0), np.float32(0))
    levels = np.round((some - low) / span * 255).astype(np.uint8) if span else np.zeros(len(some), np.uint8)
    return np.uint32(n).tobytes() + low.tobytes() + span.tobytes() + np.packbits(kept).tobytes() + levels.tobytes()


def dct_decompress(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    low, span = np.frombuffer(data, "<f4", 2, 4)
    m = n + -n % 8
    kept = np.unpackbits(np.frombuffer(data, np.uint8, (m + 7) // 8, 12))[:m].astype(bool)
    coef = np.zeros(m)
    coef[kept] = np.frombuffer(data, np.uint8, int(kept.sum()), 12 + (m + 7) // 8) / 255 * span + low
    return (coef.reshape(-1, 8) @ _cosines()).reshape(-1)[:n]


def power_rows(df: DataFrame, by: Sequence[str], fs: float, bands: Sequence[tuple[float, float]], method: str = "welch", values: str = "values") -> DataFrame:
    """lo, hi, power rows of every block row."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.repeat(np.arange(b.num_rows), len(bands))
            power = [p for x in b.column(len(by)).to_pylist() for p in signal_power(np.array(x, float), fs, bands, method)]
            cols = [c.take(pa.array(at)) for c in b.columns[: len(by)]]
            lo, hi = np.tile([x[0] for x in bands], b.num_rows).astype(float), np.tile([x[1] for x in bands], b.num_rows).astype(float)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lo), pa.array(hi), pa.array(power, pa.float64())], [*by, "lo", "hi", "power"])

    return df.select(*by, values).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", lo double, hi double, power double")


def stft_rows(df: DataFrame, by: Sequence[str], fs: float, window: int, causal: bool = True, values: str = "values") -> DataFrame:
    """by, idx (from 1), k, freq, magnitude: the transform of the window at every sample of each block row, where it fits."""
    width = window // 2 + 1
    flat = mapped(df, lambda x: stft(x, fs, window, causal=causal).reshape(-1), values, "_m")
    rows = flat.select(*by, F.posexplode("_m").alias("_p", "magnitude")).filter(~F.isnan("magnitude"))
    k = (F.col("_p") % width).cast("int")
    return rows.select(*by, (F.floor(F.col("_p") / width) + 1).cast("long").alias("idx"), k.alias("k"), (k * fs / window).alias("freq"), "magnitude")


def spectra(df: DataFrame, by: Sequence[str], fs: float, values: str = "values") -> DataFrame:
    """by, k, freq, density of every block row: the one-sided power density of its samples less their straight line, without a window."""

    def density(x: np.ndarray) -> np.ndarray:
        n = len(x)
        p = np.abs(np.fft.rfft(detrended(x))) ** 2 / n / fs
        p[1 : len(p) - (n % 2 == 0)] *= 2
        return p

    rows = mapped(df, density, values, "_d").withColumn("_n", F.size(values))
    return rows.select(*by, "_n", F.posexplode("_d").alias("k", "density")).select(*by, "k", (F.col("k") * fs / F.col("_n")).alias("freq"), "density")


def band_pass_rows(df: DataFrame, by: Sequence[str], fs: float, bands: Sequence[tuple[float, float]], values: str = "values") -> DataFrame:
    """by, lo, hi, power of every block row after the two band-pass sections of each band."""
    power = mapped(df, lambda x: np.array([band_pass_power(x, fs, lo, hi) for lo, hi in bands]), values, "_p")
    edges = F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in bands])
    return power.select(*by, F.explode(F.arrays_zip(edges.alias("band"), F.col("_p").alias("power"))).alias("x")).select(*by, "x.band.lo", "x.band.hi", "x.power")


def epoch_powers(df: DataFrame, by: Sequence[str], fs: float, bands: Sequence[tuple[float, float]], t0: float, t1: float, size: float, values: str = "values") -> DataFrame:
    """by, band (its number), segment, power of every epoch: each epoch filtered as a whole, then cut between t0 and t1 seconds."""
    flat = mapped(df, lambda x: segmented_power(x, fs, bands, t0, t1, size).reshape(-1), values, "_p")
    n = max(1, int((t1 - t0) / size + 1e-9))
    rows = flat.select(*by, F.posexplode("_p").alias("_k", "power"))
    return rows.select(*by, F.floor(F.col("_k") / n).cast("int").alias("band"), (F.col("_k") % n).cast("int").alias("segment"), "power")
