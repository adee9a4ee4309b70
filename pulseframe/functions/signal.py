"""Small numpy kernels used inside Spark tasks: each takes one signal or a batch of windows."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np


def band_gain(freq: np.ndarray, fs: float, low: float, high: float, order: int) -> np.ndarray:
    """Squared magnitude of a digital Butterworth band-pass (bilinear transform, prewarped)."""
    w, a, b = (np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-12)) / fs) for f in (freq, low, high))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (w * w - a * b) / (w * (b - a))
        return np.where(w > 0, 1.0 / (1.0 + s ** (2 * order)), 0.0)


def zero_phase(x: np.ndarray, fs: float, low: float, high: float, order: int, left: bool = True, right: bool = True) -> np.ndarray:
    """Forward-backward band-pass of the rows of x, applied as its squared gain.

    As in the recursive form, an end of the signal (`left`, `right`) is continued by a short odd extension and then by
    its end value (the steady state), long enough for the slowest transient. Where a row ends inside its signal, it
    brings samples of its neighbours along that the caller cuts off again.
    """
    odd, hold = min(x.shape[1] - 1, 3 * (2 * order + 1)), int(4 * fs / low)
    begin = [np.repeat(2 * x[:, :1] - x[:, odd : odd + 1], hold, axis=1), 2 * x[:, :1] - x[:, odd:0:-1]] if left else []
    back = x[:, ::-1]
    end = [2 * x[:, -1:] - back[:, 1 : odd + 1], np.repeat(2 * x[:, -1:] - back[:, odd : odd + 1], hold, axis=1)] if right else []
    e = np.concatenate([*begin, x, *end], axis=1)
    n = 1 << int(np.ceil(np.log2(e.shape[1] + hold)))
    gain = band_gain(np.fft.rfftfreq(n, 1 / fs), fs, low, high, order)
    at = hold + odd if left else 0
    return np.fft.irfft(np.fft.rfft(e, n, axis=1) * gain, n, axis=1)[:, at : at + x.shape[1]]


def zero_phase_band(x: np.ndarray, fs: float, low: float, high: float, order: int) -> np.ndarray:
    """G2 on one whole signal."""
    return zero_phase(np.asarray(x, dtype=np.float64)[None, :], fs, low, high, order)[0]


def detrend(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x), dtype=np.float64)
    t -= t.mean()
    d = (t * t).sum()
    return x - x.mean() - (t * ((t * x).sum() / d) if d > 0 else 0.0)


# Longest one-sided reach of the resampling filter, in steps of the faster of both rates.
REACH, LONGEST = 10, 200


def ratio(fs: float, target: float = 500.0) -> tuple[int, int]:
    r = Fraction(int(round(target)), int(round(fs)))
    return r.numerator, r.denominator


def resample_rows(x: np.ndarray, up: int, down: int, count: int, lead: int, beta: float = 5.0) -> np.ndarray:
    """Polyphase Kaiser FIR on rows: `count` outputs, the first of them at input sample `lead`; beyond its ends a row is zero."""
    rate = max(up, down)
    half = REACH * min(rate, LONGEST)
    h = np.sinc(np.arange(-half, half + 1) / rate) * np.kaiser(2 * half + 1, beta)
    h *= up / h.sum()
    width = 2 * half // up + 1
    steps = -(-count // up)
    reach = -(-half // up) + 1
    far = lead + steps * down + reach + width
    x = np.pad(x, ((0, 0), (reach, max(0, far - x.shape[1]))))
    seen = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)
    y = np.zeros((len(x), steps * up))
    for p in range(up):  # outputs p, p + up, ... share their taps
        k = -((half - p * down) // up)  # first input sample that reaches output p
        tap = p * down - (k + np.arange(width)) * up + half
        taps = np.where(tap >= 0, h[np.maximum(tap, 0)], 0.0)
        y[:, p::up] = seen[:, lead + reach + k :: down][:, :steps] @ taps
    return y[:, :count]


def resample(x: np.ndarray, fs: float, target: float = 500.0) -> np.ndarray:
    """G1 on one whole signal: the line between the end points is taken out first and put back."""
    x = np.asarray(x, dtype=np.float64)
    if fs == target:
        return x.copy()
    up, down = ratio(fs, target)
    n = len(x)
    slope = (x[-1] - x[0]) / (n - 1) if n > 1 else 0.0
    m = -(-n * up // down)
    return resample_rows((x - x[0] - slope * np.arange(n))[None, :], up, down, m, 0)[0] + x[0] + slope * np.arange(m) * down / up


def welch(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Power density of batch rows: Hann segments, half overlap, constant detrend."""
    n = min(nperseg, x.shape[1])
    step = n - n // 2
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, x.shape[1] - n + 1, step)
    acc = 0.0
    for s in starts:
        seg = x[:, s : s + n]
        p = np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * win, axis=1)) ** 2
        acc = acc + p
    psd = acc / len(starts) / (fs * (win * win).sum())
    psd[:, 1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), psd


def envelope(x: np.ndarray, fs: float) -> np.ndarray:
    """Magnitude of the analytic signal of each row in 5-30 Hz."""
    y = zero_phase(x, fs, 5.0, 30.0, 2)
    n = y.shape[1]
    keep = np.zeros(n)
    keep[: n // 2 + 1] = 2.0
    keep[[0, n // 2] if n % 2 == 0 else [0]] = 1.0
    return np.abs(np.fft.ifft(np.fft.fft(y, axis=1) * keep, axis=1))


# Fixed values of the published detector, in seconds and shares: refractory time, integration window, slope window, first levels, adaptation, search back.
REFRACTORY, INTEGRATE, STEEP, FIRST_RR, LEARN, MISSED_AFTER = 0.360, 0.150, 0.040, 0.8, 0.125, 1.66


def beat_power(x: np.ndarray, fs: float, left: bool = True, right: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the 5-15 Hz band and its integrated squared slope."""
    width = int(round(INTEGRATE * fs)) | 1
    band = zero_phase(x, fs, 5.0, 15.0, 2, left, right)
    wide = np.pad(band, ((0, 0), (2, 2)))
    slope = (wide[:, :-4] * 1.0 + wide[:, 1:-3] * 2.0 - wide[:, 3:-1] * 2.0 - wide[:, 4:] * 1.0) / 8.0
    run = np.cumsum(np.pad(slope * slope, ((0, 0), (width // 2 + 1, width // 2))), axis=1)
    return band, np.maximum(run[:, width:] - run[:, :-width], 0.0) / width


@dataclass
class Levels:
    """What the peak detector knows at a sample; it can stop after any sample and go on from there."""

    at: int = 0  # next sample to look at
    signal: float = 0.0
    noise: float = 0.0
    rr: float = 0.0
    beats: list[int] = field(default_factory=list)  # the last nine
    held: int = -1  # beat that a steeper one within the refractory time may still replace
    held_steep: float = 0.0

    @staticmethod
    def first(power: np.ndarray, total: int, fs: float) -> Levels:
        """Levels from the first two seconds, or the first quarter of a shorter signal of `total` samples."""
        n = min(int(2.0 * fs), total // 4)
        if n <= 10:
            return Levels()
        top = float(power[:n].max())
        return Levels(0, top * 0.25, top * 0.125, float(int(FIRST_RR * fs)))


def scan_beats(s: Levels, power: np.ndarray, band: np.ndarray, start: int, stop: int, total: int, fs: float) -> list[int]:
    """Beats decided between `start` and `stop`; `s` moves on.

    The arrays begin at `start - margin`, with margin the slope window (or at 0), and reach a refractory time and a slope window beyond `stop` (or to
    the end of the signal). Every look takes the largest power of the next refractory time; a table says by kind which level learns from it and where to look next.
    """
    gap, steep_n = int(round(REFRACTORY * fs)), max(2, int(round(STEEP * fs)))
    base = max(0, start - steep_n)
    p = np.pad(power, (0, gap), constant_values=-1.0)
    top = np.lib.stride_tricks.sliding_window_view(p, gap).argmax(axis=1)
    jump = np.abs(np.diff(band, prepend=band[:1]))
    done: list[int] = []

    def steep(i: int) -> float:
        a, b = i - steep_n, i + steep_n
        return float(jump[a - base + 1 : b - base + 1].max()) if a >= 0 and b < total else 0.0

    while s.at < stop:
        at = s.at + int(top[s.at - base])
        v, limit = float(power[at - base]), s.noise + 0.25 * (s.signal - s.noise)
        since = at - s.beats[-1] if s.beats else at + gap
        strong, faint = v > limit, limit >= v > 0.5 * limit and bool(s.beats)
        if (strong and since >= gap) or (faint and since > MISSED_AFTER * s.rr):
            s.beats = [*s.beats[-8:], at]
            s.rr = (at - s.beats[0]) / (len(s.beats) - 1) if len(s.beats) > 1 else s.rr
            s.signal += LEARN * (v - s.signal)
            if s.held < 0 or at - s.held >= gap:
                done += [s.held] if s.held >= 0 else []
                s.held, s.held_steep = at, steep(at)
            elif (now := steep(at)) > s.held_steep:
                s.held, s.held_steep = at, now
        elif strong or faint or v > 0:
            s.noise += LEARN * (v - s.noise)
        s.at = at + 1 if strong or faint else min(s.at + gap, total)
    if stop >= total and s.held >= 0:
        done.append(s.held)
        s.held = -1
    return done


def r_peaks(x: np.ndarray, fs: float = 500.0) -> list[int]:
    """G4 on one whole signal."""
    n = len(x)
    if n < 2 * (int(round(INTEGRATE * fs)) | 1):
        return []
    band, power = (v[0] for v in beat_power(np.asarray(x, dtype=np.float64)[None, :], fs))
    return scan_beats(Levels.first(power, n, fs), power, band, 0, n, n, fs)


def simple_peaks(x: np.ndarray, distance: int, prominence: float) -> list[int]:
    """Local maxima of a minimum prominence, the highest kept within `distance`."""
    i = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    taken = np.zeros(len(x), dtype=bool)
    kept = []
    for p in i[np.argsort(-x[i], kind="stable")]:
        if not taken[max(0, p - distance + 1) : p + distance].any():
            kept.append(p)
            taken[p] = True
    good = []
    for p in sorted(kept):
        higher = np.flatnonzero(x > x[p])
        lo = higher[higher < p].max() + 1 if (higher < p).any() else 0
        hi = higher[higher > p].min() if (higher > p).any() else len(x)
        if x[p] - max(x[lo : p + 1].min(), x[p:hi].min()) >= prominence:
            good.append(int(p))
    return good


MORPHOLOGY = ["r_amplitude", "q_depth", "t_amplitude", "qrs_width_ms", "qrs_area", "st_slope_mV_s", "j_point", "qrs_asymmetry_index", "t_r_ratio", "qrs_raggedness"]


def _between(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """rows x n: whether a column lies in [first, end) of its row."""
    k = np.arange(n)
    return (k >= first[:, None]) & (k < end[:, None])


def complex_bounds(x: np.ndarray, r: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last sample of the complex around r, and whether they were found.

    The curve (the envelope, or the raw magnitude where that fails) is followed from r to where it is below a share of the
    amplitude at r, 300 ms back and 150 ms on at most.
    """
    rows, n = np.arange(len(x)), x.shape[1]
    k = np.arange(n)
    low, high = np.maximum(0, r - int(round(0.300 * fs))), np.minimum(n, r + int(round(0.150 * fs)) + 1)
    before, after = _between(n, low, r), _between(n, r, high)
    on, off, found = np.full(len(x), -1), np.full(len(x), -1), np.zeros(len(x), bool)
    for curve, share in ((envelope(x, fs), 0.5), (np.abs(x), 0.25)):
        quiet = curve < share * np.abs(x[rows, r])[:, None]
        a = np.where(before & quiet, k, -1).max(axis=1)
        b = np.where(after & quiet, k, n).min(axis=1)
        a, b = np.where(a < 0, low, a), np.where(b == n, high - 1, b)
        new = ~found & (a < b)
        on, off, found = np.where(new, a, on), np.where(new, b, off), found | new
    return on, off, found


def morphology(x: np.ndarray, fs: float = 500.0) -> np.ndarray:
    """Ten features of each row, a beat window; NaN where the detection fails."""
    x = np.asarray(x, dtype=np.float64)
    rows, n = np.arange(len(x)), x.shape[1]
    r = np.abs(x).argmax(axis=1)
    amp = x[rows, r]
    q = np.where(_between(n, np.maximum(0, r - int(round(0.100 * fs))), r), x, np.inf).min(axis=1)
    t = np.where(_between(n, r, r + int(round(0.300 * fs)) + 1), x, -np.inf).max(axis=1)
    on, off, found = complex_bounds(x, r, fs)
    size = off - on
    width = np.where(found, size / fs * 1000.0, np.nan)
    width = np.where((width >= 20.0) & (width <= 180.0), width, np.nan)
    usable = ~np.isnan(width)
    inside, mag = _between(n, on, off) & found[:, None], np.abs(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = (mag[rows, on] + mag[rows, off - 1]) / 2  # trapezoids: the first and last sample count half
        area = np.where(usable, ((mag * inside).sum(axis=1) - ends) / fs, np.nan)
        mean = (mag * inside).sum(axis=1) / size
        ragged = np.where(found, np.sqrt((((mag - mean[:, None]) ** 2) * inside).sum(axis=1) / size), np.nan)
        skew = np.where(found & (on < r) & (r < off), (r - on) / (off - r), np.nan)
        over = np.where(np.abs(amp) > 1e-9, t / np.abs(amp), np.nan)
    j = np.where(usable, off, r)
    first, last = int(round(0.060 * fs)), int(round(0.080 * fs))
    slope = np.zeros(len(x))
    fits = np.flatnonzero(j + last <= n)
    if last - first >= 2:
        ramp = np.arange(last - first) - (last - first - 1) / 2
        slope[fits] = (x[fits[:, None], j[fits, None] + np.arange(first, last)] @ ramp) / (ramp @ ramp) * fs
    return np.column_stack([amp, np.where(np.isfinite(q), q, 0.0), t, width, area, slope, j, skew, over, ragged])


SPECTRAL = [
    "spectral_centroid", "spectral_bandwidth", "spectral_flatness", "spectral_rolloff_85", "spectral_peak_freq", "spectral_peak_power", "spectral_power_0_10hz",
    "spectral_power_10_20hz", "spectral_power_20_40hz", "spectral_power_40_60hz", "spectral_power_60_100hz", "spectral_power_ratio_low_high", "spectral_entropy",
]


def spectral(windows: np.ndarray, fs: float = 500.0, nperseg: int = 64, eps: float = 1e-8) -> np.ndarray:
    """Thirteen spectral features of a batch of QRS windows."""
    w = windows - np.median(windows[:, :20], axis=1, keepdims=True)
    f, psd = welch(w, fs, nperseg)
    tot = psd.sum(axis=1, keepdims=True)
    p = psd / np.maximum(tot, eps)
    c = (p * f).sum(axis=1)
    cum = np.cumsum(psd, axis=1)
    top = psd.argmax(axis=1)
    bands = []
    for lo, hi in ((0, 10), (10, 20), (20, 40), (40, 60), (60, 100)):
        m = (f >= lo) & (f <= hi)
        bands.append(np.trapezoid(psd[:, m], f[m], axis=1) if m.any() else np.zeros(len(w)))
    t = np.maximum(tot[:, 0], eps)
    return np.column_stack([
        c, np.sqrt((p * (f - c[:, None]) ** 2).sum(axis=1)), np.exp(np.log(np.maximum(p, eps)).mean(axis=1)) / np.maximum(p.mean(axis=1), eps),
        f[(cum >= 0.85 * cum[:, -1:]).argmax(axis=1)], f[top], 10 * np.log10(np.maximum(p[np.arange(len(w)), top], eps)),
        *[b / t for b in bands], (bands[0] + bands[1]) / np.maximum(bands[3] + bands[4], eps), -(p * np.log(np.maximum(p, eps))).sum(axis=1)])
