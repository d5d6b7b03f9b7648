"""Spikes, stuck runs and level shifts in one series (numpy only).

A series is modelled as an autoregression of its differences: the forecast of a reading is a weighted mean of the
readings before it (or after it; the model reads alike in both directions), with weights that add up to 1 and
range from "the last reading" (a random walk) to "the mean of the last few" (noise about a slow level). Its statistics
are counts, so they add up over the parts of a series, and spikes barely move them.
"""

from __future__ import annotations

import numpy as np

ORDER = 5  #: differences that the autoregression looks back on
BIN = 0.002  #: relative width of the bins in which absolute differences are counted
PRIOR = 20  #: pairs of differences that speak for plain noise about a level, so that short series don't overfit
ZERO, TINY = -(10**9), 1e-12  #: bin of differences up to ``TINY``
#: Shares of the absolute differences by which the noise is told, and normal scores of these (fixed values).
SHARES = ((0.5, 0.6745), (0.75, 1.1503), (0.9, 1.6449))
NEVER_LESS = 0.7  #: part of the limit at which a change of level is noted; its readings are judged by the limit itself


def run_lengths(values: np.ndarray) -> np.ndarray:
    """Length of the run of equal rows that each row is in; NaN equals NaN."""
    n = len(values)
    if not n:
        return np.zeros(0, int)
    a, b = values[1:], values[:-1]
    new = np.r_[True, ~np.all((a == b) | (np.isnan(a) & np.isnan(b)), axis=1)]
    starts = np.flatnonzero(new)
    return np.repeat(np.diff(np.r_[starts, n]), np.diff(np.r_[starts, n]))


def statistics(y: np.ndarray, own: np.ndarray) -> dict[int, int]:
    """Counts over the differences that end at an ``own`` reading; those of disjoint parts of a series add up.

    Keys that 2 * (ORDER + 1) divides are bins of absolute differences; key 2k - 1 is the number of pairs of differences
    ``k`` apart (k = 1..ORDER) of which neither is 0, key 2k how many more of them agree in sign than don't.
    """
    d = np.diff(y)
    at = np.flatnonzero(own[1:])
    out: dict[int, int] = {}
    if not len(at):
        return out
    size = np.abs(d[at])
    code = np.full(len(at), ZERO, np.int64)
    some = size > TINY
    code[some] = np.floor(np.log(size[some]) / BIN).astype(np.int64)
    bins, n = np.unique(code, return_counts=True)
    out.update(zip((bins * 2 * (ORDER + 1)).tolist(), n.tolist(), strict=True))
    sign = np.sign(np.where(np.abs(d) > TINY, d, 0.0))
    for k in range(1, ORDER + 1):
        pair = sign[at[at >= k]] * sign[at[at >= k] - k]
        out[2 * k - 1], out[2 * k] = int(np.count_nonzero(pair)), int(pair.sum())
    return out


def model(counts: dict[int, int]) -> tuple[float, np.ndarray]:
    """(noise, weights): the reading-to-reading noise and the forecast's weights, nearest reading first, from ``statistics``.

    The noise is the scaled median of absolute differences; where more than half of them are 0, a higher quantile's;
    0 if nine tenths are. The autocorrelations of the differences come from how often they agree in sign.
    """
    stride = 2 * (ORDER + 1)
    bins = sorted((k // stride, n) for k, n in counts.items() if k % stride == 0)
    upto = np.cumsum([n for _, n in bins]) if bins else np.zeros(0)
    noise = 0.0
    for share, score in SHARES if bins else ():
        b = bins[int(np.searchsorted(upto, share * upto[-1]))][0]
        if b != ZERO:
            noise = float(np.exp((b + 0.5) * BIN)) / score / np.sqrt(2)
            break
    rho = np.ones(ORDER + 1)
    for k in range(1, ORDER + 1):
        agree = (counts.get(2 * k, 0) - PRIOR * (k == 1) / 3) / (counts.get(2 * k - 1, 0) + PRIOR)
        rho[k] = np.sin(np.pi / 2 * agree)
    a, err = np.zeros(0), 1.0
    for k in range(1, ORDER + 1):  # Durbin-Levinson; plain noise about a level has the partial correlations -1 / (k + 1), none are less
        part = float(np.clip((rho[k] - a @ rho[k - 1 : 0 : -1]) / err, -1 / (k + 1), 0.9))
        a = np.r_[a - part * a[::-1], part]
        err *= 1 - part * part
    return noise, np.r_[1 + a[0], np.diff(a), -a[-1]]


def _forecasts(c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gap 0..n between the readings: the forecast from those before and from those after; ends go on at their median."""
    p = len(w)
    around = 2 * p + 1
    padded = np.r_[np.full(p, np.median(c[:around])), c, np.full(p, np.median(c[-around:]))]
    before = np.convolve(padded, np.r_[0.0, w])[p : p + len(c) + 1]  # before[j] = sum w_k c[j - k]
    after = np.convolve(padded[::-1], np.r_[0.0, w])[p : p + len(c) + 1][::-1]
    return before, after


def _tests(c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of an additive outlier and of a level shift at each reading, by the autoregression's residuals, and both in residual units."""
    p, n = len(w), len(c)
    around = 2 * p + 1
    padded = np.r_[np.full(p, np.median(c[:around])), c, np.full(p, np.median(c[-around:]))]
    e = padded[p:] - np.convolve(padded, np.r_[0.0, w])[p : n + 2 * p]
    out = []
    for shape in (np.r_[1.0, -w], np.r_[1.0, 1.0 - np.cumsum(w)[:-1], 0.0]):
        power = float(shape @ shape)
        size = np.correlate(e, shape, "valid") / power
        out += [size, size * np.sqrt(power)]
    return out[0], out[2], out[1], out[3]


def spikes(y: np.ndarray, noise: float, weights: np.ndarray, limit: float = 6.0, lasting: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Additive outliers of a series, and each one's departure in units of the noise.

    Rounds of tests on the residuals of the autoregression, until a round changes nothing: at each reading the
    size of an additive outlier and of a level shift are estimated, and the likelier of the two is accepted where it stands out
    and nothing near stands out more. An outlier is taken out; a shift is taken off all readings
    after it. A stretch between two shifts that is shorter than ``lasting`` is taken out where it departs from the readings before and after it.
    In the end the readings taken out are those that depart from the forecast from the readings before
    and from that of the readings after, on the same side, by at least ``limit`` times the noise.
    """
    n = len(y)
    clean, off = np.ones(n, bool), np.zeros(n)
    if n < 4:
        return ~clean, off
    least = limit * max(noise, 1e-9 * max(1.0, float(np.median(np.abs(y)))))
    p = len(weights)
    shift = np.zeros(n)
    times = np.zeros(n, np.int8)  # a reading's level is shifted twice at most, so the rounds end
    while True:
        at = np.flatnonzero(clean)
        if len(at) < 4:
            break
        z = (y - np.cumsum(shift))[at]
        outlier, level, outlier_r, level_r = _tests(z, weights)
        is_shift = np.abs(level_r) > np.abs(outlier_r)
        stands_out = np.where(is_shift, (np.abs(level) >= NEVER_LESS * least) & (times[at] < 2), np.abs(outlier) >= least)
        strength = np.where(stands_out, np.maximum(np.abs(outlier_r), np.abs(level_r)), 0.0)
        near = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(p), strength, np.zeros(p)], 2 * p + 1)
        hit = np.flatnonzero(stands_out)
        hit = hit[(near[hit, :p].max(1) < strength[hit]) & (near[hit, p:].max(1) <= strength[hit])]
        if not len(hit):
            break
        clean[at[hit[~is_shift[hit]]]] = False
        new = at[hit[is_shift[hit]]]
        shift[new] += level[hit[is_shift[hit]]]
        times[new] += 1
        _short_levels(y, clean, shift, weights, least, lasting)
    taken = np.flatnonzero(~clean)
    at = np.flatnonzero(clean)
    if not len(taken) or not len(at):
        return np.zeros(n, bool), off
    before, after = _forecasts(y[at], weights)
    gap = np.searchsorted(at, taken)
    a, b = y[taken] - before[gap], y[taken] - after[gap]
    first, last = gap == 0, gap == len(at)
    a, b = np.where(first, b, a), np.where(last, a, b)
    off[taken] = np.where(a * b > 0, np.sign(a) * np.minimum(np.abs(a), np.abs(b)), 0.0) / (least / limit)
    return np.abs(off) >= limit, off


def _short_levels(y: np.ndarray, clean: np.ndarray, shift: np.ndarray, weights: np.ndarray, least: float, lasting: int) -> None:
    """Take stretches between two shifts out of ``clean`` that are too short to be a level, shortest first, and their shifts out of ``shift``."""
    while True:
        at = np.flatnonzero(clean)
        edge = np.searchsorted(at, np.flatnonzero(shift))
        where = np.flatnonzero(shift)
        pairs = sorted((edge[j] - edge[i], i, j) for i in range(len(edge)) for j in range(i + 1, min(i + 5, len(edge))) if 0 < edge[j] - edge[i] < lasting)
        if not pairs:
            return
        c = y[at]
        before, after = _forecasts(c, weights)
        for _, i, j in pairs:
            own = slice(edge[i], edge[j])
            a, b = c[own] - before[edge[i]], c[own] - after[edge[j]]
            bad = (a * b > 0) & (np.minimum(np.abs(a), np.abs(b)) >= least)
            if 2 * np.count_nonzero(bad) > len(bad) and 0 < edge[i] and edge[j] < len(c):
                clean[at[own][bad]] = False
                shift[where[i : j + 1]] = 0.0
                break
        else:
            return
