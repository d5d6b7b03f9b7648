"""Stochastic expectation-maximisation of finite mixtures, over many models at once.

A model is ``(weights (g, k), params)``: params are ``mean (g, k, d)`` and ``cov (g, k, d, d)`` for the Gaussian, ``rate`` or
``p`` ``(g, k)`` for Poisson and Bernoulli. A summary is a model whose parameters are scaled by the weights.
"""

from __future__ import annotations

import math

import numpy as np

from driftwell.kernels.linalg import gaussian_logpdf, outer

Params = dict[str, np.ndarray]
FLOOR = 1e-12  #: weight below which a component has vanished
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_likelihoods(family: str, samples: np.ndarray, params: Params) -> np.ndarray:
    """Log density of each sample ``(g, n, ...)`` under each component: ``(g, n, k)``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if family == "gaussian":
            return gaussian_logpdf(samples[:, :, None], params["mean"][:, None], params["cov"][:, None])
        x = samples[:, :, None]
        if family == "poisson":
            rate = params["rate"][:, None]
            return x * np.log(rate) - rate - _lgamma(x + 1.0)
        p = params["p"][:, None]
        return np.where(x > 0.5, np.log(p), np.log1p(-p))


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (top + np.log(np.exp(a - top).sum(axis=-1, keepdims=True)))[..., 0]


def _chained_log_sum(a: np.ndarray) -> np.ndarray:
    """Greatest term plus ``log(1 + exp(term - greatest))`` of each other: exact for two components only."""
    s = -np.sort(-a, axis=-1)
    return s[..., 0] + np.log1p(np.exp(s[..., 1:] - s[..., :1])).sum(axis=-1)


def mixture_loglikelihood(family: str, samples: np.ndarray, weights: np.ndarray, params: Params) -> np.ndarray:
    """Log-likelihood of each model's samples."""
    with np.errstate(divide="ignore"):
        return _log_sum(log_likelihoods(family, samples, params) + np.log(weights)[:, None]).sum(axis=1)


def scaled(params: Params, w: np.ndarray) -> Params:
    return {n: a * w.reshape(w.shape + (1,) * (a.ndim - w.ndim)) for n, a in params.items()}


def em_step(family: str, samples: np.ndarray, summary: tuple[np.ndarray, Params], model: tuple[np.ndarray, Params], gamma: np.ndarray, chained: bool = False) -> tuple[np.ndarray, Params]:
    """New summary: the old one and the expectation over the samples, mixed by the step size ``gamma (g,)``."""
    weights, params = model
    with np.errstate(divide="ignore", invalid="ignore"):
        joint = log_likelihoods(family, samples, params) + np.log(weights)[:, None]
        resp = np.exp(joint - (_chained_log_sum if chained else _log_sum)(joint)[..., None])
    n = samples.shape[1]
    w = resp.sum(axis=1) / n
    if family == "gaussian":
        d = samples[:, :, None] - params["mean"][:, None]  # around the current means
        new = {"mean": np.einsum("gnk,gnd->gkd", resp, samples) / n, "cov": np.einsum("gnk,gnkij->gkij", resp, outer(d, d)) / n}
    else:
        new = {next(iter(params)): np.einsum("gnk,gn->gk", resp, samples) / n}
    mix = lambda old, fresh: (1 - gamma).reshape((-1,) + (1,) * (old.ndim - 1)) * old + gamma.reshape((-1,) + (1,) * (old.ndim - 1)) * fresh
    return mix(summary[0], w), {k: mix(summary[1][k], new[k]) for k in new}


def from_summary(summary: tuple[np.ndarray, Params], before: Params | None = None) -> tuple[np.ndarray, Params]:
    """The model of a summary: parameters divided by the weights. A component whose weight has vanished keeps those of ``before``."""
    w = summary[0]
    gone = ~(w > FLOOR)
    made = scaled(summary[1], 1.0 / np.where(gone, 1.0, w))
    if before is not None and gone.any():
        made = {n: np.where(gone.reshape(gone.shape + (1,) * (a.ndim - gone.ndim)), before[n], a) for n, a in made.items()}
    return w, made


def expectations(family: str, samples: np.ndarray, weights: np.ndarray, params: Params, chained: bool = False) -> tuple[np.ndarray, Params, float]:
    """Sums over the samples ``(n, ...)`` of one model's responsibilities and of its parameters' statistics, and their log-likelihood; sums of parts add up."""
    joint = log_likelihoods(family, samples[None], {k: a[None] for k, a in params.items()})[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        joint = joint + np.log(weights)
        resp = np.exp(joint - (_chained_log_sum if chained else _log_sum)(joint)[..., None])
    total = float(_log_sum(joint).sum())
    if family == "gaussian":
        d = samples[:, None] - params["mean"][None]
        return resp.sum(0), {"mean": resp.T @ samples, "cov": np.einsum("nk,nki,nkj->kij", resp, d, d)}, total
    return resp.sum(0), {next(iter(params)): resp.T @ samples}, total
