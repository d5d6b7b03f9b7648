"""Batched linear algebra: every array has a leading axis over independent models."""

from __future__ import annotations

import numpy as np

LOG_2PI = float(np.log(2 * np.pi))
SVD_METHODS = ("gesdd", "eigh")
_options = {"svd": "gesdd", "raising": False}


def use(svd: str = "gesdd", raising: bool = False) -> None:
    """Choose how this process decomposes matrices: ``gesdd``, or ``eigh``, which takes them for symmetric; whether matrices that aren't finite raise."""
    if svd not in SVD_METHODS:
        raise ValueError(f"the method must be one of {', '.join(SVD_METHODS)}: {svd}")
    _options.update(svd=svd, raising=raising)


def _finite(s: np.ndarray) -> np.ndarray:
    ok = np.isfinite(s).all(axis=(-1, -2))
    if _options["raising"] and not ok.all():
        raise np.linalg.LinAlgError("a matrix has entries that aren't finite")
    return ok


def t(a: np.ndarray) -> np.ndarray:
    """Transpose of each matrix."""
    return np.swapaxes(a, -1, -2)


def mv(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Matrix times vector, each."""
    return np.einsum("...ij,...j->...i", a, x)


def outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x[..., :, None] * y[..., None, :]


def _svd(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Singular values where all entries are finite; others are decomposed as zeros and reported."""
    ok = _finite(s)[..., None, None]
    s = np.where(ok, s, 0.0)
    if _options["svd"] == "eigh" and s.shape[-1] == s.shape[-2]:
        d, v = np.linalg.eigh((s + t(s)) / 2)
        return v, np.abs(d), np.sign(d)[..., None] * t(v), ok
    return *np.linalg.svd(s, full_matrices=False), ok


def pinv(s: np.ndarray) -> np.ndarray:
    """Pseudo-inverse that inverts every singular value but exact zeros; NaN for matrices that aren't finite."""
    if s.shape[-1] == s.shape[-2] == 1:
        _finite(s)
        with np.errstate(divide="ignore"):
            return np.where(s != 0, 1.0 / np.where(s != 0, s, 1.0), 0.0)
    u, d, vt, ok = _svd(s)
    inv = np.where(d != 0, 1.0 / np.where(d != 0, d, 1.0), 0.0)
    return np.where(ok, t(vt) @ (inv[..., None] * t(u)), np.nan)


def root(p: np.ndarray) -> np.ndarray:
    """Symmetric square root; NaN for matrices that aren't finite."""
    if p.shape[-1] == 1:
        return np.sqrt(np.maximum(p, 0.0))
    u, d, vt, ok = _svd(p)
    return np.where(ok, u @ (np.sqrt(d)[..., None] * vt), np.nan)


def squared_mahalanobis(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """``r' S^-1 r``; NaN where S is singular."""
    if s.shape[-1] == 1:
        with np.errstate(divide="ignore", invalid="ignore"):
            return r[..., 0] ** 2 / s[..., 0, 0]
    det = np.linalg.det(s)
    ok = np.isfinite(det) & (det != 0) & np.isfinite(s).all(axis=(-1, -2))
    safe = np.where(ok[..., None, None], s, np.eye(s.shape[-1]))
    return np.where(ok, np.einsum("...i,...i->...", r, np.linalg.solve(safe, r[..., None])[..., 0]), np.nan)


def gaussian_logpdf(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of the multivariate normal; -inf or NaN where the covariance isn't positive definite."""
    if cov.shape[-1] == 1:
        with np.errstate(divide="ignore", invalid="ignore"):
            v = cov[..., 0, 0]
            return -0.5 * (LOG_2PI + np.log(v) + (x[..., 0] - mean[..., 0]) ** 2 / v)
    sign, logdet = np.linalg.slogdet(cov)
    with np.errstate(invalid="ignore"):
        return np.where(sign > 0, -0.5 * (x.shape[-1] * LOG_2PI + logdet + squared_mahalanobis(x - mean, cov)), np.nan)
