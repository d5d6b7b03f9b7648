"""Steps of the adaptive linear filters, over many models at once."""

from __future__ import annotations

import numpy as np

from driftwell.kernels.linalg import mv, outer


def lms_step(w: np.ndarray, u: np.ndarray, d: np.ndarray, rate: float, c: float) -> np.ndarray:
    """Normalised least mean squares: ``w + e * rate * u / (c + u'u)``."""
    gain = rate * u / (c + np.einsum("gi,gi->g", u, u))[:, None]
    return w + gain * (d - np.einsum("gi,gi->g", u, w))[:, None]


def rls_step(w: np.ndarray, p: np.ndarray, u: np.ndarray, d: np.ndarray, forget: float) -> tuple[np.ndarray, np.ndarray]:
    """Recursive least squares with forgetting factor: estimate and inverse correlation."""
    pu = mv(p, u)
    gain = pu / (forget + np.einsum("gi,gi->g", pu, u))[:, None]
    e = d - np.einsum("gi,gi->g", u, w)
    return w + gain * e[:, None], (p - outer(gain, np.einsum("gi,gij->gj", u, p))) / forget
