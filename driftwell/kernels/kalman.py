"""Predict and estimate steps of the Kalman filters, over many models at once.

A model row is a dict of arrays: ``F Q`` (and ``u B`` if there is control) for predict, ``z H R`` for estimate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from driftwell.kernels.linalg import mv, outer, pinv, root, squared_mahalanobis, t

Fn = Callable[[np.ndarray, np.ndarray], np.ndarray] | None
Row = dict[str, np.ndarray]


def _each(f: Fn, x: np.ndarray, model: np.ndarray) -> np.ndarray:
    """A user function of (vector, matrix) on each model."""
    return np.stack([np.asarray(f(x[g], model[g]), float) for g in range(len(x))])


def _control(row: Row) -> np.ndarray | float:
    return mv(row["B"], row["u"]) if "u" in row else 0.0


@dataclass
class Linear:
    """The linear filter; covariance in Joseph form."""

    fading: float = 1.0

    def predict(self, x: np.ndarray, p: np.ndarray, row: Row, q: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        f = self.process_model(x, row)
        noise = self.process_noise(x, row)
        return self.process(x, row) + _control(row), self.fading**2 * f @ p @ t(f) + noise

    def estimate(self, x: np.ndarray, p: np.ndarray, row: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, None]:
        """New mean and covariance, residual and its covariance."""
        h, noise = self.measurement_model(x, row), self.measurement_noise(x, row)
        r = row["z"] - self.measure(x, row)
        s = h @ p @ t(h) + noise
        k = p @ t(h) @ pinv(s)
        left = np.eye(x.shape[1]) - k @ h
        return x + mv(k, r), left @ p @ t(left) + k @ noise @ t(k), r, s, None

    def process(self, x: np.ndarray, row: Row) -> np.ndarray:
        return mv(row["F"], x)

    def measure(self, x: np.ndarray, row: Row) -> np.ndarray:
        return mv(row["H"], x)

    def process_model(self, x: np.ndarray, row: Row) -> np.ndarray:
        return row["F"]

    def process_noise(self, x: np.ndarray, row: Row) -> np.ndarray:
        return row["Q"]

    def measurement_model(self, x: np.ndarray, row: Row) -> np.ndarray:
        return row["H"]

    def measurement_noise(self, x: np.ndarray, row: Row) -> np.ndarray:
        return row["R"]


@dataclass
class Extended(Linear):
    """First-order filter: user functions for process and measurement with their Jacobians, each optional."""

    process_fn: Fn = None
    process_state_jacobian: Fn = None
    process_noise_jacobian: Fn = None
    measurement_fn: Fn = None
    measurement_state_jacobian: Fn = None
    measurement_noise_jacobian: Fn = None

    def process(self, x: np.ndarray, row: Row) -> np.ndarray:
        return _each(self.process_fn, x, row["F"]) if self.process_fn else super().process(x, row)

    def measure(self, x: np.ndarray, row: Row) -> np.ndarray:
        return _each(self.measurement_fn, x, row["H"]) if self.measurement_fn else super().measure(x, row)

    def process_model(self, x: np.ndarray, row: Row) -> np.ndarray:
        return _each(self.process_state_jacobian, x, row["F"]) if self.process_state_jacobian else row["F"]

    def measurement_model(self, x: np.ndarray, row: Row) -> np.ndarray:
        return _each(self.measurement_state_jacobian, x, row["H"]) if self.measurement_state_jacobian else row["H"]

    def process_noise(self, x: np.ndarray, row: Row) -> np.ndarray:
        if not self.process_noise_jacobian:
            return row["Q"]
        j = _each(self.process_noise_jacobian, x, row["Q"])
        return j @ row["Q"] @ t(j)

    def measurement_noise(self, x: np.ndarray, row: Row) -> np.ndarray:
        if not self.measurement_noise_jacobian:
            return row["R"]
        j = _each(self.measurement_noise_jacobian, x, row["R"])
        return j @ row["R"] @ t(j)


@dataclass
class Sampled(Linear):
    """Filters that push sample points through the functions; subclasses give points, weights and moments."""

    process_fn: Fn = None
    measurement_fn: Fn = None

    def points(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def weights(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean and of the covariance."""
        raise NotImplementedError

    def _through(self, f: Fn, points: np.ndarray, model: np.ndarray) -> np.ndarray:
        if f is None:
            return np.einsum("gij,gkj->gki", model, points)
        k = points.shape[1]
        return np.stack([_each(f, points[:, i], model) for i in range(k)], axis=1)

    def _moments(self, points: np.ndarray, n: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
        wm, wc = self.weights(n)
        mean = np.einsum("k,gki->gi", wm, points)
        d = points - mean[:, None]
        return mean, scale * np.einsum("k,gki,gkj->gij", wc, d, d)

    def predict(self, x: np.ndarray, p: np.ndarray, row: Row, q: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        moved = self._through(self.process_fn, self.points(x, p), row["F"])
        c = _control(row)
        mean, cov = self._moments(moved + (c[:, None] if isinstance(c, np.ndarray) else c), x.shape[1], self.fading**2)
        return mean, cov + (row["Q"] if q is None else q)


@dataclass
class Unscented(Sampled):
    """Sigma points after Merwe or Julier, optional bounds, optional adaptive process noise."""

    algorithm: str = "merwe"
    alpha: float = 0.3
    beta: float = 2.0
    kappa: float = 0.1
    julier_kappa: float = 1.0
    lower: np.ndarray | None = None
    upper: np.ndarray | None = None
    adaptive: bool = False
    threshold: float = 2.0
    least_weight: float = 0.9
    noise_alpha: float = 1.0
    _cache: dict = field(default_factory=dict, repr=False)

    def _spread(self, n: int) -> float:
        """The factor of the covariance under the root."""
        return self.alpha**2 * (n + self.kappa) if self.algorithm == "merwe" else n + self.julier_kappa

    def weights(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self._cache:
            spread = self._spread(n)
            wm = np.full(2 * n + 1, 0.5 / spread)
            wm[0] = (spread - n) / spread
            wc = wm.copy()
            if self.algorithm == "merwe":
                wc[0] += 1 - self.alpha**2 + self.beta
            self._cache[n] = wm, wc
        return self._cache[n]

    def points(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        rows = root(self._spread(x.shape[1]) * p)
        around = np.concatenate([x[:, None] + rows, x[:, None] - rows], axis=1)
        if self.lower is not None:
            around = np.maximum(around, self.lower)
        if self.upper is not None:
            around = np.minimum(around, self.upper)
        return np.concatenate([x[:, None], around], axis=1)

    def estimate(self, x: np.ndarray, p: np.ndarray, row: Row):
        n, f2 = x.shape[1], self.fading**2
        points = self.points(x, p)
        seen = self._through(self.measurement_fn, points, row["H"])
        mean, s = self._moments(seen, n, f2)
        s = s + row["R"]
        cross = f2 * np.einsum("k,gki,gkj->gij", self.weights(n)[1], points - x[:, None], seen - mean[:, None])
        k = cross @ pinv(s)
        r = row["z"] - mean
        adapted = None
        if self.adaptive:
            m2 = squared_mahalanobis(r, s)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.maximum(self.least_weight, (m2 - self.noise_alpha * self.threshold) / m2)
            kr = mv(k, r)
            adapted = (m2 > self.threshold, w, outer(kr, kr))
        return x + mv(k, r), f2 * p - k @ s @ t(k), r, s, adapted


@dataclass
class Cubature(Sampled):
    """Third-degree spherical cubature: 2n points of equal weight."""

    def weights(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        w = np.full(2 * n, 0.5 / n)
        return w, w

    def points(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        cols = np.sqrt(x.shape[1]) * t(root(p))
        return np.concatenate([x[:, None] + cols, x[:, None] - cols], axis=1)

    def estimate(self, x: np.ndarray, p: np.ndarray, row: Row):
        n = x.shape[1]
        points = self.points(x, p)
        seen = self._through(self.measurement_fn, points, row["H"])
        mean, s = self._moments(seen, n, 1.0)
        s = s + row["R"]
        cross = np.einsum("k,gki,gkj->gij", self.weights(n)[0], points - x[:, None], seen - mean[:, None])
        k = cross @ pinv(s)
        r = row["z"] - mean
        return x + mv(k, r), p - k @ s @ t(k), r, s, None


def smooth(means: np.ndarray, covs: np.ndarray, models: np.ndarray, noises: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel pass over windows ``(g, lag, ...)``, oldest first: means, covariances, gains (0 for the newest)."""
    x, p, g = means.copy(), covs.copy(), np.zeros_like(covs)
    for i in range(means.shape[1] - 2, -1, -1):
        f = models[:, i]
        ahead = f @ covs[:, i] @ t(f) + noises[:, i]
        g[:, i] = covs[:, i] @ t(f) @ pinv(ahead)
        x[:, i] = means[:, i] + mv(g[:, i], x[:, i + 1] - mv(f, means[:, i]))
        p[:, i] = covs[:, i] + g[:, i] @ (p[:, i + 1] - ahead) @ t(g[:, i])
    return x, p, g
