"""Filters, smoother and mixtures as Spark ML transformers."""

from driftwell.estimators.kalman import CubatureKalmanFilter, ExtendedKalmanFilter, LinearKalmanFilter, LinearKalmanSmoother, UnscentedKalmanFilter
from driftwell.estimators.mixture import BernoulliMixture, MultivariateGaussianMixture, PoissonMixture
from driftwell.estimators.regression import LeastMeanSquaresFilter, RecursiveLeastSquaresFilter

__all__ = ["BernoulliMixture", "CubatureKalmanFilter", "ExtendedKalmanFilter", "LeastMeanSquaresFilter", "LinearKalmanFilter", "LinearKalmanSmoother", "MultivariateGaussianMixture", "PoissonMixture", "RecursiveLeastSquaresFilter", "UnscentedKalmanFilter"]
