"""Least-mean-squares and recursive-least-squares filters."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell import runtime
from driftwell.estimators.base import KeyedTransformer, gaussian_column, matrix_column, vector_column
from driftwell.estimators.params import Spec, as_matrix, as_size, as_vector, between, declare
from driftwell.kernels.regression import lms_step, rls_step


class _Regression(runtime.KeyedModel):
    """Rows with label and features advance a key's state; rows without either leave it as it is and emit nothing."""

    def __init__(self, o: dict[str, Any], gaussian: bool, with_initial: bool) -> None:
        self.o, self.gaussian = o, gaussian
        self.columns = {"u": "vector", "d": "double"} | ({"initial": "object"} if with_initial else {}) | ({"reg": "object"} if o.get("reg") else {})
        self.output = [pa.field("stateIndex", pa.int64()), pa.field("state", runtime.GAU if gaussian else pa.list_(pa.float64()))]

    def begin(self, rows, first, n):
        size = self.o["size"] or rows["u"].shape[1]
        given = first.get("initial", [None] * n)
        mean = np.zeros((n, size)) if self.o["mean"] is None else np.tile(np.asarray(self.o["mean"], float), (n, 1))
        state = {"index": np.zeros(n, np.int64), "w": mean}
        if self.gaussian:
            p = self.o["p"]
            state["p"] = np.tile(np.eye(size) * p if np.isscalar(p) else np.asarray(p, float), (n, 1, 1))
        for g, m in enumerate(first.get("reg", ())):
            if m is not None:
                if len(m["values"]) != size * size:
                    raise ValueError(f"the regularization matrix must have {size} rows and columns")
                state["p"][g] = np.asarray(m["values"], float).reshape(size, size).T
        for g, x in enumerate(given):
            if x is not None:
                w = x["mean"] if self.gaussian else x
                if w is not None and len(w) == size:
                    state["w"][g] = w
                if self.gaussian and x["covariance"] is not None:
                    state["p"][g] = np.asarray(x["covariance"]["values"], float).reshape(size, size).T
        return state

    def step(self, state, rows):
        ok = rows["u?"] & rows["d?"]
        if rows["u"].shape[1] != state["w"].shape[1]:
            ok = ok & False
        at = np.flatnonzero(ok)
        if not len(at):
            return []
        u, d = rows["u"][at], rows["d"][at]
        if self.gaussian:
            state["w"][at], state["p"][at] = rls_step(state["w"][at], state["p"][at], u, d, self.o["forget"])
        else:
            state["w"][at] = lms_step(state["w"][at], u, d, self.o["rate"], self.o["c"])
        state["index"][at] += 1
        made = {"stateIndex": state["index"][at], "state": (state["w"][at].copy(), state["p"][at].copy()) if self.gaussian else state["w"][at].copy()}
        return [(at, made)]

    def encode(self, name, parts):
        if name == "stateIndex":
            return pa.array(np.concatenate(parts))
        if not self.gaussian:
            return runtime.list_array(np.concatenate(parts))
        return runtime.gaussian_array(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


@declare(Spec("labelCol", str, "label", "Column of the label"), Spec("featuresCol", str, "features", "Column of the features"))
class _Labelled(KeyedTransformer):
    def _check(self, df: DataFrame) -> None:
        super()._check(df)
        if not isinstance(df.schema[self.opt("labelCol")].dataType, T.NumericType):
            raise ValueError("labelCol must be a number")

    def _pair(self, df: DataFrame) -> dict[str, Column]:
        return {"u": vector_column(df, self.opt("featuresCol")), "d": F.col(self.opt("labelCol")).cast("double")}

    def finish(self, df: DataFrame) -> DataFrame:
        return self.formatted(df)


@declare(
    Spec("featureSize", as_size, doc="Number of features; by default that of a key's longest row"),
    Spec("initialEstimate", as_vector, doc="Initial coefficients; zeros by default"),
    Spec("initialEstimateCol", str, doc="Column of initial coefficients, read at a key's first row"),
    Spec("learningRate", float, 1.0, "Step size"),
    Spec("regularizationConstant", float, 1.0, "Added to the squared norm of the features", ("setRegularization",)),
)
class LeastMeanSquaresFilter(_Labelled):
    """Normalised least mean squares per key: ``g = u rate / (c + u'u)``, ``w += g (d - u'w)``.

    Output: key, ``stateIndex`` (rows taken so far), ``state`` (coefficients), event time.
    """

    default_key = "filter.leastMeanSquares"

    def inputs(self, df: DataFrame) -> dict[str, Column]:
        return self._pair(df) | ({"initial": vector_column(df, self.opt("initialEstimateCol"))} if self.isSet(self.initialEstimateCol) else {})

    def model(self) -> runtime.KeyedModel:
        return _Regression({"size": self.opt("featureSize"), "mean": self.opt("initialEstimate"), "rate": self.opt("learningRate"), "c": self.opt("regularizationConstant")}, False, self.isSet(self.initialEstimateCol))


@declare(
    Spec("featureSize", as_size, doc="Number of features; by default that of a key's longest row"),
    Spec("forgettingFactor", between(0.0, 1.0), 1.0, "Weight of the past, at most 1"),
    Spec("initialEstimate", as_vector, doc="Initial coefficients; zeros by default"),
    Spec("regularizationMatrix", as_matrix, doc="Initial inverse correlation; 1e5 times the identity by default"),
    Spec("regularizationMatrixFactor", float, 10e4, "Factor of the identity as initial inverse correlation", ("setRegularizationMatrixFactor",)),
    Spec("regularizationMatrixCol", str, doc="Column of the initial inverse correlation, read at a key's first row"),
    Spec("initialStateDistributionCol", str, doc="Struct column of mean and covariance, read at a key's first row; goes before the other initial values"),
)
class RecursiveLeastSquaresFilter(_Labelled):
    """Recursive least squares per key, with forgetting.

    ``g = P u / (lambda + u'P u)``, ``w += g (d - u'w)``, ``P = (P - g u'P) / lambda``. Output: key, ``stateIndex``, ``state``
    (``mean`` w, ``covariance`` P), event time.
    """

    default_key = "filter.recursiveLeastSquares"

    def inputs(self, df: DataFrame) -> dict[str, Column]:
        given = {"initial": gaussian_column(df, self.opt("initialStateDistributionCol"))} if self.isSet(self.initialStateDistributionCol) else {}
        return self._pair(df) | given | ({"reg": matrix_column(df, self.opt("regularizationMatrixCol"))} if self.isSet(self.regularizationMatrixCol) else {})

    def model(self) -> runtime.KeyedModel:
        p = self.opt("regularizationMatrix")
        return _Regression({"size": self.opt("featureSize"), "mean": self.opt("initialEstimate"), "p": self.opt("regularizationMatrixFactor") if p is None else p, "forget": self.opt("forgettingFactor"), "reg": self.isSet(self.regularizationMatrixCol)}, True, self.isSet(self.initialStateDistributionCol))
