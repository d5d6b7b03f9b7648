"""Parameters of the estimators: declared once, with setters, getters and their own JSON form."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.linalg import DenseMatrix, DenseVector, Matrix, Vector
from pyspark.ml.param import Param, Params
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter

NO = object()


def as_vector(x: Any) -> list[float]:
    """Entries of a vector, list or array."""
    return [float(v) for v in (x.toArray() if isinstance(x, Vector) else x)]


def as_matrix(x: Any) -> list[list[float]]:
    """Rows of a matrix, nested list or array."""
    a = np.atleast_2d(x.toArray() if isinstance(x, Matrix) else np.asarray(x, float))
    return [[float(v) for v in row] for row in a]


def as_vectors(x: Any) -> list[list[float]]:
    return [as_vector(v) for v in x]


def as_function(x: Any) -> Callable:
    if not callable(x):
        raise TypeError("a function of (vector, matrix) is needed")
    return x


def as_size(x: Any) -> int:
    if int(x) != x or x < 0:
        raise ValueError(f"not a whole number of 0 or more: {x}")
    return int(x)


def between(low: float, high: float, convert: Callable = float) -> Callable:
    def check(x: Any):
        v = convert(x)
        if not low <= v <= high:
            raise ValueError(f"{x} isn't between {low} and {high}")
        return v

    return check


def one_of(*allowed: str) -> Callable:
    def check(x: Any) -> str:
        if x not in allowed:
            raise ValueError(f"{x!r} isn't one of {', '.join(allowed)}")
        return str(x)

    return check


@dataclass(frozen=True)
class Spec:
    """One parameter; ``also`` names further setters."""

    name: str
    convert: Callable
    default: Any = NO
    doc: str = ""
    also: tuple[str, ...] = ()


_BACK = {as_vector: lambda v: DenseVector(v), as_matrix: lambda v: DenseMatrix(len(v), len(v[0]) if v else 0, np.asarray(v, float).ravel("F").tolist())}


def declare(*specs: Spec) -> Callable[[type], type]:
    """Class decorator: a ``Param``, ``setX`` and ``getX`` per spec."""

    def decorate(cls: type) -> type:
        cls._specs = {**getattr(cls, "_specs", {}), **{s.name: s for s in specs}}
        for s in specs:
            cap = s.name[0].upper() + s.name[1:]
            setattr(cls, s.name, Param(Params._dummy(), s.name, s.doc, s.convert))

            def setter(self, value: Any = NO, _s: Spec = s):
                if value is NO and _s.convert is not bool:
                    raise TypeError(f"{_s.name} needs a value")
                return self._set(**{_s.name: True if value is NO else value})

            def getter(self, _s: Spec = s):
                v = self.getOrDefault(getattr(self, _s.name))
                return _BACK.get(_s.convert, lambda x: x)(v)

            for name in (f"set{cap}", *s.also):
                setattr(cls, name, setter)
            setattr(cls, f"get{cap}", getter)
        return cls

    return decorate


def encode(spec: Spec, value: Any) -> Any:
    return {"pickled": base64.b64encode(cloudpickle.dumps(value)).decode()} if spec.convert is as_function else value


def decode(spec: Spec, value: Any) -> Any:
    return cloudpickle.loads(base64.b64decode(value["pickled"])) if spec.convert is as_function else value


class Persistent(Params, MLWritable, MLReadable):
    """Saving and loading in Spark ML's form, alone or in a pipeline; functions are pickled, so load only what you trust."""

    _specs: dict[str, Spec] = {}

    def __init__(self, **params: Any) -> None:
        super().__init__()
        self._setDefault(**{n: s.default for n, s in self._specs.items() if s.default is not NO})
        self._set(**params)

    def opt(self, name: str) -> Any:
        """The value set or by default, else null."""
        p = getattr(self, name)
        return self.getOrDefault(p) if self.isDefined(p) else None

    def write(self) -> Writer:
        return Writer(self)

    @classmethod
    def read(cls) -> Reader:
        return Reader(cls)


class Writer(MLWriter):
    """Writes an estimator's parameters as one line of JSON under ``metadata``."""

    def __init__(self, owner: Persistent) -> None:
        super().__init__()
        self.owner = owner

    def saveImpl(self, path: str) -> None:  # noqa: N802 - as in Spark ML
        o, spark = self.owner, self.sparkSession
        set_ = {n: encode(s, o.getOrDefault(getattr(o, n))) for n, s in o._specs.items() if o.isSet(getattr(o, n))}
        text = json.dumps({"class": f"{type(o).__module__}.{type(o).__name__}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": o.uid, "paramMap": set_, "defaultParamMap": {}})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(f"{path}/metadata")


class Reader(MLReader):
    """Reads what ``Writer`` wrote."""

    def __init__(self, cls: type[Persistent]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Persistent:
        data = json.loads("\n".join(r[0] for r in self.sparkSession.read.text(f"{path}/metadata").collect()))
        if data["class"].rpartition(".")[2] != self.cls.__name__:
            raise ValueError(f"{path} holds a {data['class']}, not a {self.cls.__name__}")
        made = self.cls()
        made._resetUid(data["uid"])
        made._set(**{n: decode(self.cls._specs[n], v) for n, v in data["paramMap"].items()})
        return made
