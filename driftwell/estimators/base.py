"""Common parts of the keyed stateful transformers."""

from __future__ import annotations



from pyspark.ml import Transformer
from pyspark.ml.linalg import MatrixUDT, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell import runtime
from driftwell.estimators.params import Persistent, Spec, declare, one_of
from driftwell.functions.matrices import array_to_matrix, matrix_to_array
from driftwell.functions.vectors import array_to_vector, vector_to_array

MAT_DDL = "struct<numRows:int,numCols:int,values:array<double>>"
SVD_METHOD, RAISE = "spark.driftwell.linalg.svdMethod", "spark.driftwell.linalg.raiseExceptions"  #: session settings of the decompositions
GAU_DDL = f"struct<mean:array<double>,covariance:{MAT_DDL}>"


def vector_column(df: DataFrame, name: str | Column, kind: T.DataType | None = None) -> Column:
    """A vector, array or number column as ``array<double>``."""
    col = F.col(name) if isinstance(name, str) else name
    kind = df.select(col).schema[0].dataType if kind is None else kind
    if isinstance(kind, VectorUDT):
        return vector_to_array(col)
    return col.cast("array<double>") if isinstance(kind, T.ArrayType) else F.when(col.isNotNull(), F.array(col.cast("double")))


def matrix_column(df: DataFrame, name: str | Column, kind: T.DataType | None = None) -> Column:
    """A matrix column (ML matrix, struct of rows, columns and column-major values, or rows of numbers) as the internal struct."""
    col = F.col(name) if isinstance(name, str) else name
    kind = df.select(col).schema[0].dataType if kind is None else kind
    if isinstance(kind, MatrixUDT):
        return matrix_to_array(col)
    if isinstance(kind, T.StructType):
        r, c, v = (col[f.name] for f in kind.fields[:3])
        return F.when(col.isNotNull(), F.struct(r.cast("int").alias("numRows"), c.cast("int").alias("numCols"), v.cast("array<double>").alias("values")))
    n = F.size(col)
    width = F.size(F.get(col, F.lit(0)))
    values = F.flatten(F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(col, lambda row: F.get(row, j).cast("double"))))
    return F.when(n > 0, F.struct(n.alias("numRows"), width.alias("numCols"), values.alias("values")))


def gaussian_column(df: DataFrame, name: str) -> Column:
    """A struct of mean and covariance as the internal struct."""
    kind = df.schema[name].dataType
    a, b = kind.fields[:2]
    col = F.col(name)
    return F.when(col.isNotNull(), F.struct(vector_column(df, col[a.name], a.dataType).alias("mean"), matrix_column(df, col[b.name], b.dataType).alias("covariance")))


@declare(
    Spec("stateKeyCol", str, doc="Column of the keys; without it all rows are one key"),
    Spec("eventTimeCol", str, doc="Timestamp column that orders the rows of a key"),
    Spec("orderCol", str, doc="Column that orders rows of equal event time"),
    Spec("watermarkDuration", str, doc="Lateness a stream waits for, as an interval"),
    Spec("timeoutMode", one_of("none", "process", "event"), "none", "When states expire", ("setStateTimeoutMode",)),
    Spec("timeoutDuration", str, doc="Time without rows after which a state expires", also=("setStateTimeoutDuration",)),
    Spec("outputFormat", one_of("array", "udt"), "array", "Vectors and matrices as arrays and structs, or as ML types"),
)
class KeyedTransformer(Transformer, Persistent):
    """A recursion over the rows of each key, in event-time order, on tables and streams.

    Rows without event time come first. Null keys are one key of their own. Output columns: the key (``stateKey``, or
    the name of ``stateKeyCol``), those of the estimator, and the event time if ``eventTimeCol`` is set.
    """

    default_key = "driftwell.default"
    hands_watermark_on = False  #: whether an event-time operator follows in a stream

    def model(self) -> runtime.KeyedModel:
        """The numeric model for the runtime."""
        raise NotImplementedError

    def inputs(self, df: DataFrame) -> dict[str, Column]:
        """The model's input columns."""
        raise NotImplementedError

    def run(self, rows: DataFrame, model: runtime.KeyedModel) -> DataFrame:
        """The model over a batch table."""
        return runtime.batch(rows, model)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop and add output columns after the parameters."""
        return df

    def _check(self, df: DataFrame) -> None:
        if self.isSet(self.watermarkDuration) and not self.isSet(self.eventTimeCol):
            raise ValueError("watermarkDuration needs eventTimeCol")
        for p in self._specs:
            if p.endswith("Col") and self.isDefined(getattr(self, p)) and self.opt(p) not in df.columns:
                if self.isSet(getattr(self, p)) or p in ("measurementCol", "labelCol", "featuresCol", "sampleCol"):
                    raise ValueError(f"{p}: there is no column {self.opt(p)!r}")
        if self.isSet(self.eventTimeCol) and not isinstance(df.schema[self.opt("eventTimeCol")].dataType, (T.TimestampType, T.TimestampNTZType)):
            raise ValueError("eventTimeCol must be a timestamp")
        if self.isSet(self.stateKeyCol) and not isinstance(df.schema[self.opt("stateKeyCol")].dataType, (T.StringType, T.IntegralType)):
            raise ValueError("stateKeyCol must be a string or whole number")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._check(dataset)
        return self.finish(self.states(dataset))

    def transformSchema(self, schema: T.StructType) -> T.StructType:  # noqa: N802 - as in Spark ML
        """Schema of the output for input of ``schema``; the same checks as ``transform``."""
        from pyspark.sql import SparkSession

        return self.transform(SparkSession.active().createDataFrame([], schema)).schema

    def states(self, df: DataFrame) -> DataFrame:
        """All output columns, plain types."""
        key = F.col(self.opt("stateKeyCol")).cast("string") if self.isSet(self.stateKeyCol) else F.lit(self.default_key)
        time = F.col(self.opt("eventTimeCol")).cast("timestamp") if self.isSet(self.eventTimeCol) else F.lit(None).cast("timestamp")
        tie = [F.col(self.opt("orderCol")).alias(runtime.TIE)] if self.isSet(self.orderCol) else []
        rows = df.select(key.alias(runtime.KEY), time.alias(runtime.TIME), *tie, *(c.alias(n) for n, c in self.inputs(df).items()))
        model = self.model()
        conf = df.sparkSession.conf
        model.linalg = (conf.get(SVD_METHOD, "gesdd"), conf.get(RAISE, "false").lower() == "true")
        if df.isStreaming:
            if self.isSet(self.watermarkDuration):
                rows = rows.withWatermark(runtime.TIME, self.opt("watermarkDuration"))
            out = runtime.stream(rows, model, self.opt("timeoutMode"), self._duration_ms(df), self.hands_watermark_on)
        else:
            out = self.run(rows, model)
        out = out.withColumnRenamed(runtime.KEY, self.opt("stateKeyCol") or "stateKey")
        out = out.withColumnRenamed(runtime.TIME, self.opt("eventTimeCol")) if self.isSet(self.eventTimeCol) else out.drop(runtime.TIME)
        if self.opt("stateKeyCol"):
            kind = df.schema[self.opt("stateKeyCol")].dataType
            if not isinstance(kind, T.StringType):
                out = out.withColumn(self.opt("stateKeyCol"), F.col(self.opt("stateKeyCol")).cast(kind))
        return out

    def _duration_ms(self, df: DataFrame) -> int | None:
        if self.opt("timeoutMode") == "none":
            return None
        if not self.opt("timeoutDuration"):
            raise ValueError("timeoutMode needs timeoutDuration")
        interval = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {self.opt('timeoutDuration')}"))
        return int(df.sparkSession.range(1).select(interval).first()[0] // 1000)

    def formatted(self, df: DataFrame) -> DataFrame:
        """Internal vectors and matrices as ML types, if asked for."""
        if self.opt("outputFormat") == "array":
            return df

        def convert(col: Column, kind: T.DataType) -> Column:
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType):
                return array_to_vector(col)
            if isinstance(kind, T.StructType) and kind.fieldNames() == ["numRows", "numCols", "values"]:
                return array_to_matrix(col)
            if isinstance(kind, T.StructType) and kind.fieldNames() == ["mean", "covariance"]:
                return F.when(col.isNotNull(), F.struct(array_to_vector(col["mean"]).alias("mean"), array_to_matrix(col["covariance"]).alias("covariance")))
            return col

        return df.select(*(convert(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


