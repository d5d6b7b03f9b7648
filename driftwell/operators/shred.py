"""Deeply nested records into flat, linked tables: columnar shredding with levels.

``levels`` turns a nested Arrow array into one column per leaf path with repetition and definition
levels. ``rebuild`` makes a flat table for any ancestor from the level sequences of the leaves below
it: the repetition levels give the row's record and its position in every repeated ancestor, the
definition levels tell which objects exist. ``nested_objects`` applies both to filter and mixture
outputs, from columns or from JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """Values and levels of one leaf path; ``values`` has an entry (null where undefined) per level pair."""

    values: pa.Array
    rep: np.ndarray
    defn: np.ndarray
    max_rep: int
    max_def: int


def levels(array: pa.Array, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], Leaf]:
    """The leaves of a nested array by path; a list's element is the path step ``[]``. Empty arrays give empty leaves."""
    out: dict[tuple[str, ...], Leaf] = {}
    n = len(array)
    _descend(array, path, np.zeros(n, np.int16), np.zeros(n, np.int16), np.arange(n), 0, 0, out)
    return out


def _descend(array: pa.Array, path: tuple[str, ...], rep: np.ndarray, defn: np.ndarray, idx: np.ndarray, max_rep: int, max_def: int, out: dict[tuple[str, ...], Leaf]) -> None:
    there = idx >= 0
    valid = array.is_valid().to_numpy(zero_copy_only=False) if len(array) else np.zeros(1, bool)
    there = there & valid[np.where(there, idx, 0)]
    defn, idx, max_def = defn + there, np.where(there, idx, -1), max_def + 1
    if pa.types.is_struct(array.type):
        for i, field in enumerate(array.type):
            _descend(array.field(i), (*path, field.name), rep, defn, idx, max_rep, max_def, out)
    elif pa.types.is_list(array.type) or pa.types.is_large_list(array.type):
        offsets = array.offsets.to_numpy() if len(array) else np.zeros(2, np.int64)
        at = np.where(there, idx, 0)
        length = np.where(there, offsets[at + 1] - offsets[at], 0).astype(np.int64)
        times = np.maximum(length, 1)
        ends = np.cumsum(times)
        j = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - times, times)
        filled = np.repeat(length > 0, times)
        child = np.where(filled, np.repeat(offsets[at], times) + j, -1)
        _descend(array.values, (*path, "[]"), np.where(j > 0, max_rep + 1, np.repeat(rep, times)).astype(np.int16), np.repeat(defn, times) + filled, child, max_rep + 1, max_def + 1, out)
    else:
        out[path] = Leaf(array.take(pa.array(idx, mask=idx < 0)), rep, defn, max_rep, max_def)


def _def_level(path: tuple[str, ...]) -> int:
    """Definition level at which the object at ``path`` exists: one per step, two per list element, and the root."""
    return 1 + sum(2 if s == "[]" else 1 for s in path)


def positions(leaf: Leaf, upto: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the entries that start an object under ``upto`` repeated ancestors: record numbers, position per ancestor, entry indices."""
    rep = leaf.rep
    n = len(rep)
    starts = np.flatnonzero(rep <= upto)
    record = np.cumsum(rep == 0) - 1
    at = []
    for r in range(1, upto + 1):
        c = np.cumsum(rep == r)
        last = np.maximum.accumulate(np.where(rep < r, np.arange(n), 0)) if n else np.zeros(0, int)
        at.append((c - c[last])[starts] if n else np.zeros(0, int))
    return record[starts], at, starts


def rebuild(leaves: dict[tuple[str, ...], Leaf], ancestor: tuple[str, ...], fields: dict[str, tuple[str, ...]]) -> tuple[np.ndarray, list[np.ndarray], dict[str, pa.Array]]:
    """The flat table of the objects at ``ancestor``: record numbers, a position per repeated ancestor, and ``fields``.

    A field is a leaf path below the ancestor: a scalar, or one list of scalars (ending in ``[]``).
    """
    depth, need = ancestor.count("[]"), _def_level(ancestor)
    columns: dict[str, pa.Array] = {}
    record = at = keep = None
    for name, below in fields.items():
        leaf = leaves[(*ancestor, *below)]
        rec, pos, starts = positions(leaf, depth)
        exists = leaf.defn[starts] >= need
        if record is None:
            record, at, keep = rec[exists], [p[exists] for p in pos], exists
        if not below or below[-1] != "[]":
            columns[name] = leaf.values.take(pa.array(starts[exists]))
            continue
        slot = leaf.defn >= leaf.max_def - 1  # an element, null or not
        upto = np.r_[0, np.cumsum(slot)]
        ends = np.r_[starts[1:], len(leaf.defn)] if len(starts) else starts
        sizes = (upto[ends] - upto[starts])[exists] if len(starts) else np.zeros(0, int)
        is_list = leaf.defn[starts][exists] >= leaf.max_def - 2  # the list itself is there, maybe empty
        owner = np.repeat(keep, np.diff(np.r_[starts, len(leaf.defn)])) if len(starts) else np.zeros(0, bool)
        flat = leaf.values.take(pa.array(np.flatnonzero(slot & owner)))
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[~is_list, False])
        columns[name] = pa.ListArray.from_arrays(offsets, flat)
    return record, at, columns


LEAVES = ("mean", "num_rows", "num_cols", "covariance", "weight")
OUT = "src string, rec_id bigint, batch_no int, output_no int, child string, child_no int, mean array<double>, num_rows int, num_cols int, covariance array<double>, weight double"
_OUT = pa.schema([("src", pa.string()), ("rec_id", pa.int64()), ("batch_no", pa.int32()), ("output_no", pa.int32()), ("child", pa.string()), ("child_no", pa.int32()), ("mean", pa.list_(pa.float64())), ("num_rows", pa.int32()), ("num_cols", pa.int32()), ("covariance", pa.list_(pa.float64())), ("weight", pa.float64())])
_OUTPUT = ("batches", "[]", "outputs", "[]")
_FIELDS = {"mean": ("mean", "[]"), "num_rows": ("covariance", "num_rows"), "num_cols": ("covariance", "num_cols"), "covariance": ("covariance", "vals", "[]")}


def _types(leaves: tuple[str, ...]) -> tuple[pa.DataType, pa.DataType | None]:
    """The types of a Gaussian and a mixture with the wanted leaves only."""
    mat = [(n, t) for n, w, t in (("num_rows", "num_rows", pa.int32()), ("num_cols", "num_cols", pa.int32()), ("vals", "covariance", pa.list_(pa.float64()))) if w in leaves]
    gau = pa.struct(([("mean", pa.list_(pa.float64()))] if "mean" in leaves else []) + ([("covariance", pa.struct(mat))] if mat else []))
    return gau, pa.struct(([("weights", pa.list_(pa.float64()))] if "weight" in leaves else []) + [("distributions", pa.list_(gau))])


def record_type(leaves: tuple[str, ...] = LEAVES) -> pa.DataType:
    gau, mix = _types(leaves)
    return pa.struct([("batches", pa.list_(pa.struct([("outputs", pa.list_(pa.struct([("state", gau), ("residual", gau), ("mixture", mix)])))])))])


RECORD = record_type()


def _places(record: np.ndarray, at: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    code = record
    for a, n in zip(at, sizes, strict=True):
        code = code * n + a
    return code


def _flat_tables(src: str, ids: np.ndarray, records: pa.Array, wanted: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    found = levels(records)
    fields = {n: p for n, p in _FIELDS.items() if n in wanted}
    weights = None
    if "weight" in wanted:
        weights = rebuild(found, (*_OUTPUT, "mixture", "weights", "[]"), {"weight": ()})
    for child, ancestor in (("weight", None), ("state", (*_OUTPUT, "state")), ("residual", (*_OUTPUT, "residual")), ("component", (*_OUTPUT, "mixture", "distributions", "[]"))):
        if child == "weight" and weights is None:
            continue
        record, at, columns = weights if child == "weight" else rebuild(found, ancestor, fields)
        n = len(record)
        if not n:
            continue
        if child == "component" and weights is not None and len(weights[0]):
            # The weight at the same place, from the same levels.
            sizes = [1 + max(int(a.max(initial=0)), int(b.max(initial=0))) for a, b in zip(at, weights[1], strict=True)]
            own, there = _places(record, at, sizes), _places(weights[0], weights[1], sizes)
            k = np.minimum(np.searchsorted(there, own), len(there) - 1)
            columns["weight"] = weights[2]["weight"].take(pa.array(k, mask=there[k] != own))
        made = {"src": pa.array([src] * n), "rec_id": pa.array(ids[record]), "batch_no": pa.array(at[0]), "output_no": pa.array(at[1]), "child": pa.array([child] * n), "child_no": pa.array(at[2] if len(at) > 2 else np.zeros(n, int))} | columns
        keep = [f for f in _OUT if f.name in wanted or f.name not in LEAVES]
        yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(n, f.type) for f in keep], names=[f.name for f in keep])


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _no_number(x: str) -> float:
    raise ValueError(x)


def _json(text: str) -> object:
    """Strict JSON: ``NaN`` and infinities are none."""
    return json.loads(text, parse_constant=_no_number)


def _object(x: object) -> object:
    """What JSON text holds, if ``x`` is the JSON text of an object or array; else ``x``."""
    if isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
        try:
            return _object(_json(x))
        except ValueError:
            return x
    return x


def _list(x: object) -> list | None:
    """An array, a lone object as an array of one, else null."""
    x = _object(x)
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else None


def _numbers(x: object) -> list | None:
    x = _object(x)
    return [_number(v) for v in x] if isinstance(x, list) else None


def _matrix(x: object) -> dict | None:
    """A matrix from ``{numRows, numCols, values}`` (column-major) or from a list of rows."""
    x = _object(x)
    if isinstance(x, dict):
        rows, cols = (int(v) if (v := _number(x.get(k))) is not None else None for k in ("numRows", "numCols"))
        return {"num_rows": rows, "num_cols": cols, "vals": _numbers(x.get("values"))}
    if isinstance(x, list) and all(isinstance(r, list) for r in x):
        width = max((len(r) for r in x), default=0)
        return {"num_rows": len(x), "num_cols": width, "vals": [_number(r[j]) if j < len(r) else None for j in range(width) for r in x]}
    return None


def _gaussian(x: object, wanted: tuple[str, ...]) -> dict | None:
    x = _object(x)
    if not isinstance(x, dict):
        return None
    mean = {"mean": _numbers(x.get("mean"))} if "mean" in wanted else {}
    return mean | {"covariance": _matrix(x.get("covariance"))} if len({*wanted} - {"mean", "weight"}) else mean


def _output(x: object, wanted: tuple[str, ...]) -> dict | None:
    x = _object(x)
    if not isinstance(x, dict):
        return None
    mix = _object(x.get("mixtureModel"))
    parts = _list(mix.get("distributions")) if isinstance(mix, dict) else None
    own = None
    if isinstance(mix, dict):
        own = {"distributions": None if parts is None else [_gaussian(p, wanted) for p in parts]} | ({"weights": _numbers(mix.get("weights"))} if "weight" in wanted else {})
    return {"state": _gaussian(x.get("state"), wanted), "residual": _gaussian(x.get("residual"), wanted), "mixture": own}


def record_of(payload: str | None, wanted: tuple[str, ...] = LEAVES) -> dict | None:
    """The record of a JSON export in any known layout; null if it is no complete JSON object."""
    try:
        x = _object(_json(payload)) if payload else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(x, dict):
        return None
    if "batches" not in x and isinstance(run := _object(x.get("run")), dict):
        x = run
    batches = _list(x.get("batches")) if "batches" in x else [x]
    if batches is None:
        return {"batches": None}
    made = []
    for b in map(_object, batches):
        outputs = _list(b.get("outputs")) if isinstance(b, dict) else None
        made.append(None if not isinstance(b, dict) else {"outputs": None if outputs is None else [_output(o, wanted) for o in outputs]})
    return {"batches": made}


def _run(src: str, wanted: tuple[str, ...], read: Callable[[pa.RecordBatch], pa.Array]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield from _flat_tables(src, ids, read(batch), wanted)

    return run


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_struct(kind):
        return f"struct<{','.join(f'{f.name}:{_ddl(f.type)}' for f in kind)}>"
    return f"array<{_ddl(kind.value_type)}>" if pa.types.is_list(kind) else {"double": "double", "int32": "int"}[str(kind)]


def _pruned(col: Column, kind: pa.DataType) -> Column:
    """The wanted leaves of a struct column, as plain field references, so that the scan reads no others."""
    parts = [(col[f.name].cast(_ddl(f.type)) if not pa.types.is_struct(f.type) else _pruned(col[f.name], f.type)).alias(f.name) for f in kind]
    return F.when(col.isNotNull(), F.struct(*parts))


def nested_objects(df: DataFrame, src: str, rec_id: str, *, state: str | None = None, residual: str | None = None, mixture: str | None = None, payload: str | None = None, leaves: tuple[str, ...] = LEAVES) -> DataFrame:
    """The flat table of all states, residuals, mixture components and weights of ``df``'s records.

    One row per object that exists, linked to its parent by ``rec_id`` and positions: ``src, rec_id, batch_no,
    output_no, child, child_no`` (``child``: ``state``, ``residual``, ``component``, ``weight``; positions start at 0 and count
    nulls; a component and its weight share all positions), and ``mean, num_rows, num_cols, covariance, weight``. A component's row
    has the weight at its position, null where there are fewer weights.
    Records come from the struct columns named, or from the JSON text in ``payload``, in any of the layouts
    ``{batches: [{outputs}]}``, ``{run: {batches}}``, ``{outputs}``, with lone objects for arrays and objects held as JSON text.

    A null struct has no row, a hollow one has a row with null fields. Payloads that are null or not
    complete JSON have no rows. Rows with a null id are dropped. Repeated records have their own rows. ``leaves`` names the
    leaf columns wanted; no others are read, shredded or returned. With ``("mean",)`` the mixture's means are read without the objects
    around them, so a component without mean has a row whether the component is null or hollow.
    """
    wanted = tuple(n for n in LEAVES if n in leaves)
    if not {*wanted} & {*_FIELDS}:
        raise ValueError("leaves must name a field of the objects")
    out = ", ".join(c for c in OUT.split(", ") if c.split()[0] in wanted or c.split()[0] not in LEAVES)
    kind = record_type(wanted)
    df = df.where(F.col(rec_id).isNotNull())
    if payload:
        made = df.select(F.col(rec_id).cast("long"), payload)
        return made.mapInArrow(_run(src, wanted, lambda b: pa.array([record_of(p, wanted) for p in b.column(1).to_pylist()], kind)), out)
    gau, mix = _types(wanted)
    null = lambda t: F.lit(None).cast(_ddl(t))
    struct = lambda c: (_pruned(F.col(c), gau) if c and c in df.columns else null(gau))
    if not mixture:
        parts = null(mix)
    elif wanted == ("mean",):
        parts = F.when(F.col(mixture).isNotNull(), F.struct(F.transform(F.col(f"{mixture}.distributions.mean"), lambda m: F.struct(m.cast("array<double>").alias("mean"))).alias("distributions")))
    else:
        objects = F.transform(F.col(f"{mixture}.distributions"), lambda g: _pruned(g, gau)).alias("distributions")
        parts = F.when(F.col(mixture).isNotNull(), F.struct(*([F.col(f"{mixture}.weights").cast("array<double>").alias("weights")] if "weight" in wanted else []), objects))
    output = F.struct(struct(state).alias("state"), struct(residual).alias("residual"), parts.alias("mixture"))
    made = df.select(F.col(rec_id).cast("long"), F.struct(F.array(F.struct(F.array(output).alias("outputs"))).alias("batches")).alias("r"))
    return made.mapInArrow(_run(src, wanted, lambda b: b.column(1)), out)
