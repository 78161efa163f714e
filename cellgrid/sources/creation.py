"""Arrays from nothing or from local data: ranges, constants, diagonals, grids, and NumPy arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, active, fresh, from_cells, literal, numpy_dtype, spark_type, strides


def index_frame(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(int(n))


def shape_of(shape) -> tuple[int, ...]:
    return tuple(int(n) for n in shape) if isinstance(shape, (tuple, list)) else (int(shape),)


def grid(shape) -> Array:
    """All positions of a shape from one range, the value being the flat position."""
    shape = shape_of(shape)
    df = index_frame(active(), math.prod(shape))
    columns = [F.expr(f"(id div {s}) % {n}").alias(f"i{k}") if n > 1 else F.lit(0).cast("bigint").alias(f"i{k}") for k, (s, n) in enumerate(zip(strides(shape), shape, strict=True))]
    return from_cells(df.select(*columns, F.col("id").alias("v")), shape, "int64")


def full(shape, fill_value, dtype=None, chunks=None) -> Array:
    dtype = np.dtype(dtype) if dtype is not None else np.asarray(fill_value).dtype
    x = grid(shape)
    return Array(x.df, x.axes, literal(fill_value, dtype), dtype, chunks)


def ones(shape, dtype=float, chunks=None) -> Array:
    return full(shape, 1, dtype, chunks)


def zeros(shape, dtype=float, chunks=None) -> Array:
    return full(shape, 0, dtype, chunks)


empty = zeros


def full_like(a: Array, fill_value, dtype=None, shape=None, **kwargs) -> Array:
    dtype = np.dtype(dtype) if dtype is not None else a.dtype
    return full(shape, fill_value, dtype) if shape is not None else a.with_value(literal(fill_value, dtype), dtype)


def ones_like(a: Array, dtype=None, shape=None, **kwargs) -> Array:
    return full_like(a, 1, dtype, shape)


def zeros_like(a: Array, dtype=None, shape=None, **kwargs) -> Array:
    return full_like(a, 0, dtype, shape)


empty_like = zeros_like


def arange(start, stop=None, step=1, dtype=None, chunks=None, like=None) -> Array:
    if stop is None:
        start, stop = 0, start
    dtype = np.dtype(dtype) if dtype is not None else np.arange(start, start + step, step).dtype
    n = max(0, math.ceil((stop - start) / step))
    value = F.lit(start) + F.col("id") * F.lit(step)
    return Array(index_frame(active(), n), [Axis("id", 0, n)], value.cast(spark_type(dtype)), dtype, chunks)


def linspace(start, stop, num: int = 50, endpoint: bool = True, retstep: bool = False, dtype=None, chunks=None):
    pieces = max(1, num - 1 if endpoint else num)
    step = (stop - start) / pieces
    value = F.lit(float(start)) + F.col("id") * F.lit(float(step))
    if endpoint and num > 1:
        value = F.when(F.col("id") == num - 1, float(stop)).otherwise(value)
    dtype = np.dtype(dtype or float)
    out = Array(index_frame(active(), num), [Axis("id", 0, num)], value.cast(spark_type(dtype)), dtype, chunks)
    return (out, step) if retstep else out


def eye(N: int, M: int | None = None, k: int = 0, dtype=float, chunks=None) -> Array:
    x = grid((N, N if M is None else M))
    return x.with_value(F.when(F.col("i1") == F.col("i0") + k, 1).otherwise(0).cast(spark_type(np.dtype(dtype))), dtype)


def tri(N: int, M: int | None = None, k: int = 0, dtype=float) -> Array:
    x = grid((N, N if M is None else M))
    return x.with_value(F.when(F.col("i1") <= F.col("i0") + k, 1).otherwise(0).cast(spark_type(np.dtype(dtype))), dtype)


def diag(v, k: int = 0) -> Array:
    """A matrix with the vector on its k-th diagonal, or the k-th diagonal of a matrix."""
    from cellgrid.operators.elementwise import asarray

    v = asarray(v)
    if v.ndim == 2:
        return diagonal(v, k)
    n = v.shape[0] + abs(k)
    position = v.axes[0].position
    on = v.df.select(position.alias("d"), v.value.alias("w"))
    at = grid((n, n)).cells().withColumn("d", F.when(F.col("i1") == F.col("i0") + k, F.least("i0", "i1")))
    joined = at.drop("v").join(on, "d", "left").select("i0", "i1", F.coalesce("w", literal(0, v.dtype)).alias("v"))
    return from_cells(joined, (n, n), v.dtype)


def diagonal(a: Array, offset: int = 0, axis1: int = 0, axis2: int = 1) -> Array:
    """The cells with position axis2 = position axis1 + offset; the diagonal's axis comes last."""
    axis1, axis2 = axis1 % a.ndim, axis2 % a.ndim
    rows, cols = a.shape_or_none[axis1], a.shape_or_none[axis2]
    n = max(0, min(rows, cols - offset) if offset >= 0 else min(rows + offset, cols))
    one, two = a.axes[axis1], a.axes[axis2]
    df = a.filtered(two.position == one.position + offset)
    first = one.offset if offset >= 0 else one.offset - offset
    return a.with_axes([*[x for k, x in enumerate(a.axes) if k not in (axis1, axis2)], Axis(one.col, first, n)], df)


def meshgrid(*xi, sparse: bool = False, indexing: str = "xy", **kwargs) -> list[Array]:
    from cellgrid.operators.elementwise import asarray, broadcast_to
    from cellgrid.operators.shape import expand_dims

    xi = [asarray(x) for x in xi]
    order = list(range(len(xi)))
    if indexing == "xy" and len(xi) > 1:
        order[0], order[1] = 1, 0
    out = []
    for x, place in zip(xi, order, strict=True):
        for k in range(len(xi)):
            if k != place:
                x = expand_dims(x, k if k < place else x.ndim)
        out.append(x)
    if sparse:
        return out
    shape = [0] * len(xi)
    for x, place in zip(xi, order, strict=True):
        shape[place] = x.shape[0]
    return [broadcast_to(x, tuple(shape)) for x in out]


def indices(dimensions, dtype=int) -> Array:
    from cellgrid.operators.combine import stack

    x = grid(dimensions)
    return stack([x.with_value(a.position.cast(spark_type(np.dtype(dtype))), dtype) for a in x.axes])


def fromfunction(func, shape, dtype=float, **kwargs) -> Array:
    """func of the index arrays, which are lazy, so it may use any function of this library."""
    x = grid(shape)
    out = func(*[x.with_value(a.position.cast(spark_type(np.dtype(dtype))), dtype) for a in x.axes], **kwargs)
    return out if isinstance(out, Array) else full(shape, out)


def fftfreq(n: int, d: float = 1.0) -> Array:
    x = arange(n)
    return x.with_value((F.when(F.col("id") < (n + 1) // 2, F.col("id")).otherwise(F.col("id") - n) / F.lit(float(n * d))), float)


def rfftfreq(n: int, d: float = 1.0) -> Array:
    x = arange(n // 2 + 1)
    return x.with_value(F.col("id") / F.lit(float(n * d)), float)


def from_array(x, chunks=None, **kwargs) -> Array:
    """A local NumPy array (or what converts to one), sent through Arrow."""
    if isinstance(x, Array):
        return x
    x = np.asarray(x)
    flat = x.reshape(-1)
    columns = {f"i{k}": i.astype(np.int64) for k, i in enumerate(np.unravel_index(np.arange(x.size), x.shape))} if x.ndim else {}
    if x.dtype.kind == "c":
        value = pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], ["re", "im"])
    elif x.dtype.kind in "Mm":
        value = pa.array(flat.view("int64"))
    elif x.dtype.kind in "OUS":
        value = pa.array([None if v is None else str(v) for v in flat.tolist()], pa.string())
    else:
        value = pa.array(flat.astype("uint64").astype(object).tolist(), pa.decimal128(20, 0)) if x.dtype == np.uint64 else pa.array(flat.astype({"uint8": "int16", "uint16": "int32", "uint32": "int64"}.get(x.dtype.name, x.dtype)))
    table = pa.table({**columns, "v": value})
    return from_cells(active().createDataFrame(table), x.shape, x.dtype if x.dtype.kind not in "US" else object, chunks)


array = asarray = asanyarray = from_array


def from_dataframe(df: DataFrame, index, value: str, shape=None, dtype=None, origin=0) -> Array:
    """An array over stored columns: index columns (dense integers from `origin`) and a value column. The columns stay as they are, so slices reach the scan."""
    index = [index] if isinstance(index, str) else list(index)
    origin = [origin] * len(index) if np.isscalar(origin) else list(origin)
    shape = [None] * len(index) if shape is None else list(shape_of(shape))
    kind = df.schema[value].dataType.simpleString()
    kept = df.select(*[F.col(c) for c in dict.fromkeys([*index, value])])
    return Array(kept, [Axis(c, o, n) for c, o, n in zip(index, origin, shape, strict=True)], F.col(value), dtype or numpy_dtype(kind))


def from_vectors(df: DataFrame, index: str, vector: str, length: int, rows: int | None = None, dtype=None) -> Array:
    """A matrix from a table of fixed-length array rows."""
    name = fresh("p")
    df = df.select(F.col(index), F.posexplode(vector).alias(name, "v")).select(index, F.col(name).cast("bigint").alias(name), "v")
    return Array(df, [Axis(index, 0, rows), Axis(name, 0, length)], F.col("v"), dtype or numpy_dtype(df.schema["v"].dataType.simpleString()))
