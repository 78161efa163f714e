"""The array: a frame with one row a cell, some index columns and a value expression over it.

An axis names its index column and the offset of its origin, so slicing filters the stored column itself, below any shift, and reaches the Parquet scan.
The value is a Column over the frame; arrays that share a frame and its axes combine by projection, without a join.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint",
    "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "complex64": "struct<re:double,im:double>", "complex128": "struct<re:double,im:double>", "object": "string",
}
_fresh = itertools.count()


def spark_type(dtype: np.dtype) -> str:
    if dtype.kind in "Mm":
        return "bigint"
    return SPARK_TYPES.get(dtype.name, "string")


def numpy_dtype(kind: str) -> np.dtype:
    """The dtype of a Spark column."""
    names = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "struct<re:double,im:double>": "complex128"}
    return np.dtype(names.get(kind, "float64" if kind.startswith("decimal") else "object"))


def fresh(stem: str = "i") -> str:
    return f"_{stem}{next(_fresh)}"


@dataclass(frozen=True)
class Axis:
    """col: index column, None for a constant axis of one cell; offset: the column's value at position 0; size: None if unknown."""

    col: str | None
    offset: int = 0
    size: int | None = 1

    @property
    def position(self) -> Column:
        if self.col is None:
            return F.lit(0).cast("bigint")
        return F.col(self.col) - F.lit(self.offset).cast("bigint") if self.offset else F.col(self.col)


def active() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    return spark


class Array:
    """A lazy n-dimensional array. Every cell has a row unless `fill` says what the missing ones hold."""

    __array_priority__ = 20

    def __init__(self, df: DataFrame, axes, value: Column | None = None, dtype=None, chunks=None):
        self.df = df
        self.axes = tuple(axes)
        self.value = F.col("v") if value is None else value
        self.dtype = np.dtype(dtype) if dtype is not None else numpy_dtype(df.select(self.value.alias("v")).schema["v"].dataType.simpleString())
        self._chunks = chunks

    # -- metadata ------------------------------------------------------------------------------------------------------------------------------------
    @property
    def shape(self) -> tuple:
        return tuple(float("nan") if a.size is None else a.size for a in self.axes)

    @property
    def ndim(self) -> int:
        return len(self.axes)

    @property
    def size(self):
        return prod(self.shape)

    @property
    def itemsize(self) -> int:
        return self.dtype.itemsize

    @property
    def nbytes(self):
        return self.size * self.itemsize

    @property
    def chunks(self) -> tuple:
        from cellgrid.operators.blocks import normalize_chunks

        return self._chunks if self._chunks is not None else normalize_chunks("auto", self.shape, dtype=self.dtype)

    @property
    def numblocks(self) -> tuple:
        return tuple(map(len, self.chunks))

    @property
    def npartitions(self) -> int:
        return prod(self.numblocks)

    @property
    def chunksize(self) -> tuple:
        return tuple(max(c) for c in self.chunks)

    def __len__(self) -> int:
        if not self.axes:
            raise TypeError("len() of a 0-d array")
        return self.shape[0]

    def __repr__(self) -> str:
        return f"cellgrid.Array(shape={self.shape}, dtype={self.dtype})"

    # -- frames --------------------------------------------------------------------------------------------------------------------------------------
    def cells(self) -> DataFrame:
        """i0, i1, ..., v with positions from 0."""
        return self.df.select(*[a.position.alias(f"i{k}") for k, a in enumerate(self.axes)], self.value.alias("v"))

    to_dataframe = cells

    def settled(self) -> Array:
        """The same array over its cells: plain index columns and value."""
        return from_cells(self.cells(), self.shape_or_none, self.dtype, self._chunks)

    @property
    def shape_or_none(self) -> tuple:
        return tuple(a.size for a in self.axes)

    def with_value(self, value: Column, dtype=None) -> Array:
        dtype = np.dtype(dtype) if dtype is not None else self.dtype
        return Array(self.df, self.axes, value, dtype, self._chunks)

    def with_axes(self, axes, df: DataFrame | None = None) -> Array:
        return Array(self.df if df is None else df, axes, self.value, self.dtype)

    def filtered(self, condition: Column) -> DataFrame:
        return self.df.where(condition)

    def persist(self) -> Array:
        return from_cells(self.cells().persist(), self.shape_or_none, self.dtype, self._chunks)

    def copy(self) -> Array:
        return Array(self.df, self.axes, self.value, self.dtype, self._chunks)

    # -- results -------------------------------------------------------------------------------------------------------------------------------------
    def compute(self) -> np.ndarray:
        """The local NumPy array, by the cells' positions."""
        return scatter(self.compute_chunk_sizes() if None in self.shape_or_none else self)

    __array__ = lambda self, dtype=None, copy=None: np.asarray(self.compute(), dtype)

    def compute_chunk_sizes(self) -> Array:
        """Counts unknown lengths: the largest position of the axis plus one."""
        unknown = [k for k, a in enumerate(self.axes) if a.size is None]
        if not unknown:
            return self
        cells = self.cells()
        row = cells.agg(*[F.max(f"i{k}").alias(f"m{k}") for k in unknown]).first()
        sizes = [(-1 if row[f"m{k}"] is None else row[f"m{k}"]) + 1 if k in unknown else a.size for k, a in enumerate(self.axes)]
        return from_cells(cells, sizes, self.dtype)

    def item(self):
        return self.compute().item()

    def __bool__(self) -> bool:
        return bool(self.item())

    def __int__(self) -> int:
        return int(self.item())

    def __float__(self) -> float:
        return float(self.item())

    def __complex__(self) -> complex:
        return complex(self.item())

    def __index__(self) -> int:
        return int(self.item())

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def __deepcopy__(self, memo) -> Array:
        return self.copy()


def scatter(x: Array) -> np.ndarray:
    table = x.cells().toArrow()
    v = table["v"].combine_chunks() if table.num_rows else None
    if x.dtype.kind == "c":
        parts = [np.asarray(v.field(k).to_numpy(zero_copy_only=False)) for k in ("re", "im")] if v is not None else [np.zeros(0)] * 2
        values = (parts[0] + 1j * parts[1]).astype(x.dtype)
    elif v is None:
        values = np.zeros(0, x.dtype)
    elif x.dtype.kind == "O":
        values = np.array(v.to_pylist(), object)
    else:
        if pa.types.is_decimal(v.type):
            v = v.cast(pa.float64())
        values = v.to_numpy(zero_copy_only=False)
        values = np.where(values == None, np.nan, values).astype(x.dtype) if values.dtype == object else values.astype(x.dtype) if x.dtype.kind not in "Mm" else values.astype("int64").view(x.dtype)  # noqa: E711
    out = np.zeros(x.shape_or_none, x.dtype)
    index = tuple(table[f"i{k}"].to_numpy() for k in range(x.ndim))
    if x.ndim:
        out[index] = values
    elif len(values):
        out[()] = values[0]
    return out


def from_cells(df: DataFrame, shape, dtype=None, chunks=None) -> Array:
    """An array over a frame of i0, i1, ..., v."""
    return Array(df, [Axis(f"i{k}", 0, n) for k, n in enumerate(shape)], F.col("v"), dtype, chunks)


def literal(value, dtype: np.dtype) -> Column:
    if dtype.kind == "c":
        return F.struct(F.lit(float(np.real(value))).alias("re"), F.lit(float(np.imag(value))).alias("im"))
    if dtype.kind in "Mm":
        return F.lit(int(np.asarray(value, dtype).view("int64")))
    if isinstance(value, np.generic):
        value = value.item()
    if dtype.kind == "O":
        return F.lit(value)
    return F.lit(value).cast(spark_type(dtype))


def strides(shape) -> list[int]:
    out = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        out[k] = out[k + 1] * shape[k + 1]
    return out


def axis_number(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise IndexError(f"axis {axis} is out of bounds for {ndim} dimensions")
    return axis % ndim


def axis_numbers(axis, ndim: int) -> tuple[int, ...]:
    if axis is None:
        return tuple(range(ndim))
    return tuple(axis_number(a, ndim) for a in (axis if isinstance(axis, (tuple, list)) else (axis,)))


def resized(axis: Axis, **kwargs) -> Axis:
    return replace(axis, **kwargs)
