"""Elementwise operations: broadcasting, the universal functions, predicates and generic maps over values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, active, fresh, from_cells, literal, spark_type
from cellgrid.functions import scalar

#: A side of at most so many cells is broadcast in an alignment.
BROADCAST_CELLS = 1_000_000


def asarray(x, **kwargs) -> Array:
    from cellgrid.sources.creation import from_array

    return x if isinstance(x, Array) else from_array(np.asarray(x))


def is_scalar(x) -> bool:
    return np.isscalar(x) or (isinstance(x, np.ndarray) and x.ndim == 0)


def broadcast_shapes(*shapes) -> tuple:
    ndim = max(map(len, shapes), default=0)
    out = []
    for k in range(ndim):
        sizes = {s[k - ndim] for s in shapes if len(s) >= ndim - k} - {1}
        known = {n for n in sizes if n is not None}
        if len(known) > 1:
            raise ValueError(f"shapes {shapes} do not fit together")
        out.append(1 if not sizes else known.pop() if known else None)
    return tuple(out)


def fused(arrays: list[Array]) -> list[Array]:
    """Reductions of one frame by the same keys become one aggregation."""
    out, groups = list(arrays), {}
    for place, a in enumerate(arrays):
        if grouping := a.df.__dict__.get("_grouping"):
            groups.setdefault((id(grouping[0]), grouping[1]), []).append(place)
    for (_, keys), places in groups.items():
        if len({id(arrays[p].df) for p in places}) < 2:
            continue
        base = arrays[places[0]].df._grouping[0]
        every = {name: column for p in places for name, column in arrays[p].df._grouping[2].items()}
        sums = [column.alias(name) for name, column in every.items()]
        df = base.groupBy(*keys).agg(*sums) if keys else base.agg(*sums)
        df._grouping = (base, keys, every)
        for p in places:
            a = arrays[p]
            out[p] = Array(df, a.axes, a.value, a.dtype)
    return out


def crossed(left: DataFrame, left_cells: int | None, right: DataFrame, right_cells: int | None) -> DataFrame:
    """Each row of one frame with each of the other, the smaller one broadcast. Refused unless a side is known to have at most BROADCAST_CELLS cells."""
    small = [(n, k) for k, n in enumerate((left_cells, right_cells)) if n is not None and n <= BROADCAST_CELLS]
    if not small:
        raise ValueError(f"an outer product of {left_cells} by {right_cells} cells: one side must be known to have at most {BROADCAST_CELLS}; slice it, or call compute_chunk_sizes")
    return left.crossJoin(F.broadcast(right)) if min(small)[1] else F.broadcast(left).crossJoin(right)


def align(arrays: list[Array]) -> tuple[Array, list[Column]]:
    """One frame for all: its axes (value aside) and each array's value in it.

    Arrays over one frame whose active axes agree need no join. Others are joined on the positions that both have; a side that has none is crossed, which
    is what an outer product is. The smaller side is broadcast if its size is known to be small."""
    arrays = fused(arrays)
    shape = broadcast_shapes(*[a.shape_or_none for a in arrays])
    padded = [[Axis(None)] * (len(shape) - a.ndim) + list(a.axes) for a in arrays]
    active_at = [[k for k, ax in enumerate(axes) if ax.col is not None and shape[k] != 1 and ax.size != 1] for axes in padded]
    if all(a.df is arrays[0].df for a in arrays):
        chosen: list[Axis] = []
        for k, n in enumerate(shape):
            used = {(axes[k].col, axes[k].offset) for axes, at in zip(padded, active_at, strict=True) if k in at}
            if len(used) > 1 or (not used and n != 1):
                break
            col, offset = used.pop() if used else (None, 0)
            chosen.append(Axis(col, offset, n))
        else:
            cells = {tuple(sorted((ax.col, ax.offset) for ax in a.axes if ax.col)) for a in arrays}
            if len(cells) == 1:
                return Array(arrays[0].df, chosen, F.lit(None), float), [a.value for a in arrays]
    names = [fresh("j") for _ in shape]
    joined, have, size, values = None, set(), 1, []
    for a, axes, at in zip(arrays, padded, active_at, strict=True):
        value = fresh("v")
        side = a.df.select(*[axes[k].position.alias(names[k]) for k in at], a.value.alias(value))
        values.append(F.col(value))
        own = None if any(shape[k] is None for k in at) else int(np.prod([shape[k] for k in at], dtype=np.int64))
        if joined is None:
            joined, have, size = side, set(at), own
            continue
        keys = [names[k] for k in at if k in have]
        if not keys:
            joined = crossed(joined, size, side, own)
        elif own is not None and own <= BROADCAST_CELLS and (size is None or own <= size):
            joined = joined.join(F.broadcast(side), keys)
        elif size is not None and size <= BROADCAST_CELLS:
            joined = F.broadcast(joined).join(side, keys)
        else:
            joined = joined.join(side, keys)
        have |= set(at)
        size = None if own is None or size is None else int(np.prod([shape[k] for k in have], dtype=np.int64))
    return Array(joined, [Axis(names[k] if k in have else None, 0, n) for k, n in enumerate(shape)], F.lit(None), float), values


def combine(function: Callable[..., Column], arrays: list[Array], dtype) -> Array:
    frame, values = align(arrays)
    return frame.with_value(function(*values), dtype)


def _sample(x):
    return np.ones(1, x.dtype) if isinstance(x, Array) else x


def result_dtype(name: str, args) -> np.dtype:
    with np.errstate(all="ignore"):
        try:
            return np.asarray(getattr(np, name)(*[_sample(a) for a in args])).dtype
        except (TypeError, ValueError):
            return np.result_type(*[_sample(a) for a in args])


def result_type(*args) -> np.dtype:
    return np.result_type(*[_sample(a) if isinstance(a, Array) else a for a in args])


def elemwise(name: str, *args, dtype=None, where=True, out=None) -> Array:
    """A universal function by NumPy's name, with broadcasting; where= keeps `out` (or 0) at cells where it is false."""
    dtype = np.dtype(dtype) if dtype is not None else result_dtype(name, args)
    arrays = [a for a in args if isinstance(a, Array)]
    dtypes = [a.dtype if isinstance(a, Array) else np.asarray(a).dtype for a in args]
    table = scalar.COMPLEX if any(d.kind == "c" for d in dtypes) else scalar.UFUNCS
    if name not in table:
        raise NotImplementedError(f"{name} of {dtypes}")
    extra = ([where] if isinstance(where, Array) else []) + ([out] if isinstance(out, Array) else [])

    def build(*values: Column) -> Column:
        rest = iter(values)
        columns = [next(rest) if isinstance(a, Array) else literal(a, d) for a, d in zip(args, dtypes, strict=True)]
        value = table[name](*columns, *dtypes)
        if dtype.kind in "iufb":
            value = value.cast(spark_type(dtype))
        if where is not True:
            condition = next(rest) if isinstance(where, Array) else F.lit(bool(where))
            kept = next(rest) if isinstance(out, Array) else literal(0, dtype)
            value = F.when(condition, value).otherwise(kept)
        return value

    return combine(build, [*arrays, *extra], dtype)


class ufunc:
    def __init__(self, name: str):
        self.__name__ = name
        self.__doc__ = f"Elementwise {name}, as NumPy defines it."

    def __call__(self, *args, out=None, where=True, dtype=None) -> Array:
        if not any(isinstance(a, Array) for a in args):
            args = [asarray(args[0]), *args[1:]]
        args = [a if isinstance(a, Array) or is_scalar(a) else asarray(a) for a in args]
        return elemwise(self.__name__, *args, where=where, dtype=dtype, out=out)

    def outer(self, a, b) -> Array:
        from cellgrid.operators.shape import expand_dims

        a, b = asarray(a), asarray(b)
        for k in range(b.ndim):
            a = expand_dims(a, a.ndim)
        return self(a, b)

    def reduce(self, a, axis=0, **kwargs) -> Array:
        from cellgrid.operators import reductions as r

        by = {"add": r.sum, "multiply": r.prod, "maximum": r.max, "minimum": r.min, "logical_and": r.all, "logical_or": r.any}
        return by[self.__name__](a, axis=axis, **kwargs)


#: Every universal function as a callable, by name.
FUNCTIONS = {name: ufunc(name) for name in scalar.UFUNCS}
globals().update(FUNCTIONS)


def i0(x) -> Array:
    """The modified Bessel function of order 0."""
    return frompyfunc(lambda v: float(np.i0(v)), 1)(x)


def nextafter(x, y) -> Array:
    return frompyfunc(lambda a, b: float(np.nextafter(a, b)), 2)(x, y)


def wrap_elemwise(name) -> ufunc:
    """A universal function of this library by NumPy's function or its name."""
    return FUNCTIONS[name if isinstance(name, str) else name.__name__]


def astype(x: Array, dtype) -> Array:
    dtype = np.dtype(dtype)
    if dtype.kind == "c":
        return x if x.dtype.kind == "c" else x.with_value(scalar.complex_of(scalar.real(x.value), F.lit(0.0)), dtype)
    value = x.value
    if dtype.kind == "b":
        value = scalar.truthy(value, x.dtype)
    elif dtype.kind in "iu" and x.dtype.kind == "f":
        value = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return x.with_value(value.cast(spark_type(dtype)), dtype)


def where(condition, x=None, y=None):
    """Cells of x where the condition holds, else of y; with the condition alone, the positions where it holds."""
    if x is None and y is None:
        from cellgrid.operators.indexing import nonzero

        return nonzero(condition)
    dtype = result_type(*(v for v in (x, y)))
    condition = asarray(condition)
    arrays = [condition, *[v for v in (x, y) if isinstance(v, Array)]]

    def build(c, *values):
        rest = iter(values)
        a, b = (next(rest) if isinstance(v, Array) else literal(v, np.asarray(v).dtype) for v in (x, y))
        return F.when(scalar.truthy(c, condition.dtype), a.cast(spark_type(dtype))).otherwise(b.cast(spark_type(dtype)))

    return combine(build, arrays, dtype)


def select(condlist, choicelist, default=0) -> Array:
    """The first choice whose condition holds."""
    out = default
    for c, v in zip(reversed(list(condlist)), reversed(list(choicelist)), strict=True):
        out = where(c, v, out)
    return out


def piecewise(x: Array, condlist, funclist) -> Array:
    """Values (or functions of x) by the last condition that holds; one more than the conditions is the default."""
    condlist, funclist = list(condlist), list(funclist)
    default = funclist.pop() if len(funclist) == len(condlist) + 1 else 0
    value = lambda f: f(x) if callable(f) else f
    out = value(default)
    for c, f in zip(condlist, funclist, strict=True):
        out = where(c, value(f), out)
    return astype(out, x.dtype)


def choose(a: Array, choices) -> Array:
    choices = [asarray(c) if not is_scalar(c) else c for c in choices]
    out = choices[-1]
    for k in range(len(choices) - 2, -1, -1):
        out = where(elemwise("equal", a, k), choices[k], out)
    return out


def clip(x: Array, min=None, max=None) -> Array:
    out = x
    if min is not None:
        out = elemwise("maximum", out, min)
    if max is not None:
        out = elemwise("minimum", out, max)
    return out


def round(x: Array, decimals: int = 0) -> Array:
    """Half to even."""
    return x.with_value(F.bround(x.value, decimals)) if x.dtype.kind in "fiu" else x


around = round


def isclose(a, b, rtol=1e-5, atol=1e-8, equal_nan=False) -> Array:
    a, b = asarray(a), asarray(b)
    return combine(lambda x, y: scalar.isclose(x, y, rtol, atol, equal_nan), [a, b], bool)


def allclose(a, b, rtol=1e-5, atol=1e-8, equal_nan=False) -> Array:
    from cellgrid.operators.reductions import all

    return all(isclose(a, b, rtol, atol, equal_nan))


def isnull(x) -> Array:
    x = asarray(x)
    return x.with_value(x.value.isNull() | (scalar.isnan(x.value, x.dtype) if x.dtype.kind in "fc" else F.lit(False)), bool)


def notnull(x) -> Array:
    x = isnull(x)
    return x.with_value(~x.value, bool)


def nan_to_num(x: Array, nan=0.0, posinf=None, neginf=None) -> Array:
    top = float(np.finfo(x.dtype).max) if x.dtype.kind == "f" else 0
    high, low = top if posinf is None else posinf, -top if neginf is None else neginf
    v = x.value
    return x.with_value(F.when(F.isnan(v), nan).when(v == scalar.INF, high).when(v == -scalar.INF, low).otherwise(v).cast(spark_type(x.dtype))) if x.dtype.kind == "f" else x


def real(x: Array) -> Array:
    return x.with_value(x.value["re"], np.zeros(1, x.dtype).real.dtype) if x.dtype.kind == "c" else x


def imag(x: Array) -> Array:
    return x.with_value(x.value["im"], np.zeros(1, x.dtype).real.dtype) if x.dtype.kind == "c" else x.with_value(F.lit(0).cast(spark_type(x.dtype)))


def conj(x: Array) -> Array:
    return x.with_value(scalar.complex_of(x.value["re"], -x.value["im"])) if x.dtype.kind == "c" else x


conjugate = conj


def angle(x: Array, deg: bool = False) -> Array:
    re, im = scalar.complex_parts(x.value, x.dtype)
    value = F.atan2(im, re)
    return x.with_value(F.degrees(value) if deg else value, float)


def iscomplexobj(x) -> bool:
    return np.iscomplexobj(np.zeros(1, x.dtype)) if isinstance(x, Array) else np.iscomplexobj(x)


def modf(x: Array) -> tuple[Array, Array]:
    whole = elemwise("trunc", x)
    fraction = F.when(F.abs(scalar.real(x.value)) == scalar.INF, 0.0).otherwise(scalar.real(x.value) - whole.value)
    return x.with_value(fraction, float), astype(whole, float)


def divmod(x, y) -> tuple[Array, Array]:
    return elemwise("floor_divide", x, y), elemwise("remainder", x, y)


def frexp(x: Array) -> tuple[Array, Array]:
    """Mantissa of magnitude 0.5 to 1 and binary exponent. Normal numbers; the exponent is corrected where the logarithm rounds."""
    v = scalar.real(x.value)
    usable = (v != 0) & ~F.isnan(v) & (F.abs(v) != scalar.INF)
    rough = F.floor(F.log2(F.abs(F.when(usable, v)))).cast("int") + 1
    mantissa = v / F.pow(F.lit(2.0), rough)
    low, high = F.abs(mantissa) < 0.5, F.abs(mantissa) >= 1
    exponent = rough + F.when(high, 1).when(low, -1).otherwise(0)
    return x.with_value(F.when(usable, v / F.pow(F.lit(2.0), exponent)).otherwise(v), float), x.with_value(F.coalesce(exponent, F.lit(0)).cast("int"), "int32")


def digitize(a: Array, bins, right: bool = False) -> Array:
    """Index of the bin of each value. Few edges: a binary search unrolled into conditions over one literal array."""
    edges = np.asarray(bins, float)
    rising = len(edges) < 2 or edges[0] <= edges[-1]
    up = edges if rising else edges[::-1]
    v = scalar.real(a.value)
    if len(up) == 0:
        return a.with_value(F.lit(0).cast("bigint"), "int64")
    below = (lambda k: v > float(up[k])) if right else (lambda k: v >= float(up[k]))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo).cast("bigint")
        mid = (lo + hi) // 2
        return F.when(F.isnan(v) | below(mid), search(mid + 1, hi)).otherwise(search(lo, mid))

    place = search(0, len(up))
    return a.with_value(place if rising else F.lit(len(up)).cast("bigint") - place, "int64")


def isin(element, test_elements, assume_unique=False, invert=False) -> Array:
    """Whether each value occurs among the others: a left join with their distinct values. Not-a-number equals nothing."""
    element, others = asarray(element), asarray(test_elements)
    values = others.cells().select(F.col("v").alias("_w")).distinct()
    if others.dtype.kind == "f":
        values = values.where(~F.isnan("_w"))
    if None not in others.shape_or_none and others.size <= BROADCAST_CELLS:
        values = F.broadcast(values)
    cells = element.cells()
    hit = cells.join(values, F.col("v") == F.col("_w"), "left")
    flag = F.col("_w").isNull() if invert else F.col("_w").isNotNull()
    return from_cells(hit.select(*[c for c in cells.columns if c != "v"], flag.alias("v")), element.shape_or_none, bool)


def broadcast_to(x, shape) -> Array:
    from cellgrid.sources.creation import index_frame

    x = asarray(x)
    shape = tuple(shape) if isinstance(shape, (tuple, list)) else (shape,)
    if broadcast_shapes(x.shape_or_none, shape) != tuple(shape):
        raise ValueError(f"{x.shape} does not broadcast to {shape}")
    axes = [Axis(None)] * (len(shape) - x.ndim) + list(x.axes)
    df, cells = x.df, None if None in x.shape_or_none else x.size
    for k, n in enumerate(shape):
        if axes[k].size == 1 and n != 1:
            name = fresh("b")
            df = crossed(df, cells, index_frame(active(), n).withColumnRenamed("id", name), n)
            cells = None if cells is None else cells * n
            axes[k] = Axis(name, 0, n)
    return Array(df, axes, x.value, x.dtype)


def broadcast_arrays(*arrays) -> list[Array]:
    arrays = [asarray(a) for a in arrays]
    shape = broadcast_shapes(*[a.shape_or_none for a in arrays])
    return [broadcast_to(a, shape) for a in arrays]


def frompyfunc(func: Callable, nin: int, nout: int = 1, dtype: str = "double"):
    """A Python function of scalars, run over Arrow batches."""
    if nout != 1:
        raise NotImplementedError("more than one output")
    run = F.udf(func, dtype, useArrow=True)

    def call(*args) -> Array:
        arrays = [asarray(a) for a in args]
        return combine(lambda *v: run(*v), arrays, None)

    return call


