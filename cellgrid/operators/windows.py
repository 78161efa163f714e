"""Scans and windows along an axis, without ever sorting a long axis in one task.

A finite frame works on blocks of positions: rows near a block's end are also dealt to the neighbour, the window runs within blocks, and only a block's own
rows stay. A prefix (cumulative) frame runs within blocks too and then adds what the blocks before come to. Short axes are one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, active, axis_number, fresh, spark_type
from cellgrid.functions import scalar
from cellgrid.operators.elementwise import BROADCAST_CELLS, asarray

#: Positions in a block of a long axis.
BLOCK = 1 << 18


def _keys(x: Array, k: int) -> list[str]:
    return [a.col for j, a in enumerate(x.axes) if j != k and a.col is not None]


def halo(x: Array, k: int, before: int, after: int, build, block: int | None = None):
    """Runs build(window) over each position's frame of `before` cells ahead and `after` behind; returns the frame with the columns that it names.

    The window is ordered by position within (other axes, block); `build` maps a WindowSpec to {name: Column}."""
    axis = x.axes[k]
    n = axis.size
    size = max(block or BLOCK, 4 * (before + after))
    own, to = fresh("o"), fresh("k")
    df = x.df.withColumn(own, F.call_function("div", axis.position, F.lit(size)).cast("bigint"))
    if n is None or n > size:
        targets = [F.col(own)]
        place = F.pmod(axis.position, F.lit(size))
        if before:
            targets.append(F.when(place >= size - before, F.col(own) + 1))
        if after:
            targets.append(F.when(place < after, F.col(own) - 1))
        df = df.withColumn(to, F.explode(F.array_compact(F.array(*targets))))
    else:
        df = df.withColumn(to, F.col(own))
    window = Window.partitionBy(*_keys(x, k), to).orderBy(axis.col)
    for name, column in build(window).items():
        df = df.withColumn(name, column)
    return df.where(F.col(own) == F.col(to)).drop(own, to)


def _scan(x: Array, k: int, total, merge, value: Column, dtype, block: int | None = None) -> Array:
    """A prefix aggregate: within blocks, then merged with the aggregate of the blocks before."""
    axis, block = x.axes[k], block or BLOCK
    out = fresh("s")
    keys = _keys(x, k)
    if axis.size is not None and axis.size <= block:
        window = Window.partitionBy(*keys, F.lit(0) if not keys else keys[0]).orderBy(axis.col).rowsBetween(Window.unboundedPreceding, 0)
        return Array(x.df.withColumn(out, total(value).over(window)), x.axes, F.col(out).cast(spark_type(np.dtype(dtype))), dtype)
    b = fresh("k")
    df = x.df.withColumn(b, F.call_function("div", axis.position, F.lit(block)).cast("bigint")).withColumn("_v", value)
    sums = df.groupBy(*keys, b).agg(total(F.col("_v")).alias("_t"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.withColumn("_c", total(F.col("_t")).over(before)).drop("_t")  # one row a block
    inside = Window.partitionBy(*keys, b).orderBy(axis.col).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_w", total(F.col("_v")).over(inside)).join(carries, [*keys, b])
    value = F.when(F.col("_c").isNull(), F.col("_w")).otherwise(merge(F.col("_c"), F.col("_w")))
    return Array(joined.withColumn(out, value).drop("_v", "_w", "_c", b), x.axes, F.col(out).cast(spark_type(np.dtype(dtype))), dtype)


def _flat(x, axis) -> tuple[Array, int]:
    from cellgrid.operators.shape import ravel

    x = asarray(x)
    return (ravel(x), 0) if axis is None else (x, axis_number(axis, x.ndim))


def cumsum(x, axis=None, dtype=None, method: str = "sequential") -> Array:
    x, k = _flat(x, axis)
    dtype = np.dtype(dtype) if dtype is not None else np.cumsum(np.ones(1, x.dtype)).dtype
    return _scan(x, k, F.sum, lambda a, b: a + b, x.value.cast("bigint") if x.dtype.kind == "b" else x.value, dtype)


def cumprod(x, axis=None, dtype=None, method: str = "sequential") -> Array:
    x, k = _flat(x, axis)
    dtype = np.dtype(dtype) if dtype is not None else np.cumprod(np.ones(1, x.dtype)).dtype
    return _scan(x, k, F.product, lambda a, b: a * b, scalar.real(x.value), dtype)


def nancumsum(x, axis=None, dtype=None, method: str = "sequential") -> Array:
    x = asarray(x)
    return cumsum(x.with_value(F.nanvl(x.value, F.lit(0.0))) if x.dtype.kind == "f" else x, axis, dtype)


def nancumprod(x, axis=None, dtype=None, method: str = "sequential") -> Array:
    x = asarray(x)
    return cumprod(x.with_value(F.nanvl(x.value, F.lit(1.0))) if x.dtype.kind == "f" else x, axis, dtype)


def cumreduction(func, binop, ident, x, axis=None, dtype=None, **kwargs) -> Array:
    """A scan by NumPy kernels: func (as np.cumsum) within blocks, binop with the last value of the blocks before."""
    from cellgrid.operators.blocks import block_scan

    x, k = _flat(x, axis)
    return block_scan(x, func, binop, ident, k, dtype)


def push(array, n=None, axis: int = -1) -> Array:
    """Fills values that are not a number with the last one before them, at most n positions back."""
    x = asarray(array)
    k = axis_number(axis, x.ndim)
    valid = F.when(~F.isnan(x.value), x.value)
    out = fresh("p")
    if n is not None:
        df = halo(x, k, int(n), 0, build=lambda w: {out: F.last(valid, ignorenulls=True).over(w.rowsBetween(-int(n), 0))})
        return Array(df, x.axes, F.coalesce(F.col(out), F.lit(float("nan"))), x.dtype)
    filled = _scan(x, k, lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a), valid, x.dtype) if x.axes[k].size is not None and x.axes[k].size <= BLOCK else _last_scan(x, k, valid)
    return filled.with_value(F.coalesce(filled.value, F.lit(float("nan"))))


def _last_scan(x: Array, k: int, valid: Column) -> Array:
    """The last valid value so far, as the largest (position, value) pair: an order that partial aggregates keep."""
    pair = F.when(valid.isNotNull(), F.struct(x.axes[k].position.alias("at"), valid.alias("val")))
    axis, keys, b, out = x.axes[k], _keys(x, k), fresh("k"), fresh("s")
    df = x.df.withColumn(b, F.call_function("div", axis.position, F.lit(BLOCK)).cast("bigint")).withColumn("_v", pair)
    sums = df.groupBy(*keys, b).agg(F.max("_v").alias("_t"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.withColumn("_c", F.max("_t").over(before)).drop("_t")
    inside = Window.partitionBy(*keys, b).orderBy(axis.col).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_w", F.max("_v").over(inside)).join(carries, [*keys, b])
    return Array(joined.withColumn(out, F.coalesce(F.col("_w"), F.col("_c"))["val"]).drop("_v", "_w", "_c", b), x.axes, F.col(out), x.dtype)


def _shifted(x: Array, k: int, steps) -> tuple:
    """The frame with columns of the values at the given distances (negative: before)."""
    names = {s: fresh("d") for s in steps}
    value = x.value
    df = halo(x, k, max([0, *[-s for s in steps]]), max([0, *steps]), build=lambda w: {names[s]: (F.lag(value, -s) if s < 0 else F.lead(value, s)).over(w) for s in steps if s})
    return df, {s: (F.col(names[s]) if s else value) for s in steps}


def diff(a, n: int = 1, axis: int = -1, prepend=None, append=None) -> Array:
    """n-th differences from one window: the values at 0..n positions back, with binomial weights."""
    from math import comb

    from cellgrid.operators.combine import concatenate

    a = asarray(a)
    k = axis_number(axis, a.ndim)
    parts = []
    for extra in (prepend, append):
        if extra is not None and np.isscalar(extra):
            from cellgrid.sources.creation import full

            extra = full([1 if j == k else m for j, m in enumerate(a.shape_or_none)], extra)
        parts.append(extra)
    if prepend is not None or append is not None:
        a = concatenate([p for p in (parts[0], a, parts[1]) if p is not None], k)
    if n == 0:
        return a
    axis = a.axes[k]
    df, at = _shifted(a, k, range(-n, 1))
    if a.dtype.kind == "b":
        value = at[-1] != at[0]
    else:
        value = at[0]
        for j in range(1, n + 1):
            value = value + at[-j] * (comb(n, j) * (-1) ** j)
    out = Array(df.where(axis.position >= n), a.axes, value, a.dtype)
    axes = list(out.axes)
    axes[k] = Axis(axis.col, axis.offset + n, None if axis.size is None else max(0, axis.size - n))
    return out.with_axes(axes)


def ediff1d(ary, to_end=None, to_begin=None) -> Array:
    from cellgrid.operators.combine import concatenate
    from cellgrid.operators.shape import ravel

    d = diff(ravel(asarray(ary)))
    ends = [asarray(np.ravel(e)) if e is not None else None for e in (to_begin, to_end)]
    return concatenate([p for p in (ends[0], d, ends[1]) if p is not None]) if to_end is not None or to_begin is not None else d


def gradient(f, *varargs, axis=None, edge_order: int = 1):
    """Central differences, one-sided at the ends; spacing by a scalar or by coordinates, one for all axes or one for each."""
    f = asarray(f)
    axes = [axis_number(k, f.ndim) for k in (range(f.ndim) if axis is None else (axis if isinstance(axis, (tuple, list)) else [axis]))]
    spacing = list(varargs) * len(axes) if len(varargs) == 1 else list(varargs) or [1.0] * len(axes)
    out = [_gradient(f, k, h, edge_order) for k, h in zip(axes, spacing, strict=True)]
    return out[0] if len(out) == 1 else out


def _gradient(f: Array, k: int, h, edge_order: int) -> Array:
    n, position = f.axes[k].size, f.axes[k].position
    if n < edge_order + 1:
        raise ValueError("too few cells for the gradient")
    df, at = _shifted(f, k, range(-edge_order, edge_order + 1))
    v = {s: scalar.real(c) for s, c in at.items()}
    if np.ndim(h) == 0:
        h = float(h)
        inner = (v[1] - v[-1]) / (2 * h)
        if edge_order == 1:
            first, last = (v[1] - v[0]) / h, (v[0] - v[-1]) / h
        else:
            first, last = (-1.5 * v[0] + 2 * v[1] - 0.5 * v[2]) / h, (1.5 * v[0] - 2 * v[-1] + 0.5 * v[-2]) / h
    else:
        # each position's distances to its neighbours, by a join
        x = np.asarray(h, float)
        place, left, right = fresh("p"), fresh("l"), fresh("r")
        steps = np.diff(x)
        rows = pa.table({place: pa.array(np.arange(n)), left: pa.array(np.r_[np.nan, steps]), right: pa.array(np.r_[steps, np.nan])})
        spaces = active().createDataFrame(rows)
        df = df.join(F.broadcast(spaces) if n <= BROADCAST_CELLS else spaces, position == F.col(place)).drop(place)
        left, right = F.col(left), F.col(right)
        inner = (v[1] * left * left - v[-1] * right * right + v[0] * (right * right - left * left)) / (left * right * (left + right))
        first, last = (v[1] - v[0]) / right, (v[0] - v[-1]) / left
        if edge_order == 2:
            # slopes at the ends of the parabolas through the first and the last three cells
            p, q = float(steps[0]), float(steps[1])
            first = v[0] * (-(2 * p + q) / (p * (p + q))) + v[1] * ((p + q) / (p * q)) - v[2] * (p / (q * (p + q)))
            p, q = float(steps[-1]), float(steps[-2])
            last = v[0] * ((2 * p + q) / (p * (p + q))) - v[-1] * ((p + q) / (p * q)) + v[-2] * (p / (q * (p + q)))
    value = F.when(position == 0, first).when(position == n - 1, last).otherwise(inner)
    return Array(df, f.axes, value, float)


def sliding_window_view(x, window_shape, axis=None, automatic_rechunk: bool = True) -> Array:
    """Windows as new last axes: each cell is dealt to every window that holds it. Reductions over it are better written with sliding()."""
    x = asarray(x)
    window = (window_shape,) if np.isscalar(window_shape) else tuple(window_shape)
    axes = tuple(range(x.ndim)) if axis is None else tuple(axis_number(a, x.ndim) for a in ((axis,) if np.isscalar(axis) else axis))
    df, out, extra = x.df, list(x.axes), []
    for k, w in zip(axes, window, strict=True):
        n = out[k].size
        if w > n:
            raise ValueError("the window is longer than the axis")
        inner, start = fresh("w"), fresh()
        position = out[k].position
        df = df.withColumn(inner, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(w - 1).cast("bigint"))))
        df = df.withColumn(start, (position - F.col(inner)).cast("bigint")).where((F.col(start) >= 0) & (F.col(start) <= n - w))
        out[k] = Axis(start, 0, n - w + 1)
        extra.append(Axis(inner, 0, w))
    return Array(df, [*out, *extra], x.value, x.dtype)


def _window_value(name: str, v: Column, dtype: np.dtype, ddof: int = 0):
    nan = F.isnan(v) if dtype.kind == "f" else F.lit(False)
    v = v.cast("bigint") if dtype.kind == "b" else v
    ok = F.when(~nan, v)
    skip = name.startswith("nan") or name.startswith("move_")
    base = name.removeprefix("nan").removeprefix("move_")
    use = ok if skip else v

    def spread(w):
        n = F.count(use).over(w)
        return F.var_pop(use).over(w) * n / F.when(n > ddof, n - ddof)

    table = {
        "sum": lambda w: F.coalesce(F.sum(use).over(w), F.lit(0)),
        "mean": lambda w: F.avg(use).over(w),
        "min": lambda w: F.min(use).over(w),
        "max": lambda w: F.max(use).over(w),
        "prod": lambda w: F.coalesce(F.product(use).over(w), F.lit(1.0)),
        "var": spread,
        "std": lambda w: F.sqrt(spread(w)),
        "median": lambda w: F.median(use).over(w),
        "any": lambda w: F.bool_or(scalar.truthy(v, dtype)).over(w),
        "all": lambda w: F.bool_and(scalar.truthy(v, dtype)).over(w),
        "count": lambda w: F.count(ok).over(w),
    }
    value = table[base]
    if skip or dtype.kind != "f" or base in ("any", "all", "count"):
        return value
    return lambda w: F.when(F.max(F.when(nan, 1).otherwise(0)).over(w) == 1, float("nan")).otherwise(value(w))


def sliding(x, window: int, reduction="mean", axis: int = -1, ddof: int = 0):
    """What `reduction` gives over each full window, as sliding_window_view(x, window, axis) reduced along its last axis, from one window function.

    A list of reductions gives a list of arrays over one frame, from one pass."""
    x = asarray(x)
    k = axis_number(axis, x.ndim)
    names = [reduction] if isinstance(reduction, str) else list(reduction)
    columns = [fresh("m") for _ in names]
    parts = [_window_value(name, x.value, x.dtype, ddof) for name in names]
    df = halo(x, k, 0, window - 1, build=lambda w: {c: part(w.rowsBetween(0, window - 1)) for c, part in zip(columns, parts, strict=True)})
    n = x.axes[k].size - window + 1
    axes = list(x.axes)
    axes[k] = Axis(axes[k].col, axes[k].offset, n)
    df, out = df.where(x.axes[k].position < n), []
    for name, column in zip(names, columns, strict=True):
        dtype = {"any": bool, "all": bool, "count": "int64"}.get(name) or (x.dtype if name.endswith(("min", "max")) else _sum_like(x, name))
        out.append(Array(df, axes, F.col(column).cast(spark_type(np.dtype(dtype))), dtype))
    return out[0] if isinstance(reduction, str) else out


def _sum_like(x: Array, reduction: str):
    return np.sum(np.ones(1, x.dtype)).dtype if reduction.endswith(("sum", "prod")) else np.dtype(float)


def moving(x, window: int, reduction: str = "mean", min_count: int | None = None, axis: int = -1, ddof: int = 0) -> Array:
    """Trailing windows (the cell and window - 1 before it), skipping values that are not a number; cells with fewer than min_count values are not a number."""
    x = asarray(x)
    k = axis_number(axis, x.ndim)
    out, count = fresh("m"), fresh("n")
    value = _window_value("move_" + reduction, x.value, x.dtype, ddof)
    counted = _window_value("count", x.value, x.dtype)
    frame = lambda w: w.rowsBetween(-(window - 1), 0)
    df = halo(x, k, window - 1, 0, build=lambda w: {out: value(frame(w)), count: counted(frame(w))})
    least = window if min_count is None else min_count
    result = F.when(F.col(count) >= least, F.col(out).cast("double"))
    return Array(df, x.axes, F.coalesce(result, F.lit(float("nan"))), float)


def stencil(x, weights: dict[int, float], axis: int = -1, boundary="reflect") -> Array:
    """A weighted sum of neighbours along an axis; past the ends: the mirrored cell, the edge cell, or a constant."""
    x = asarray(x)
    k = axis_number(axis, x.ndim)
    before, after = max([0, *[-s for s in weights]]), max([0, *weights])
    from cellgrid.operators.shape import pad

    widths = [(before, after) if j == k else (0, 0) for j in range(x.ndim)]
    mode = {"reflect": "symmetric", "nearest": "edge", "periodic": "wrap"}.get(boundary, "constant")
    padded = pad(x, widths, mode, constant_values=boundary if mode == "constant" and boundary != "none" else 0)
    df, at = _shifted(padded, k, sorted({0, *weights}))
    value = F.lit(0.0)
    for s, w in weights.items():
        value = value + scalar.real(at[s]) * float(w)
    out = Array(df, padded.axes, value, float)
    n = x.axes[k].size
    return out[(slice(None),) * k + (slice(before, before + n),)]


