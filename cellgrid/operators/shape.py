"""Shape: index arithmetic and column renames; no row moves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, axis_number, axis_numbers, fresh, literal, strides
from cellgrid.operators.elementwise import asarray


def _mapped(x: Array, k: int, position, size) -> Array:
    """x with the positions of axis k replaced by an expression."""
    name = fresh()
    axes = list(x.axes)
    axes[k] = Axis(name, 0, size)
    return Array(x.df.withColumn(name, position), axes, x.value, x.dtype)


def transpose(a: Array, axes=None) -> Array:
    axes = range(a.ndim)[::-1] if axes is None else [axis_number(k, a.ndim) for k in axes]
    if sorted(axes) != list(range(a.ndim)):
        raise ValueError("axes do not match the array")
    return a.with_axes([a.axes[k] for k in axes])


def swapaxes(a: Array, axis1: int, axis2: int) -> Array:
    order = list(range(a.ndim))
    order[axis1], order[axis2] = order[axis2], order[axis1]
    return transpose(a, order)


def moveaxis(a: Array, source, destination) -> Array:
    source, destination = axis_numbers(source, a.ndim), axis_numbers(destination, a.ndim)
    order = [k for k in range(a.ndim) if k not in source]
    for d, s in sorted(zip(destination, source, strict=True)):
        order.insert(d, s)
    return transpose(a, order)


def rollaxis(a: Array, axis: int, start: int = 0) -> Array:
    axis, start = axis_number(axis, a.ndim), start + a.ndim if start < 0 else start
    order = [k for k in range(a.ndim) if k != axis]
    order.insert(start - (axis < start), axis)
    return transpose(a, order)


def expand_dims(a: Array, axis) -> Array:
    axis = (axis,) if np.isscalar(axis) else tuple(axis)
    ndim = a.ndim + len(axis)
    new = {axis_number(k, ndim) for k in axis}
    rest = iter(a.axes)
    return a.with_axes([Axis(None) if k in new else next(rest) for k in range(ndim)])


def squeeze(a: Array, axis=None) -> Array:
    drop = [k for k, x in enumerate(a.axes) if x.size == 1] if axis is None else axis_numbers(axis, a.ndim)
    if any(a.axes[k].size != 1 for k in drop):
        raise ValueError("only axes of one cell can be squeezed")
    return a.with_axes([x for k, x in enumerate(a.axes) if k not in drop])


def atleast_1d(*arrays):
    return _each(arrays, lambda a: a if a.ndim else expand_dims(a, 0))


def atleast_2d(*arrays):
    return _each(arrays, lambda a: a if a.ndim > 1 else expand_dims(atleast_1d(a), 0))


def atleast_3d(*arrays):
    return _each(arrays, lambda a: a if a.ndim > 2 else expand_dims(atleast_2d(a), 2) if a.ndim != 1 else expand_dims(a, (0, 2)))


def _each(arrays, f):
    out = [f(asarray(a)) for a in arrays]
    return out[0] if len(out) == 1 else out


def flip(m: Array, axis=None) -> Array:
    for k in axis_numbers(axis, m.ndim):
        m = _mapped(m, k, F.lit(m.axes[k].size - 1).cast("bigint") - m.axes[k].position, m.axes[k].size)
    return m


def flipud(m: Array) -> Array:
    return flip(m, 0)


def fliplr(m: Array) -> Array:
    return flip(m, 1)


def rot90(m: Array, k: int = 1, axes=(0, 1)) -> Array:
    a, b = (axis_number(x, m.ndim) for x in axes)
    k %= 4
    if k == 0:
        return m
    if k == 2:
        return flip(flip(m, a), b)
    order = list(range(m.ndim))
    order[a], order[b] = order[b], order[a]
    return transpose(flip(m, b), order) if k == 1 else flip(transpose(m, order), b)


def roll(x: Array, shift, axis=None) -> Array:
    if axis is None:
        return reshape(roll(ravel(x), shift, 0), x.shape)
    shift = (shift,) if np.isscalar(shift) else tuple(shift)
    axes = axis_numbers(axis, x.ndim)
    for s, k in zip(shift if len(shift) == len(axes) else shift * len(axes), axes, strict=True):
        n = x.axes[k].size
        x = _mapped(x, k, F.pmod(x.axes[k].position + int(s) % max(n, 1), F.lit(n)).cast("bigint"), n)
    return x


def ravel(x) -> Array:
    x = asarray(x)
    return x if x.ndim == 1 else reshape(x, (-1,))


flatten = ravel


def flat_position(x: Array):
    out = F.lit(0).cast("bigint")
    for a, s in zip(x.axes, strides(x.shape_or_none), strict=True):
        out = out + a.position * F.lit(s).cast("bigint")
    return out


def reshape(x: Array, *shape) -> Array:
    shape = list(shape[0]) if len(shape) == 1 and not np.isscalar(shape[0]) else list(shape)
    if -1 in shape:
        rest = -math.prod(shape)
        shape[shape.index(-1)] = x.size // rest if rest else 0
    if math.prod(shape) != x.size:
        raise ValueError(f"{x.shape} does not reshape to {tuple(shape)}")
    flat = fresh("f")
    df = x.df.withColumn(flat, flat_position(x))
    names = [fresh() for _ in shape]
    for name, n, s in zip(names, shape, strides(shape), strict=True):
        df = df.withColumn(name, F.expr(f"({flat} div {s}) % {n}") if n > 1 else F.lit(0).cast("bigint"))
    return Array(df, [Axis(a, 0, n) for a, n in zip(names, shape, strict=True)], x.value, x.dtype)


def reshape_blockwise(x: Array, shape, chunks=None) -> Array:
    """Reshape in block order: cells are numbered block by block, C order within each."""
    from cellgrid.operators.blocks import block_order

    shape = tuple(shape)
    flat = block_order(x)
    return reshape(Array(flat.df, flat.axes, flat.value, x.dtype), shape)


def tril(m: Array, k: int = 0) -> Array:
    return _triangle(m, m.axes[-1].position <= m.axes[-2].position + k)


def triu(m: Array, k: int = 0) -> Array:
    return _triangle(m, m.axes[-1].position >= m.axes[-2].position + k)


def _triangle(m: Array, keep) -> Array:
    return m.with_value(F.when(keep, m.value).otherwise(literal(0, m.dtype)))


def tril_indices(n: int, k: int = 0, m: int | None = None) -> tuple[Array, Array]:
    return _triangle_indices(n, n if m is None else m, lambda i, j: j <= i + k)


def triu_indices(n: int, k: int = 0, m: int | None = None) -> tuple[Array, Array]:
    return _triangle_indices(n, n if m is None else m, lambda i, j: j >= i + k)


def tril_indices_from(arr: Array, k: int = 0):
    return tril_indices(arr.shape[-2], k, arr.shape[-1])


def triu_indices_from(arr: Array, k: int = 0):
    return triu_indices(arr.shape[-2], k, arr.shape[-1])


def _triangle_indices(n, m, keep):
    from cellgrid.operators.indexing import nonzero
    from cellgrid.sources.creation import grid

    x = grid((n, m))
    return nonzero(x.with_value(keep(F.col("i0"), F.col("i1")), bool))


def repeat(a: Array, repeats: int, axis=None) -> Array:
    if axis is None:
        a, axis = ravel(a), 0
    k, r = axis_number(axis, a.ndim), int(repeats)
    copy = fresh("c")
    df = a.df.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(r - 1).cast("bigint")))) if r else a.df.limit(0).withColumn(copy, F.lit(0).cast("bigint"))
    y = Array(df, a.axes, a.value, a.dtype)
    return _mapped(y, k, a.axes[k].position * r + F.col(copy), a.axes[k].size * r)


def tile(A, reps) -> Array:
    A = asarray(A)
    reps = (reps,) if np.isscalar(reps) else tuple(reps)
    while A.ndim < len(reps):
        A = expand_dims(A, 0)
    reps = (1,) * (A.ndim - len(reps)) + reps
    for k, r in enumerate(reps):
        if r == 1:
            continue
        copy, n = fresh("c"), A.axes[k].size
        df = A.df.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(r - 1).cast("bigint")))) if r else A.df.limit(0).withColumn(copy, F.lit(0).cast("bigint"))
        A = _mapped(Array(df, A.axes, A.value, A.dtype), k, A.axes[k].position + F.col(copy) * n, n * r)
    return A


def unravel_index(indices, shape, order: str = "C") -> Array:
    from cellgrid.operators.combine import stack

    x = asarray(indices)
    shape = tuple(shape) if not np.isscalar(shape) else (shape,)
    steps = strides(shape) if order == "C" else strides(shape[::-1])[::-1]
    return stack([x.with_value((F.floor(x.value / s) % n).cast("bigint"), "int64") for s, n in zip(steps, shape, strict=True)])


def ravel_multi_index(multi_index, dims, mode: str = "raise", order: str = "C") -> Array:
    from cellgrid.operators.elementwise import combine

    parts = [asarray(x) for x in multi_index] if not isinstance(multi_index, Array) else [multi_index[k] for k in range(len(dims))]
    steps = strides(dims) if order == "C" else strides(tuple(dims)[::-1])[::-1]

    def one(v, n):
        if mode == "wrap":
            return F.pmod(v, F.lit(n))
        return F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)) if mode == "clip" else F.when((v < 0) | (v >= n), F.raise_error(F.lit("invalid index"))).otherwise(v)

    return combine(lambda *vs: sum((one(v, n) * s for v, n, s in zip(vs, dims, steps, strict=True)), F.lit(0)).cast("bigint"), parts, "int64")


def pad(array: Array, pad_width, mode="constant", **kwargs) -> Array:
    """All of NumPy's modes; axes are padded one after another, so corners follow from earlier axes."""
    widths = np.broadcast_to(np.asarray(pad_width, int), (array.ndim, 2)).tolist()
    extra = lambda name: np.broadcast_to(np.asarray(kwargs.get(name, 0), object), (array.ndim, 2)).tolist()
    values = extra("constant_values" if mode == "constant" else "end_values")
    for k, (before, after) in enumerate(widths):
        if before or after:
            array = _pad_axis(array, k, before, after, mode, values[k], kwargs)
    return array


def _pad_axis(x: Array, k: int, before: int, after: int, mode, values, kwargs) -> Array:
    from cellgrid.operators import reductions as r
    from cellgrid.operators.combine import concatenate
    from cellgrid.operators.elementwise import astype, broadcast_to
    from cellgrid.operators.indexing import take_positions
    from cellgrid.sources.creation import arange

    n = x.axes[k].size
    if mode in ("edge", "wrap", "reflect", "symmetric"):
        at = F.col("id") - before
        if mode == "edge":
            source = F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))
        elif mode == "wrap":
            source = F.pmod(at, F.lit(n))
        elif mode == "reflect":
            source = F.lit(n - 1) - F.abs(F.lit(n - 1) - F.pmod(at, F.lit(max(1, 2 * (n - 1))))) if n > 1 else F.lit(0)
        else:
            m = F.pmod(at, F.lit(2 * n))
            source = F.when(m < n, m).otherwise(2 * n - 1 - m)
        if mode in ("reflect", "symmetric") and kwargs.get("reflect_type", "even") == "odd":
            return _pad_odd(x, k, before, after, 1 if mode == "reflect" else 0)
        return take_positions(x, arange(n + before + after).with_value(source.cast("bigint"), "int64"), k)

    def filler(width: int, value) -> Array:
        shape = [width if j == k else m for j, m in enumerate(x.shape_or_none)]
        if isinstance(value, Array):
            return astype(broadcast_to(value, shape), x.dtype)
        from cellgrid.sources.creation import full

        return full(shape, value, x.dtype)

    if mode in ("constant", "empty"):
        sides = values if mode == "constant" else (0, 0)
    elif mode in ("maximum", "minimum", "mean", "median"):
        if kwargs.get("stat_length") is not None:
            lengths = np.broadcast_to(np.asarray(kwargs["stat_length"], int), (x.ndim, 2)).tolist()[k]
            parts = [x[(slice(None),) * k + (s,)] for s in (slice(0, lengths[0]), slice(max(0, n - lengths[1]), n))]
        else:
            parts = [x, x]
        f = {"maximum": r.max, "minimum": r.min, "mean": r.mean, "median": r.median}[mode]
        sides = [f(p, axis=k, keepdims=True) for p in parts]
        if x.dtype.kind in "iu" and mode in ("mean", "median"):
            from cellgrid.operators.elementwise import round as round_

            sides = [round_(s) for s in sides]
    elif mode == "linear_ramp":
        edges = [x[(slice(None),) * k + (s,)] for s in (slice(0, 1), slice(n - 1, n))]
        ramps = []
        for side, (edge, width, end) in enumerate(zip(edges, (before, after), values, strict=True)):
            whole = broadcast_to(edge, [width if j == k else m for j, m in enumerate(x.shape_or_none)]) if width else None
            if whole is not None:
                place = whole.axes[k].position
                share = (F.lit(float(width)) - place) / width if side == 0 else (place + 1.0) / width
                # rising from the end value to the edge before, and back after
                ramp = F.lit(float(end)) * share + whole.value.cast("double") * (1 - share)
                ramps.append(astype(whole.with_value(ramp, float), x.dtype))
            else:
                ramps.append(None)
        return concatenate([p for p in (ramps[0], x, ramps[1]) if p is not None], k)
    elif callable(mode):
        from cellgrid.operators.blocks import along

        padded = _pad_axis(x, k, before, after, "constant", (0, 0), {})
        return along(padded, k, _Filler(mode, (before, after), k, kwargs), (n + before + after,), x.dtype)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    parts = [filler(before, sides[0])] if before else []
    return concatenate([*parts, x, *([filler(after, sides[1])] if after else [])], k)


class _Filler:
    """A user's function of a padded vector, its widths, the axis and further arguments; it changes the vector in place."""

    def __init__(self, function, widths, axis, kwargs):
        self.function, self.widths, self.axis, self.kwargs = function, widths, axis, kwargs

    def __call__(self, vector):
        vector = vector.copy()
        out = self.function(vector, self.widths, self.axis, self.kwargs)
        return vector if out is None else out


def _pad_odd(x: Array, k: int, before: int, after: int, skip: int) -> Array:
    """Mirrored cells, also mirrored in value at the edge cell. Widths up to what one mirror holds."""
    from cellgrid.operators.combine import concatenate

    n = x.axes[k].size
    if max(before, after) > n - skip:
        raise ValueError("the width is larger than one mirror of the axis")
    part = lambda s: x[(slice(None),) * k + (s,)]
    sides = []
    if before:
        sides.append(2 * part(slice(0, 1)) - part(slice(skip, skip + before)).settled()[(slice(None),) * k + (slice(None, None, -1),)])
    sides.append(x)
    if after:
        sides.append(2 * part(slice(n - 1, n)) - part(slice(n - skip - after, n - skip)).settled()[(slice(None),) * k + (slice(None, None, -1),)])
    return concatenate(sides, k)
