"""Indexing and assignment. Slices become filters on the stored index columns; integer arrays become joins with a position frame; masks become filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, active, axis_number, fresh, spark_type
from cellgrid.functions import scalar
from cellgrid.operators.elementwise import BROADCAST_CELLS, asarray, combine, literal

#: Rows that a dense renumbering counts in one group.
RENUMBER_BLOCK = 1 << 20


def getitem(x: Array, index) -> Array:
    index = list(index) if isinstance(index, tuple) else [index]
    if x.dtype.kind == "O" and len(index) == 1 and isinstance(index[0], str):
        return x.with_value(x.value[index[0]], None)
    masks = [i for i in index if isinstance(i, Array) and i.dtype.kind == "b" or isinstance(i, np.ndarray) and i.dtype.kind == "b"]
    if len(masks) == 1 and len(index) == 1 and masks[0].ndim > 1:
        return masked(x, asarray(masks[0]))
    used = sum(i is not None and i is not Ellipsis for i in index)
    if used > x.ndim:
        raise IndexError("too many indices")
    if not any(i is Ellipsis for i in index):
        index.append(Ellipsis)
    at = next(k for k, i in enumerate(index) if i is Ellipsis)
    index[at : at + 1] = [slice(None)] * (x.ndim - used)
    arrays = [i for i in index if isinstance(i, (list, np.ndarray, Array)) and not np.isscalar(i)]
    if len([a for a in arrays if not isinstance(a, Array) or a.ndim]) > 1:
        raise NotImplementedError("more than one integer array: use vindex")
    out, k = x, 0
    for i in index:
        if i is None:
            from cellgrid.operators.shape import expand_dims

            out = expand_dims(out, k)
            k += 1
        elif isinstance(i, slice):
            out = sliced(out, k, i)
            k += 1
        elif isinstance(i, (int, np.integer)):
            out = picked(out, k, int(i))
        else:
            i = asarray(i)
            out = compress(i, out, k) if i.dtype.kind == "b" else take_positions(out, i, k)
            k += 1
    return out


def sliced(x: Array, k: int, s: slice) -> Array:
    axis = x.axes[k]
    if s == slice(None):
        return x
    if axis.size is None:
        if (s.start or 0) < 0 or (s.stop is not None and s.stop < 0) or (s.step or 1) < 1:
            raise ValueError("the length is unknown; call compute_chunk_sizes()")
        start, stop, step, size = s.start or 0, s.stop, s.step or 1, None
    else:
        start, stop, step = s.indices(axis.size)
        size = len(range(start, stop, step))
    if getattr(x, "k", None) == k and size and x.ends is not None:
        lo, hi = (start, stop) if step > 0 else (start + (size - 1) * step, start + 1)
        part, first = x.pruned(lo, hi)
        if part is not x:
            return sliced(part, k, slice(start - first, None if step < 0 and stop < first else stop - first, step))
    axes = list(x.axes)
    if axis.col is None:
        axes[k] = Axis(None, 0, size)
        return x.with_axes(axes) if size else x.with_axes(axes, x.df.limit(0))
    raw = F.col(axis.col)
    lo, hi = (start, stop) if step > 0 else (start + (size - 1) * step, start + 1) if size else (0, 0)
    df = x.df
    if size == 0:
        df = df.where(F.lit(False))
    else:
        if lo > 0:
            df = df.where(raw >= axis.offset + lo)  # on the stored column: it reaches the scan
        if hi is not None and (axis.size is None or hi < axis.size):
            df = df.where(raw < axis.offset + hi)
    if step == 1:
        axes[k] = Axis(axis.col, axis.offset + start, size)
        return x.with_axes(axes, df)
    name = fresh()
    away = (axis.position - start) if step > 0 else (F.lit(start) - axis.position)
    df = df.where(F.pmod(away, F.lit(abs(step))) == 0).withColumn(name, F.call_function("div", away, F.lit(abs(step))).cast("bigint"))
    axes[k] = Axis(name, 0, size)
    return x.with_axes(axes, df)


def picked(x: Array, k: int, i: int) -> Array:
    axis = x.axes[k]
    if axis.size is not None and not -axis.size <= i < axis.size:
        raise IndexError(f"index {i} is out of bounds for axis {k} with size {axis.size}")
    i += axis.size if i < 0 else 0
    df = x.df if axis.col is None else x.df.where(F.col(axis.col) == axis.offset + i)
    return x.with_axes([a for j, a in enumerate(x.axes) if j != k], df)


def take_positions(x: Array, positions: Array, k: int) -> Array:
    """Positions (negative ones count from the end) along an axis: a join with the position frame, which keeps order and repeats."""
    axis, n = x.axes[k], x.axes[k].size
    place, want = fresh(), fresh("p")
    value = positions.value
    wanted = positions.df.select(positions.axes[0].position.alias(place), (F.when(value < 0, value + n).otherwise(value) if n is not None else value).cast("bigint").alias(want))
    if positions.size <= BROADCAST_CELLS:
        wanted = F.broadcast(wanted)
    df = x.df.join(wanted, axis.position == F.col(want)).drop(want)
    axes = list(x.axes)
    axes[k] = Axis(place, 0, positions.shape_or_none[0])
    return x.with_axes(axes, df)


def take(a: Array, indices, axis: int = 0) -> Array:
    a = asarray(a)
    if np.isscalar(indices):
        return picked(a, axis_number(axis, a.ndim), int(indices))
    indices = asarray(indices)
    k = axis_number(axis, a.ndim)
    if indices.ndim == 1:
        return take_positions(a, indices, k)
    from cellgrid.operators.shape import ravel, reshape

    out = take_positions(a, ravel(indices), k)
    return reshape(out, (*a.shape[:k], *indices.shape, *a.shape[k + 1 :]))


def vindex(x: Array, *positions) -> Array:
    """Points by one integer array an axis, broadcast together; slices keep their axis. The points' axes come first."""
    from cellgrid.operators.elementwise import align

    positions = list(positions) + [slice(None)] * (x.ndim - len(positions))
    at = [k for k, p in enumerate(positions) if not isinstance(p, slice)]
    frame, values = align([asarray(np.asarray(positions[k])) if not isinstance(positions[k], Array) else positions[k] for k in at])
    names = [fresh("p") for _ in at]
    places = [fresh() for _ in frame.axes]
    wanted = frame.df.select(*[a.position.alias(n) for a, n in zip(frame.axes, places, strict=True)], *[F.when(v < 0, v + x.axes[k].size).otherwise(v).cast("bigint").alias(n) for v, k, n in zip(values, at, names, strict=True)])
    condition = [x.axes[k].position == F.col(n) for k, n in zip(at, names, strict=True)]
    df = x.df.join(F.broadcast(wanted) if frame.size <= BROADCAST_CELLS else wanted, condition)
    axes = [Axis(n, 0, a.size) for n, a in zip(places, frame.axes, strict=True)] + [a for k, a in enumerate(x.axes) if k not in at]
    out = x.with_axes(axes, df)
    for k, p in enumerate([p for p in positions if isinstance(p, slice)]):
        out = sliced(out, len(places) + k, p)
    return out


class VIndex:
    def __init__(self, x: Array):
        self.x = x

    def __getitem__(self, key) -> Array:
        return vindex(self.x, *(key if isinstance(key, tuple) else (key,)))


def renumber(df, old: str, new: str):
    """Gives the rows' distinct values of `old` dense numbers in their order: places within blocks of values, plus the counts of the blocks before."""
    block = fresh("k")
    values = df.select(old).distinct().withColumn(block, F.floor(F.col(old) / RENUMBER_BLOCK))
    counts = values.groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(block, (F.sum("n").over(Window.orderBy(block)) - F.col("n")).alias("b"))
    within = Window.partitionBy(block).orderBy(old)
    numbered = values.withColumn("w", F.row_number().over(within) - 1).join(before, block).select(old, (F.col("w") + F.col("b")).cast("bigint").alias(new))
    return df.join(numbered, old)


def masked(x: Array, mask: Array) -> Array:
    """The cells where a mask of the same shape holds, in C order; the length is unknown until counted."""
    from cellgrid.operators.elementwise import align
    from cellgrid.operators.shape import flat_position

    frame, (value, keep) = align([x, mask])
    frame = Array(frame.df, [Axis(a.col, a.offset, n) for a, n in zip(frame.axes, x.shape_or_none, strict=True)], value, x.dtype)
    flat, new, v = fresh("f"), fresh(), fresh("v")
    df = frame.df.where(scalar.truthy(keep, mask.dtype)).select(flat_position(frame).alias(flat), value.alias(v))
    return Array(renumber(df, flat, new), [Axis(new, 0, None)], F.col(v), x.dtype)


def extract(condition, arr) -> Array:
    from cellgrid.operators.shape import ravel

    return masked(ravel(asarray(arr)), astype_bool(ravel(asarray(condition))))


def astype_bool(x: Array) -> Array:
    return x.with_value(scalar.truthy(x.value, x.dtype), bool)


def compress(condition, a: Array, axis=None) -> Array:
    """Positions of an axis where the condition holds; a condition shorter than the axis is false beyond its end."""
    condition = astype_bool(asarray(condition))
    if axis is None:
        return extract(condition, a)
    k = axis_number(axis, a.ndim)
    keep = condition.df.where(condition.value).select(condition.axes[0].position.alias("_at"))
    name = fresh()
    keep = renumber(keep, "_at", name)
    if condition.shape_or_none[0] is not None and condition.size <= BROADCAST_CELLS:
        keep = F.broadcast(keep)
    df = a.df.join(keep, a.axes[k].position == F.col("_at")).drop("_at")
    axes = list(a.axes)
    axes[k] = Axis(name, 0, None)
    return a.with_axes(axes, df)


def nonzero(a) -> tuple[Array, ...]:
    """For each axis the positions of non-zero cells, in C order."""
    a = asarray(a)
    places = [masked(a.with_value(x.position, "int64"), astype_bool(a)) for x in a.axes]
    return tuple(places)


def argwhere(a) -> Array:
    from cellgrid.operators.combine import stack

    return stack(list(nonzero(a)), 1)


def flatnonzero(a) -> Array:
    from cellgrid.operators.shape import ravel

    return nonzero(ravel(asarray(a)))[0]


def setitem(x: Array, key, value) -> Array:
    """A new array with the region replaced: a condition for slices and masks over the same frame, else a left join with the patch."""
    if isinstance(key, Array) and key.dtype.kind == "b":
        value = value if isinstance(value, Array) else literal(value, np.asarray(value).dtype)
        if isinstance(value, Array):
            return combine(lambda v, m, w: F.when(m, w.cast(spark_type(x.dtype))).otherwise(v), [x, key, value], x.dtype)
        return combine(lambda v, m: F.when(m, value.cast(spark_type(x.dtype))).otherwise(v), [x, key], x.dtype)
    key = list(key) if isinstance(key, tuple) else [key]
    if Ellipsis in [k for k in key if k is Ellipsis]:
        at = next(i for i, k in enumerate(key) if k is Ellipsis)
        key[at : at + 1] = [slice(None)] * (x.ndim - len(key) + 1)
    key += [slice(None)] * (x.ndim - len(key))
    inside: Column = F.lit(True)
    sources, kept = [], []
    for k, (i, axis) in enumerate(zip(key, x.axes, strict=True)):
        if isinstance(i, slice):
            start, stop, step = i.indices(axis.size)
            n = len(range(start, stop, step))
            lo, hi = (start, start + (n - 1) * step) if step > 0 else (start + (n - 1) * step, start)
            inside = inside & (F.lit(n > 0) & (axis.position >= lo) & (axis.position <= hi) & (F.pmod(axis.position - start, F.lit(abs(step))) == 0))
            sources.append((F.call_function("div", axis.position - start, F.lit(step))).cast("bigint"))
            kept.append((k, n))
        elif isinstance(i, (int, np.integer)):
            inside = inside & (axis.position == int(i) % axis.size)
        else:
            places = np.asarray(i)
            places = np.flatnonzero(places) if places.dtype == bool else places % axis.size
            last = {int(p): j for j, p in enumerate(places)}
            at, number = fresh("g"), fresh("j")
            listed = active().createDataFrame(list(last.items()), f"{at} bigint, {number} bigint")
            df = x.df.join(F.broadcast(listed) if len(last) <= BROADCAST_CELLS else listed, axis.position == F.col(at), "left").drop(at)
            x = x.with_axes(x.axes, df)
            inside = inside & F.col(number).isNotNull()
            sources.append(F.col(number))
            kept.append((k, len(places)))
    if not isinstance(value, (Array, np.ndarray, list)):
        return x.with_value(F.when(inside, literal(value, np.asarray(value).dtype).cast(spark_type(x.dtype))).otherwise(x.value))
    value = asarray(value)
    shape = [n for _, n in kept]
    value = value.with_axes([a for a in value.axes if a.size != 1 or value.ndim <= len(shape)][-len(shape) :] if shape else [])
    names, patch = [], fresh("w")
    for a in value.axes:
        names.append(fresh("p") if a.size != 1 else None)
    small = value.df.select(*[a.position.alias(n) for a, n in zip(value.axes, names, strict=True) if n], value.value.cast(spark_type(x.dtype)).alias(patch))
    if value.size <= BROADCAST_CELLS:
        small = F.broadcast(small)
    used = sources[len(sources) - len(names) :]
    matches = inside
    for s, n in zip(used, names, strict=True):
        if n:
            matches = matches & (s == F.col(n))
    hit = fresh("h")
    df = x.df.join(small.withColumn(hit, F.lit(True)), matches, "left")
    return Array(df, x.axes, F.when(F.col(hit), F.col(patch)).otherwise(x.value), x.dtype)


def append(arr, values, axis=None) -> Array:
    from cellgrid.operators.combine import concatenate
    from cellgrid.operators.shape import ravel

    arr, values = asarray(arr), asarray(values)
    return concatenate([ravel(arr), ravel(values)], 0) if axis is None else concatenate([arr, values], axis)


def _counted_before(df, position: Column, marks: np.ndarray, n: int, name: str):
    """df with `name`: how many of the marks, sorted positions up to n, lie at or below the position. Marks are dealt into equal blocks of the axis, about eight to each, so a row
    looks at its own block's marks only; the blocks are broadcast up to BROADCAST_CELLS marks."""
    size = max(1, -(-n // max(1, len(marks) // 8)))
    blocks = np.arange(n // size + 1)
    first, last = np.searchsorted(marks, blocks * size), np.searchsorted(marks, (blocks + 1) * size)
    rows = [(int(b), int(f), [int(x) for x in marks[f:e]]) for b, f, e in zip(blocks, first, last, strict=True)]
    block, base, own = fresh("b"), fresh("n"), fresh("m")
    frame = active().createDataFrame(rows, f"{block} bigint, {base} bigint, {own} array<bigint>")
    frame = F.broadcast(frame) if len(marks) <= BROADCAST_CELLS else frame
    joined = df.join(frame, F.call_function("div", position, F.lit(size)) == F.col(block), "left")
    return joined.withColumn(name, F.col(base) + F.size(F.filter(own, lambda m: m <= position))).drop(block, base, own)


def delete(arr: Array, obj, axis: int) -> Array:
    """Drops positions of an axis; the rest move up by the number of dropped positions before them. A slice is dropped by arithmetic, so it may be of any length."""
    k = axis_number(axis, arr.ndim)
    n, position, name, axes = arr.axes[k].size, arr.axes[k].position, fresh(), list(arr.axes)
    if isinstance(obj, slice):
        start, stop, step = obj.indices(n)
        if step < 0:
            start, stop, step = start + (len(range(start, stop, step)) - 1) * step, start + 1, -step
        count = len(range(start, stop, step))
        ahead = F.call_function("div", position - start + (step - 1), F.lit(step))
        before = F.when(position <= start, 0).otherwise(F.least(ahead, F.lit(count))).cast("bigint")
        gone = (position >= start) & (position < stop) & (F.pmod(position - start, F.lit(step)) == 0) if count else F.lit(False)
        df = arr.df.withColumn(name, position - before).where(~gone)
    else:
        obj = np.atleast_1d(np.asarray(obj))
        obj = np.flatnonzero(obj) if obj.dtype == bool else obj.astype(np.int64)
        marks = np.unique(np.where(obj < 0, obj + n, obj))
        count, passed, at = len(marks), fresh("n"), fresh("g")
        gone = active().createDataFrame([(int(m),) for m in marks], f"{at} bigint")
        kept = arr.df.join(F.broadcast(gone) if count <= BROADCAST_CELLS else gone, position == F.col(at), "left_anti")
        df = _counted_before(kept, position, marks, n, passed).withColumn(name, position - F.col(passed)).drop(passed)
    axes[k] = Axis(name, 0, n - count)
    return arr.with_axes(axes, df)


def insert(arr: Array, obj, values, axis: int) -> Array:
    """Puts values before positions of an axis; several values at one position keep their order. Cells move by the number of values before them, values go to their places."""
    from cellgrid.core import from_cells
    from cellgrid.operators.elementwise import astype, broadcast_to

    k = axis_number(axis, arr.ndim)
    n = arr.axes[k].size
    single = np.isscalar(obj)
    obj = np.atleast_1d(np.arange(*obj.indices(n)) if isinstance(obj, slice) else np.asarray(obj)).astype(np.int64)
    obj = np.where(obj < 0, obj + n, obj)
    order = np.argsort(obj, kind="stable")
    shape = [len(obj) if j == k else m for j, m in enumerate(arr.shape_or_none)]
    values = asarray(values)
    if single and values.ndim == arr.ndim - 1 and arr.ndim > 1:
        from cellgrid.operators.shape import expand_dims

        values = expand_dims(values, k)
    values = astype(broadcast_to(values, shape), arr.dtype)
    passed, at, place = fresh("n"), fresh("g"), fresh("p")
    moved = _counted_before(arr.cells(), F.col(f"i{k}"), obj[order], n, passed).withColumn(f"i{k}", F.col(f"i{k}") + F.col(passed)).drop(passed)
    rows = [(int(j), int(obj[j]) + rank) for rank, j in enumerate(order)]
    places = active().createDataFrame(rows, f"{at} bigint, {place} bigint")
    new = values.cells().join(F.broadcast(places) if len(obj) <= BROADCAST_CELLS else places, F.col(f"i{k}") == F.col(at)).withColumn(f"i{k}", F.col(place))
    columns = [*[f"i{j}" for j in range(arr.ndim)], "v"]
    return from_cells(moved.select(*columns).union(new.select(*columns)), [m + len(obj) if j == k else m for j, m in enumerate(arr.shape_or_none)], arr.dtype)
