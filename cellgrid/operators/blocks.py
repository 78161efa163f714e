"""Blocks: NumPy kernels over rectangular pieces of an array, for what columns cannot express.

A block is a group of cells with one block number an axis; a kernel gets it as an ndarray and its result is dealt back into cells. Block sizes bound what
one task holds.
"""

from __future__ import annotations

import inspect
import itertools
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, active, axis_number, axis_numbers, fresh, from_cells, spark_type
from cellgrid.operators.elementwise import BROADCAST_CELLS, align, asarray, crossed

BLOCK_BYTES = 16 * 2**20


# -- chunk grammar -----------------------------------------------------------------------------------------------------------------------------------------
def normalize_chunks(chunks, shape=None, limit=None, dtype=None, previous_chunks=None) -> tuple:
    """Block sizes for each axis from an int, a tuple, a dict, -1, None, 'auto' or a byte string."""
    shape = tuple(shape) if shape is not None else None
    if isinstance(chunks, dict):
        chunks = tuple(chunks.get(k, None) for k in range(len(shape)))
    if chunks is None or isinstance(chunks, (int, str, np.integer)):
        chunks = (chunks,) * len(shape)
    chunks = list(chunks)
    if shape is not None and len(chunks) == 1 and len(shape) > 1:
        chunks = chunks * len(shape)
    if shape is not None and len(shape) == 1 and len(chunks) > 1 and all(isinstance(c, (int, np.integer)) for c in chunks):
        chunks = [tuple(chunks)]
    if shape is None:
        shape = tuple(sum(c) if isinstance(c, tuple) else c for c in chunks)
    if len(chunks) != len(shape):
        raise ValueError(f"chunks {chunks} and shape {shape} have different lengths")
    for k, c in enumerate(chunks):
        if isinstance(c, str) and c != "auto":
            limit, chunks[k] = parse_bytes(c), "auto"
    auto = [k for k, c in enumerate(chunks) if c == "auto"]
    room = (parse_bytes(limit) if isinstance(limit, str) else limit or BLOCK_BYTES) / max(1, np.dtype(dtype or float).itemsize)
    for k, c in enumerate(chunks):
        if k not in auto and (size := _sizes(c, shape[k])):
            room /= max(size)
    out = []
    for k, (c, n) in enumerate(zip(chunks, shape, strict=True)):
        if k in auto and n == n:
            side = max(1, int(room ** (1 / len(auto))))
            side = min(side, int(n)) if n else 0
            room /= max(1, side)
            auto = auto[1:]
            c = side
        out.append(_sizes(c, n))
    for sizes, n in zip(out, shape, strict=True):
        if n == n and sum(sizes) != n:
            raise ValueError(f"chunks {sizes} do not add up to {n}")
    return tuple(out)


def _sizes(c, n) -> tuple:
    if isinstance(c, (tuple, list)):
        return tuple(int(x) for x in c)
    if n != n:
        return (float("nan"),)
    if c in (None, -1) or c == "auto":
        return (int(n),)
    if c == 0 or n == 0:
        return (0,)
    return (int(c),) * (int(n) // int(c)) + ((int(n) % int(c),) if n % c else ())


def parse_bytes(text) -> int:
    m = re.fullmatch(r"\s*([0-9.]+)\s*([kKMGT]?)(i?)B?\s*", str(text))
    if not m:
        raise ValueError(f"{text!r} is no number of bytes")
    return int(float(m[1]) * (1024 if m[3] else 1000) ** " kMGT".index(m[2].replace("K", "k") or " "))


def aligned_coarsen_chunks(chunks, multiple: int) -> tuple:
    """Sizes that are multiples of `multiple` (but for a rest at the end) and near the given ones."""
    total = sum(chunks)
    ends = [min(total // multiple * multiple, round(e / multiple) * multiple) for e in itertools.accumulate(chunks)]
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    rest = total - sum(sizes)
    return tuple(s for s in sizes if s) + ((rest,) if rest else ())


def auto_chunks(chunks, shape, limit, dtype, previous_chunks=None) -> tuple:
    return normalize_chunks(chunks, shape, limit, dtype)


def rechunk(x: Array, chunks="auto", threshold=None, block_size_limit=None, balance: bool = False, method=None) -> Array:
    """Cells have no blocks until a kernel asks for them, so this only notes the sizes."""
    sizes = normalize_chunks(chunks, x.shape, block_size_limit, x.dtype)
    if isinstance(chunks, dict):
        sizes = tuple(s if k in chunks or k - x.ndim in chunks else c for k, (s, c) in enumerate(zip(sizes, x.chunks, strict=True)))
    if balance:
        sizes = tuple(_sizes(math.ceil(sum(s) / len(s)), sum(s)) for s in sizes)
    return Array(x.df, x.axes, x.value, x.dtype, sizes)


def plan_rechunk(old_chunks, new_chunks, itemsize, **kwargs) -> list:
    return [new_chunks]


def freeze_chunks(x: Array) -> Array:
    return Array(x.df, x.axes, x.value, x.dtype, x.chunks)


def unify_chunks(*args):
    arrays = [a for a in args if isinstance(a, Array)]
    return arrays[0].chunks if arrays else (), list(arrays)


# -- cells to blocks and back --------------------------------------------------------------------------------------------------------------------------------
def block_number(position, sizes: tuple):
    """The block of a position: a division for equal sizes, the first and a shorter last one aside, else a search in the literal ends."""
    if len(sizes) == 1:
        return F.lit(0)
    if len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]:
        return F.call_function("div", position, F.lit(sizes[0])).cast("int")
    if len(set(sizes[1:-1])) == 1 and sizes[-1] <= sizes[1] and sizes[1]:
        return F.when(position < sizes[0], F.lit(0)).otherwise(F.call_function("div", position - sizes[0], F.lit(sizes[1])).cast("int") + 1)
    ends = np.cumsum(sizes)

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(position >= int(ends[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(sizes) - 1)


def _values(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    v = column.combine_chunks()
    if dtype.kind == "c":
        return (np.asarray(v.field("re")) + 1j * np.asarray(v.field("im"))).astype(dtype)
    if dtype.kind == "O":
        return np.array(v.to_pylist(), object)
    out = v.to_numpy(zero_copy_only=False)
    return out.astype(dtype) if dtype.kind not in "Mm" else out.astype("int64").view(dtype)


def _column(values: np.ndarray, dtype: np.dtype) -> pa.Array:
    values = np.ascontiguousarray(values).reshape(-1)
    if dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(values.real.astype(float)), pa.array(values.imag.astype(float))], ["re", "im"])
    if dtype.kind in "Mm":
        return pa.array(values.view("int64"))
    if dtype.kind == "O":
        return pa.array([None if x is None else str(x) for x in values], pa.string())
    arrow = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    return pa.array(values, arrow.get(spark_type(dtype), pa.float64()))


def fill(table: pa.Table, names: list[str], starts: list[int], shape: tuple, dtype: np.dtype, value: str = "v") -> np.ndarray:
    out = np.zeros(shape, dtype)
    if table.num_rows:
        out[tuple(table[n].to_numpy() - s for n, s in zip(names, starts, strict=True))] = _values(table[value], dtype)
    return out


def spread(block: np.ndarray, starts, dtype: np.dtype) -> pa.Table:
    block = np.asarray(block, dtype)
    index = np.indices(block.shape).reshape(block.ndim, -1) if block.ndim else np.zeros((0, 1), np.int64)
    return pa.table({**{f"i{k}": pa.array((index[k] + starts[k]).astype(np.int64)) for k in range(block.ndim)}, "v": _column(block, dtype)})


def schema_of(ndim: int, dtype: np.dtype) -> str:
    return ", ".join([*[f"i{k} bigint" for k in range(ndim)], f"v {spark_type(np.dtype(dtype))}"])


def block_frame(x: Array, chunks: tuple) -> DataFrame:
    cells = x.cells()
    return cells.withColumns({f"b{k}": block_number(F.col(f"i{k}"), c) for k, c in enumerate(chunks)})


def starts_of(chunks: tuple) -> list[list[int]]:
    return [[0, *itertools.accumulate(c)][:-1] for c in chunks]


def _infer(func, arrays, kwargs, dtype) -> np.dtype:
    if dtype is not None:
        return np.dtype(dtype)
    with np.errstate(all="ignore"):
        try:
            return np.asarray(func(*[np.ones((1,) * a.ndim, a.dtype) if isinstance(a, Array) else a for a in arrays], **kwargs)).dtype
        except Exception as e:
            raise ValueError("the kernel's dtype cannot be inferred; give dtype=") from e


def _accepts(func, name: str) -> bool:
    try:
        return name in inspect.signature(func).parameters
    except (TypeError, ValueError):
        return False


def map_blocks(func: Callable, *args, dtype=None, chunks=None, drop_axis=None, new_axis=None, block_id=None, **kwargs) -> Array:
    """func of each block (and of scalars as they are); arrays are joined cell by cell first, so they broadcast. A kernel with a block_id or block_info
    parameter gets the block's numbers, or its place. chunks: the result's sizes where the kernel changes them."""
    arrays = [a for a in args if isinstance(a, Array)]
    if not arrays:
        raise ValueError("map_blocks needs an array")
    frame, values = align(arrays)
    shape = frame.shape
    sizes = next((a._chunks for a in arrays if a._chunks is not None and a.shape == shape), None) or normalize_chunks("auto", shape, dtype=float)
    extra = {k: v for k, v in kwargs.items()}
    want_id, want_info = _accepts(func, "block_id"), _accepts(func, "block_info")
    if want_id or want_info:
        sample = {**extra, **({"block_id": (0,) * len(shape)} if want_id else {}), **({"block_info": None} if want_info else {})}
    else:
        sample = extra
    out_dtype = _infer(func, args, sample, dtype)
    names = [f"v{j}" for j in range(len(arrays))]
    cells = frame.df.select(*[a.position.alias(f"i{k}") for k, a in enumerate(frame.axes)], *[v.alias(n) for v, n in zip(values, names, strict=True)])
    cells = cells.withColumns({f"b{k}": block_number(F.col(f"i{k}"), c) for k, c in enumerate(sizes)})
    drop = set(axis_numbers(drop_axis, len(shape))) if drop_axis is not None else set()
    new = tuple(new_axis) if isinstance(new_axis, (tuple, list)) else (() if new_axis is None else (new_axis,))
    origins, dtypes = starts_of(sizes), [a.dtype for a in arrays]
    # an array's own part of a block: one cell along axes that it is broadcast over, none along those it lacks
    cut = [tuple(0 if k < len(shape) - a.ndim else slice(0, 1) if a.shape[k - len(shape) + a.ndim] == 1 else slice(None) for k in range(len(shape))) for a in arrays]
    base = [c for k, c in enumerate(sizes) if k not in drop]
    for k in sorted(new):
        base.insert(k, (1,))
    out_sizes = list(base)
    if chunks is not None:
        given = chunks if isinstance(chunks, tuple) else (chunks,)
        out_sizes = [tuple(c) if isinstance(c, (tuple, list)) else (int(c),) * len(b) for c, b in zip(given, base, strict=True)]
    out_origins = starts_of(tuple(out_sizes))
    kept = [k for k in range(len(shape)) if k not in drop]
    places: list[int | None] = list(kept)
    for k in sorted(new):
        places.insert(k, None)

    def kernel(key, table):
        block = tuple(k.as_py() for k in key)
        start = [o[b] for o, b in zip(origins, block, strict=True)]
        extent = tuple(c[b] for c, b in zip(sizes, block, strict=True))
        index = [f"i{k}" for k in range(len(shape))]
        parts = iter([fill(table, index, start, extent, d, n)[c] for n, d, c in zip(names, dtypes, cut, strict=True)])
        call = [next(parts) if isinstance(a, _Hole) else a for a in holes]
        more = dict(extra)
        if want_id:
            more["block_id"] = block
        if want_info:
            more["block_info"] = {0: {"shape": shape, "chunk-location": block, "array-location": [(s, s + e) for s, e in zip(start, extent, strict=True)]}}
        out = np.asarray(func(*call, **more))
        at = [0 if p is None else block[p] for p in places]
        return spread(out, [o[b] for o, b in zip(out_origins, at, strict=True)], out_dtype)

    holes = [_Hole() if isinstance(a, Array) else a for a in args]
    done = cells.groupBy(*[f"b{k}" for k in range(len(shape))]).applyInArrow(kernel, schema_of(len(out_sizes), out_dtype))
    return from_cells(done, [sum(c) for c in out_sizes], out_dtype, tuple(out_sizes))


class _Hole:
    """Stands for an array's block among a kernel's arguments."""


def map_blocks_multi_output(func, *args, outputs: int, dtypes, **kwargs) -> list[Array]:
    """One array for each output of a kernel that returns a tuple; the kernel runs once for each that is used."""
    return [map_blocks(_Output(func, j), *args, dtype=dtypes[j], **kwargs) for j in range(outputs)]


class _Output:
    def __init__(self, func, j: int):
        self.func, self.j = func, j

    def __call__(self, *args, **kwargs):
        return self.func(*args, **kwargs)[self.j]


def map_overlap(func: Callable, x, depth=1, boundary=None, trim: bool = True, dtype=None, axis=None, **kwargs) -> Array:
    """func of each block with `depth` cells of its neighbours on each side; past the ends of the array: mirrored, edge, wrapped or constant cells, or none."""
    from cellgrid.operators.shape import pad

    x = asarray(x)
    depth = {k: depth for k in range(x.ndim)} if np.isscalar(depth) else dict(enumerate(depth)) if isinstance(depth, (tuple, list)) else dict(depth)
    sides = {k: (d, d) if np.isscalar(d) else tuple(d) for k, d in depth.items()}
    boundary = {k: boundary for k in range(x.ndim)} if not isinstance(boundary, dict) else boundary
    sizes = x.chunks
    y, shift = x, [0] * x.ndim
    for k, (a, b) in sides.items():
        kind = boundary.get(k)
        if kind not in (None, "none") and (a or b):
            mode = {"reflect": "symmetric", "nearest": "edge", "periodic": "wrap"}.get(kind, "constant")
            y = pad(y, [(a, b) if j == k else (0, 0) for j in range(x.ndim)], mode, **({"constant_values": kind} if mode == "constant" else {}))
            shift[k] = a
    cells = y.cells()
    for k in range(x.ndim):
        cells = cells.withColumn(f"i{k}", F.col(f"i{k}") - shift[k])
    for k, c in enumerate(sizes):
        a, b = sides.get(k, (0, 0))
        position = F.col(f"i{k}")
        clipped = F.least(F.greatest(position, F.lit(0)), F.lit(sum(c) - 1))
        lo = block_number(F.least(F.greatest(position - b, F.lit(0)), F.lit(sum(c) - 1)), c)
        hi = block_number(F.least(F.greatest(position + a, F.lit(0)), F.lit(sum(c) - 1)), c)
        cells = cells.withColumn(f"b{k}", F.explode(F.sequence(lo, hi)) if a or b else block_number(clipped, c))
    origins, total = starts_of(sizes), x.shape_or_none
    out_dtype = _infer(func, [x], kwargs, dtype)
    in_dtype, shifts, ndim = x.dtype, list(shift), x.ndim

    def kernel(key, table):
        block = [k.as_py() for k in key]
        lo, hi, cut = [], [], []
        for k, b in enumerate(block):
            before, after = sides.get(k, (0, 0))
            s, e = origins[k][b], origins[k][b] + sizes[k][b]
            first, last = -shifts[k], total[k] + (after if shifts[k] or boundary.get(k) not in (None, "none") else 0)
            lo.append(max(first, s - before))
            hi.append(min(last, e + after))
            cut.append((s - lo[-1], e - lo[-1]))
        out = np.asarray(func(fill(table, [f"i{k}" for k in range(ndim)], lo, tuple(h - a for a, h in zip(lo, hi, strict=True)), in_dtype), **kwargs))
        if trim:
            out = out[tuple(slice(a, b) for a, b in cut)]
        return spread(out, [o[b] for o, b in zip(origins, block, strict=True)], out_dtype)

    done = cells.groupBy(*[f"b{k}" for k in range(ndim)]).applyInArrow(kernel, schema_of(ndim, out_dtype))
    return from_cells(done, total, out_dtype, sizes)


def overlap(x: Array, depth, boundary=None) -> Array:
    """Blocks with their neighbours' cells, one after another: the array whose blocks a map over overlapping blocks sees."""
    x = asarray(x)
    depth = {k: depth for k in range(x.ndim)} if np.isscalar(depth) else dict(depth)
    sizes, y, shift = x.chunks, x, [0] * x.ndim
    from cellgrid.operators.shape import pad

    for k, d in depth.items():
        kind = boundary.get(k) if isinstance(boundary, dict) else boundary
        if kind not in (None, "none") and d:
            mode = {"reflect": "symmetric", "nearest": "edge", "periodic": "wrap"}.get(kind, "constant")
            y = pad(y, [(d, d) if j == k else (0, 0) for j in range(x.ndim)], mode, **({"constant_values": kind} if mode == "constant" else {}))
            shift[k] = d
    cells, out_sizes = y.cells(), []
    for k, c in enumerate(sizes):
        d = depth.get(k, 0)
        starts = starts_of((c,))[0]
        lo = [max(0 if not shift[k] else -d, s - d) for s in starts]
        hi = [min(sum(c) + (d if shift[k] else 0), s + n + d) for s, n in zip(starts, c, strict=True)]
        own = [h - a for a, h in zip(lo, hi, strict=True)]
        out_sizes.append(tuple(own))
        position = F.col(f"i{k}") - shift[k]
        empty, last = c.count(0), F.lit(len(c) - 1)
        inside = lambda p, n=sum(c): F.least(F.greatest(p, F.lit(0)), F.lit(max(n - 1, 0)))
        first, final = block_number(inside(position - d), c), block_number(inside(position + d), c)
        dealt = cells.withColumn("_b", F.explode(F.sequence(F.greatest(first - empty, F.lit(0)).cast("int"), F.least(final + empty, last).cast("int"))))
        cells = _moved(dealt, k, position, lo, hi)
    return from_cells(cells.select(*[F.col(f"i{k}").cast("bigint").alias(f"i{k}") for k in range(x.ndim)], "v"), [sum(s) for s in out_sizes], x.dtype, tuple(out_sizes))


def _moved(cells: DataFrame, k: int, position, lo, hi) -> DataFrame:
    """The cells whose position is within lo..hi of their block `_b`, at their places when those ranges follow one another: a join with the blocks' ranges."""
    lo, hi = np.asarray(lo, np.int64), np.asarray(hi, np.int64)
    begin = np.r_[0, np.cumsum(hi - lo)][:-1]
    ranges = active().createDataFrame(pa.table({"_b": np.arange(len(lo), dtype=np.int32), "_lo": lo, "_hi": hi, "_move": begin - lo}))
    joined = cells.withColumn("_p", position.cast("bigint")).join(F.broadcast(ranges) if len(lo) <= BROADCAST_CELLS else ranges, "_b")
    return joined.where("_p >= _lo and _p < _hi").withColumn(f"i{k}", F.col("_p") + F.col("_move")).drop("_b", "_p", "_lo", "_hi", "_move")


def trim_overlap(x: Array, depth, boundary=None) -> Array:
    """Takes the neighbours' cells off again."""
    depth = {k: depth for k in range(x.ndim)} if np.isscalar(depth) else dict(depth)
    cells, out_sizes = x.cells(), []
    for k, c in enumerate(x.chunks):
        d = depth.get(k, 0)
        kind = boundary.get(k) if isinstance(boundary, dict) else boundary
        first = d if kind not in (None, "none") else 0
        starts = starts_of((c,))[0]
        keep = [(s + (d if j or first else 0), s + n - (d if j < len(c) - 1 or first else 0)) for j, (s, n) in enumerate(zip(starts, c, strict=True))]
        out_sizes.append(tuple(b - a for a, b in keep))
        position = F.col(f"i{k}")
        cells = _moved(cells.withColumn("_b", block_number(position, c).cast("int")), k, position, *zip(*keep, strict=True))
    return from_cells(cells, [sum(s) for s in out_sizes], x.dtype, tuple(out_sizes))


def boundaries(x: Array, depth=None, kind=None) -> Array:
    from cellgrid.operators.shape import pad

    for k, d in (depth or {}).items():
        mode = {"reflect": "symmetric", "nearest": "edge", "periodic": "wrap"}.get(kind[k], "constant")
        x = pad(x, [(d, d) if j == k else (0, 0) for j in range(x.ndim)], mode, **({"constant_values": kind[k]} if mode == "constant" else {}))
    return x


class BlockView:
    """x.blocks[i, j]: the cells of some blocks, by filters on positions."""

    def __init__(self, x: Array):
        self.x = x

    @property
    def shape(self) -> tuple:
        return self.x.numblocks

    def __getitem__(self, key) -> Array:
        from cellgrid.operators.combine import concatenate

        key = key if isinstance(key, tuple) else (key,)
        out = self.x
        for k, i in enumerate(key):
            sizes = self.x.chunks[k]
            numbers = np.atleast_1d(np.arange(len(sizes))[i])
            starts = starts_of((sizes,))[0]
            parts = [out[(slice(None),) * k + (slice(starts[b], starts[b] + sizes[b]),)] for b in numbers]
            out = parts[0] if len(parts) == 1 else concatenate(parts, k)
        return out


# -- kernels along an axis -----------------------------------------------------------------------------------------------------------------------------------
def apply_along_axis(func1d: Callable, axis: int, arr, *args, dtype=None, shape=None, **kwargs) -> Array:
    """func1d of each vector along an axis; each vector is held by one task."""
    arr = asarray(arr)
    k = axis_number(axis, arr.ndim)
    sample = np.asarray(func1d(np.ones(max(arr.shape_or_none[k], 1), arr.dtype), *args, **kwargs)) if dtype is None or shape is None else None
    out_dtype = np.dtype(dtype) if dtype is not None else sample.dtype
    out_shape = tuple(shape) if shape is not None else sample.shape
    return along(arr, k, lambda v: func1d(v, *args, **kwargs), out_shape, out_dtype)


def along(arr: Array, k: int, func, out_shape: tuple, out_dtype) -> Array:
    others = [j for j in range(arr.ndim) if j != k]
    n, in_dtype, out_dtype = arr.shape_or_none[k], arr.dtype, np.dtype(out_dtype)
    keys = [f"i{j}" for j in others]
    cells = arr.cells()
    if not keys:
        cells, keys = cells.withColumn("_one", F.lit(0)), ["_one"]

    def kernel(key, table):
        vector = np.zeros(n, in_dtype)
        vector[table[f"i{k}"].to_numpy()] = _values(table["v"], in_dtype)
        out = np.asarray(func(vector), out_dtype).reshape(out_shape)
        got = spread(out, [0] * out.ndim, out_dtype)
        columns, inner = {}, iter(range(out.ndim))
        at = iter(key)
        fixed = {j: np.full(got.num_rows, next(at).as_py(), np.int64) for j in others}
        place = 0
        for j in range(arr_ndim):
            if j == k:
                for i in inner:
                    columns[f"i{place}"] = got[f"i{i}"]
                    place += 1
            else:
                columns[f"i{place}"] = pa.array(fixed[j])
                place += 1
        return pa.table({**columns, "v": got["v"]})

    arr_ndim = arr.ndim
    total = [*arr.shape_or_none[:k], *out_shape, *arr.shape_or_none[k + 1 :]]
    return from_cells(cells.groupBy(*keys).applyInArrow(kernel, schema_of(len(total), out_dtype)), total, out_dtype)


def apply_over_axes(func, a, axes) -> Array:
    out = asarray(a)
    for k in (axes,) if np.isscalar(axes) else axes:
        new = func(out, k)
        if new.ndim < out.ndim:
            from cellgrid.operators.shape import expand_dims

            new = expand_dims(new, axis_number(k, out.ndim))
        out = new
    return out


def parse_signature(signature: str) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    left, right = signature.replace(" ", "").split("->")
    read = lambda s: [tuple(x for x in p.split(",") if x) for p in re.findall(r"\(([^)]*)\)", s)]
    return read(left), read(right)


def apply_gufunc(func: Callable, signature: str, *args, axes=None, axis=None, keepdims: bool = False, output_dtypes=None, output_sizes=None, vectorize: bool = False, **kwargs):
    """A generalised function: core dimensions go to the kernel whole, loop dimensions are broadcast and dealt out."""
    ins, outs = parse_signature(signature)
    arrays = [asarray(a) for a in args]
    sizes: dict[str, int] = dict(output_sizes or {})
    loops = []
    for a, core in zip(arrays, ins, strict=True):
        loops.append(a.shape_or_none[: a.ndim - len(core)])
        for name, n in zip(core, a.shape_or_none[a.ndim - len(core) :], strict=True):
            if sizes.setdefault(name, n) != n:
                raise ValueError(f"core dimension {name} has sizes {sizes[name]} and {n}")
    from cellgrid.operators.elementwise import broadcast_shapes

    loop = broadcast_shapes(*loops)
    joined, keys = None, [f"l{k}" for k in range(len(loop))]
    for j, (a, core) in enumerate(zip(arrays, ins, strict=True)):
        head = a.axes[: a.ndim - len(core)]
        own = [k for k, ax in zip(range(len(loop) - len(head), len(loop)), head, strict=True) if ax.col is not None and ax.size != 1 or loop[k] == 1 and ax.col is not None]
        cell = a.df.select(*[ax.position.alias(f"l{k}") for k, ax in zip(range(len(loop) - len(head), len(loop)), head, strict=True) if k in own], F.struct(*[ax.position.alias(f"c{i}") for i, ax in enumerate(a.axes[a.ndim - len(core) :])], a.value.alias("v")).alias("x"))
        packed = cell.groupBy(*[f"l{k}" for k in own]).agg(F.collect_list("x").alias(f"x{j}"))
        on = [c for c in packed.columns if joined is not None and c in joined.columns]
        n = None if None in a.shape_or_none else a.size
        if joined is None:
            joined, held = packed, n
        else:
            joined = joined.join(packed, on) if on else crossed(joined, held, packed, n)
            held = None if held is None or n is None else held + n if on else held * n
    for k in range(len(loop)):
        if f"l{k}" not in joined.columns:
            joined = joined.withColumn(f"l{k}", F.lit(0).cast("bigint"))
    dtypes = output_dtypes if isinstance(output_dtypes, (list, tuple)) else [output_dtypes] * len(outs)
    dtypes = [np.dtype(d or float) for d in dtypes]
    shapes = [tuple(sizes[n] for n in core) for core in outs]
    in_dtypes, in_shapes = [a.dtype for a in arrays], [tuple(sizes[n] for n in core) for core in ins]
    results = []
    for j, (shape, dtype) in enumerate(zip(shapes, dtypes, strict=True)):

        def run(batches, j=j, shape=shape, dtype=dtype):
            for batch in batches:
                for row in range(batch.num_rows):
                    call = []
                    for i, (s, d) in enumerate(zip(in_shapes, in_dtypes, strict=True)):
                        items = batch.column(f"x{i}")[row].values
                        x = np.zeros(s, d)
                        if len(items):
                            x[tuple(items.field(f"c{c}").to_numpy() for c in range(len(s)))] = _values(pa.chunked_array([items.field("v")]), d) if len(s) else _values(pa.chunked_array([items.field("v")]), d)[0]
                        call.append(x)
                    out = func(*call, **kwargs)
                    out = np.asarray(out[j] if len(shapes) > 1 else out, dtype).reshape(shape)
                    got = spread(out, [0] * len(shape), dtype)
                    columns = {f"i{k}": pa.array(np.full(got.num_rows, batch.column(key)[row].as_py(), np.int64)) for k, key in enumerate(keys)}
                    columns |= {f"i{len(keys) + k}": got[f"i{k}"].combine_chunks() for k in range(len(shape))}
                    yield pa.RecordBatch.from_arrays([*columns.values(), got["v"].combine_chunks()], names=[*columns, "v"])

        results.append(from_cells(joined.mapInArrow(run, schema_of(len(keys) + len(shape), dtype)), [*loop, *shape], dtype))
    return results[0] if len(results) == 1 else tuple(results)


class gufunc:
    """A callable generalised function."""

    def __init__(self, func, *, signature: str, **kwargs):
        self.func, self.signature, self.kwargs = func, signature, kwargs

    def __call__(self, *args, **kwargs):
        return apply_gufunc(self.func, self.signature, *args, **{**self.kwargs, **kwargs})


def as_gufunc(signature: str, **kwargs):
    return lambda func: gufunc(func, signature=signature, **kwargs)


def blockwise(func: Callable, out_ind, *args, dtype=None, adjust_chunks=None, new_axes=None, concatenate: bool = True, **kwargs) -> Array:
    """Index notation. Labels in all arrays that stay are aligned; labels that the result lacks are contracted whole by the kernel."""
    arrays, labels = [asarray(a) for a in args[::2]], [tuple(i) for i in args[1::2]]
    gone = [x for x in dict.fromkeys(itertools.chain(*labels)) if x not in out_ind]
    new = list((new_axes or {}).items())
    loop = [x for x in out_ind if x not in dict(new)]
    from cellgrid.operators.shape import expand_dims, transpose

    shaped = []
    for a, ind in zip(arrays, labels, strict=True):
        have = [x for x in loop if x in ind]
        rest = [x for x in gone if x in ind]
        y = transpose(a, [ind.index(x) for x in [*have, *rest]])
        for k, x in enumerate(loop):
            if x not in ind:
                y = expand_dims(y, k)
        shaped.append((y, rest))
    if not gone and not new:
        from cellgrid.operators.shape import transpose as t

        order = [loop.index(x) for x in out_ind]
        return t(map_blocks(func, *[y for y, _ in shaped], dtype=dtype, **kwargs), order)
    name = {x: f"d{k}" for k, x in enumerate([*gone, *[n for n, _ in new]])}
    signature = ",".join("(" + ",".join(name[x] for x in rest) + ")" for _, rest in shaped) + "->(" + ",".join(name[n] for n, _ in new) + ")"
    out = apply_gufunc(func, signature, *[y for y, _ in shaped], output_dtypes=[dtype or float], output_sizes={name[n]: s for n, s in new}, **kwargs)
    order = [*loop, *[n for n, _ in new]]
    return transpose(out, [order.index(x) for x in out_ind])


def tree_reduction(x: Array, chunk, aggregate, axis, keepdims, dtype, combine_with=None) -> Array:
    """chunk(block, axis, keepdims=True) on each block, then aggregate over the blocks' results along the reduced axes."""
    gone = axis_numbers(axis, x.ndim)
    sizes = x.chunks
    out_dtype = _infer(lambda b: aggregate(chunk(b, axis=gone, keepdims=True), axis=gone, keepdims=True), [x], {}, dtype)
    middle = np.asarray(chunk(np.ones((1,) * x.ndim, x.dtype), axis=gone, keepdims=True)).dtype
    partial = map_blocks(_Kernel(chunk, gone), rechunk(x, sizes), dtype=middle, chunks=tuple((1,) * len(c) if k in gone else c for k, c in enumerate(sizes)))
    whole = tuple((len(c),) if k in gone else c for k, c in enumerate(sizes))
    done = map_blocks(_Kernel(aggregate, gone), rechunk(partial, whole), dtype=out_dtype, chunks=tuple((1,) if k in gone else c for k, c in enumerate(sizes)))
    return done if keepdims else done.with_axes([a for k, a in enumerate(done.axes) if k not in gone], done.df)


class _Kernel:
    def __init__(self, func, axes):
        self.func, self.axes = func, axes

    def __call__(self, block):
        return self.func(block, axis=self.axes, keepdims=True)


def block_scan(x: Array, func, binop, ident, k: int, dtype=None) -> Array:
    """func along the axis in each block; binop with the running result of the blocks before, which are as many as there are blocks along the axis."""
    dtype = np.dtype(dtype) if dtype is not None else np.asarray(func(np.ones(1, x.dtype), axis=0)).dtype
    inner = map_blocks(_Scan(func, k), rechunk(x, x.chunks), dtype=dtype).settled()
    starts = starts_of((x.chunks[k],))[0]
    lasts = [s + n - 1 for s, n in zip(starts, x.chunks[k], strict=True)]
    from cellgrid.operators.indexing import take

    ends = take(inner, np.array(lasts), k)
    carry = along(ends, k, _Carry(binop, ident), (len(lasts),), dtype)
    number = block_number(inner.axes[k].position, x.chunks[k])
    frame = inner.df.withColumn("_b", number.cast("bigint"))
    before = carry.cells().withColumnRenamed("v", "_c").withColumnRenamed(f"i{k}", "_b")
    joined = frame.join(before, [*[f"i{j}" for j in range(x.ndim) if j != k], "_b"])
    left = Array(joined, inner.axes, F.col("_c"), dtype)
    right = Array(joined, inner.axes, F.col("v"), dtype)
    name = getattr(binop, "__name__", "")
    from cellgrid.operators.elementwise import elemwise

    return elemwise({"add": "add", "mul": "multiply", "multiply": "multiply", "maximum": "maximum", "minimum": "minimum"}[name], left, right)


class _Scan:
    def __init__(self, func, k):
        self.func, self.k = func, k

    def __call__(self, block):
        return self.func(block, axis=self.k)


class _Carry:
    def __init__(self, binop, ident):
        self.binop, self.ident = binop, ident

    def __call__(self, v):
        out, now = np.empty_like(v), self.ident
        for i, x in enumerate(v):
            out[i] = now
            now = self.binop(now, x)
        return out


def block_order(x: Array) -> Array:
    """A flat array whose order goes block by block, C order within each."""
    offset = F.lit(0).cast("bigint")
    blocks = [block_number(a.position, c) for a, c in zip(x.axes, x.chunks, strict=True)]
    starts, sizes = starts_of(x.chunks), x.chunks
    lookup = lambda values, b: F.get(F.array(*[F.lit(int(v)) for v in values]), b.cast("int")).cast("bigint")
    # cells in the blocks before, axis by axis, then the place within the block
    remaining = [sum(c) for c in sizes]
    scale = F.lit(1).cast("bigint")
    for k in range(x.ndim):
        rest = math.prod(remaining[k + 1 :])
        offset = offset + scale * lookup(starts[k], blocks[k]) * rest
        scale = scale * lookup(sizes[k], blocks[k])
    inside = F.lit(0).cast("bigint")
    for k, a in enumerate(x.axes):
        inside = inside * lookup(sizes[k], blocks[k]) + (a.position - lookup(starts[k], blocks[k]))
    name = fresh()
    return Array(x.df.withColumn(name, offset + inside), [Axis(name, 0, x.size)], x.value, x.dtype)


def shuffle(x: Array, indexer, axis: int, chunks="auto") -> Array:
    """Groups of positions become the blocks of the axis, in their order."""
    from cellgrid.operators.indexing import take

    k = axis_number(axis, x.ndim)
    out = take(x, np.concatenate([np.asarray(g, np.int64) for g in indexer]), k)
    sizes = tuple(tuple(map(len, indexer)) if j == k else c for j, c in enumerate(x.chunks))
    return Array(out.df, out.axes, out.value, out.dtype, sizes)


def chunk_report(*arrays, limit: int = 8) -> str:
    lines = []
    for a in arrays:
        lines.append(f"shape {a.shape}, dtype {a.dtype}, {a.npartitions} blocks of up to {math.prod(a.chunksize) * a.itemsize:,} bytes")
        lines += [f"  axis {k}: {len(c)} blocks, {list(c[:limit])}{' ...' if len(c) > limit else ''}" for k, c in enumerate(a.chunks)]
    return "\n".join(lines)


