"""Lazy n-dimensional arrays over Spark DataFrames, with NumPy's interface.

    import cellgrid as cg
    x = cg.from_dataframe(spark.read.parquet(path), "o_orderkey", "o_totalprice", shape=n)
    cg.coarsen(cg.sum, x[100:1000] * 2 + 1, {0: 100}).cells().show()
"""

from __future__ import annotations

import numpy as np

from cellgrid.core import Array, from_cells
from cellgrid.functions.scalar import UFUNCS
from cellgrid.operators import blocks as _blocks
from cellgrid.operators import combine as _combine
from cellgrid.operators import elementwise as _elementwise
from cellgrid.operators import fft, linalg, random
from cellgrid.operators import indexing as _indexing
from cellgrid.operators import reductions as _reductions
from cellgrid.operators import shape as _shape
from cellgrid.operators import windows as _windows
from cellgrid.operators.blocks import (
    BlockView, aligned_coarsen_chunks, apply_along_axis, apply_gufunc, apply_over_axes, as_gufunc, auto_chunks, blockwise, boundaries, chunk_report, freeze_chunks, gufunc, map_blocks,
    map_blocks_multi_output, map_overlap, normalize_chunks, overlap, plan_rechunk, rechunk, shuffle, trim_overlap, unify_chunks,
)
from cellgrid.operators.combine import block, concatenate, dstack, hstack, stack, vstack
from cellgrid.operators.elementwise import (
    FUNCTIONS, allclose, angle, around, broadcast_arrays, broadcast_to, choose, clip, conj, digitize, divmod, elemwise, frexp, frompyfunc, i0, imag, isclose, iscomplexobj, isin, isnull, modf,
    nan_to_num, nextafter, notnull, piecewise, real, result_type, round, select, ufunc, where, wrap_elemwise,
)
from cellgrid.operators.indexing import append, argwhere, compress, delete, extract, flatnonzero, insert, nonzero, take
from cellgrid.operators.linalg import dot, einsum, matmul, outer, tensordot, vdot
from cellgrid.operators.random import default_rng
from cellgrid.operators.reductions import (
    all, any, arg_reduction, argmax, argmin, argtopk, average, bincount, coarsen, corrcoef, count_nonzero, cov, histogram, histogram2d, histogramdd, max, mean, median, merge_percentiles, min,
    moment, nanargmax, nanargmin, nanmax, nanmean, nanmedian, nanmin, nanpercentile, nanprod, nanquantile, nanstd, nansum, nanvar, percentile, prod, ptp, quantile, reduction, searchsorted,
    std, sum, topk, trace, union1d, unique, var,
)
from cellgrid.operators.shape import (
    atleast_1d, atleast_2d, atleast_3d, expand_dims, flip, fliplr, flipud, moveaxis, pad, ravel, ravel_multi_index, repeat, reshape, reshape_blockwise, roll, rollaxis, rot90, squeeze,
    swapaxes, tile, transpose, tril, tril_indices, tril_indices_from, triu, triu_indices, triu_indices_from, unravel_index,
)
from cellgrid.operators.windows import cumprod, cumreduction, cumsum, diff, ediff1d, gradient, moving, nancumprod, nancumsum, push, sliding, sliding_window_view, stencil
from cellgrid.plans.explain import explain, expr_flow, expr_table, optimize, to_svg, trace_rewrites, transfer_bytes
from cellgrid.sources.creation import (
    arange, array, asanyarray, asarray, diag, diagonal, empty, empty_like, eye, from_array, from_dataframe, from_vectors, fromfunction, full, full_like, indices, linspace, meshgrid, ones,
    ones_like, tri, zeros, zeros_like,
)
from cellgrid.sources.io import from_delayed, from_graph, from_map, from_npy_stack, from_parquet, from_tiledb, from_zarr, store, to_delayed, to_hdf5, to_npy_stack, to_parquet, to_tiledb, to_zarr

for _name, _function in FUNCTIONS.items():
    globals()[_name] = _function
conjugate = conj
nan, inf, pi, e, newaxis = np.nan, np.inf, np.pi, np.e, None
ALIASES = {"bool_": "bool", "int8": "int8", "int16": "int16", "int32": "int32", "int64": "int64", "uint8": "uint8", "uint16": "uint16", "uint32": "uint32", "uint64": "uint64"}
for _name in (*ALIASES, "float32", "float64", "complex64", "complex128"):
    globals()[_name] = getattr(np, _name)


def ndim(a) -> int:
    return a.ndim if isinstance(a, Array) else np.ndim(a)


def shape(a) -> tuple:
    return a.shape if isinstance(a, Array) else np.shape(a)


def compute(*arrays):
    return tuple(a.compute() if isinstance(a, Array) else a for a in arrays)


def to_backend(x, backend=None):
    return x


def isscalar(x) -> bool:
    return np.isscalar(x)


def _operators() -> None:
    def binary(name, swapped=False):
        def op(self, other):
            if not isinstance(other, (Array, np.ndarray, int, float, complex, bool, np.generic, list, str)):
                return NotImplemented
            other = other if isinstance(other, Array) or np.isscalar(other) else from_array(np.asarray(other))
            return elemwise(name, other, self) if swapped else elemwise(name, self, other)

        return op

    pairs = {
        "add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "floor_divide", "mod": "remainder", "pow": "power", "and": "bitwise_and", "or": "bitwise_or",
        "xor": "bitwise_xor", "lshift": "left_shift", "rshift": "right_shift",
    }
    for short, name in pairs.items():
        setattr(Array, f"__{short}__", binary(name))
        setattr(Array, f"__r{short}__", binary(name, True))
    for short, name in {"eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal"}.items():
        setattr(Array, f"__{short}__", binary(name))
    Array.__hash__ = object.__hash__
    Array.__matmul__ = lambda self, other: matmul(self, other)
    Array.__rmatmul__ = lambda self, other: matmul(other, self)
    Array.__divmod__ = lambda self, other: divmod(self, other)
    Array.__rdivmod__ = lambda self, other: divmod(from_array(np.asarray(other)), self)
    Array.__neg__ = lambda self: elemwise("negative", self)
    Array.__pos__ = lambda self: self
    Array.__abs__ = lambda self: elemwise("absolute", self)
    Array.__invert__ = lambda self: elemwise("invert", self)
    Array.__getitem__ = _indexing.getitem

    def setitem(self, key, value):
        new = _indexing.setitem(self, key, value)
        self.df, self.axes, self.value = new.df, new.axes, new.value

    Array.__setitem__ = setitem

    def array_ufunc(self, function, method, *inputs, **kwargs):
        if method != "__call__" or function.__name__ not in UFUNCS:
            return NotImplemented
        kwargs.pop("out", None)
        return FUNCTIONS[function.__name__](*inputs, **kwargs)

    def array_function(self, function, types, args, kwargs):
        parts = function.__module__.split(".")
        home = {"fft": fft, "linalg": linalg}.get(parts[1] if len(parts) > 1 else "")
        mine = getattr(home, function.__name__, None) if home is not None else globals().get(function.__name__)
        return NotImplemented if mine is None else mine(*args, **kwargs)

    Array.__array_ufunc__, Array.__array_function__ = array_ufunc, array_function
    for source, names in (
        (_reductions, "sum prod min max any all mean var std moment argmin argmax topk argtopk trace"),
        (_windows, "cumsum cumprod"),
        (_shape, "transpose swapaxes squeeze reshape ravel flatten repeat"),
        (_elementwise, "astype clip round choose conj"),
        (_indexing, "nonzero"),
        (linalg, "dot"),
        (_blocks, "rechunk shuffle freeze_chunks"),
    ):
        for name in names.split():
            setattr(Array, name, _method(getattr(source, name)))
    Array.map_blocks = lambda self, func, *args, **kwargs: map_blocks(func, self, *args, **kwargs)
    Array.map_overlap = lambda self, func, **kwargs: map_overlap(func, self, **kwargs)
    Array.T = property(lambda self: transpose(self))
    Array.A = property(lambda self: self)
    Array.real, Array.imag = property(real), property(imag)
    Array.blocks = Array.partitions = property(BlockView)
    Array.vindex = property(_indexing.VIndex)
    Array.optimize = Array.simplify = lambda self: optimize(self)
    Array.pprint = lambda self: print(expr_table(self))
    Array.visualize = lambda self, **kwargs: explain(self)
    Array.to_zarr, Array.to_parquet = lambda self, *a, **k: to_zarr(self, *a, **k), lambda self, *a, **k: to_parquet(self, *a, **k)
    Array.to_tiledb, Array.to_hdf5 = lambda self, *a, **k: to_tiledb(self, *a, **k), lambda self, filename, datapath, **k: to_hdf5(filename, datapath, self, **k)
    Array.to_delayed, Array.store = lambda self, **k: to_delayed(self), lambda self, target, **k: store(self, target, **k)
    Array.to_svg, Array.transfer_bytes = lambda self, size=120: to_svg(self, size), property(transfer_bytes)
    Array.to_backend = lambda self, backend=None: self
    Array.name = property(lambda self: f"array-{abs(hash(self.df.semanticHash())):x}")
    Array.view = _view


def _method(function):
    def method(self, *args, **kwargs):
        return function(self, *args, **kwargs)

    method.__name__, method.__doc__ = function.__name__, function.__doc__
    return method


def _view(self, dtype=None, order: str = "C") -> Array:
    """The same bits as another dtype of the same width (by an Arrow kernel)."""
    dtype = np.dtype(dtype or self.dtype)
    if dtype.itemsize != self.dtype.itemsize:
        raise NotImplementedError("a view of another width")
    return map_blocks(lambda b: np.ascontiguousarray(b).view(dtype), self, dtype=dtype)


_operators()
