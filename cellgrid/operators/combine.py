"""Combination: unions with shifted positions. Members that a slice misses are pruned before they are read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, axis_number, spark_type
from cellgrid.operators.elementwise import asarray, astype, result_type
from cellgrid.operators.shape import atleast_1d, atleast_2d, atleast_3d, expand_dims


class Concatenated(Array):
    """A union that knows its members, so that a slice along its axis reads only those it touches."""

    def __init__(self, members: list[Array], k: int, dtype):
        self.members, self.k = members, k
        ends = np.cumsum([0, *[m.axes[k].size for m in members]]).tolist() if all(m.axes[k].size is not None for m in members) else None
        self.ends = ends
        frames = []
        for m, start in zip(members, ends, strict=False):
            shifted = [(a.position + F.lit(start).cast("bigint") if j == k else a.position).alias(f"i{j}") for j, a in enumerate(m.axes)]
            frames.append(m.df.select(*shifted, m.value.cast(spark_type(dtype)).alias("v") if dtype.kind != "c" else astype(m, dtype).value.alias("v")))
        df = frames[0]
        for f in frames[1:]:
            df = df.union(f)
        shape = [ends[-1] if j == k else n for j, n in enumerate(members[0].shape_or_none)]
        super().__init__(df, [Axis(f"i{j}", 0, n) for j, n in enumerate(shape)], F.col("v"), dtype)

    def pruned(self, start: int, stop: int) -> tuple[Array, int]:
        """The union of the members that positions start..stop-1 touch, and its first position."""
        kept = [j for j in range(len(self.members)) if self.ends[j] < stop and self.ends[j + 1] > start]
        if not kept or len(kept) == len(self.members):
            return self, 0
        part = [self.members[j] for j in kept]
        return (Concatenated(part, self.k, self.dtype) if len(part) > 1 else astype(part[0], self.dtype)), self.ends[kept[0]]


def concatenate(seq, axis: int = 0, allow_unknown_chunksizes: bool = False) -> Array:
    seq = [asarray(x) for x in seq]
    if axis is None:
        from cellgrid.operators.shape import ravel

        seq, axis = [ravel(x) for x in seq], 0
    k = axis_number(axis, seq[0].ndim)
    shapes = {tuple(n for j, n in enumerate(x.shape_or_none) if j != k) for x in seq}
    if len(shapes) > 1:
        raise ValueError(f"shapes differ beside axis {axis}: {[x.shape for x in seq]}")
    if any(x.axes[k].size is None for x in seq):
        seq = [x.compute_chunk_sizes() for x in seq]
    dtype = result_type(*seq)
    seq = [x for x in seq if x.axes[k].size] or seq[:1]
    return astype(seq[0], dtype) if len(seq) == 1 else Concatenated(seq, k, dtype)


def stack(seq, axis: int = 0, allow_unknown_chunksizes: bool = False) -> Array:
    seq = [asarray(x) for x in seq]
    if len({x.shape_or_none for x in seq}) > 1:
        raise ValueError("stacked arrays have one shape")
    k = axis_number(axis, seq[0].ndim + 1)
    return concatenate([expand_dims(x, k) for x in seq], k)


def vstack(tup) -> Array:
    return concatenate([atleast_2d(asarray(x)) for x in tup], 0)


def hstack(tup) -> Array:
    parts = [atleast_1d(asarray(x)) for x in tup]
    return concatenate(parts, 0 if parts[0].ndim == 1 else 1)


def dstack(tup) -> Array:
    return concatenate([atleast_3d(asarray(x)) for x in tup], 2)


def block(arrays, allow_unknown_chunksizes: bool = False) -> Array:
    """Nested lists of arrays: the innermost join along the last axis."""

    def depth(x) -> int:
        return 1 + max(map(depth, x)) if isinstance(x, list) else 0

    def leaves(x):
        return [y for z in x for y in leaves(z)] if isinstance(x, list) else [asarray(x)]

    levels = depth(arrays)
    ndim = max(levels, *[a.ndim for a in leaves(arrays)])

    def build(x, level: int) -> Array:
        if not isinstance(x, list):
            x = asarray(x)
            while x.ndim < ndim:
                x = expand_dims(x, 0)
            return x
        return concatenate([build(y, level + 1) for y in x], ndim - levels + level)

    return build(arrays, 0)


