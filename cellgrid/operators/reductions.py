"""Reductions: one grouped aggregation on the kept index columns, so Spark sums up in each task before the shuffle and filters on kept axes reach the scan."""

from __future__ import annotations

import builtins
import math

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, active, axis_number, axis_numbers, fresh, from_cells, spark_type
from cellgrid.functions import scalar
from cellgrid.operators.elementwise import asarray, astype, combine

NAN = float("nan")


def reduce_with(x: Array, axis, keepdims: bool, dtype, aggregate) -> Array:
    """aggregate(value column) -> aggregate Column, over the given axes."""
    x = asarray(x)
    gone = axis_numbers(axis, x.ndim)
    keys = [a.col for k, a in enumerate(x.axes) if k not in gone and a.col is not None]
    out = fresh("r")
    df = x.df.groupBy(*keys).agg(aggregate(x.value).alias(out)) if keys else x.df.agg(aggregate(x.value).alias(out))
    df._grouping = (x.df, tuple(keys), {out: aggregate(x.value)})  # so that align() can fuse reductions of one frame
    axes = [Axis(None) if k in gone else a for k, a in enumerate(x.axes) if keepdims or k not in gone]
    value = F.col(out) if dtype is None else F.col(out).cast(spark_type(np.dtype(dtype)))
    return Array(df, axes, value, dtype)


def _length(x: Array, axis) -> int | None:
    sizes = [x.axes[k].size for k in axis_numbers(axis, x.ndim)]
    return None if None in sizes else math.prod(sizes)


def _sum_dtype(x: Array, dtype) -> np.dtype:
    return np.dtype(dtype) if dtype is not None else np.sum(np.ones(1, x.dtype)).dtype


def _numeric(v: Column, d: np.dtype) -> Column:
    return v.cast("bigint") if d.kind == "b" else v


def _ordinary(x: Array, v: Column) -> Column:
    """The value, or null where it is not a number."""
    return F.when(~F.isnan(v), v) if x.dtype.kind == "f" else v


def _filled(x: Array, v: Column, value: float) -> Column:
    return F.nanvl(v, F.lit(value)) if x.dtype.kind == "f" else v


def sum(x, axis=None, dtype=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    if x.dtype.kind == "c":
        return reduce_with(x, axis, keepdims, x.dtype, lambda v: scalar.complex_of(F.coalesce(F.sum(v["re"]), F.lit(0.0)), F.coalesce(F.sum(v["im"]), F.lit(0.0))))
    return reduce_with(x, axis, keepdims, _sum_dtype(x, dtype), lambda v: F.coalesce(F.sum(_numeric(v, x.dtype)), F.lit(0)))


def prod(x, axis=None, dtype=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    return reduce_with(x, axis, keepdims, _sum_dtype(x, dtype), lambda v: F.coalesce(F.product(_numeric(v, x.dtype)), F.lit(1.0)))


def min(x, axis=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    plain = lambda v: F.min(v)
    return reduce_with(x, axis, keepdims, x.dtype, (lambda v: F.when(F.bool_or(F.isnan(v)), NAN).otherwise(F.min(v))) if x.dtype.kind == "f" else plain)


def max(x, axis=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    return reduce_with(x, axis, keepdims, x.dtype, F.max)


def any(x, axis=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    return reduce_with(x, axis, keepdims, bool, lambda v: F.coalesce(F.bool_or(scalar.truthy(v, x.dtype)), F.lit(False)))


def all(x, axis=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    return reduce_with(x, axis, keepdims, bool, lambda v: F.coalesce(F.bool_and(scalar.truthy(v, x.dtype)), F.lit(True)))


def mean(x, axis=None, dtype=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    return reduce_with(x, axis, keepdims, dtype or np.mean(np.ones(1, x.dtype)).dtype, lambda v: F.coalesce(F.avg(_numeric(v, x.dtype)), F.lit(NAN)))


def _moment2(x: Array, axis, keepdims, ddof, root: bool, pick) -> Array:
    def aggregate(v):
        v = pick(_numeric(v, x.dtype))
        if ddof == 0:
            out = F.var_pop(v)
        else:
            n = F.count(v)
            out = F.when(n > ddof, F.var_pop(v) * n / F.when(n > ddof, n - ddof)).otherwise(F.when((n == ddof) & (F.var_pop(v) > 0), float("inf")).otherwise(NAN))
        out = F.coalesce(out, F.lit(NAN))
        return F.sqrt(out) if root else out

    return reduce_with(x, axis, keepdims, np.var(np.ones(2, x.dtype)).dtype, aggregate)


def var(x, axis=None, dtype=None, keepdims=False, ddof=0, split_every=None) -> Array:
    return _moment2(asarray(x), axis, keepdims, ddof, False, lambda v: v)


def std(x, axis=None, dtype=None, keepdims=False, ddof=0, split_every=None) -> Array:
    return _moment2(asarray(x), axis, keepdims, ddof, True, lambda v: v)


def moment(x, order: int, axis=None, dtype=None, keepdims=False, ddof=0, split_every=None) -> Array:
    """The central moment: the mean first, then the mean power of the distance from it."""
    x = asarray(x)
    if order == 0:
        from cellgrid.sources.creation import ones_like

        return max(ones_like(x, float), axis, keepdims)
    if order == 1:
        from cellgrid.sources.creation import zeros_like

        return max(zeros_like(x, float), axis, keepdims)
    centred = combine(lambda v, m: F.pow(scalar.real(v) - m, F.lit(order)), [x, mean(x, axis, keepdims=True)], float)
    n = _length(x, axis)
    total = sum(centred, axis, keepdims=keepdims)
    return total.with_value(total.value / F.lit(float(n - ddof)))


def nansum(x, axis=None, dtype=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    return sum(x.with_value(_filled(x, x.value, 0.0)), axis, dtype, keepdims)


def nanprod(x, axis=None, dtype=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    return prod(x.with_value(_filled(x, x.value, 1.0)), axis, dtype, keepdims)


def _nan_extreme(f):
    def g(x, axis=None, keepdims=False, split_every=None) -> Array:
        x = asarray(x)
        fallback = F.lit(NAN) if x.dtype.kind == "f" else F.lit(None)
        return reduce_with(x, axis, keepdims, x.dtype, lambda v: F.coalesce(f(_ordinary(x, v)), fallback))

    return g


nanmin, nanmax = _nan_extreme(F.min), _nan_extreme(F.max)


def nanmean(x, axis=None, dtype=None, keepdims=False, split_every=None) -> Array:
    x = asarray(x)
    return reduce_with(x, axis, keepdims, dtype or float, lambda v: F.coalesce(F.avg(_ordinary(x, v)), F.lit(NAN)))


def nanvar(x, axis=None, dtype=None, keepdims=False, ddof=0, split_every=None) -> Array:
    x = asarray(x)
    return _moment2(x, axis, keepdims, ddof, False, lambda v: _ordinary(x, v))


def nanstd(x, axis=None, dtype=None, keepdims=False, ddof=0, split_every=None) -> Array:
    x = asarray(x)
    return _moment2(x, axis, keepdims, ddof, True, lambda v: _ordinary(x, v))


def _arg(x, axis, keepdims, low: bool, skip_nan: bool) -> Array:
    """The first position of the extreme; one that is not a number counts as the extreme unless it is skipped."""
    from cellgrid.operators.shape import flat_position

    x = asarray(x)
    position = flat_position(x) if axis is None else x.axes[axis_number(axis, x.ndim)].position
    v = x.value.cast("int") if x.dtype.kind == "b" else x.value
    rank = v if low else -v
    key = F.struct(rank.alias("a"), position.alias("b"))
    if x.dtype.kind == "f":
        nan = F.isnan(v)
        key = F.when(~nan, key) if skip_nan else F.struct(F.when(nan, 0).otherwise(1).alias("n"), F.when(nan, 0.0).otherwise(rank).alias("a"), position.alias("b"))

    def aggregate(_):
        at = F.min(key)["b"]
        return F.when(at.isNull(), F.raise_error(F.lit("All-NaN slice encountered"))).otherwise(at) if skip_nan else at

    return reduce_with(x, axis, keepdims, "int64", aggregate)


def argmin(a, axis=None, keepdims=False, split_every=None) -> Array:
    return _arg(a, axis, keepdims, True, False)


def argmax(a, axis=None, keepdims=False, split_every=None) -> Array:
    return _arg(a, axis, keepdims, False, False)


def nanargmin(a, axis=None, keepdims=False, split_every=None) -> Array:
    return _arg(a, axis, keepdims, True, True)


def nanargmax(a, axis=None, keepdims=False, split_every=None) -> Array:
    return _arg(a, axis, keepdims, False, True)


#: Whole arrays of so many cells or more, or of an unknown number of values, get their quantiles from a range partitioning instead of an exact percentile, whose state grows with the distinct values.
SORTED_QUANTILES = 1 << 22

# fixed values: where the order statistic of a quantile lies among n sorted values (virtual index), by method (Hyndman and Fan); m rounds numbers, or columns
_VIRTUAL = {
    "linear": lambda n, q, m: (n - 1) * q,
    "weibull": lambda n, q, m: (n + 1) * q - 1,
    "hazen": lambda n, q, m: n * q - 0.5,
    "median_unbiased": lambda n, q, m: (n + 1 / 3) * q + 1 / 3 - 1,
    "normal_unbiased": lambda n, q, m: (n + 1 / 4) * q + 3 / 8 - 1,
    "interpolated_inverted_cdf": lambda n, q, m: n * q - 1,
    "lower": lambda n, q, m: m.floor((n - 1) * q),
    "higher": lambda n, q, m: m.ceil((n - 1) * q),
    "nearest": lambda n, q, m: m.rint((n - 1) * q),
    "midpoint": lambda n, q, m: (m.floor((n - 1) * q) + m.ceil((n - 1) * q)) / 2,
    "inverted_cdf": lambda n, q, m: m.ceil(n * q) - 1,
    "closest_observation": lambda n, q, m: m.rint(n * q) - 1,
    "averaged_inverted_cdf": lambda n, q, m: (m.floor(n * q) + m.ceil(n * q) - 1) / 2,
}



def _percentile_disc(share: float) -> Column:
    """The first value, in order, up to which there is at least the share of all; of the column `_q`, as Spark has this in SQL text only."""
    return F.expr(f"percentile_disc({share!r}D) within group (order by _q)")


def quantile(a, q, axis=None, method: str = "linear", keepdims=False, **kwargs) -> Array:
    """Exact quantiles by any of NumPy's methods. The order statistics are exact percentiles of each group; a value that is not a number makes the result so."""
    return _quantiles(asarray(a), q, axis, method, keepdims, False)


def nanquantile(a, q, axis=None, method: str = "linear", keepdims=False, **kwargs) -> Array:
    return _quantiles(asarray(a), q, axis, method, keepdims, True)


def _quantiles(a: Array, q, axis, method, keepdims, skip_nan) -> Array:
    from cellgrid.operators.combine import stack

    if not np.isscalar(q):
        return stack([_quantiles(a, float(p), axis, method, keepdims, skip_nan) for p in np.ravel(q)])
    if not 0 <= q <= 1:
        raise ValueError("quantiles lie between 0 and 1")
    v = _ordinary(a, scalar.real(a.value)) if a.dtype.kind == "f" else scalar.real(a.value)
    n = _length(a, axis)
    if len(axis_numbers(axis, a.ndim)) == a.ndim and n is not None and n >= SORTED_QUANTILES:
        return _sorted_quantile(a, v, float(q), method, keepdims, skip_nan)
    frames = a.df.__dict__.setdefault("_quantiles", {})  # so that quantiles of one value share a frame, and fuse
    if method != "linear" and (skip_nan or n is None) and len(axis_numbers(axis, a.ndim)) == a.ndim:
        return _sorted_quantile(a, v, float(q), method, keepdims, skip_nan)
    named = a if method == "linear" else Array(frames.setdefault(str(a.value), a.df.withColumn("_q", v)), a.axes, a.value, a.dtype)
    if method == "linear":
        value = F.percentile(v, F.lit(float(q)))
    elif skip_nan or n is None:
        # the number of values differs by group: the place of the order statistic is worked out from each group's sorted values
        values = F.sort_array(F.collect_list(v.cast("double")))
        m = F.size(values)
        at = F.least(F.greatest(_VIRTUAL[method](m.cast("double"), float(q), F), F.lit(0.0)), (m - 1).cast("double"))
        low = F.floor(at).cast("int")
        share = at - low
        value = F.get(values, low) * (1 - share) + F.when(share > 0, F.get(values, low + 1) * share).otherwise(0.0)
    else:
        at = float(builtins.min(builtins.max(_VIRTUAL[method](n, q, np), 0), n - 1))
        low, share = int(math.floor(at)), at - math.floor(at)
        value = _percentile_disc((low + 0.5) / n)
        if share:
            value = value * (1 - share) + _percentile_disc((low + 1.5) / n) * share
    if not skip_nan and a.dtype.kind == "f":
        value = F.when(F.bool_or(F.isnan(a.value)), NAN).otherwise(value)
    return reduce_with(named, axis, keepdims, float, lambda _: F.coalesce(value.cast("double"), F.lit(NAN)))


def _sorted_quantile(a: Array, v: Column, q: float, method: str, keepdims: bool, skip_nan: bool) -> Array:
    """A quantile of a whole large array: its order statistics by ranks of a range partitioning, so no task holds all distinct values."""
    cells = a.df.select(v.alias("_v"), (F.isnan(a.value) if a.dtype.kind == "f" else F.lit(False)).alias("_nan")).where(F.col("_v").isNotNull() | (F.col("_nan") & F.lit(not skip_nan)))
    ordered = ranked(cells.groupBy("_v", "_nan").agg(F.count(F.lit(1)).alias("_n")), "_v", "_n")  # a value counts once, however frequent it is
    n = a.df.agg(F.count(v)).first()[0] if skip_nan or None in a.shape_or_none else a.size
    at = float(builtins.min(builtins.max(_VIRTUAL[method](n, q, np), 0), builtins.max(n - 1, 0)))
    low, share = int(math.floor(at)), at - math.floor(at)
    statistic = lambda k: F.max(F.when((F.col("_r") <= k) & (F.col("_r") + F.col("_n") > k), F.col("_v")))
    value = statistic(low) if not share else statistic(low) * (1 - share) + statistic(low + 1) * share
    if not skip_nan:
        value = F.when(F.bool_or("_nan"), NAN).otherwise(value)
    df = ordered.agg(F.coalesce(value, F.lit(NAN)).alias("_q"))
    return Array(df, [Axis(None)] * a.ndim if keepdims else [], F.col("_q"), float)


def percentile(a, q, axis=None, method: str = "linear", **kwargs) -> Array:
    return quantile(a, np.asarray(q) / 100 if not np.isscalar(q) else q / 100, axis, method)


def nanpercentile(a, q, axis=None, method: str = "linear", **kwargs) -> Array:
    return nanquantile(a, np.asarray(q) / 100 if not np.isscalar(q) else q / 100, axis, method)


def median(a, axis=None, keepdims=False) -> Array:
    return quantile(a, 0.5, axis, keepdims=keepdims)


def nanmedian(a, axis=None, keepdims=False) -> Array:
    return nanquantile(a, 0.5, axis, keepdims=keepdims)


def merge_percentiles(finalq, qs, vals, method: str = "linear", Ns=None, **kwargs) -> np.ndarray:
    """Percentiles of a whole from those of its parts, each part weighing as many values as it has: the weighted step function, read at finalq."""
    qs, vals, Ns = [np.asarray(q, float) for q in qs], [np.asarray(v) for v in vals], list(Ns)
    used = [(q, v, n) for q, v, n in zip(qs, vals, Ns, strict=True) if n]
    if not used:
        raise ValueError("no data")
    weights = np.concatenate([np.diff(q, prepend=0.0) * n for q, _, n in used])
    values = np.concatenate([v for _, v, _ in used])
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weights[order])
    wanted = np.asarray(finalq, float) * builtins.sum(n for *_, n in used)
    at = np.clip(np.searchsorted(reached, wanted, side="left" if method in ("lower", "linear") else "right"), 0, len(values) - 1)
    return np.interp(wanted, reached, values[order]) if method == "linear" else values[order][at]


def count_nonzero(a, axis=None) -> Array:
    a = asarray(a)
    return reduce_with(a, axis, False, "int64", lambda v: F.count_if(scalar.truthy(v, a.dtype)))


def ptp(a, axis=None) -> Array:
    from cellgrid.operators.elementwise import elemwise

    return elemwise("subtract", max(a, axis), min(a, axis))


def average(a, axis=None, weights=None, returned=False, keepdims=False):
    from cellgrid.operators.elementwise import broadcast_to, elemwise

    a = asarray(a)
    if weights is None:
        out = mean(a, axis, keepdims=keepdims)
        scale = out.with_value(F.lit(float(_length(a, axis))), float)
        return (out, scale) if returned else out
    w = asarray(weights)
    if w.ndim != a.ndim:
        w = w.with_axes([w.axes[0] if k == axis_number(axis, a.ndim) else Axis(None) for k in range(a.ndim)])
    top = sum(elemwise("multiply", a, w), axis, float, keepdims)
    scale = sum(broadcast_to(w, a.shape), axis, float, keepdims)
    out = elemwise("divide", top, scale)
    return (out, scale) if returned else out


def trace(a, offset=0, axis1=0, axis2=1, dtype=None) -> Array:
    from cellgrid.sources.creation import diagonal

    return sum(diagonal(asarray(a), offset, axis1, axis2), -1, dtype)


def _dense(counts, n: int | None, key: str, value: str, default, dtype) -> Array:
    """Counts by position, completed with rows for the positions that have none."""
    full = active().range(n).select(F.col("id").alias("i0"))
    joined = full.join(counts.select(F.col(key).cast("bigint").alias("i0"), F.col(value).alias("_c")), "i0", "left")
    return from_cells(joined.select("i0", F.coalesce("_c", F.lit(default)).cast(spark_type(np.dtype(dtype))).alias("v")), (n,), dtype)


def bincount(x, weights=None, minlength: int = 0, split_every=None) -> Array:
    """Counts (or weight sums) of 0, 1, ..., up to the largest value or minlength - 1. One aggregate, one number, reads the largest."""
    x = asarray(x)
    frame = x if weights is None else combine(lambda v, w: F.struct(v.alias("v"), w.alias("w")), [x, asarray(weights)], object)
    value = frame.value if weights is None else frame.value["v"]
    counted = frame.df.groupBy(value.cast("bigint").alias("_k")).agg((F.count(F.lit(1)) if weights is None else F.sum(frame.value["w"])).alias("_n"))
    top = counted.agg(F.max("_k")).first()[0]
    n = builtins.max(minlength, 0 if top is None else int(top) + 1)
    return _dense(counted, n, "_k", "_n", 0, "int64" if weights is None else float)


def _edges(a: Array, bins, range) -> np.ndarray:
    if not np.isscalar(bins):
        return np.asarray(bins, float)
    if range is None:
        row = a.df.agg(F.min(a.value).cast("double").alias("a"), F.max(a.value).cast("double").alias("b")).first()
        range = (row["a"], row["b"]) if row["a"] is not None else (0.0, 1.0)
    lo, hi = map(float, range)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return np.linspace(lo, hi, int(bins) + 1)


def bin_of(v: Column, edges: np.ndarray) -> Column:
    """The bin of each value: half-open, the last closed; null outside. Equal bins by arithmetic, mended by one where it rounds over an edge; others by a binary search over literals."""
    v = scalar.real(v).cast("double")
    n, low, high = len(edges) - 1, float(edges[0]), float(edges[-1])
    if n > 16 and np.array_equal(edges, np.linspace(low, high, n + 1)):
        step = (high - low) / n
        edge = lambda k: F.when(k >= n, high).otherwise(k * F.lit(step) + low)
        guess = F.least(F.greatest(F.floor((v - low) / step), F.lit(0)), F.lit(n - 1))
        found = F.when(v < edge(guess), guess - 1).when((v >= edge(guess + 1)) & (guess < n - 1), guess + 1).otherwise(guess)
        return F.when((v >= low) & (v <= high) & ~F.isnan(v), found)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(v >= float(edges[mid]), search(mid, hi)).otherwise(search(lo, mid - 1))

    return F.when((v >= float(edges[0])) & (v <= float(edges[-1])) & ~F.isnan(v), search(0, len(edges) - 2))


def histogram(a, bins=10, range=None, weights=None, density: bool = False, normed=None):
    """(counts, edges)."""
    counts, edges = histogramdd([a], [bins], [range] if range is not None else None, weights, density)
    return (counts if density or weights is not None else astype(counts, "int64")), edges[0]


def histogram2d(x, y, bins=10, range=None, weights=None, density: bool = False, normed=None):
    counts, edges = histogramdd([x, y], [bins, bins] if np.isscalar(bins) else bins, range, weights, density)
    return counts, edges[0], edges[1]


def histogramdd(sample, bins=10, range=None, weights=None, density: bool = False, normed=None):
    from cellgrid.operators.elementwise import align
    from cellgrid.sources.creation import grid

    if isinstance(sample, Array):
        sample = [sample[:, k] for k in builtins.range(sample.shape[1])]
    sample = [asarray(s) for s in sample]
    bins = [bins] * len(sample) if np.isscalar(bins) else list(bins)
    ranges = [None] * len(sample) if range is None else list(range)
    edges = [_edges(s, b, r) for s, b, r in zip(sample, bins, ranges, strict=True)]
    frame, values = align([*sample, *([asarray(weights)] if weights is not None else [])])
    names = [f"i{k}" for k in builtins.range(len(sample))]
    binned = frame.df.select(*[bin_of(v, e).cast("bigint").alias(n) for v, e, n in zip(values, edges, names, strict=False)], (values[-1] if weights is not None else F.lit(1)).alias("_w"))
    counted = binned.dropna(subset=names).groupBy(*names).agg((F.sum("_w") if weights is not None else F.count(F.lit(1))).alias("_n"))
    shape = tuple(len(e) - 1 for e in edges)
    dtype = np.dtype(float)
    places = grid(shape).cells().drop("v").join(counted, names, "left").select(*names, F.coalesce("_n", F.lit(0)).cast(spark_type(dtype)).alias("v"))
    out = from_cells(places, shape, dtype)
    if density:
        total = sum(out, keepdims=True)
        for k, e in enumerate(edges):
            width = np.diff(e).reshape([-1 if j == k else 1 for j in builtins.range(len(edges))])
            out = out / asarray(width)
        out = out / total
    return out, [asarray(e) for e in edges]


def coarsen(reduction, x: Array, axes: dict, trim_excess: bool = False, **kwargs) -> Array:
    """Reduces blocks of axes[k] cells along axis k: a group by the position divided by the factor."""
    sizes, out_axes, df = list(x.shape_or_none), list(x.axes), x.df
    inner = []
    for k, f in axes.items():
        k = axis_number(k, x.ndim)
        if sizes[k] % f:
            if not trim_excess:
                raise ValueError(f"axis {k} of {sizes[k]} cells is not a multiple of {f}")
            x = x[(slice(None),) * k + (slice(0, sizes[k] // f * f),)]
            df, out_axes, sizes = x.df, list(x.axes), list(x.shape_or_none)
        outer, within = fresh(), fresh()
        position = out_axes[k].position
        df = df.withColumn(outer, F.call_function("div", position, F.lit(f)).cast("bigint")).withColumn(within, F.pmod(position, F.lit(f)).cast("bigint"))
        out_axes[k] = Axis(outer, 0, sizes[k] // f)
        inner.append(Axis(within, 0, f))
    name = getattr(reduction, "__name__", str(reduction))
    by = globals().get({"amin": "min", "amax": "max"}.get(name, name))
    y = Array(df, [*out_axes, *inner], x.value, x.dtype)
    return by(y, axis=tuple(builtins.range(len(out_axes), len(out_axes) + len(inner))), **kwargs)


def unique(ar, return_index=False, return_inverse=False, return_counts=False):
    """Sorted distinct values; optionally their first positions, each cell's number among them, and their counts. All values that are not a number count as one.

    Numbers are given by ranges of values, so no task sorts all of them."""
    from cellgrid.operators.shape import ravel

    x = ravel(asarray(ar))
    cells = x.cells()
    table = cells.groupBy("v").agg(F.min("i0").alias("first"), F.count(F.lit(1)).alias("n"))
    table = ranked(table, "v")
    make = lambda column, dtype: Array(table.select(F.col("_r").alias("i0"), F.col(column).alias("v")), [Axis("i0", 0, None)], F.col("v"), dtype)
    out = [make("v", x.dtype)]
    if return_index:
        out.append(make("first", "int64"))
    if return_inverse:
        back = cells.join(table.select("v", "_r"), cells["v"].eqNullSafe(table["v"])).select("i0", F.col("_r").alias("v"))
        out.append(from_cells(back, x.shape_or_none, "int64"))
    if return_counts:
        out.append(make("n", "int64"))
    return out[0] if len(out) == 1 else tuple(out)


def _parts(df, by: str):
    """df with `_p`, a number of ranges of the values `by` in their order, and whether it is held in memory. Numbers are dealt by bounds taken from an approximate percentile, so the ranges are
    the same each time the frame is read; other values by Spark's range partitioning, which is not, so that frame is held."""
    if df.schema[by].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bounds = df.agg(F.percentile_approx(by, [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else None
        if not bounds:
            return df.withColumn("_p", F.lit(0))
        edges = F.array(*[F.lit(b) for b in sorted(set(bounds))])
        return df.withColumn("_p", F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col(by))), F.lit(0)))
    return df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()).persist()


def ranked(df, by: str, weight: str | None = None):
    """Adds `_r`, how many rows (or how much weight) come before, in the order of the distinct `by` values: sums within ranges of values, and the sums of the ranges before."""
    one = F.lit(1) if weight is None else F.col(weight)
    parts = _parts(df, by)
    sizes = parts.groupBy("_p").agg(F.sum(one).alias("_m"))
    before = sizes.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_b"))
    inside = parts.withColumn("_w", F.sum(one).over(Window.partitionBy("_p").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) - one)
    return inside.join(F.broadcast(before), "_p").withColumn("_r", (F.col("_w") + F.col("_b")).cast("bigint")).drop("_p", "_w", "_b")


def union1d(ar1, ar2) -> Array:
    from cellgrid.operators.combine import concatenate
    from cellgrid.operators.shape import ravel

    return unique(concatenate([ravel(asarray(ar1)), ravel(asarray(ar2))]))


def _top(a, k: int, axis: int, index: bool) -> Array:
    """The |k| largest (k > 0, descending) or smallest (k < 0, ascending) along an axis, ties by position. A rank filter, which each task applies before the shuffle."""
    a = asarray(a)
    at = axis_number(axis, a.ndim)
    n = builtins.min(abs(k), a.axes[at].size if a.axes[at].size is not None else abs(k))
    cells = a.cells()
    others = [f"i{j}" for j in builtins.range(a.ndim) if j != at]
    order = [F.desc("v") if k > 0 else F.asc("v"), F.asc(f"i{at}")]
    if others:
        ranks = cells.withColumn("_r", F.row_number().over(Window.partitionBy(*others).orderBy(*order)) - 1).where(F.col("_r") < n)
    else:
        best = cells.orderBy(*order).limit(n)
        ranks = best.withColumn("_r", F.row_number().over(Window.orderBy(*order)) - 1)  # at most |k| rows
    value = F.col(f"i{at}") if index else F.col("v")
    picked = ranks.select(*[F.col("_r").cast("bigint").alias(f"i{j}") if j == at else F.col(f"i{j}") for j in builtins.range(a.ndim)], value.alias("v"))
    return from_cells(picked, [n if j == at else s for j, s in enumerate(a.shape_or_none)], "int64" if index else a.dtype)


def topk(a, k: int, axis: int = -1, split_every=None) -> Array:
    return _top(a, k, axis, False)


def argtopk(a, k: int, axis: int = -1, split_every=None) -> Array:
    return _top(a, k, axis, True)


def searchsorted(a, v, side: str = "left", sorter=None) -> Array:
    """Where each value would go in the sorted array. Few edges: a broadcast range of counts; many: both are ordered together and edges counted by ranges."""
    a, v = asarray(a), asarray(v)
    if sorter is not None:
        a = a[asarray(sorter)]
    n = a.shape_or_none[0]
    if n is not None and n <= 4096:
        from cellgrid.operators.elementwise import digitize

        edges = a.compute()  # at most 4096 values
        return digitize(v, edges, right=side == "left") if len(edges) < 2 or edges[0] <= edges[-1] else digitize(v, np.sort(edges), right=side == "left")
    from cellgrid.operators.shape import flat_position

    place = 1 if side == "left" else -1
    points = v.df.select(v.value.alias("v"), F.lit(0).alias("s"), flat_position(v).alias("p"))
    both = a.df.select(a.value.alias("v"), F.lit(place).alias("s"), F.lit(None).cast("bigint").alias("p")).union(points)
    parts = both.repartitionByRange("v", "s").withColumn("_p", F.spark_partition_id()).persist()
    sizes = parts.groupBy("_p").agg(F.count_if(F.col("s") != 0).alias("_m"))
    before = sizes.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_b"))
    within = F.count_if(F.col("s") != 0).over(Window.partitionBy("_p").orderBy("v", "s").rowsBetween(Window.unboundedPreceding, 0))
    found = parts.withColumn("_w", within).join(F.broadcast(before), "_p").where("s = 0").select(F.col("p").alias("i0"), (F.col("_w") + F.col("_b")).cast("bigint").alias("v"))
    from cellgrid.operators.shape import reshape

    flat = from_cells(found, (v.size,), "int64")
    return flat if v.ndim == 1 else reshape(flat, v.shape)


def cov(m, y=None, rowvar=True, bias=False, ddof=None, fweights=None, aweights=None) -> Array:
    """Covariance of the variables (rows): the product of the centred matrix with itself."""
    from cellgrid.operators.combine import vstack
    from cellgrid.operators.elementwise import elemwise
    from cellgrid.operators.linalg import dot
    from cellgrid.operators.shape import atleast_2d, transpose

    m = atleast_2d(asarray(m))
    m = m if rowvar or m.shape[0] == 1 else transpose(m)
    if y is not None:
        y = atleast_2d(asarray(y))
        m = vstack([m, y if rowvar or y.shape[0] == 1 else transpose(y)])
    m = astype(m, float)
    ddof = (0 if bias else 1) if ddof is None else ddof
    w = None
    if fweights is not None or aweights is not None:
        w = np.ones(m.shape[1])
        w = w * (np.asarray(fweights) if fweights is not None else 1) * (np.asarray(aweights) if aweights is not None else 1)
        total = w.sum()
        scale = total - ddof * ((w * np.asarray(aweights)).sum() / total if aweights is not None else 1)
        centre = average(m, 1, w, keepdims=True)
    else:
        centre, scale = mean(m, 1, keepdims=True), float(m.shape[1] - ddof)
    x = elemwise("subtract", m, centre).settled()
    right = transpose(x if w is None else elemwise("multiply", x, asarray(w)).settled())
    out = dot(x, right)
    out = out.with_value(out.value / F.lit(float(scale)))
    return out if out.shape != (1, 1) else out[0, 0]


def corrcoef(x, y=None, rowvar=True) -> Array:
    from cellgrid.operators.elementwise import elemwise
    from cellgrid.operators.shape import expand_dims
    from cellgrid.sources.creation import diag

    c = cov(x, y, rowvar).settled()
    d = elemwise("sqrt", diag(c)).settled()
    return elemwise("divide", elemwise("divide", c, expand_dims(d, 1)), expand_dims(d, 0))


def reduction(x, chunk, aggregate, axis=None, keepdims=False, dtype=None, combine_with=None, **kwargs) -> Array:
    """A reduction by NumPy kernels: chunk on each block, then aggregate over the blocks' results (kernels take axis= and keepdims=)."""
    from cellgrid.operators.blocks import tree_reduction

    return tree_reduction(asarray(x), chunk, aggregate, axis, keepdims, dtype, combine_with)


def arg_reduction(x, chunk, combine, agg, axis=None, keepdims=False, **kwargs) -> Array:
    return {"argmin": argmin, "argmax": argmax, "nanargmin": nanargmin, "nanargmax": nanargmax}[getattr(agg, "__name__", str(agg))](x, axis, keepdims)


