"""Contractions and factorisations.

Products join on the contracted positions and sum by the kept ones; `blocks=` multiplies dense blocks instead. Tall matrices are factored by QR of row
blocks and of the stacked R factors, in a tree. Square factorisations hold the matrix in one task; its size is checked against MAX_LOCAL_CELLS.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cellgrid.core import Array, Axis, axis_numbers, fresh, from_cells, spark_type
from cellgrid.functions import scalar
from cellgrid.operators.blocks import fill, schema_of, spread
from cellgrid.operators.elementwise import asarray, crossed, elemwise, result_type
from cellgrid.operators.shape import expand_dims, ravel, transpose

#: Cells that one task may hold for a square factorisation (half a gigabyte of doubles).
MAX_LOCAL_CELLS = 1 << 26
#: Rows of a block of a tall matrix, and R factors stacked at a time.
ROWS, FAN = 8192, 16


def einsum(subscripts: str, *operands, dtype=None, **kwargs) -> Array:
    """Labels shared by operands join them; labels that the result lacks are summed. Repeated labels of one operand take its diagonal."""
    operands = [asarray(a) for a in operands]
    left, arrow, out = subscripts.replace(" ", "").partition("->")
    terms = left.split(",")
    if "..." in left:
        spare = [c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in subscripts]
        width = max(a.ndim - len(t.replace("...", "")) for a, t in zip(operands, terms, strict=True) if "..." in t)
        free = "".join(spare[:width])
        terms = [t.replace("...", free[width - (a.ndim - len(t.replace("...", ""))) :] if "..." in t else "") for a, t in zip(operands, terms, strict=True)]
        out = out.replace("...", free) if arrow else free + "".join(sorted(c for c in set("".join(terms)) - set(free) if "".join(terms).count(c) == 1))
        arrow = "->"
    if not arrow:
        out = "".join(sorted(c for c in set("".join(terms)) if "".join(terms).count(c) == 1))
    dtype = np.dtype(dtype) if dtype is not None else result_type(*operands)
    joined, have, sizes, names, product = None, {}, {}, {}, None
    for a, t in zip(operands, terms, strict=True):
        df, own = a.df, {}
        value = fresh("v")
        selected = []
        for c, axis in zip(t, a.axes, strict=True):
            n = axis.size
            if sizes.get(c, 1) == 1:
                sizes[c] = n
            elif n not in (1, sizes[c]):
                raise ValueError(f"label {c} has sizes {sizes[c]} and {n}")
            if c in own:
                df = df.where(axis.position == own[c])
            elif axis.col is not None and n != 1:
                own[c] = axis.position
        for c, p in own.items():
            names.setdefault(c, fresh("e"))
            selected.append(p.alias(names[c]))
        side = df.select(*selected, a.value.alias(value))
        product = F.col(value) if product is None else _times(product, F.col(value), dtype)
        if joined is None:
            joined = side
        else:
            on = [names[c] for c in own if c in have]
            joined = joined.join(side, on) if on else crossed(joined, _cells(have, sizes), side, _cells(own, sizes))
        have.update(dict.fromkeys(own))
    keys = [names[c] for c in out if c in have]
    if dtype.kind == "c":
        total = scalar.complex_of(F.sum(product["re"]), F.sum(product["im"]))
    else:
        total = F.bool_or(product) if dtype.kind == "b" else F.sum(product)
    result = fresh("r")
    df = joined.groupBy(*keys).agg(total.alias(result)) if keys else joined.agg(total.alias(result))
    return Array(df, [Axis(names[c] if c in have else None, 0, sizes[c]) for c in out], F.col(result).cast(spark_type(dtype)), dtype)


def _cells(labels, sizes: dict) -> int | None:
    """How many cells positions by these labels make; None if a size is unknown."""
    return None if any(sizes[c] is None for c in labels) else math.prod(sizes[c] for c in labels)


def _times(a, b, dtype: np.dtype):
    if dtype.kind == "c":
        both = np.dtype(complex)
        return scalar.COMPLEX["multiply"](a, b, both, both)
    return a & b if dtype.kind == "b" else a * b


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def tensordot(lhs, rhs, axes=2) -> Array:
    lhs, rhs = asarray(lhs), asarray(rhs)
    if np.isscalar(axes):
        axes = (list(range(lhs.ndim - axes, lhs.ndim)), list(range(axes)))
    left, right = ([x] if np.isscalar(x) else list(x) for x in axes)
    left, right = axis_numbers(left, lhs.ndim), axis_numbers(right, rhs.ndim)
    a = list(_LETTERS[: lhs.ndim])
    b = list(_LETTERS[lhs.ndim : lhs.ndim + rhs.ndim])
    for i, j in zip(left, right, strict=True):
        b[j] = a[i]
    out = [c for k, c in enumerate(a) if k not in left] + [c for k, c in enumerate(b) if k not in right]
    return einsum(f"{''.join(a)},{''.join(b)}->{''.join(out)}", lhs, rhs)


def dot(a, b) -> Array:
    a, b = asarray(a), asarray(b)
    if a.ndim == 0 or b.ndim == 0:
        return elemwise("multiply", a, b)
    return tensordot(a, b, ([a.ndim - 1], [max(0, b.ndim - 2)]))


def vdot(a, b) -> Array:
    from cellgrid.operators.elementwise import conj

    return dot(ravel(conj(asarray(a))), ravel(asarray(b)))


def matmul(a, b, blocks: int | None = None) -> Array:
    """Batch axes broadcast. blocks: side of the dense blocks to multiply (two-dimensional operands)."""
    a, b = asarray(a), asarray(b)
    if a.ndim == 0 or b.ndim == 0:
        raise ValueError("matmul takes no scalars")
    if blocks and a.ndim == b.ndim == 2:
        return _block_product(a, b, blocks)
    one, two = a.ndim == 1, b.ndim == 1
    batch = max(a.ndim, b.ndim) - 2
    letters = _LETTERS[: max(0, batch)]
    left = ("k" if one else letters[max(0, batch - (a.ndim - 2)) :] + "ik") if batch >= 0 else "k"
    right = ("k" if two else letters[max(0, batch - (b.ndim - 2)) :] + "kj") if batch >= 0 else "k"
    left, right = left.replace("i", "I").replace("k", "K"), right.replace("j", "J").replace("k", "K")
    return einsum(f"{left},{right}->{letters if batch > 0 else ''}{'' if one else 'I'}{'' if two else 'J'}", a, b)


def _block_product(a: Array, b: Array, side: int) -> Array:
    """Cells become blocks, blocks meet by their contracted number, products are summed by result block."""
    (n, m), p = a.shape_or_none, b.shape_or_none[1]
    dtype = result_type(a, b)
    da, db = a.dtype, b.dtype
    div = lambda c: F.call_function("div", F.col(c), F.lit(side)).cast("int")
    across, down = -(-p // side), -(-n // side)
    left = a.cells().select("i0", "i1", "v", div("i0").alias("r"), div("i1").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    right = b.cells().select("i0", "i1", "v", div("i1").alias("c"), div("i0").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"))

    def kernel(key, x, y):
        r, k, c = (v.as_py() for v in key)
        inner = min(side, m - k * side)
        left = fill(x, ["i0", "i1"], [r * side, k * side], (min(side, n - r * side), inner), da)
        right = fill(y, ["i0", "i1"], [k * side, c * side], (inner, min(side, p - c * side)), db)
        return spread(left @ right, [r * side, c * side], dtype)

    parts = left.groupBy("r", "k", "c").cogroup(right.groupBy("r", "k", "c")).applyInArrow(kernel, schema_of(2, dtype))
    return from_cells(parts.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (n, p), dtype)


def outer(a, b) -> Array:
    a, b = ravel(asarray(a)), ravel(asarray(b))
    return elemwise("multiply", expand_dims(a, 1), expand_dims(b, 0))


def norm(x, ord=None, axis=None, keepdims: bool = False) -> Array:
    from cellgrid.operators import reductions as r

    x = asarray(x)
    size = elemwise("absolute", x)
    if axis is None and ord is None:
        return elemwise("sqrt", r.sum(elemwise("multiply", size, size), None, float, keepdims))
    axes = axis_numbers(axis, x.ndim)
    if len(axes) == 1:
        if ord in (None, 2):
            return elemwise("sqrt", r.sum(elemwise("multiply", size, size), axes, float, keepdims))
        if ord == np.inf:
            return r.max(size, axes, keepdims)
        if ord == -np.inf:
            return r.min(size, axes, keepdims)
        if ord == 0:
            return r.sum(elemwise("not_equal", x, 0), axes, float, keepdims)
        return elemwise("power", r.sum(elemwise("power", size, float(ord)), axes, float, keepdims), 1.0 / ord)
    if ord in (None, "fro"):
        return elemwise("sqrt", r.sum(elemwise("multiply", size, size), axes, float, keepdims))
    if ord in (1, -1, np.inf, -np.inf):
        first, second = (axes[0], axes[1]) if abs(ord) == 1 else (axes[1], axes[0])
        sums = r.sum(size, first, float, True)
        out = (r.max if ord > 0 else r.min)(sums, second, True)
        return out if keepdims else out.with_axes([a for k, a in enumerate(out.axes) if k not in axes])
    s = svd(x, compute_uv=False)
    pick = {2: r.max, -2: r.min, "nuc": r.sum}[ord]
    return pick(s)


# -- tall matrices -------------------------------------------------------------------------------------------------------------------------------------------
def _rows(a: Array):
    """(i0, row): the rows of a matrix as arrays in the order of their columns."""
    cells = a.cells()
    return cells.groupBy("i0").agg(F.transform(F.array_sort(F.collect_list(F.struct("i1", "v"))), lambda s: s["v"].cast("double")).alias("row"))


def _r_factor(a: Array) -> np.ndarray:
    """R of a tall matrix: QR of row blocks, then of FAN stacked factors at a time; one small factor reaches the driver."""
    n = a.shape_or_none[1]

    def factor(key, table):
        x = np.stack([np.asarray(r) for r in table["row"].to_pylist()]) if table.num_rows else np.zeros((0, n))
        r = np.linalg.qr(x, mode="r")
        return pa.table({"g": pa.array([key[0].as_py()] * len(r), pa.int64()), "row": pa.array(r.tolist(), pa.list_(pa.float64()))})

    factors = _rows(a).withColumn("g", F.call_function("div", F.col("i0"), F.lit(ROWS)).cast("bigint")).groupBy("g").applyInArrow(factor, "g long, row array<double>")
    groups = -(-a.shape_or_none[0] // ROWS)
    while groups > 1:
        factors = factors.withColumn("g", F.call_function("div", F.col("g"), F.lit(FAN)).cast("bigint")).groupBy("g").applyInArrow(factor, "g long, row array<double>")
        groups = -(-groups // FAN)
    rows = factors.collect()  # at most the number of columns
    return np.array([r["row"] for r in rows], float).reshape(-1, n)


def _signs(r: np.ndarray) -> np.ndarray:
    d = np.sign(np.diag(r))
    return np.where(d == 0, 1.0, d)


def _times_small(a: Array, m: np.ndarray) -> Array:
    """A tall matrix times a small one, row by row."""
    n, k = a.shape_or_none[0], m.shape[1]
    m = np.ascontiguousarray(m)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ m
            i = np.repeat(batch.column("i0").to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.tile(np.arange(k), batch.num_rows)), pa.array(x.reshape(-1))], names=["i0", "i1", "v"])

    return from_cells(_rows(a).mapInArrow(run, schema_of(2, np.dtype(float))), (n, k), float)


def tsqr(data, compute_svd: bool = False, **kwargs):
    """Q and R of a tall matrix. R by the tree; Q = A R^-1, corrected once by the R factor of Q itself, which restores orthogonality."""
    a = asarray(data)
    if a.shape[0] < a.shape[1]:
        raise ValueError("the matrix has fewer rows than columns")
    r1 = _r_factor(a)
    if np.linalg.matrix_rank(r1) < r1.shape[1]:
        return _svd_from_r(a, r1) if compute_svd else _local(a, lambda x: np.linalg.qr(x), [(a.shape[0], a.shape[1]), (a.shape[1], a.shape[1])])
    q = _times_small(a, np.linalg.inv(r1))
    r2 = _r_factor(q)
    r = r2 @ r1
    s = _signs(r)
    q = _times_small(q, np.linalg.inv(r2) * s)
    r = s[:, None] * r
    if compute_svd:
        u, d, vh = np.linalg.svd(r)
        return _times_small(q, u), asarray(d), asarray(vh)
    return q, asarray(r)


def _svd_from_r(a: Array, r: np.ndarray):
    return _local(a, lambda x: np.linalg.svd(x, full_matrices=False), [(a.shape[0], r.shape[1]), (r.shape[1],), (r.shape[1], r.shape[1])])


def sfqr(data, **kwargs):
    """Short and wide: Q and R0 of the first square block, then Q^T times the rest."""
    a = asarray(data)
    m, n = a.shape
    first, rest = a[:, :m], a[:, m:]
    q, r = tsqr(first)
    if n == m:
        return q, r
    from cellgrid.operators.combine import hstack

    return q, hstack([r, dot(transpose(q), rest)])


def qr(a, mode: str = "reduced"):
    a = asarray(a)
    return tsqr(a) if a.shape[0] >= a.shape[1] else sfqr(a)


def svd(a, full_matrices: bool = False, compute_uv: bool = True, coerce_signs: bool = True):
    """Thin decomposition; the sign of each pair makes the sum of the row of vh non-negative."""
    if full_matrices:
        raise NotImplementedError("full_matrices=True")
    a = asarray(a)
    wide = a.shape[0] < a.shape[1]
    x = transpose(a) if wide else a
    if not compute_uv:
        return asarray(np.linalg.svd(_r_factor(x), compute_uv=False))
    u, s, vh = tsqr(x, compute_svd=True)
    small = vh.compute()
    sign = np.where(small.sum(axis=1) < 0, -1.0, 1.0)
    u, vh = _times_small(u, np.diag(sign)), asarray(sign[:, None] * small)
    return (transpose(vh), s, transpose(u)) if wide else (u, s, vh)


def compression_level(n: int, q: int, n_oversamples: int = 10, min_subspace_size: int = 20) -> int:
    return min(max(min_subspace_size, q + n_oversamples), n)


def compression_matrix(data, q: int, iterator: str = "power", n_power_iter: int = 0, n_oversamples: int = 10, seed=None, **kwargs) -> Array:
    """An orthonormal basis (transposed) of about the range of the data: a random projection, sharpened by power or QR steps."""
    a = asarray(data)
    width = compression_level(min(a.shape), q, n_oversamples)
    omega = np.random.default_rng(seed).standard_normal((a.shape[1], width))
    y = _times_small(a, omega)
    for _ in range(n_power_iter):
        if iterator == "QR":
            y, _ = tsqr(y)
        z = dot(transpose(a), y).compute()  # columns of the data by width
        z, _ = np.linalg.qr(z)
        y = _times_small(a, z)
    return transpose(tsqr(y)[0])


def svd_compressed(a, k: int, iterator: str = "power", n_power_iter: int = 0, n_oversamples: int = 10, seed=None, compute: bool = False, coerce_signs: bool = True):
    a = asarray(a)
    basis = compression_matrix(a, k, iterator, n_power_iter, n_oversamples, seed)
    small = dot(basis, a).compute()
    u, s, vh = np.linalg.svd(small, full_matrices=False)
    sign = np.where(vh.sum(axis=1) < 0, -1.0, 1.0)
    return _times_small(transpose(basis), (u * sign)[:, :k]), asarray(s[:k]), asarray((vh * sign[:, None])[:k])


# -- square matrices -----------------------------------------------------------------------------------------------------------------------------------------
def _local(a: Array, func, shapes: list[tuple], *others: Array, dtype=float) -> tuple[Array, ...]:
    """Results of a kernel that needs whole matrices, in one task."""
    arrays = [a, *others]
    cells = sum(x.size for x in arrays)
    if cells > MAX_LOCAL_CELLS:
        raise MemoryError(f"{cells} cells; at most {MAX_LOCAL_CELLS} are held by one task")
    frame = None
    for j, x in enumerate(arrays):
        part = x.cells()
        part = part.select(F.lit(j).alias("w"), F.col("i0"), (F.col("i1") if x.ndim > 1 else F.lit(0).cast("bigint")).alias("i1"), F.col("v").cast("double").alias("v"))
        frame = part if frame is None else frame.union(part)
    sizes = [x.shape_or_none if x.ndim > 1 else (x.shape_or_none[0], 1) for x in arrays]
    vector = [x.ndim == 1 for x in arrays]

    def kernel(table: pa.Table) -> pa.Table:
        which = table["w"].to_numpy()
        inputs = []
        for j, (n, m) in enumerate(sizes):
            x = fill(table.filter(pa.array(which == j)), ["i0", "i1"], [0, 0], (n, m), np.dtype(float))
            inputs.append(x[:, 0] if vector[j] else x)
        out = func(*inputs)
        out = out if isinstance(out, tuple) else (out,)
        parts = []
        for j, o in enumerate(out):
            o = np.asarray(o, float)
            o = o.reshape(o.shape[0], -1) if o.ndim else o.reshape(1, 1)
            t = spread(o, [0, 0], np.dtype(float))
            parts.append(t.append_column("o", pa.array(np.full(t.num_rows, j, np.int32))))
        return pa.concat_tables(parts)

    done = frame.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(kernel, "i0 bigint, i1 bigint, v double, o int")
    results = []
    for j, shape in enumerate(shapes):
        part = done.where(F.col("o") == j)
        axes = [Axis("i0", 0, shape[0]), Axis("i1", 0, shape[1])] if len(shape) == 2 else [Axis("i0", 0, shape[0])] if len(shape) == 1 else []
        results.append(Array(part, axes, F.col("v"), float))
    return tuple(results)


def cholesky(a, lower: bool = False) -> Array:
    a = asarray(a)
    return _local(a, lambda x: np.linalg.cholesky(x) if lower else np.linalg.cholesky(x).T, [a.shape])[0]


def _lu(a: np.ndarray):
    n = len(a)
    u, l, p = a.copy(), np.eye(n), np.arange(n)
    for k in range(n - 1):
        i = k + int(np.argmax(np.abs(u[k:, k])))
        if i != k:
            u[[k, i]], p[[k, i]] = u[[i, k]], p[[i, k]]
            l[[k, i], :k] = l[[i, k], :k]
        if u[k, k]:
            l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
    return np.eye(n)[:, p], l, np.triu(u)


def lu(a) -> tuple[Array, Array, Array]:
    """a = p l u with partial pivoting."""
    a = asarray(a)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("a square matrix is needed")
    return _local(a, _lu, [a.shape] * 3)


def solve_triangular(a, b, lower: bool = False) -> Array:
    a, b = asarray(a), asarray(b)
    return _local(a, lambda x, y: np.linalg.solve(np.tril(x) if lower else np.triu(x), y), [b.shape], b)[0]


def solve(a, b, sym_pos=None, assume_a: str = "gen") -> Array:
    a, b = asarray(a), asarray(b)

    def by_cholesky(x, y):
        low = np.linalg.cholesky(x)
        return np.linalg.solve(low.T, np.linalg.solve(low, y))

    return _local(a, by_cholesky if sym_pos or assume_a == "pos" else np.linalg.solve, [b.shape], b)[0]


def inv(a) -> Array:
    a = asarray(a)
    return _local(a, np.linalg.inv, [a.shape])[0]


def lstsq(a, b):
    """(x, residuals, rank, singular values) of a tall system, by R of the matrix with b beside it, so rows are read once."""
    from cellgrid.operators.combine import hstack

    a, b = asarray(a), asarray(b)
    m, n = a.shape
    both = hstack([a, expand_dims(b, 1) if b.ndim == 1 else b])
    r = _r_factor(both)
    r = np.vstack([r, np.zeros((max(0, both.shape[1] - len(r)), both.shape[1]))])
    x, _, rank, s = np.linalg.lstsq(r[:n, :n], r[:n, n:], rcond=None)
    rest = (r[n:, n:] ** 2).sum(axis=0) + ((r[:n, :n] @ x - r[:n, n:]) ** 2).sum(axis=0)
    x = x[:, 0] if b.ndim == 1 else x
    return asarray(x), asarray(rest if m > n and rank == n else np.zeros(0)), asarray(np.array(rank)), asarray(s)
