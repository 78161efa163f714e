"""The array interface against NumPy, on small inputs with ties, not-a-number, negative and empty cases."""

import warnings

import numpy as np
import pytest

import cellgrid as cg

warnings.filterwarnings("ignore")
RNG = np.random.default_rng(0)
A = np.arange(24.0).reshape(4, 6) % 7 - 2
N = np.where(A == 1, np.nan, A)
I = np.arange(20).reshape(4, 5) % 6 - 2
B = I > 0
V = np.array([3.0, -1.0, 2.0, 2.0, 7.0, 0.0, -4.0])
W = np.where(V == 2, np.nan, V)
Z = np.array([1.5, np.nan, np.inf, -np.inf, 0.0, -0.0, -2.5, 3.0])
Y = np.array([2.0, 1.0, np.inf, 3.0, 0.0, 1.0, -0.7, -2.0])
C = V[:4] + 1j * V[3:]
T3 = np.arange(60.0).reshape(3, 4, 5) % 11

CASES = {}


def case(f):
    CASES[f.__name__] = f
    return f


def table(names, *args):
    for name in names.split():
        key = name
        while key in CASES:
            key += "_"
        CASES[key] = lambda m, w, name=name: getattr(m, name)(*[w(a) for a in args])


table("exp exp2 expm1 sqrt square cbrt sin cos tan sinh cosh tanh arcsinh arctan deg2rad rad2deg fabs absolute sign rint floor ceil trunc negative isnan isinf isfinite signbit log log2 log10 log1p reciprocal isneginf isposinf", Z)
table("arcsin arccos arctanh", np.array([-1.5, -1.0, -0.3, 0.0, 0.5, 1.0]))
table("arccosh", np.array([0.5, 1.0, 2.0]))
table("add subtract multiply divide true_divide floor_divide remainder mod maximum minimum fmax fmin greater greater_equal less less_equal equal not_equal logical_and logical_or logical_xor arctan2 hypot logaddexp logaddexp2 copysign fmod", Z, Y)
table("add subtract multiply divide floor_divide remainder bitwise_and bitwise_or bitwise_xor maximum equal less", np.array([7, -7, 7, -7, 0, 3]), np.array([2, 2, -2, -2, 3, 3]))
table("left_shift right_shift", np.array([1, 5, -9]), np.array([3, 2, 1]))
table("logical_not invert", np.array([True, False]))
table("invert negative absolute square", np.array([0, 5, -6]))
table("logical_and logical_or logical_xor add multiply bitwise_and maximum", np.array([True, True, False]), np.array([True, False, False]))
table("power float_power", np.array([0.0, 2.0, -2.0, 9.0]), np.array([-1.0, 3.0, 2.0, 0.5]))
table("power", np.array([7, -7, 2]), np.array([2, 3, 0]))
table("ldexp", np.array([1.0, 3.0]), np.array([2, -1]))
for name in "sum prod min max any all mean var std argmin argmax median ptp count_nonzero".split():
    for tag, axis in (("", None), ("_0", 0), ("_1", 1)):
        CASES[f"{name}{tag}_f"] = lambda m, w, n=name, a=axis: getattr(m, n)(w(A), axis=a)
        CASES[f"{name}{tag}_nan"] = lambda m, w, n=name, a=axis: getattr(m, n)(w(N), axis=a)
    CASES[f"{name}_i"] = lambda m, w, n=name: getattr(m, n)(w(I), axis=1)
for name in "nansum nanprod nanmin nanmax nanmean nanvar nanstd nanmedian nanargmin nanargmax".split():
    for tag, axis in (("", None), ("_0", 0), ("_1", 1)):
        CASES[f"{name}{tag}"] = lambda m, w, n=name, a=axis: getattr(m, n)(w(N), axis=a)
for name in "sum mean max".split():
    CASES[f"{name}_keep"] = lambda m, w, n=name: getattr(m, n)(w(T3), axis=(0, 2), keepdims=True)
for d in (1, 2):
    CASES[f"var_ddof{d}"] = lambda m, w, d=d: m.var(w(A), axis=1, ddof=d)
    CASES[f"std_ddof{d}"] = lambda m, w, d=d: m.nanstd(w(N), axis=0, ddof=d)
for method in "linear lower higher nearest midpoint inverted_cdf hazen weibull median_unbiased normal_unbiased interpolated_inverted_cdf averaged_inverted_cdf closest_observation".split():
    CASES[f"quantile_{method}"] = lambda m, w, k=method: m.quantile(w(A), [0.0, 0.1, 0.25, 0.5, 0.77, 1.0], axis=1, method=k)
CASES["percentile"] = lambda m, w: m.percentile(w(V), [5, 50, 95])
CASES["nanpercentile"] = lambda m, w: m.nanpercentile(w(N), 40, axis=0)
CASES["quantile_nan"] = lambda m, w: m.quantile(w(N), 0.5, axis=1)
for name in "cumsum cumprod nancumsum nancumprod".split():
    for tag, axis in (("", None), ("_0", 0), ("_1", 1)):
        CASES[f"{name}{tag}"] = lambda m, w, n=name, a=axis: getattr(m, n)(w(N if n.startswith("nan") else A), axis=a)
CASES["cumsum_bool"] = lambda m, w: m.cumsum(w(B), axis=0)
for n in (1, 2, 3):
    CASES[f"diff{n}"] = lambda m, w, n=n: m.diff(w(A), n, axis=1)
CASES["diff_ends"] = lambda m, w: m.diff(w(A), axis=0, prepend=0.0, append=w(A[:2]))
CASES["diff_bool"] = lambda m, w: m.diff(w(B), axis=0)
CASES["ediff1d"] = lambda m, w: m.ediff1d(w(A), to_end=9.0, to_begin=np.array([1.0, 2.0]))
CASES["gradient"] = lambda m, w: m.gradient(w(V), 2.0)
CASES["gradient2"] = lambda m, w: m.gradient(w(A), 0.5, edge_order=2, axis=1)
CASES["gradient_xy"] = lambda m, w: m.gradient(w(A))
CASES["gradient_at"] = lambda m, w: m.gradient(w(V), np.array([0.0, 1, 3, 4, 8, 9, 11]))
SLICES = [np.s_[1], np.s_[-1], np.s_[1:3], np.s_[::-1], np.s_[::2, ::-2], np.s_[3:0:-1, 1], np.s_[..., 2:4], np.s_[None, 1:], np.s_[:, None, 3], np.s_[5:2], np.s_[:, [3, 0, 0, -1]], np.s_[[True, False, True, False]], np.s_[2:][:1] if False else np.s_[2:, -3:], np.s_[[-1, 1]], np.s_[::-1, ::-1]]
for j, s in enumerate(SLICES):
    CASES[f"getitem{j}"] = lambda m, w, s=s: w(A)[s]
CASES["slice_slice"] = lambda m, w: w(V)[1:][2:5][::2]
CASES["mask"] = lambda m, w: w(A)[w(A) > 1]
CASES["mask1"] = lambda m, w: w(V)[w(V) > 1]
CASES["take"] = lambda m, w: m.take(w(A), [[0, -1], [2, 2]], axis=1)
CASES["compress"] = lambda m, w: m.compress([False, True, True], w(A), axis=0)
CASES["extract"] = lambda m, w: m.extract(w(A) > 2, w(A))
CASES["nonzero"] = lambda m, w: m.nonzero(w(I))
CASES["argwhere"] = lambda m, w: m.argwhere(w(I) > 1)
CASES["flatnonzero"] = lambda m, w: m.flatnonzero(w(I))
CASES["append"] = lambda m, w: m.append(w(A), w(A[:1]), axis=0)
CASES["append_flat"] = lambda m, w: m.append(w(A), w(V))
for obj in (1, [0, 3], slice(1, 3), [-1, 1]):
    CASES[f"delete_{obj}"] = lambda m, w, o=obj: m.delete(w(A), o, axis=1)
for obj in (1, [0, 3, 3], 4):
    CASES[f"insert_{obj}"] = lambda m, w, o=obj: m.insert(w(A), o, -9.0, axis=0)
CASES["insert_values"] = lambda m, w: m.insert(w(V), [1, 1, 4], w(np.array([9.0, 8.0, 7.0])), axis=0)
CASES["where"] = lambda m, w: m.where(w(A) > 0, w(A), -1.0)
CASES["where_mixed"] = lambda m, w: m.where(w(B), 1, w(A[:, :5]))
CASES["where_one"] = lambda m, w: m.where(w(I) > 2)
CASES["select"] = lambda m, w: m.select([w(A) < 0, w(A) < 2], [w(A) * 10, w(A) * 100], -5)
CASES["piecewise"] = lambda m, w: m.piecewise(w(V), [w(V) < 0, w(V) >= 2], [-1.0, lambda x: x * 2, 5.0])
CASES["choose"] = lambda m, w: m.choose(w(np.array([0, 2, 1])), [w(V[:3]), w(V[1:4]), 9.0])
CASES["clip"] = lambda m, w: m.clip(w(N), -1, 2)
CASES["round"] = lambda m, w: m.round(w(np.array([0.5, 1.5, 2.5, -0.5, 2.345, -7.125])), 0)
CASES["round2"] = lambda m, w: m.around(w(np.array([0.125, 2.375, -7.125])), 2)
for right in (False, True):
    CASES[f"digitize_{right}"] = lambda m, w, r=right: m.digitize(w(A), np.array([-1.0, 0.0, 2.5, 4.0]), right=r)
    CASES[f"digitize_down_{right}"] = lambda m, w, r=right: m.digitize(w(A), np.array([4.0, 2.0, 0.0]), right=r)
for side in ("left", "right"):
    CASES[f"searchsorted_{side}"] = lambda m, w, s=side: m.searchsorted(w(np.array([-2.0, 0, 0, 3, 3, 9])), w(A), side=s)
CASES["isin"] = lambda m, w: m.isin(w(N), w(np.array([3.0, np.nan, -2.0])))
CASES["isin_invert"] = lambda m, w: m.isin(w(I), w(np.array([1, 2])), invert=True)
CASES["isclose"] = lambda m, w: m.isclose(w(Z), w(Z + 1e-9), equal_nan=True)
CASES["allclose"] = lambda m, w: m.allclose(w(V), w(V + 1e-9))
CASES["nan_to_num"] = lambda m, w: m.nan_to_num(w(Z))
CASES["modf"] = lambda m, w: m.modf(w(np.array([1.5, -2.25, 0.0, 3.0])))
CASES["frexp"] = lambda m, w: m.frexp(w(np.array([1.5, -8.0, 0.0, 0.3, 1e300])))
CASES["divmod"] = lambda m, w: m.divmod(w(np.array([7.5, -7.5])), 2.0) if m is cg else np.divmod(np.array([7.5, -7.5]), 2.0)
for name in "real imag angle conj absolute square exp".split():
    CASES[f"complex_{name}"] = lambda m, w, n=name: getattr(m, n)(w(C))
CASES["complex_math"] = lambda m, w: (w(C) + 2) * w(C) / (w(C) - 1j)
CASES["complex_sum"] = lambda m, w: m.sum(w(C))
CASES["broadcast"] = lambda m, w: w(A) + w(A[0]) * w(A[:, :1]) - w(V)[1]
CASES["broadcast3"] = lambda m, w: w(T3) * w(T3[0, :, :1]) + w(T3[:, :1, :])
CASES["broadcast_to"] = lambda m, w: m.broadcast_to(w(A[:, :1]), (2, 4, 3))
CASES["broadcast_arrays"] = lambda m, w: m.broadcast_arrays(w(V[:3]), w(A[:, :1]))
for name in "transpose ravel flipud fliplr squeeze atleast_1d atleast_2d atleast_3d tril triu rot90".split():
    CASES[f"shape_{name}"] = lambda m, w, n=name: getattr(m, n)(w(A))
CASES["transpose3"] = lambda m, w: m.transpose(w(T3), (1, 2, 0))
CASES["swapaxes"] = lambda m, w: m.swapaxes(w(T3), 0, -1)
CASES["moveaxis"] = lambda m, w: m.moveaxis(w(T3), [0, 1], [-1, 0])
CASES["rollaxis"] = lambda m, w: m.rollaxis(w(T3), 2, 1)
CASES["expand_dims"] = lambda m, w: m.expand_dims(w(A), (0, -1))
CASES["squeeze1"] = lambda m, w: m.squeeze(w(A[:1, None]), 1)
CASES["flip"] = lambda m, w: m.flip(w(T3), (0, 2))
for k in (1, 2, 3, -1):
    CASES[f"rot90_{k}"] = lambda m, w, k=k: m.rot90(w(A), k)
CASES["roll"] = lambda m, w: m.roll(w(A), 3)
CASES["roll_axes"] = lambda m, w: m.roll(w(A), (1, -2), (0, 1))
CASES["reshape"] = lambda m, w: m.reshape(w(A)[:, 1:4], (2, -1, 3))
CASES["repeat"] = lambda m, w: m.repeat(w(A), 3, axis=1)
CASES["repeat_flat"] = lambda m, w: m.repeat(w(V), 2)
CASES["tile"] = lambda m, w: m.tile(w(A), (2, 1, 3))
CASES["tril1"] = lambda m, w: m.tril(w(A), 1)
CASES["triu-1"] = lambda m, w: m.triu(w(A), -1)
CASES["tril_indices"] = lambda m, w: m.tril_indices(4, 1, 5)
CASES["triu_indices_from"] = lambda m, w: m.triu_indices_from(w(A), -1)
CASES["unravel_index"] = lambda m, w: m.unravel_index(w(np.array([0, 7, 23])), (4, 6))
for mode in ("wrap", "clip"):
    CASES[f"ravel_multi_{mode}"] = lambda m, w, k=mode: m.ravel_multi_index([w(np.array([0, 5, -1])), w(np.array([1, 2, 9]))], (4, 6), mode=k)
for mode in "constant edge wrap reflect symmetric linear_ramp maximum mean median minimum".split():
    CASES[f"pad_{mode}"] = lambda m, w, k=mode: m.pad(w(A), ((1, 2), (3, 0)), mode=k)
CASES["pad_values"] = lambda m, w: m.pad(w(A), 2, mode="constant", constant_values=((1, 2), (3, 4)))
for mode in ("reflect", "symmetric"):
    CASES[f"pad_odd_{mode}"] = lambda m, w, k=mode: m.pad(w(A), ((1, 2), (3, 2)), mode=k, reflect_type="odd")


def fill_with(vector, width, axis, kwargs):
    vector[: width[0]] = kwargs.get("padder", 10)
    vector[len(vector) - width[1] :] = vector[width[0]]


CASES["pad_callable"] = lambda m, w: m.pad(w(A), 2, fill_with, padder=5.0)
CASES["pad_long"] = lambda m, w: m.pad(w(V[:3]), (7, 5), mode="reflect")
CASES["concatenate"] = lambda m, w: m.concatenate([w(A), w(I[:, :2]), w(A)], axis=1)
CASES["concat_slice"] = lambda m, w: m.concatenate([w(V), w(V * 2), w(V * 3)])[8:12]
CASES["concat_back"] = lambda m, w: m.concatenate([w(V), w(V * 2), w(V * 3)])[12:3:-2]
for k in (0, 1, -1):
    CASES[f"stack{k}"] = lambda m, w, k=k: m.stack([w(A), w(A * 2)], axis=k)
for name in "vstack hstack dstack".split():
    CASES[name] = lambda m, w, n=name: getattr(m, n)([w(A), w(A + 1)])
    CASES[name + "1"] = lambda m, w, n=name: getattr(m, n)([w(V), w(V + 1)])
CASES["block"] = lambda m, w: m.block([[w(A), w(A[:, :1])], [w(A[:1]), w(A[:1, :1])]])
CASES["dot"] = lambda m, w: m.dot(w(A), w(A.T))
CASES["dot1"] = lambda m, w: m.dot(w(V), w(V))
CASES["dot3"] = lambda m, w: m.dot(w(T3), w(T3[0].T))
CASES["matmul"] = lambda m, w: m.matmul(w(T3), w(T3[0].T))
CASES["matmul1"] = lambda m, w: m.matmul(w(A), w(A[0]))
CASES["matmul_batch"] = lambda m, w: m.matmul(w(T3), m.transpose(w(T3), (0, 2, 1)))
CASES["vdot"] = lambda m, w: m.vdot(w(C), w(C * 2))
CASES["outer"] = lambda m, w: m.outer(w(V), w(A))
CASES["tensordot"] = lambda m, w: m.tensordot(w(T3), w(T3), axes=([0, 2], [0, 2]))
for s in ("ij,kj->ik", "ij->ji", "ij->", "ij,ij->i", "ij,i->j", "ij,kj", "i...->..."):
    CASES[f"einsum_{s}"] = lambda m, w, s=s: m.einsum(s, *[w(A), w(A[:, 0]) if s.startswith("ij,i-") else w(A)][: s.split("->")[0].count(",") + 1])
CASES["einsum_trace"] = lambda m, w: m.einsum("ii->i", w(A[:, :4]))
CASES["einsum3"] = lambda m, w: m.einsum("ij,jk,kl->il", w(A[:2]), w(A.T), w(A))
CASES["trace"] = lambda m, w: m.trace(w(A), 1)
CASES["cov"] = lambda m, w: m.cov(w(A))
CASES["cov_cols"] = lambda m, w: m.cov(w(A), rowvar=False, ddof=0)
CASES["cov_y"] = lambda m, w: m.cov(w(V), w(V * V))
CASES["corrcoef"] = lambda m, w: m.corrcoef(w(A))
CASES["average"] = lambda m, w: m.average(w(A), axis=1, weights=np.array([1.0, 2, 3, 1, 0, 1]))
CASES["histogram"] = lambda m, w: m.histogram(w(A), bins=5, range=(-1, 4))
CASES["histogram_edges"] = lambda m, w: m.histogram(w(V), bins=np.array([-4.0, 0, 2, 7]), density=True)
CASES["histogram_weights"] = lambda m, w: m.histogram(w(V), bins=3, range=(-4, 7), weights=w(V))
CASES["histogram2d"] = lambda m, w: m.histogram2d(w(V), w(V[::-1].copy()), bins=[2, 3], range=[(-4, 7), (-4, 7)])
CASES["histogramdd"] = lambda m, w: m.histogramdd(w(np.abs(A[:, :3])), bins=2, range=[(0, 4)] * 3)[0]
CASES["bincount"] = lambda m, w: m.bincount(w(np.array([2, 1, 5, 2, 1])), minlength=8)
CASES["bincount_w"] = lambda m, w: m.bincount(w(np.array([2, 1, 5, 2, 1])), weights=w(V[:5]))
CASES["unique"] = lambda m, w: m.unique(w(I), return_index=True, return_inverse=True, return_counts=True) if m is cg else tuple(np.ravel(x) for x in np.unique(I, return_index=True, return_inverse=True, return_counts=True))
CASES["union1d"] = lambda m, w: m.union1d(w(I), w(np.array([99, 1])))
CASES["eye"] = lambda m, w: m.eye(4, 5, k=-1)
CASES["tri"] = lambda m, w: m.tri(4, 5, 1)
CASES["diag1"] = lambda m, w: m.diag(w(V), -2)
CASES["diag2"] = lambda m, w: m.diag(w(A), 1)
CASES["diagonal"] = lambda m, w: m.diagonal(w(T3), -1, 2, 0)
CASES["arange"] = lambda m, w: m.arange(3, -4, -1.5)
CASES["linspace"] = lambda m, w: m.linspace(0, 1, 7, endpoint=False)
CASES["full"] = lambda m, w: m.full((2, 3), 7)
CASES["ones_like"] = lambda m, w: m.ones_like(w(A))
CASES["indices"] = lambda m, w: m.indices((2, 3))
CASES["fromfunction"] = lambda m, w: m.fromfunction(lambda i, j: i * 10 + j, (2, 3))
for ix in ("xy", "ij"):
    CASES[f"meshgrid_{ix}"] = lambda m, w, i=ix: m.meshgrid(w(V[:2]), w(V[:3]), indexing=i)
for name in "fft ifft rfft hfft ihfft fftn ifftn rfftn irfftn fft2 irfft".split():
    CASES[f"fft_{name}"] = lambda m, w, n=name: getattr(m.fft, n)(w(A))
CASES["fft_n_axis"] = lambda m, w: m.fft.fft(w(A), 5, axis=0)
CASES["fftfreq"] = lambda m, w: m.fft.fftfreq(7, 0.5)
CASES["rfftfreq"] = lambda m, w: m.fft.rfftfreq(8)
CASES["fftshift"] = lambda m, w: m.fft.fftshift(w(A))
CASES["ifftshift"] = lambda m, w: m.fft.ifftshift(w(V))
for o in (None, 1, np.inf, -np.inf, "fro", 2, "nuc"):
    CASES[f"norm_{o}"] = lambda m, w, o=o: m.linalg.norm(w(A.T), o)
CASES["norm_axis"] = lambda m, w: m.linalg.norm(w(A), 3, axis=1)
S = A[:, :4] @ A[:, :4].T + 10 * np.eye(4)
CASES["inv"] = lambda m, w: m.linalg.inv(w(S))
CASES["solve"] = lambda m, w: m.linalg.solve(w(S), w(A))
CASES["cholesky"] = lambda m, w: m.linalg.cholesky(w(S), lower=True) if m is cg else np.linalg.cholesky(S)
CASES["apply_along_axis"] = lambda m, w: m.apply_along_axis(np.sort, 1, w(A))
CASES["apply_over_axes"] = lambda m, w: m.apply_over_axes(m.sum, w(T3), [0, 2])
CASES["astype"] = lambda m, w: w(np.array([1.7, -1.7, 0.0])).astype("int64")
CASES["sliding_view"] = lambda m, w: (m if m is cg else np.lib.stride_tricks).sliding_window_view(w(A), 3, axis=1)
CASES["empty_sum"] = lambda m, w: m.sum(w(np.zeros((0, 3))), axis=0)


@pytest.mark.parametrize("name", CASES)
def test_parity(spark, name):
    with np.errstate(all="ignore"):
        want = CASES[name](np, lambda a: a)
    got = CASES[name](cg, lambda a: cg.from_array(a) if isinstance(a, np.ndarray) else a)
    pairs = list(zip(got, want, strict=True)) if isinstance(want, (tuple, list)) else [(got, want)]
    for g, w in pairs:
        if isinstance(g, (list, tuple)):
            pairs += list(zip(g, w, strict=True))
            continue
        g, w = g.compute() if isinstance(g, cg.Array) else np.asarray(g), np.asarray(w)
        assert g.shape == w.shape, (g, w)
        assert g.dtype.kind == w.dtype.kind or {g.dtype.kind, w.dtype.kind} <= set("iu"), (g.dtype, w.dtype)
        np.testing.assert_allclose(g, w, rtol=1e-9, atol=1e-9)
