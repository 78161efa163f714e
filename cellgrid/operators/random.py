"""Random arrays. Cells come in blocks of BLOCK, each drawn by a generator of its own, seeded by (seed, call, block): the same for any partitioning and retry."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cellgrid.core import Array, active, from_cells, strides
from cellgrid.operators.blocks import _column, schema_of
from cellgrid.operators.elementwise import asarray
from cellgrid.sources.creation import shape_of

BLOCK = 1 << 16

DISTRIBUTIONS = (
    "beta binomial chisquare exponential f gamma geometric gumbel hypergeometric laplace logistic lognormal logseries negative_binomial noncentral_chisquare "
    "noncentral_f normal pareto poisson power rayleigh standard_cauchy standard_exponential standard_gamma standard_normal standard_t triangular uniform vonmises wald weibull zipf"
).split()


class Generator:
    """Each call draws from the next stream of the seed."""

    def __init__(self, seed=None):
        self.seed = int(np.random.SeedSequence(seed).generate_state(1, np.uint64)[0] >> np.uint64(1)) if seed is None else int(seed)
        self.calls = 0

    def _draw(self, size, dtype, draw, tail: tuple = ()) -> Array:
        shape = () if size is None else shape_of(size)
        n, seed, call = math.prod(shape), self.seed, self.calls
        self.calls += 1
        out, dtype = (*shape, *tail), np.dtype(dtype)
        width = math.prod(tail)
        steps = strides(out)

        def run(batches):
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    count = min(BLOCK, n - b * BLOCK)
                    rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(call, b)))
                    values = np.asarray(draw(rng, count), dtype).reshape(-1)
                    flat = b * BLOCK * width + np.arange(count * width)
                    index = [(flat // s) % m for s, m in zip(steps, out, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(i.astype(np.int64)) for i in index], _column(values, dtype)], names=[*[f"i{k}" for k in range(len(out))], "v"])

        df = active().range(-(-n // BLOCK)).mapInArrow(run, schema_of(len(out), dtype))
        return from_cells(df, out, dtype)

    def random(self, size=None, dtype=float) -> Array:
        return self._draw(size, dtype, lambda rng, n: rng.random(n))

    random_sample = sample = ranf = random

    def integers(self, low, high=None, size=None, dtype="int64", endpoint: bool = False) -> Array:
        return self._draw(size, dtype, lambda rng, n: rng.integers(low, high, n, endpoint=endpoint))

    randint = integers

    def random_integers(self, low, high=None, size=None) -> Array:
        low, high = (1, low) if high is None else (low, high)
        return self.integers(low, high, size, endpoint=True)

    def tomaxint(self, size=None) -> Array:
        return self.integers(0, np.iinfo("int64").max, size, endpoint=True)

    def seed_with(self, seed) -> None:
        self.seed, self.calls = int(seed), 0

    def multinomial(self, n, pvals, size=None) -> Array:
        return self._draw(1 if size is None else size, "int64", lambda rng, m: rng.multinomial(n, pvals, m), (len(pvals),))

    def multivariate_hypergeometric(self, colors, nsample, size=None, method: str = "marginals") -> Array:
        return self._draw(1 if size is None else size, "int64", lambda rng, m: rng.multivariate_hypergeometric(colors, nsample, m, method=method), (len(colors),))

    def choice(self, a, size=None, replace: bool = True, p=None, axis: int = 0, shuffle: bool = True) -> Array:
        """With replacement: positions drawn block by block. Without: the first `size` of a permutation."""
        from cellgrid.operators.indexing import take

        n = int(a) if np.isscalar(a) else asarray(a).shape[0]
        if replace:
            at = self._draw(size, "int64", lambda rng, m: rng.choice(n, m, p=p))
        elif p is not None:
            at = asarray(np.random.default_rng(self.seed + self.calls).choice(n, size, replace=False, p=p))
        else:
            at = self.permutation(n)[: math.prod(shape_of(size or 1))]
        return at if np.isscalar(a) else take(asarray(a), at, axis)

    def permutation(self, x, axis: int = 0) -> Array:
        """Rows in the order of a hash of their position: ranks by ranges of hashes, so no task sorts them all."""
        from cellgrid.operators.indexing import take
        from cellgrid.operators.reductions import ranked

        n = int(x) if np.isscalar(x) else asarray(x).shape[axis]
        keys = active().range(n).withColumn("h", F.struct(F.xxhash64(F.col("id"), F.lit(self.seed), F.lit(self.calls)).alias("h"), F.col("id").alias("p")))
        self.calls += 1
        order = ranked(keys.select("h"), "h").select(F.col("_r").alias("i0"), F.col("h.p").alias("v"))
        at = from_cells(order, (n,), "int64")
        return at if np.isscalar(x) else take(asarray(x), at, axis)

    shuffle = permutation


def _distribution(name: str):
    kind = np.asarray(getattr(np.random.default_rng(0), name)(*{"hypergeometric": (2, 2, 2), "triangular": (0, 1, 2), "noncentral_f": (1, 1, 1)}.get(name, _sample_args(name)))).dtype

    def draw(self, *args, size=None, **kwargs) -> Array:
        # NumPy takes size last by position as well
        if size is None and len(args) > _arity(name):
            *args, size = args
        return self._draw(size, kind, lambda rng, n: getattr(rng, name)(*args, size=n, **kwargs))

    draw.__name__ = name
    return draw


def _arity(name: str) -> int:
    import inspect

    text = (getattr(np.random.Generator, name).__doc__ or "").strip().split("\n", 1)[0]
    try:
        return len([p for p in inspect.signature(getattr(np.random.default_rng(0), name)).parameters if p not in ("size", "dtype", "out", "method")])
    except (TypeError, ValueError):
        inside = text[text.index("(") + 1 : text.rindex(")")] if "(" in text else ""
        return len([p for p in inside.split(",") if p.strip() and p.split("=")[0].strip() not in ("size", "dtype", "out", "method")])


def _sample_args(name: str) -> tuple:
    return {0: (), 1: (0.5,), 2: (1, 0.5), 3: (1, 1, 1)}[min(3, _required(name))]


# fixed values: how many arguments each distribution needs
_REQUIRED = {"beta": 2, "binomial": 2, "chisquare": 1, "f": 2, "gamma": 1, "geometric": 1, "hypergeometric": 3, "logseries": 1, "negative_binomial": 2, "noncentral_chisquare": 2, "noncentral_f": 3, "pareto": 1, "power": 1, "standard_gamma": 1, "standard_t": 1, "triangular": 3, "vonmises": 2, "wald": 2, "weibull": 1, "zipf": 1}


def _required(name: str) -> int:
    return _REQUIRED.get(name, 0)


for _name in DISTRIBUTIONS:
    if _name == "zipf":
        Generator.zipf = lambda self, a, size=None: self._draw(size, "int64", lambda rng, n: rng.zipf(a, n))
    else:
        setattr(Generator, _name, _distribution(_name))


class RandomState(Generator):
    """The older interface: the same draws, with rand and randn."""

    def rand(self, *shape) -> Array:
        return self.random(shape)

    def randn(self, *shape) -> Array:
        return self.standard_normal(size=shape)


def default_rng(seed=None) -> Generator:
    return Generator(seed)


_state = RandomState()


def seed(value=None) -> None:
    global _state
    _state = RandomState(value)


def __getattr__(name: str):
    """Module-level functions draw from one shared state."""
    if name.startswith("_") or not hasattr(RandomState, name):
        raise AttributeError(name)
    return lambda *args, **kwargs: getattr(_state, name)(*args, **kwargs)
