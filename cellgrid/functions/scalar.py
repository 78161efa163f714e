"""Scalar functions with NumPy's results: not-a-number, division by zero, floor division, rounding half to even, shifts.

Each takes Columns and their dtypes and returns a Column; the caller casts it to the result's dtype. Integer overflow raises, as Spark's ANSI mode does,
and does not wrap.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def real(x: Column) -> Column:
    return x.cast("double")


def truthy(x: Column, dtype: np.dtype) -> Column:
    if dtype.kind == "b":
        return x
    if dtype.kind == "O":
        return x != ""
    return F.isnan(x) | (x != 0) if dtype.kind == "f" else x != 0


def isnan(x: Column, dtype: np.dtype) -> Column:
    return F.isnan(x) if dtype.kind == "f" else F.isnan(x["re"]) | F.isnan(x["im"]) if dtype.kind == "c" else F.lit(False)


def _nan2(x, y, dx, dy):
    return isnan(x, dx) | isnan(y, dy)


def divide(x: Column, y: Column, dx=None, dy=None) -> Column:
    x, y = real(x), real(y)
    # 0.0 and -0.0 differ in the sign of the infinity that they give; the text of -0.0 starts with a minus
    sign = F.when(y.cast("string").startswith("-"), -INF).otherwise(INF)
    return F.when(y == 0, F.when((x == 0) | F.isnan(x), NAN).otherwise(F.signum(x) * sign)).otherwise(x / F.when(y != 0, y))


def floor_divide(x: Column, y: Column, dx: np.dtype, dy: np.dtype) -> Column:
    if dx.kind in "iub" and dy.kind in "iub":
        x, y = x.cast("bigint"), y.cast("bigint")
        safe = F.when(y != 0, y)
        remainder = x % safe
        return F.coalesce(F.call_function("div", x, safe) - F.when((remainder != 0) & ((remainder < 0) != (safe < 0)), 1).otherwise(0), F.lit(0).cast("bigint"))
    x, y = real(x), real(y)
    whole = _floor((x - remainder_of(x, y)) / F.when(y != 0, y) + 0.5)
    beyond = F.when((x == 0) | ((x < 0) == (y < 0)), 0.0).otherwise(-1.0)
    return F.when(y == 0, divide(x, y)).when(F.isnan(x) | F.isnan(y) | (F.abs(x) == INF), NAN).when(F.abs(y) == INF, beyond).otherwise(whole)


def _floor(x: Column) -> Column:
    """floor as a double; what has no fraction (2^52 and beyond, infinities, not-a-number) stays."""
    return F.when((F.abs(x) < 4503599627370496.0) & ~F.isnan(x), F.floor(F.when((F.abs(x) < 4503599627370496.0) & ~F.isnan(x), x)).cast("double")).otherwise(x)


def remainder_of(x: Column, y: Column) -> Column:
    rest = x % F.when(y != 0, y)
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)


def remainder(x: Column, y: Column, dx: np.dtype, dy: np.dtype) -> Column:
    if dx.kind in "iub" and dy.kind in "iub":
        return F.coalesce(remainder_of(x.cast("bigint"), y.cast("bigint")), F.lit(0).cast("bigint"))
    x, y = real(x), real(y)
    return F.when(_nan2(x, y, np.dtype(float), np.dtype(float)) | (y == 0) | (F.abs(x) == INF), NAN).when(F.abs(y) == INF, F.when((x == 0) | ((x < 0) == (y < 0)), x).otherwise(y)).otherwise(remainder_of(x, y))


def power(x: Column, y: Column, dx: np.dtype, dy: np.dtype) -> Column:
    return F.pow(real(x), real(y))


def _log(f, at_zero: float = 0.0):
    def log(x: Column, dx=None) -> Column:
        x = real(x)
        shifted = x - at_zero
        # not-a-number counts as more than 0; null stays null
        return F.when(shifted > 0, f(F.when(shifted > 0, x))).when(shifted == 0, -INF).when(shifted < 0, NAN)

    return log


def logaddexp(x: Column, y: Column, dx=None, dy=None) -> Column:
    x, y = real(x), real(y)
    top = F.greatest(x, y)
    return F.when((x == y) & (F.abs(x) == INF), x).otherwise(top + F.log1p(F.exp(-F.abs(x - y))))


def logaddexp2(x: Column, y: Column, dx=None, dy=None) -> Column:
    return logaddexp(real(x) * math.log(2), real(y) * math.log(2)) / math.log(2)


def maximum(x, y, dx, dy):
    if dx.kind == "b" and dy.kind == "b":
        return x | y
    return F.greatest(*_common(x, y, dx, dy))


def minimum(x, y, dx, dy):
    if dx.kind == "b" and dy.kind == "b":
        return x & y
    a, b = _common(x, y, dx, dy)
    return F.when(_nan2(x, y, dx, dy), F.lit(NAN)).otherwise(F.least(a, b)) if "f" in (dx.kind, dy.kind) else F.least(a, b)


def fmax(x, y, dx, dy):
    a, b = _common(x, y, dx, dy)
    return F.when(isnan(x, dx), b).when(isnan(y, dy), a).otherwise(F.greatest(a, b))


def fmin(x, y, dx, dy):
    return F.least(*_common(x, y, dx, dy))


def _common(x, y, dx, dy):
    if dx.kind == "f" or dy.kind == "f":
        return real(x), real(y)
    if dx.kind == "b" or dy.kind == "b":
        return x.cast("bigint"), y.cast("bigint")
    return x, y


def _compare(op: str):
    def compare(x, y, dx, dy):
        a, b = _common(x, y, dx, dy) if "O" not in (dx.kind, dy.kind) else (x, y)
        plain = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
        if "f" not in (dx.kind, dy.kind):
            return plain
        nan = _nan2(x, y, dx, dy)
        return nan | plain if op == "!=" else ~nan & plain

    return compare


def _shift(left: bool):
    def shift(x, y, dx, dy):
        x, y = x.cast("bigint"), y.cast("int")
        wide = (y < 0) | (y >= 64)
        moved = F.call_function("shiftleft" if left else "shiftright", x, F.when(wide, 0).otherwise(y))
        return F.when(wide, F.lit(0).cast("bigint") if left else F.when(x < 0, -1).otherwise(0).cast("bigint")).otherwise(moved)

    return shift


def _bits(name: str, logical):
    def op(x, y, dx, dy):
        if dx.kind == "b" and dy.kind == "b":
            return logical(x, y)
        return getattr(x.cast("bigint"), name)(y.cast("bigint"))

    return op


def bround(x: Column, decimals: int = 0) -> Column:
    return F.bround(x, decimals)


def rint(x: Column, dx=None) -> Column:
    return F.rint(real(x))


def isclose(x, y, rtol=1e-5, atol=1e-8, equal_nan=False) -> Column:
    x, y = real(x), real(y)
    nan, infinite = F.isnan(x) | F.isnan(y), (F.abs(x) == INF) | (F.abs(y) == INF)
    close = F.when(infinite, x == y).otherwise(F.abs(x - y) <= atol + rtol * F.abs(y))
    both = F.isnan(x) & F.isnan(y) if equal_nan else F.lit(False)
    return F.when(nan, both).otherwise(close)


def spacing(x: Column, dx=None) -> Column:
    return F.pow(F.lit(2.0), F.floor(F.log2(F.abs(real(x)))) - 52)


def unary(f):
    return lambda x, dx=None: f(real(x))


#: name: function of (columns..., dtypes...)
UFUNCS = {
    "add": lambda x, y, dx, dy: x | y if (dx.kind, dy.kind) == ("b", "b") else x + y,
    "subtract": lambda x, y, dx, dy: x - y,
    "multiply": lambda x, y, dx, dy: x & y if (dx.kind, dy.kind) == ("b", "b") else x * y,
    "divide": divide,
    "true_divide": divide,
    "logaddexp": logaddexp,
    "logaddexp2": logaddexp2,
    "floor_divide": floor_divide,
    "remainder": remainder,
    "mod": remainder,
    "fmod": lambda x, y, dx, dy: F.when(real(y) == 0, NAN).otherwise(real(x) % F.when(real(y) != 0, real(y))),
    "negative": lambda x, dx: -x,
    "positive": lambda x, dx: x,
    "power": power,
    "float_power": power,
    "absolute": lambda x, dx: F.abs(x),
    "fabs": unary(F.abs),
    "sign": lambda x, dx: F.when(isnan(x, dx), x).otherwise(F.signum(real(x))),
    "rint": rint,
    "floor": lambda x, dx: _floor(real(x)),
    "ceil": lambda x, dx: -_floor(-real(x)),
    "trunc": lambda x, dx: F.when(real(x) < 0, -_floor(-real(x))).otherwise(_floor(real(x))),
    "fix": lambda x, dx: F.when(real(x) < 0, -_floor(-real(x))).otherwise(_floor(real(x))),
    "exp": unary(F.exp),
    "exp2": unary(lambda x: F.pow(F.lit(2.0), x)),
    "log": _log(F.ln),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
    "log1p": _log(F.log1p, -1.0),
    "expm1": unary(F.expm1),
    "sqrt": unary(F.sqrt),
    "square": lambda x, dx: x * x,
    "cbrt": unary(F.cbrt),
    "reciprocal": lambda x, dx: divide(F.lit(1.0), x),
    "sin": unary(F.sin),
    "cos": unary(F.cos),
    "tan": unary(F.tan),
    "arcsin": unary(F.asin),
    "arccos": unary(F.acos),
    "arctan": unary(F.atan),
    "arctan2": lambda x, y, dx, dy: F.atan2(real(x), real(y)),
    "hypot": lambda x, y, dx, dy: F.hypot(real(x), real(y)),
    "sinh": unary(F.sinh),
    "cosh": unary(F.cosh),
    "tanh": unary(F.tanh),
    "arcsinh": unary(F.asinh),
    "arccosh": unary(F.acosh),
    "arctanh": unary(F.atanh),
    "deg2rad": unary(F.radians),
    "radians": unary(F.radians),
    "rad2deg": unary(F.degrees),
    "degrees": unary(F.degrees),
    "sinc": lambda x, dx: F.when(real(x) == 0, 1.0).otherwise(F.sin(real(x) * math.pi) / F.when(real(x) != 0, real(x) * math.pi)),
    "i0": None,
    "greater": _compare(">"),
    "greater_equal": _compare(">="),
    "less": _compare("<"),
    "less_equal": _compare("<="),
    "not_equal": _compare("!="),
    "equal": _compare("=="),
    "logical_and": lambda x, y, dx, dy: truthy(x, dx) & truthy(y, dy),
    "logical_or": lambda x, y, dx, dy: truthy(x, dx) | truthy(y, dy),
    "logical_xor": lambda x, y, dx, dy: truthy(x, dx) != truthy(y, dy),
    "logical_not": lambda x, dx: ~truthy(x, dx),
    "maximum": maximum,
    "minimum": minimum,
    "fmax": fmax,
    "fmin": fmin,
    "bitwise_and": _bits("bitwiseAND", lambda x, y: x & y),
    "bitwise_or": _bits("bitwiseOR", lambda x, y: x | y),
    "bitwise_xor": _bits("bitwiseXOR", lambda x, y: x != y),
    "invert": lambda x, dx: ~x if dx.kind == "b" else F.bitwise_not(x),
    "left_shift": _shift(True),
    "right_shift": _shift(False),
    "isfinite": lambda x, dx: ~isnan(x, dx) & (F.abs(x) != INF) if dx.kind == "f" else F.lit(True),
    "isinf": lambda x, dx: F.abs(x) == INF if dx.kind == "f" else F.lit(False),
    "isnan": isnan,
    "isneginf": lambda x, dx: x == -INF if dx.kind == "f" else F.lit(False),
    "isposinf": lambda x, dx: x == INF if dx.kind == "f" else F.lit(False),
    "signbit": lambda x, dx: x.cast("string").startswith("-") if dx.kind == "f" else x < 0,
    "copysign": lambda x, y, dx, dy: F.abs(real(x)) * F.when(real(y).cast("string").startswith("-"), -1.0).otherwise(1.0),
    "ldexp": lambda x, y, dx, dy: real(x) * F.pow(F.lit(2.0), y),
    "isreal": lambda x, dx: x["im"] == 0 if dx.kind == "c" else F.lit(True),
    "iscomplex": lambda x, dx: x["im"] != 0 if dx.kind == "c" else F.lit(False),
    "nextafter": None,
    "spacing": spacing,
}
UFUNCS["abs"] = UFUNCS["absolute"]
UFUNCS["bitwise_not"] = UFUNCS["invert"]
for _name in ("i0", "nextafter"):
    UFUNCS.pop(_name)


def complex_parts(x: Column, dtype: np.dtype) -> tuple[Column, Column]:
    return (x["re"], x["im"]) if dtype.kind == "c" else (real(x), F.lit(0.0))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _c_mul(x, y, dx, dy):
    (a, b), (c, d) = complex_parts(x, dx), complex_parts(y, dy)
    return complex_of(a * c - b * d, a * d + b * c)


def _c_div(x, y, dx, dy):
    (a, b), (c, d) = complex_parts(x, dx), complex_parts(y, dy)
    n = c * c + d * d
    return complex_of(divide(a * c + b * d, n), divide(b * c - a * d, n))


def _c_each(op):
    def f(x, y, dx, dy):
        (a, b), (c, d) = complex_parts(x, dx), complex_parts(y, dy)
        return complex_of(op(a, c), op(b, d))

    return f


#: The same for operands of which one is complex.
COMPLEX = {
    "add": _c_each(lambda a, b: a + b),
    "subtract": _c_each(lambda a, b: a - b),
    "multiply": _c_mul,
    "divide": _c_div,
    "true_divide": _c_div,
    "negative": lambda x, dx: complex_of(-x["re"], -x["im"]),
    "positive": lambda x, dx: x,
    "absolute": lambda x, dx: F.hypot(x["re"], x["im"]),
    "abs": lambda x, dx: F.hypot(x["re"], x["im"]),
    "square": lambda x, dx: _c_mul(x, x, dx, dx),
    "exp": lambda x, dx: complex_of(F.exp(x["re"]) * F.cos(x["im"]), F.exp(x["re"]) * F.sin(x["im"])),
    "isnan": isnan,
    "isreal": UFUNCS["isreal"],
    "iscomplex": UFUNCS["iscomplex"],
    "equal": lambda x, y, dx, dy: (complex_parts(x, dx)[0] == complex_parts(y, dy)[0]) & (complex_parts(x, dx)[1] == complex_parts(y, dy)[1]),
    "not_equal": lambda x, y, dx, dy: ~COMPLEX["equal"](x, y, dx, dy),
}
