"""Vector and matrix arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def norm_squared(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x) * _d(x))


def l2_normalize(a: Column) -> Column:
    return let(F.sqrt(norm_squared(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, _d(x)).otherwise(_d(x) / n)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _d(x) + _d(y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.when(x > 20, x).when(x < -20, F.exp(x)).otherwise(F.log1p(F.exp(F.least(x, F.lit(20.0)))))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def swiglu(gate: Column, value: Column) -> Column:
    return F.zip_with(gate, value, lambda g, v: silu(_d(g)) * _d(v))


def rms_norm(a: Column, weight: Column | None = None, epsilon: float = 1e-6) -> Column:
    scale = 1 / F.sqrt(norm_squared(a) / F.size(a) + epsilon)
    return let(scale, lambda k: F.transform(a, lambda x: _d(x) * k) if weight is None else F.zip_with(a, weight, lambda x, w: _d(x) * k * _d(w)))


def softmax(a: Column) -> Column:
    """Shifted by the maximum; if all weights vanish they are returned as they are."""
    powers = let(_d(F.array_max(a)), lambda most: F.transform(a, lambda x: F.exp(_d(x) - most)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: F.when(t == 0, x).otherwise(x / t))))


def argmax(a: Column) -> Column:
    """Place of the first maximum, from 0; 0 for an empty array."""
    return F.when(F.size(a) == 0, 0).otherwise(F.array_position(a, F.array_max(a)) - 1).cast("int")


def clamp_tail(a: Column, most: int) -> Column:
    n = F.least(F.size(a), F.lit(most))
    return F.when(n == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, -n, n))


def reshape_heads(a: Column, heads: int, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(a, h * dim + 1, dim))


def flatten_heads(a: Column) -> Column:
    return F.flatten(a)


def mat_vec(rows: Column, x: Column) -> Column:
    """A matrix as an array of rows times a vector."""
    return F.transform(rows, lambda r: dot(r, x))


def orientation(rows: Column, cols: Column, n: Column) -> Column:
    """'row' if the matrix takes n inputs as it is, 'transposed' if by its columns; else an error."""
    return F.when(cols == n, "row").when(rows == n, "transposed").otherwise(F.raise_error(F.format_string("matrix %sx%s does not take %s inputs", rows.cast("string"), cols.cast("string"), n.cast("string"))))


def rotate_pairs(a: Column, offset: Column | int, base: float = 10000.0, factor: float = 1.0) -> Column:
    """Rotary positions: each pair (2k, 2k+1) turned by offset * base^(-2k/n) / factor."""
    n, offset = F.size(a), offset if isinstance(offset, Column) else F.lit(offset)

    def one(x: Column, i: Column) -> Column:
        pair = F.floor(i / 2) * 2
        angle = offset * F.pow(F.lit(base), -pair / n) / factor
        even, odd = _d(F.get(a, pair.cast("int"))), _d(F.get(a, (pair + 1).cast("int")))
        return F.when(i % 2 == 0, even * F.cos(angle) - odd * F.sin(angle)).otherwise(even * F.sin(angle) + odd * F.cos(angle))

    return F.transform(a, one)


def pack_signature(a: Column, dims: int) -> Column:
    """32-bit words of sign bits, lowest bit first; a component of zero counts as positive."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(-(-dims // 32) - 1)),
        lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, b: s + F.when(F.get(a, w * 32 + b) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
    )


def hamming(a: Column, b: Column, words: int | None = None) -> Column:
    """Differing bits; with the number of words given, as a plain sum without lambdas."""
    if words is not None:
        return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(1, words)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
