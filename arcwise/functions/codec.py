"""Code lengths, zig-zag and time buckets as column expressions. All divisions truncate towards zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    return F.call_function("div", _col(a), b if isinstance(b, Column) else F.lit(b))


def int2nat(x) -> Column:
    x = _col(x)
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def nat2int(x) -> Column:
    x = _col(x)
    return F.when(x % 2 == 0, div(x, 2)).otherwise(-div(x, 2) - 1)


def log2_floor(x) -> Column:
    """Binary logarithm of a positive whole number, rounded down, without floating point."""
    return (F.length(F.bin(_col(x))) - 1).cast("bigint")


def unary_bits(x) -> Column:
    return _col(x) + 1


def gamma_bits(x) -> Column:
    return 2 * log2_floor(_col(x) + 1) + 1


def delta_bits(x) -> Column:
    size = log2_floor(_col(x) + 1)
    return size + gamma_bits(size)


def nibble_bits(x) -> Column:
    """Three data bits and a stop bit in each group of four; zero takes one group."""
    return F.when(_col(x) == 0, 4).otherwise(4 * (div(log2_floor(F.greatest(_col(x), F.lit(1))), 3) + 1)).cast("bigint")


def golomb_bits(x, b: int) -> Column:
    """Unary quotient and minimal binary remainder."""
    size = max(b - 1, 0).bit_length()
    short = (1 << size) - b
    rest = _col(x) % b
    return div(x, b) + 1 + (F.when(rest < short, size - 1).otherwise(size) if b > 1 else F.lit(0)).cast("bigint")


def zeta_bits(x, k) -> Column:
    """Length of the zeta code with shrinking factor k, a number or a column."""
    k = k if isinstance(k, Column) else F.lit(k)
    n = _col(x) + 1
    h = div(log2_floor(n), k)
    # n >= 2 * 2**(h * k), told by the logarithms.
    return h + 1 + h * k + k - 1 + (log2_floor(n) >= h * k + 1).cast("bigint")


def bucket(ts, factor) -> Column:
    """Time rounded to a multiple of the factor; a factor under 1 is an error."""
    if isinstance(factor, int) and factor < 1:
        raise ValueError("the aggregation factor must be 1 or more")
    return bucket_index(ts, factor) * factor


def bucket_index(ts, factor) -> Column:
    return div(ts, factor)


def bucket_difference(a, b, factor) -> Column:
    return bucket_index(b, factor) - bucket_index(a, factor)


def bucket_reverse(before, difference, factor) -> Column:
    return _col(before) + _col(difference) * factor


def elias_fano_bits(n, upper) -> Column:
    """Bits of n monotone values up to ``upper``: low bits, unary high bits."""
    n, upper = _col(n), _col(upper)
    low = F.when((n > 0) & (upper >= n), log2_floor(F.greatest(div(upper, F.greatest(n, F.lit(1))), F.lit(1)))).otherwise(0)
    return n * low + n + F.floor(upper / F.pow(F.lit(2.0), low)).cast("bigint")
