"""Column expressions: cleaning, binning, calendar parts, encodings and guarded arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Text to double; what cannot be read becomes null."""
    return F.trim(c).try_cast("double")


def zero_is_missing(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def finite_or_null(c: Column) -> Column:
    """NaN and infinities are missing values here, as NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b with a zero divisor giving null."""
    return a / F.nullif(b, F.lit(0))


def safe_log(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


def ieee_log(c: Column) -> Column:
    """Logarithm by IEEE rules: minus infinity at zero (of either sign), NaN below; null stays null."""
    return F.when(c > 0, F.log(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def label(c: Column, names: dict) -> Column:
    """Code to label by a literal map; unknown codes become null."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), c)


def bins(c: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins (lo, hi]; outside values become null. Without labels: bin number from 0."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = (c > F.lit(float(lo))) & (c <= F.lit(float(hi)))
        value = F.lit(labels[i] if labels else i)
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Keep within bounds; null stays null."""
    out = c
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def season(ts: Column) -> Column:
    names = F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "fall")])
    return F.element_at(names, (F.floor((F.month(ts) % 12) / 3) + 1).cast("int"))


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a place in a cycle."""
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def fourier(pos: Column, origin: int | Column, terms: Sequence[tuple[float, int]]) -> dict[str, Column]:
    """Harmonics of each (period, count), measured from ``origin``.

    The origin is required: training and test rows must measure phase from the same slot.
    """
    t = pos - (F.lit(origin) if isinstance(origin, int) else origin)
    out = {}
    for period, count in terms:
        for k in range(1, count + 1):
            angle = t * (2 * math.pi * k / period)
            out[f"sin_{period:g}_{k}"], out[f"cos_{period:g}_{k}"] = F.sin(angle), F.cos(angle)
    return out


def hash_unit(*keys: Column, seed: int = 0) -> Column:
    """A uniform draw in (0, 1) fixed by keys and seed, whatever the partitioning."""
    h = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / float(1 << 52)


def hash_normal(*keys: Column, seed: int = 0) -> Column:
    """A standard normal draw fixed by keys and seed (Box and Muller)."""
    u, v = hash_unit(*keys, seed=2 * seed), hash_unit(*keys, seed=2 * seed + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def portable_hash(key: Column, modulus: int = 1_000_003) -> Column:
    """Multiplicative hash of a whole-number key that plain SQL can repeat; the key is reduced first, so none overflows."""
    return F.pmod(F.pmod(key, F.lit(modulus)) * 2654435761, F.lit(modulus))


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function by Acklam's rational approximation (error below 1.2e-9)."""
    # Fixed values of the published approximation.
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)

    def poly(coef, x, tail=None):
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * x + F.lit(k)
        return out if tail is None else out * x + F.lit(tail)

    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return (F.when(p < 0.02425, poly(c, low) / poly(d, low, 1.0))
            .when(p > 1 - 0.02425, -poly(c, high) / poly(d, high, 1.0))
            .otherwise(poly(a, r) * q / poly(b, r, 1.0)))
