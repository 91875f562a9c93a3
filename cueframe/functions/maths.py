"""Numbers: vectors, levels, ramps. Medians and percentiles, which need more than an expression, are in operators.ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """In double precision; null where the lengths differ."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where either vector is zero or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def decibels(power: Column | str, floor: float = 1e-10) -> Column:
    power = F.col(power) if isinstance(power, str) else power
    return 10 * F.log10(power + F.lit(floor))


def semitones(frequency: Column | str, reference: Column | str) -> Column:
    f, r = (F.col(x) if isinstance(x, str) else x for x in (frequency, reference))
    return 12 * F.log2(f / r)


def ramp(value: Column | str, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, linear between."""
    v = F.col(value) if isinstance(value, str) else value
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))


def resample(values: Column | str, points: int) -> Column:
    """An array resampled linearly to so many points; null for an empty array."""
    v = F.col(values) if isinstance(values, str) else values
    n = F.size(v)

    def at(i: Column) -> Column:
        place = i * (n - 1) / max(1, points - 1)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, n - 1)
        a, b = F.element_at(v, low + 1), F.element_at(v, high + 1)
        return a + (b - a) * (place - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))
