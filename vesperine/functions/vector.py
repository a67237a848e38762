"""Vector expressions: FP64 accumulation, FP32 results, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_TOLERANCE = 2e-3
ROUNDED = 2.0**-24  # what rounding a unit vector to FP32 moves its norm at most


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def is_finite(x: Column) -> Column:
    d = x.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def is_valid(v: Column, dimension: int) -> Column:
    """A vector of the right size whose coordinates are all finite."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, is_finite), F.lit(False))


def is_unit(v: Column, tolerance: float = UNIT_TOLERANCE) -> Column:
    return F.abs(norm(v) - 1.0) <= tolerance


def normalize(v: Column, slack: float | None = None) -> Column:
    """L2-normalised FP32 coordinates; a non-finite or zero norm is an error.
    With ``slack``, a vector whose norm is that near to 1 stays as it is."""

    def scaled(length: Column) -> Column:
        bad = F.isnan(length) | (length == float("inf")) | (length == 0) | length.isNull()
        out = F.transform(v, lambda x: (x.cast("double") / length).cast("float"))
        if slack is not None:
            out = F.when(F.abs(length - 1.0) <= slack, v).otherwise(out)
        return F.when(bad, F.raise_error(F.lit("a vector needs a finite, non-zero norm")).cast("array<float>")).otherwise(out)

    # a variable of a lambda: the norm is summed once, not once for each coordinate
    return F.transform(F.array(norm(v)), scaled)[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """``float(1 - a.b)`` of unit vectors; norms are not divided by."""
    return (F.lit(1.0) - dot(a, b)).cast("float")


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))).cast("float")


def hamming(a: Column, b: Column, bits: int) -> Column:
    """Differing bits of two sketches (arrays of 64-bit words), over ``bits``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x) / F.lit(bits)
