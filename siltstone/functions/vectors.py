"""Vector functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """The vector at unit length; the divisor is 1e-12 at least."""
    divided = lambda p: F.transform(p["v"], lambda x: x.cast("double") / F.greatest(p["n"], F.lit(1e-12)))
    return let(v, lambda u: let(F.struct(u.alias("v"), norm(u).alias("n")), divided))
