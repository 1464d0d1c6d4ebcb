"""Vector expressions. They run inside the JVM and define the exact results; the top-k
search in ``operators.vector_search`` computes the same scores batch-wise with numpy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let


def max_abs(v: Column) -> Column:
    return F.coalesce(
        F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(0.0)
    )


def quantize(v: Column) -> Column:
    """struct(q array<tinyint>, scale double); half rounds toward +infinity."""

    def scaled(scale: Column) -> Column:
        def one(x: Column) -> Column:
            r = F.floor(x.cast("double") / scale * 127 + 0.5)
            return F.greatest(F.lit(-127), F.least(F.lit(127), r)).cast("tinyint")

        zeros = F.transform(v, lambda x: F.lit(0).cast("tinyint"))
        q = F.when(scale == 0, zeros).otherwise(F.transform(v, one))
        return F.struct(q.alias("q"), scale.alias("scale"))

    return let(max_abs(v), scaled)


def dequantize(q: Column, scale: Column) -> Column:
    """F2."""
    return F.transform(q, lambda x: x.cast("double") * scale / 127)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _ratio(top: Column, bottom: Column) -> Column:
    return top / F.when(bottom == 0, F.lit(1.0)).otherwise(bottom)


def cosine(a: Column, b: Column) -> Column:
    """cosine of two float vectors; 0 when either is all zero."""
    return _ratio(dot(a, b), norm(a) * norm(b))


def cosine_quantized(a: Column, q: Column, scale: Column) -> Column:
    """cosine of a float query and an int8 vector with its scale."""
    f = scale / 127
    return _ratio(dot(a, q) * f, norm(a) * (norm(q) * f))
