"""Column expressions on ARRAY<FLOAT> vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_vector(v: Column | str, size: int | None = None) -> Column:
    """Not null, of `size` numbers where given, all finite and not all zero; never null itself."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == size) if size else ok, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, first element first; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """`v` at unit length, as doubles; null for a vector that is null, or of length zero."""
    # The length is an argument beside the elements: inside the lambda it would be computed for each of them.
    length = norm(v)
    return F.when(length > 0, F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a length is zero or the sizes differ."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)
