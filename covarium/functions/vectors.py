"""Vectors as array columns, with double arithmetic in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors with a smaller length count as zero.
MIN_NORM = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * k)


def divide(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def normalized(a: Column) -> Column:
    """Unit length; a vector that counts as zero stays as it is."""
    n = norm(a)
    return F.when(n > MIN_NORM, divide(a, n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector counts as zero."""
    na, nb = norm(a), norm(b)
    return F.when((na >= MIN_NORM) & (nb >= MIN_NORM), dot(a, b) / (na * nb))


def euclid(a: Column, b: Column) -> Column:
    """Distance of the unit vectors."""
    return F.sqrt(F.aggregate(F.zip_with(normalized(a), normalized(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def matvec(rows: Column, x: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return F.transform(rows, lambda r: dot(r, x))


def matvec_transposed(rows: Column, x: Column) -> Column:
    """Transposed matrix times vector."""
    zero = F.transform(F.element_at(rows, 1), lambda _: F.lit(0.0))
    scaled = F.zip_with(rows, x, lambda r, k: F.transform(r, lambda v: v.cast("double") * k.cast("double")))
    return F.aggregate(scaled, zero, lambda s, r: F.zip_with(s, r, lambda a, b: a + b))


def add_outer(rows: Column, x: Column, y: Column, alpha: Column) -> Column:
    """Matrix plus alpha times the outer product of x and y."""
    return F.zip_with(rows, x, lambda r, k: F.zip_with(r, y, lambda v, m: v.cast("double") + alpha * k.cast("double") * m.cast("double")))


def clip_norm(a: Column, limit: float) -> Column:
    """Shortened to length `limit`; a limit of zero or less disables it."""
    if limit <= 0:
        return F.transform(a, lambda x: x.cast("double"))
    n = norm(a)
    return F.when(n > limit, scale(a, F.lit(limit) / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def sigmoid(d: Column, clamp: float = 20.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-clamp), F.least(F.lit(clamp), d.cast("double")))))


def log_loss(target: Column, p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -(target * F.log(q) + (F.lit(1.0) - target) * F.log(F.lit(1.0) - q))


def finite_or_zero(a: Column) -> Column:
    """The vector, or zeros if any part isn't finite."""
    bad = F.exists(a, lambda x: F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(bad, F.transform(a, lambda x: F.lit(0.0).cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double")))


def similarity_label(cos: Column) -> Column:
    return (
        F.when(cos > 0.8, "Very similar").when(cos > 0.5, "Moderately similar").when(cos > 0.2, "Weakly similar").when(cos > -0.2, "Unrelated").otherwise("Opposite")
    )
