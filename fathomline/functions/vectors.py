"""Column functions on array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLD = 96


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, mismatch: float = -1.0) -> Column:
    """Cosine similarity; ``mismatch`` where lengths differ or are 0, and 0 where a norm is 0."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(mismatch)).when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, where it would be once an element inside a lambda."""
    return F.transform(F.array(value), body)[0]


def normalised(a: Column) -> Column:
    return _bound(F.struct(a.alias("a"), norm(a).alias("n")), lambda s: F.when(s["n"] == 0, s["a"]).otherwise(F.transform(s["a"], lambda x: x / s["n"])))


def fold_sign(i: Column) -> Column:
    return F.when(F.shiftright(i.cast("long") * F.lit(2654435761), 8).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)


def folded(a: Column, width: int = FOLD) -> Column:
    """Signed fold of a vector into ``width`` dimensions, normalised."""
    signed = F.transform(a, lambda x, i: x * fold_sign(i))
    dims = F.sequence(F.lit(0), F.lit(width - 1))

    def fold(v: Column) -> Column:
        # element k, k + width, ...: as many as the vector has
        return F.transform(dims, lambda k: F.aggregate(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), F.lit(0.0), lambda s, j: s + F.coalesce(F.get(v, (k + j * width).cast("int")), F.lit(0.0))))

    return _bound(_bound(signed, fold), normalised)


def as_double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))
