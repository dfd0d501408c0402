"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(_doubles(left), _doubles(right), lambda a, b: a * b))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(vector), lambda x: x * x)))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; NULL when either vector has length zero."""
    return F.try_divide(dot(left, right), l2_norm(left) * l2_norm(right))


def squared_l2(left: Column, right: Column) -> Column:
    return _sum(
        F.zip_with(_doubles(left), _doubles(right), lambda a, b: (a - b) * (a - b))
    )
