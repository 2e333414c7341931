"""Scalar functions of the dialect that differ from Spark's, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Floating-point division; null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_divide(a: Column, b: Column) -> Column:
    """Integer division towards zero; null where the divisor is 0."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0)))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null where the divisor is 0."""
    return a % F.nullif(b, F.lit(0))


def truncate(x: Column, digits: int) -> Column:
    """Cuts towards zero at so many decimal digits."""
    shown = x.cast("decimal(38,18)")  # the digits as they are shown, not the binary number
    cut = F.when(x < 0, F.ceil(shown, F.lit(digits)).cast("double")).otherwise(F.floor(shown, F.lit(digits)).cast("double"))
    return F.when(F.abs(x) >= 1e19, x.cast("double")).otherwise(cut)


def xor(a: Column, b: Column) -> Column:
    return a.cast("boolean") != b.cast("boolean")


def truth(x: Column) -> Column:
    """A condition as the dialect reads it: a number is true unless 0."""
    return x.cast("boolean")


def if_(condition: Column, yes: Column, no: Column) -> Column:
    """No branch is null-propagating: a null condition takes ``no``."""
    return F.when(truth(condition), yes).otherwise(no)


def geodist(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371) -> Column:
    """Great-circle distance from degrees, by the spherical law of cosines."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1) - F.radians(lon2))
    return F.lit(radius) * F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def substr(text: Column, place: int, length: int | None = None) -> Column:
    """From 1; negative places count from the end; place 0 gives ''."""
    if place == 0:
        return F.when(text.isNotNull(), "")
    return F.substring(text, place, 2**31 - 1 if length is None else length)
