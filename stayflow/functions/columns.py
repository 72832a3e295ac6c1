"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """Column by its literal name; category columns carry spaces, ampersands or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(c: Column) -> Column:
    """Spark ranks NaN above every number, so it becomes null before any comparison or sort."""
    return F.when(~F.isnan(c), c)


def id_string(c: Column, kind: str = "string") -> Column:
    """13085, 13085.0 and "13085.0" all become "13085"; `kind` is the column's type. Only doubles pass through double."""
    if kind in ("double", "float"):
        return c.cast("bigint").cast("string")
    if kind == "string" or kind.startswith("decimal"):
        return F.substring_index(c.cast("decimal(38,10)").cast("string"), ".", 1)
    return c.cast("string")


def half_even(c: Column, digits: int) -> Column:
    """Rounds the binary value, as Python's round does: what lies above or below the middle is decided exactly.

    x * 10^digits is split into its rounded product and the product's error, so a value that only looks like a tie
    is told from a true one; true ties go to the even neighbour.
    """
    scale = float(10**digits)
    x = F.abs(c.cast("double"))
    product = x * scale
    big = x * 134217729.0
    high = big - (big - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    above = (product - whole) - 0.5
    up = (above > 0) | ((above == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = F.signum(c.cast("double")) * (whole + up.cast("double")) / scale
    return F.when(x < 4503599627370496.0 / scale, rounded).otherwise(c.cast("double"))


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(default))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two array<double> columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def hash_uniform(seed: str, *cols: Column) -> Column:
    """Reproducible value in [0, 1): the first 13 hex digits of an md5, so any engine can repeat it."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
