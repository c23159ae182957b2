"""Similarity of neighbouring slices, as columns over their three dot products and nonzero counts.

d0 is the sum of a[i] b[i], df of a[i+1] b[i], db of a[i] b[i+1]; na and nb count nonzeros. A user's
own measure is any function of these five columns. All give null where both slices are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Similarity = Callable[[Column, Column, Column, Column, Column], Column]


def mean_shift(d0: Column, df: Column, db: Column, na: Column, nb: Column) -> Column:
    return F.try_divide(d0 + df + db, F.lit(3.0) * F.greatest(na, nb))


def best_shift(d0: Column, df: Column, db: Column, na: Column, nb: Column) -> Column:
    return F.try_divide(F.greatest(d0, df, db), F.greatest(na, nb).cast("double"))


def best_shift_or_zero(d0: Column, df: Column, db: Column, na: Column, nb: Column) -> Column:
    """best_shift, but 0 where either slice is empty."""
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(best_shift(d0, df, db, na, nb))
