"""Aggregate expressions with explicit treatment of unknown values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any3(x) -> Column:
    """True if any row is true, else NULL if any row is unknown, else false."""
    x = _c(x)
    return F.when(F.bool_or(x), F.lit(True)).when(F.bool_or(x.isNull()), F.lit(None)).otherwise(F.lit(False))


def all3(x) -> Column:
    """False if any row is false, else NULL if any row is unknown, else true."""
    x = _c(x)
    return F.when(~F.bool_and(x), F.lit(False)).when(F.bool_or(x.isNull()), F.lit(None)).otherwise(F.lit(True))


def ordered_text(value, order, sep: str = ",", null_poisons: bool = True) -> Column:
    """Values joined in the given order; a NULL value makes the result NULL unless ``null_poisons`` is off."""
    value, order = _c(value), _c(order)
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.cast("string").alias("v")))))
    text = F.array_join(F.transform(pairs, lambda p: p["v"]), sep)
    text = F.when(F.size(pairs) > 0, text)
    return F.when(~F.bool_or(value.isNull()), text) if null_poisons else text


def active_text(value, flag, sep: str = ";", empty: str = "missing") -> Column:
    """Alphabetical list of the values whose flag holds, or ``empty``."""
    picked = F.array_sort(F.collect_list(F.when(_c(flag), _c(value))))
    return F.when(F.size(picked) > 0, F.array_join(picked, sep)).otherwise(F.lit(empty))


def missing_share(x) -> Column:
    return F.avg(_c(x).isNull().cast("double"))
