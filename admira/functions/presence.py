"""When a value counts as given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_present(value: Column, kind: str = "string", mode: str = "empty") -> Column:
    """True unless the value is null or, by ``mode``, empty, zero or false.

    kind: ``string``, ``array``, ``map``, ``number`` or ``boolean``. mode: ``empty`` takes '' and empty collections for
    missing, ``empty_or_zero`` the number 0 too, ``falsy`` also false.
    """
    given = value.isNotNull()
    if kind == "string":
        return given & (F.coalesce(value, F.lit("")) != "")
    if kind in ("array", "map"):
        return given & (F.coalesce(F.size(value), F.lit(0)) > 0)
    if kind == "number" and mode in ("empty_or_zero", "falsy"):
        return given & (F.coalesce(value, F.lit(0)) != 0)
    if kind == "boolean" and mode == "falsy":
        return F.coalesce(value, F.lit(False))
    return given
