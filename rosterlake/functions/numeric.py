"""Numeric helpers shared by all operators.

Rounding: the source app rounds with exact NUMERIC half-up in one variant and with
binary doubles in another. One rule is used everywhere here: go through
DECIMAL(30,6), round half-up, come back to DOUBLE. The same expression in SQL
(``round_sql``) gives the same digits, so results compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL_T = "decimal(30,6)"


def round_half_up(c: Column | str, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast(DECIMAL_T), digits).cast("double")


def round_sql(expr: str, digits: int) -> str:
    """SQL text of ``round_half_up`` for the oracle side."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(30,6)), {digits}) AS DOUBLE)"


def nullif_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def safe_int(c: Column, default: int = 0) -> Column:
    """Integer with a default: text that is no whole number (``'3.5'``, ``'abc'``)
    and NULL/NaN give the default; ``'28.0'`` is 28, as numeric cells are often
    exported so; a double is truncated (``3.9 -> 3``)."""
    d = c.try_cast("double")
    return F.coalesce(c.try_cast("int"), F.when(d == F.floor(d), d.try_cast("int")), F.lit(default))


def safe_double(c: Column) -> Column:
    """Double or NULL: unparsable text and NaN both become NULL."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def decode_typed(df, types: dict[str, str]):
    """Text result columns -> typed columns by a type map (F12): integers and
    doubles with ``try_cast`` (bad text -> NULL), booleans from 'true'/'false';
    timestamps stay text, as in the source app."""
    out = df
    for name, kind in types.items():
        k = kind.lower()
        if k in ("int", "integer", "long", "bigint"):
            out = out.withColumn(name, F.col(name).try_cast("long"))
        elif k in ("double", "float", "decimal"):
            out = out.withColumn(name, F.col(name).try_cast("double"))
        elif k in ("boolean", "bool"):
            out = out.withColumn(name, F.lower(F.col(name)) == "true")
    return out
