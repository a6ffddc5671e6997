"""A costly expression whose result filters need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(column: Column) -> Column:
    """``column``, worked out once a row however many filters and columns behind it use it.

    A filter behind a plain column is pushed below it with a copy of the column's expression; a
    filter on what a generator gives stays where it is.
    """
    return F.explode(F.array(column))
