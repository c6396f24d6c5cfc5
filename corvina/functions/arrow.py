"""Arrow functions that modules can define before there is a session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(returns: str):
    """A decorator: the function takes and gives Arrow arrays, and is called with columns."""

    def wrap(f):
        def call(*columns: Column) -> Column:
            return F.arrow_udf(f, returns)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
