"""The first few values of a group, without sorting it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def first_k(value: Column | str, k: int) -> Column:
    """The ``k`` least values of a group, ascending, as an array.

    An aggregate of Spark's own that keeps a queue of ``k`` values per group, on the
    map side too; what leaves a task is ``k`` values a group however many rows it has.
    """
    column = F.col(value) if isinstance(value, str) else value
    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", column, F.lit(k), F.lit(True))
