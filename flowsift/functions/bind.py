"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is computed once however often the body uses it.

    Without this every use repeats the whole expression: in the plan, in generated code,
    and, for what the optimizer does not share, at run time.
    """
    return F.transform(F.array(value), body)[0]
