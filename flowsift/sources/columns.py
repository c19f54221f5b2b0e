"""Column lookup by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(df: DataFrame, aliases: dict[str, list[str]], needed=()) -> dict[str, Column | None]:
    """Meaning -> column; the first alias present wins, letter case does not matter."""
    present = {name.lower(): name for name in df.columns}
    found = {}
    for meaning, names in aliases.items():
        hit = next((present[n.lower()] for n in names if n.lower() in present), None)
        found[meaning] = None if hit is None else F.col(f"`{hit}`")
    missing = [meaning for meaning in needed if found[meaning] is None]
    if missing:
        raise ValueError("log is missing: " + ", ".join("/".join(aliases[m]) for m in missing))
    return found


def optional(column: Column | None) -> Column:
    return F.lit(None).cast("string") if column is None else column
