"""Column names that don't meet those of the caller's table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def free_name(taken: Iterable[str], wanted: str) -> str:
    """The wanted name, with underscores behind it until no column has it (Spark compares names without regard to case)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def exactly(name: str) -> Column:
    """The column of this very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")
