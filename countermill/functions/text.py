"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(text: Column) -> Column:
    """NULL, empty or only white space."""
    return F.coalesce(text, F.lit("")).rlike(r"^\s*$")
