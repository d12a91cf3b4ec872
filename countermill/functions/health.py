"""Scores over health counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def success_rate(total: Column, ok: Column) -> Column:
    """Percent of reads that succeeded; 0 without reads."""
    return F.when(total > 0, ok.cast("double") / F.nullif(total, F.lit(0)) * 100.0).otherwise(F.lit(0.0))


def health_score(total: Column, ok: Column, consecutive_failures: Column) -> Column:
    """0 to 100: success ratio less a penalty of 0.1 per consecutive failure, at most 0.5."""
    ratio = ok.cast("double") / F.nullif(total, F.lit(0))
    penalty = F.least(consecutive_failures * 0.1, F.lit(0.5))
    return F.when(total > 0, F.greatest(F.lit(0.0), (ratio - penalty) * 100.0)).otherwise(F.lit(0.0))
