"""Forward-looking (A) or backward-looking (B), by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import phrases_in


def rule_typeab(text: Column, forward: tuple[str, ...], backward: tuple[str, ...]) -> Column:
    """struct(type_ab, ab_confidence, temporal_signal); type_ab is NULL where the rules don't decide.

    Only one kind found: 0.5 and 0.1 for each phrase, 0.95 at most. Both found: the more frequent kind
    with 0.5 and 0.05 for each phrase it leads by, 0.7 at most. Phrases within phrases count each.
    """
    ahead, behind = phrases_in(text, forward), phrases_in(text, backward)
    n, m = F.size(ahead), F.size(behind)
    sure = lambda k: F.least(F.lit(0.5) + k * F.lit(0.1), F.lit(0.95))
    lead = lambda k: F.least(F.lit(0.5) + k * F.lit(0.05), F.lit(0.7))
    a, b = n > m, m > n
    return F.struct(
        F.when(a, "A").when(b, "B").alias("type_ab"),
        F.when(a & (m == 0), sure(n)).when(b & (n == 0), sure(m)).when(a, lead(n - m)).when(b, lead(m - n)).otherwise(F.lit(0.0)).alias("ab_confidence"),
        F.when(a, F.array_join(ahead, ", ")).when(b, F.array_join(behind, ", ")).otherwise(F.lit("")).alias("temporal_signal"),
    )
