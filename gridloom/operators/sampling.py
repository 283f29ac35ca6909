"""Weighted draws with replacement from given uniform numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.order import running_total
from gridloom.session import materialize


def weighted_draws(subjects: DataFrame, draws: DataFrame, subject: str = "subject", weight: str = "weight",
                   u: str = "u", buckets: int | None = None) -> DataFrame:
    """Each draw (draw_id, u in [0, 1)) picks the subject whose cumulative weight interval holds u.

    The running total over subjects is computed in slices. Intervals and draws meet in equal-width buckets of [0, 1):
    an interval is listed once per bucket it touches, a heavy subject in many, so no bucket holds more than its share
    of draws and the join is an equi-join with a range left over. There are as many buckets as subjects by default, so
    interval rows stay below twice the subjects and a bucket holds about one of them.
    """
    buckets = buckets or max(subjects.count(), 1)
    total = subjects.agg(F.sum(weight)).scalar()
    cum = running_total(subjects.select(F.col(subject), F.col(weight).alias("_w")), [], [F.col(subject)], F.col("_w"), "_hi")
    cum = materialize(running_total(cum, [], [F.col(subject)], F.lit(1), "_n"))
    # An interval starts at the very number at which the one before ends, and the last one ends at 1: no draw falls between.
    before = cum.select((F.col("_n") + 1).alias("_n"), (F.col("_hi") / total).alias("_lo"))
    up = F.when(F.col("_n") == subjects.count(), F.lit(1.0)).otherwise(F.col("_hi") / total)
    spans = cum.join(before, "_n", "left").select(F.col(subject), F.coalesce("_lo", F.lit(0.0)).alias("_lo"), up.alias("_up"))
    first, last = F.floor(F.col("_lo") * buckets), F.least(F.floor(F.col("_up") * buckets), F.lit(buckets - 1))
    spans = spans.withColumn("_b", F.explode(F.sequence(first, last)))
    d = draws.withColumn("_b", F.floor(F.col(u) * buckets))
    return (d.join(spans, "_b").where((F.col(u) >= F.col("_lo")) & (F.col(u) < F.col("_up")))
            .select(*draws.columns, subject))
