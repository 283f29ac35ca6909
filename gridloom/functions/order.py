"""Exact order statistics and running totals that do not pull a whole group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.layout import by_sort
from gridloom.session import materialize


def beside(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` joined with the row of ``facts`` that has the same keys; NULL keys are equal to each other."""
    other = {k: f"_k{i}" for i, k in enumerate(keys)}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    return df.join(by_sort(facts.withColumnsRenamed(other)), same).drop(*other.values())


def running_total(df: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """Inclusive running total of ``value`` per ``keys`` in ``order``.

    A plain window would sort each group in one task. Here rows are range-partitioned on (keys, order), each
    slice gets a local running total, and the totals of the earlier slices of the same group (one row per group
    and slice) are added. The slice layout is written out once because range bounds are sampled.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    sliced = materialize(
        df.withColumn("_value", value)
        .repartitionByRange(*[F.col(k) for k in keys], *cols)
        .withColumn("_slice", F.spark_partition_id())
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(sliced.schema["_value"].dataType)
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), zero)).drop("_sum")
    )
    return (
        beside(sliced.withColumn("_local", F.sum("_value").over(local)), offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_value", "_slice", "_local", "_before")
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], out: list[str],
                      accuracy: int = 1000, interpolate: bool = True) -> DataFrame:
    """Exact percentiles per group, numpy's linear interpolation (or the plain order statistic at int(f*n)).

    Two passes. The first builds a small mergeable quantile sketch per group, which brackets every wanted rank
    within a guaranteed rank error. The second counts the rows below each bracket and keeps, with counts, only the
    distinct values inside the brackets, about 8/accuracy of the rows; ranks are then read off exactly. Values
    outside the brackets never leave the map side of the aggregation except as one count per gap.
    NaN and NULL values are ignored. Output: keys, n, one column per fraction.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    margin = 4.0 / accuracy
    probes = []
    for f in fractions:
        probes += [max(f - margin, 0.0), min(f + margin, 1.0)]
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", probes, accuracy).alias("_probe"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    # Brackets at the ends of the range use the true ends. Small groups, where the rank margin is not worth several
    # rows, are kept whole.
    small = F.col("n") <= accuracy
    lows = [F.when(small | F.lit(probes[2 * i] <= 0.0), F.col("_min")).otherwise(F.col("_probe")[2 * i])
            for i in range(len(fractions))]
    highs = [F.when(small | F.lit(probes[2 * i + 1] >= 1.0), F.col("_max")).otherwise(F.col("_probe")[2 * i + 1])
             for i in range(len(fractions))]
    sketch = sketch.select(*keys, "n", F.array(*lows).alias("_lo"), F.array(*highs).alias("_hi"))
    joined = beside(data, sketch, keys)
    inside = None
    for i in range(len(fractions)):
        test = F.col("_v").between(F.col("_lo")[i], F.col("_hi")[i])
        inside = test if inside is None else inside | test
    # Rows between brackets collapse to one row per gap: the gap number counts the bracket ends passed so far.
    gap = sum((F.col("_v") > F.col("_hi")[i]).cast("int") for i in range(len(fractions)))
    gap = gap + sum((F.col("_v") > F.col("_lo")[i]).cast("int") for i in range(len(fractions)))
    counted = (
        joined.withColumn("_in", inside)
        .groupBy(*keys, "n", F.when(F.col("_in"), F.col("_v")).alias("_x"),
                 F.when(~F.col("_in"), gap).alias("_gap"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_first"))
    )
    w = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_c").over(w)).where("_x IS NOT NULL")

    def order_stat(index: Column) -> Column:
        # value whose rank interval [cum-c, cum) holds the 0-based index
        return F.max(F.when((index >= F.col("_cum") - F.col("_c")) & (index < F.col("_cum")), F.col("_x")))

    aggs = []
    for f, name in zip(fractions, out):
        if interpolate:
            pos = F.lit(f) * (F.col("n") - 1)
            low = F.floor(pos)
            a, b = order_stat(low), order_stat(F.least(low + 1, F.col("n") - 1))
            frac = F.max(pos - low)
            aggs.append((a + (b - a) * frac).alias(name))
        else:
            index = F.greatest(F.least(F.floor(F.lit(f) * F.col("n")), F.col("n") - 1), F.lit(0))
            aggs.append(order_stat(index).alias(name))
    return ranked.groupBy(*keys, "n").agg(*aggs)
