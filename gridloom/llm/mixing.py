"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sizes are counted once per row; what is shuffled is one sum per source, then one per (source, slice of the sampling
key), both pre-aggregated, so a source with a third of all rows costs no more than the others. Rows meet their source's
plan in a join with a table of one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_SQL, table
from gridloom.plans.registry import query
from gridloom.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Hexadecimal digits of the sampling key that name a slice; the slice that holds the cut is then ordered exactly.
SLICE_DIGITS = 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_SQL)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: Column | float, max_epochs: float) -> DataFrame:
    """Targets of ``sources`` (source, weight, source_size): proportional to weight, at most ``max_epochs`` sizes.

    Clamping the sources above their cap and sharing the excess among the others until none is above leads to
    target = min(cap, level * weight); the level is read off the sources in the order in which they fill up.
    Adds ``target``. A budget above all caps fills every source to its cap; sources of size 0 get 0.
    """
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = (sources.withColumn("cap", max_epochs * F.col("source_size"))
              .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("level", (budget - F.col("cap_before")) / F.col("weight_left")))
    # The level of the first source that it does not fill; with none such, every source is full.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                         F.struct((F.col("cap") / F.col("weight")).alias("order"), F.col("level").alias("level"))))
    everything = Window.partitionBy()
    return (ranked.withColumn("level", level.over(everything)["level"])
            .withColumn("target", F.when(F.col("level").isNull(), F.col("cap"))
                        .otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
            .drop("cap", "cap_before", "weight_left", "level"))


def plan_sources(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sources by code point, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    weighted = per.withColumn("weight", weight).withColumn("budget", share * total)
    return water_fill(weighted, F.col("budget"), max_epochs).select("source", "source_size", "target")


def sampling_key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with the columns of its source's plan; the plan has one row per source."""
    return rows.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mixing_plan(sized: DataFrame, *, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
                seed: str = SEED) -> DataFrame:
    """(source, source_size, target, whole, last_key) from ``sized`` (id, source, size).

    Every row is taken ``whole`` = floor(target / source_size) times. One more time go the rows whose seeded hash of
    the id is at most ``last_key``, the cut at which the source's rest is best met; rows with equal ids go together.
    """
    plan = plan_sources(sized, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = materialize(plan.withColumn("whole", whole.cast("long"))
                       .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    keyed = sized.withColumn("key", sampling_key("id", seed)).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (with_plan(slices.withColumn("before", before), plan).where("rest > 0 AND before <= rest")
           .groupBy("source").agg(F.max(F.struct("slice", "before", "rest")).alias("cut"))
           .select("source", "cut.*").withColumnRenamed("slice", "cut_slice"))
    # Only the slice that holds the cut is put in order, one slice of 16 ** SLICE_DIGITS per source.
    inside = (with_plan(keyed, cut).where("slice = cut_slice")
              .groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("words")))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("key"))
    last = (inside.withColumn("upto", upto).groupBy("source")
            .agg(F.max(F.when(F.expr("upto - words / 2 <= rest"), F.col("key"))).alias("last"),
                 F.min(F.substring("key", 1, SLICE_DIGITS)).alias("slice")))
    # With no row of the cut slice taken, the slices before it are.
    last = last.select("source", F.coalesce("last", "slice").alias("last_key"))
    return (plan.join(last.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left")
            .select("source", "source_size", "target", "whole", "last_key"))


def times_taken(id_col: str, seed: str) -> Column:
    """How often the mix takes a row that stands beside its source's plan."""
    return F.col("whole") + F.when(sampling_key(id_col, seed) <= F.col("last_key"), 1).otherwise(0)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
               seed: str = SEED, **shares) -> DataFrame:
    """(id, source, size, source_size, target, times) for every row of ``docs``.

    Null and blank texts have size 0; null is a source of its own, the last. A source of size 0 has target 0 and its
    rows are taken 0 times. Repeated rows are counted and drawn as often as they stand there. Other columns of
    ``docs`` are not read; an empty table gives an empty one.
    """
    sized = materialize(sizes(docs, id_col, text_col, source_col))
    plan = materialize(mixing_plan(sized, seed=seed, **shares))
    return (with_plan(sized, plan).withColumn("times", times_taken("id", seed))
            .select("id", "source", "size", "source_size", "target", "times"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
                    seed: str = SEED, **shares) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they are.

    The texts only meet the table of one row per source, which Spark broadcasts while it is small.
    """
    sized = materialize(sizes(docs, id_col, text_col, source_col))
    plan = materialize(mixing_plan(sized, seed=seed, **shares))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), whole.alias("row"))
    taken = with_plan(rows, plan).withColumn("times", times_taken("id", seed).cast("int")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS DOUBLE) source_size, sum(CAST(sum(size) AS DOUBLE)) OVER () total,
      [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] weight FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size cap, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) cap_before,
      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) weight_left
      FROM p WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
g AS (SELECT *, arg_min((1.5 * total - cap_before) / weight_left, cap / weight)
      FILTER ((1.5 * total - cap_before) / weight_left * weight <= cap) OVER () lev FROM f),
t AS (SELECT source, source_size, CASE WHEN lev IS NULL THEN cap ELSE least(cap, lev * weight) END target FROM g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END whole FROM t),
k AS (SELECT d.*, source_size, target, whole, target - whole * source_size rest,
      sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), 'null')))) upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) taken FROM k"""


@query("op10_water_filling", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mix_counts(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")))
