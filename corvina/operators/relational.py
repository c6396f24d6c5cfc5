"""Deduplication, counters, gates and set operations over any keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def variant_index(rows: DataFrame, keys: list[str], order: list, to: str = "variant_index") -> DataFrame:
    """Counts the rows of each key from 0 in the given order."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def unique_names(rows: DataFrame, base: str, order: list, to: str) -> DataFrame:
    """base for its first row, base_2, base_3 ... for later ones."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn(to, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("_", base, n.cast("string"))))


def failure_streaks(calls: DataFrame, key: str, order: list, failed: Column) -> DataFrame:
    """(key, longest run of failures): rows since the last success are one run."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = calls.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(w)).where(failed)
    each = runs.groupBy(key, "_run").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.max("n").alias("longest"))


def missing(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key right has not."""
    return left.join(right, left[left_key] == right[right_key], "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def layered(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value of each key in the first layer that has a non-null one."""
    out = None
    for k, layer in enumerate(layers):
        one = layer.select(F.col(key), F.lit(k).alias("_layer"), F.col(value).alias("_value"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("_layer"))).alias(value))
