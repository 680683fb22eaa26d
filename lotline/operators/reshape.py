"""Pivots, stacks, unions and repeats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import spread


def pivot(df: DataFrame, row: str, key: str, value: str, order: str, keys: list | None = None) -> DataFrame:
    """Long to wide: one column a key, the value that is last in order; missing ones null."""
    grouped = df.groupBy(row)
    return (grouped.pivot(key, keys) if keys else grouped.pivot(key)).agg(F.max_by(value, order))


def pivot_over(df: DataFrame, row: str, key: str, value: str, order: str, size: Column, least: float, keys: list | None = None) -> DataFrame:
    """pivot() of the rows whose size is over a threshold and whose key is known."""
    return pivot(df.where(F.col(key).isNotNull() & (size > least)), row, key, value, order, keys)


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Wide to long: (ids, name, value)."""
    return df.unpivot(ids, values, "name", "value")


def transpose(df: DataFrame, row: str, values: list[str], rows: list) -> DataFrame:
    """Columns as rows; rows are the (few) row keys that become columns."""
    return unpivot(df, [row], values).groupBy("name").pivot(row, rows).agg(F.first("value"))


def series_tables(df: DataFrame, variable: str, entity: str, period: str, value: str, periods: list, missing: float | None = None) -> DataFrame:
    """A row for each variable and entity with a column a period; the sentinel for missing values becomes null."""
    v = F.col(value) if missing is None else F.when(F.abs(F.col(value) - missing) > 1e-6, F.col(value))
    return df.withColumn("__v", v).groupBy(variable, entity).pivot(period, periods).agg(F.first("__v"))


def append(*tables: DataFrame) -> DataFrame:
    """Rows of same-named columns one after another; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def aligned(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same columns in the same order."""
    return a.columns == b.columns


def repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row so many times."""
    return df.withColumn("__t", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop("__t")


def repeat_cyclic(df: DataFrame, row: str, times: list[int]) -> DataFrame:
    """Each row as often as the factor that its number meets in turn."""
    return repeat(df, F.get(F.array(*map(F.lit, times)), F.pmod(F.col(row), F.lit(len(times))).cast("int")))


def correlated(df: DataFrame, y: str, r: float, key: str, seed: int = 0, name: str = "x") -> DataFrame:
    """A column with a stated correlation to y: y plus normal noise of the fitting size.

    The noise is made from two even numbers of each row's whole-number key, so it
    doesn't depend on partitions.
    """
    sd = df.agg(F.stddev_samp(y)).first()[0] or 0.0
    u, v = ((spread(F.pmod(F.col(key) * k, F.lit(2**30)), seed) + 0.5) / 2.0**32 for k in (1, 40503))
    return df.withColumn(name, F.col(y) + sd * ((1 - r * r) / (r * r)) ** 0.5 * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v))
