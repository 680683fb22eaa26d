"""Sorting, limits, folds and exact samples that don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(key: Column, seed: int = 0) -> Column:
    """An even 32-bit number of a whole-number key (multiplicative hashing)."""
    return F.pmod((key + seed).cast("long") * F.lit(2654435761), F.lit(2**32))


def top(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer), the same on each run."""
    return df.orderBy(spread(F.col(key), seed), key).limit(n)


def indicator(df: DataFrame, key: str, ones: int, seed: int = 0, name: str = "selected") -> DataFrame:
    """A 0/1 column with exactly so many ones."""
    chosen = exact_sample(df.select(key), key, ones, seed).withColumn(name, F.lit(1))
    return df.join(chosen, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def block_indicator(df: DataFrame, key: str, block: int, ones: int, seed: int = 0, name: str = "selected") -> DataFrame:
    """An indicator of whole blocks of keys."""
    blocks = df.select(F.floor(F.col(key) / block).alias("__b")).distinct()
    return df.withColumn("__b", F.floor(F.col(key) / block)).join(indicator(blocks, "__b", ones, seed, name), "__b").drop("__b")


def balanced_indicator(df: DataFrame, key: str, tag: str, ones: int, seed: int = 0, name: str = "selected") -> DataFrame:
    """So many ones within each tag."""
    w = Window.partitionBy(tag).orderBy(spread(F.col(key), seed), key)
    return df.withColumn(name, (F.row_number().over(w) <= ones).cast("int"))


def folds(df: DataFrame, key: str, k: int, seed: int | None = None, name: str = "fold") -> DataFrame:
    """Fold of each row: by the key's hash, or with seed None by the key itself."""
    return df.withColumn(name, F.pmod(F.col(key) if seed is None else F.floor(spread(F.col(key), seed) / 65536), F.lit(k)).cast("int"))


def even_folds(df: DataFrame, key: str, k: int, by: list[str], name: str = "fold") -> DataFrame:
    """Runs of near-equal size in key order, from 0."""
    return df.withColumn(name, F.ntile(k).over(Window.partitionBy(*by).orderBy(key)) - 1)


def bernoulli(df: DataFrame, p: float, seed: int, name: str = "drawn") -> DataFrame:
    return df.withColumn(name, (F.rand(seed) < p).cast("int"))


def pick_lines(lines: DataFrame, numbers: DataFrame, number: str = "number") -> DataFrame:
    """Lines (number, text) whose number is asked for."""
    return lines.join(numbers.select(number).distinct(), number, "left_semi")


def proportional_sample(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """A share of the rows, to the nearest row, drawn without replacement by the key's hash; the ranges of hashes stay spread over tasks."""
    from .ordered import row_numbers

    placed = row_numbers(df.withColumn("__hash", spread(F.col(key), seed)), ["__hash", key], "__place")
    return placed.where(F.col("__place") < round(share * df.count())).drop("__hash", "__place")
