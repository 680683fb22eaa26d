"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, word_count, written

#: Bits of the hash that one histogram resolves, and the number of nested histograms.
BITS, LEVELS = 12, 3


def spread(key: Column) -> Column:
    """36 evenly spread bits of a key's text, as a long; null is a key of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) to the same with target.

    Sources in code point order (null last) take the weights in turn. The level
    L with sum(least(most * size, L * weight)) = total is found among the
    sources ordered by most * size / weight: it is the largest quotient of what
    is left by the weight that is left. The windows see one row a source in one
    task, which is fit for up to some millions of sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    turn = F.array(*map(F.lit, weights))
    return (
        sources.withColumn("w", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_cap), F.lit(0)))
        .withColumn("level", F.max(F.col("left").cast("double") / F.col("left_w")).over(every))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))
    )


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """What each source gives, from a written table of (source, size, h): src, source_size, target, whole, limit.

    whole passes over a source come first; what is left of the target is a
    budget that the documents with the lowest hashes fill, up to limit. It is
    found by nested histograms: words by (source, hash bucket), then only the
    bucket in which the budget ends, split finer; no documents are sorted. The
    documents of the last boundary (same 36 bits) are taken if that comes nearer
    to the budget.
    """
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = written(per.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    at = per.select("source", "budget", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("bucket"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sized.select("source", "size", F.shiftright("h", shift).alias("b"))
        if level:
            edge = at.select(F.col("source").alias("s"), F.col("bucket").alias("at"))
            inside = inside.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("b", BITS) == F.col("at"))).select("source", "size", "b")
        bins = inside.groupBy("source", "b").agg(F.sum("size").alias("words"))
        bins = bins.withColumn("to", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
        was = at.select(F.col("source").alias("s"), "budget", "base")
        bins = bins.join(was, F.col("source").eqNullSafe(F.col("s"))).where(F.col("base") + F.col("to") > F.col("budget"))
        first = bins.groupBy("source").agg(F.min(F.struct("b", "base", "to", "words", "budget")).alias("x"))
        was, at = at, written(first.select("source", "x.budget", (F.col("x.base") + F.col("x.to") - F.col("x.words")).alias("base"), F.col("x.b").alias("bucket"), F.col("x.words").alias("words")), "mix-edges")
        if level:
            forget(was)
    fits = (F.col("budget") - F.col("base")) * 2 >= F.col("words")
    limit = at.select(F.col("source").alias("s"), (F.col("bucket") - F.when(fits, 0).otherwise(1)).alias("limit"))
    out = written(per.join(limit, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("src"), "source_size", "target", "whole", F.coalesce("limit", F.lit(-1).cast("long")).alias("limit")), "mix-limits")
    forget(per, at)
    return out


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), spread(F.col(key)).alias("h")), "mix-sizes")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Copies of each document so that sources come near their target words.

    Returns (key, size, source_size, target, copies). Null texts have size 0, a
    null source is a source, rows with equal keys fall together, no rows give no
    rows.
    """
    sized = _sized(docs, key, text, source)
    out = sized.join(plan(sized, weights, most), F.col("source").eqNullSafe(F.col("src")))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("whole") + (F.col("h") <= F.col("limit")).cast("long")).alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, copies: str = "copies") -> DataFrame:
    """The documents that the mix takes, with all columns and how many times each is taken, in a column named by copies.

    All columns stay, whatever their names; copies must not be one of them.
    """
    if copies in docs.columns:
        raise ValueError(f"{copies} is a column of the documents")
    sized = _sized(docs, key, text, source)
    per = plan(sized, weights, most)
    forget(sized)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    of = lambda name: F.col(f"c{docs.columns.index(name)}")
    taken = rows.join(per.select("src", "whole", "limit"), of(source).eqNullSafe(F.col("src"))).withColumn("times", F.col("whole") + (spread(of(key)) <= F.col("limit")).cast("long"))
    return taken.where("times > 0").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("times").alias(copies))
