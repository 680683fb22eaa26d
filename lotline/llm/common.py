"""Helpers that the operators share: written intermediate tables and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget, shared_dir, written

__all__ = ["ascii_lower", "components", "forget", "maybe_among", "shared_dir", "word_count", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


#: Bits for each key in a filter, and its most bits.
FILTER_BITS, MOST_BITS = 16, 1 << 28


def maybe_among(df: DataFrame, value: Column, keys: DataFrame) -> DataFrame:
    """df with a column __hit: false where the value is surely not in the one column of keys.

    So most rows that have no partner are told before a join, and their other
    columns aren't shuffled. The filter is a bitmap of key hashes with FILTER_BITS
    bits a key, at most MOST_BITS in all (32 MB), in rows of 4 KB; this bound is
    why it may be broadcast. Nulls don't hit.
    """
    bits = 1 << 15
    while bits < min(MOST_BITS, FILTER_BITS * keys.count()):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(bits)) + 1
    key = F.col(keys.columns[0])
    maps = keys.groupBy(F.bitmap_bucket_number(place(key)).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(key))).alias("__map"))
    hit = F.expr("(conv(hex(substring(__map, cast(floor(__at / 8) as int) + 1, 1)), 16, 10) div cast(power(2, __at % 8) as bigint)) % 2 = 1")
    rows = df.withColumn("__bucket", F.bitmap_bucket_number(place(value))).withColumn("__at", F.bitmap_bit_position(place(value)))
    return rows.join(F.broadcast(maps), "__bucket", "left").select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(value.isNotNull() & hit, F.lit(False)).alias("__hit"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves all other characters."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b", rows_a_task: int = 500_000) -> DataFrame:
    """Connected components: (node, root) with the least node of each component.

    Alternates large-star and small-star steps, each of them a grouped minimum
    (combined before its shuffle) and a join, until no edge changes. Nodes that
    appear in no edge are not returned. The number of rounds grows with the
    logarithm of the longest path, and no list of neighbours is gathered. As the
    edges are counted anyway, few edges are handled by few tasks.
    """

    lows: list[DataFrame] = []

    def large(e: DataFrame, parts: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain exchanges, whose hot keys Spark can split
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "cc-low")
        lows.append(low)
        return both.where("v > u").join(low, "u").coalesce(parts).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    def small(e: DataFrame, parts: int) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(low, "u").coalesce(parts)
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000000007)).first())

    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    known = told(now)
    while known[0]:
        parts = max(8, -(-known[0] // rows_a_task))
        new = written(small(large(now, parts), parts).where("u <> v").distinct().coalesce(parts), "cc")
        forget(now, lows.pop())
        now, before, known = new, known, told(new)
        if known == before:
            break
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "cc-roots")
    forget(now)
    return out
