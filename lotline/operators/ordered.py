"""Operators on rows in an order that a key column gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import forget, written

#: Cells that one task pools at once.
RANGE_CELLS = 100_000
#: Cells that a look-up may have (16 bytes each go to every task).
LOOK_UP = 5_000_000


def lag_first(x: str, order: list[str], by: list[str], lag: int = 1, block: int = 1) -> Column:
    """x as it was lag * block rows before; rows before the start take the first value."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = lag * block
    return F.when(F.row_number().over(w) > n, F.lag(x, n).over(w)).otherwise(F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def difference(x: str, order: list[str], by: list[str]) -> Column:
    return F.col(x) - F.lag(x).over(Window.partitionBy(*by).orderBy(*order))


def cyclic(values: Column, i: Column) -> Column:
    """Element i of an array, starting over after the last."""
    return F.get(values, F.pmod(i, F.size(values)).cast("int"))


def periodic(i: Column, period: int) -> Column:
    return F.pmod(i, F.lit(period))


def ordering(x: str, by: list[str], descending: bool = False, tie: str | None = None) -> Column:
    """Place of a row in the order of x, from 0."""
    first = F.desc(x) if descending else F.asc(x)
    return F.row_number().over(Window.partitionBy(*by).orderBy(first, *([tie] if tie else []))) - 1


def row_numbers(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Numbers from 0 in a global order, without gathering the rows.

    Ranges are sorted and written with each row's range and place in it, both
    from one run, so how Spark deals the ranges can't differ between the counting
    and the numbering. The ranges, one row each, are then counted and offset.
    """
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND((1 << 33) - 1).alias("__in"))
    ranged = written(placed, "row-numbers")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def block_sums(df: DataFrame, row: str, block: int, terms: dict[str, Column]) -> DataFrame:
    """Sums of terms over blocks of rows, then the sums of their squares."""
    sums = df.groupBy(F.floor(F.col(row) / block).alias("__b")).agg(*(F.sum(c).alias(n) for n, c in terms.items()))
    return sums.agg(*(F.sum(F.col(n) * F.col(n)).alias(n) for n in terms))


def stacked(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """A row a key: count, first place in order, opening value, and the array of values in order."""
    s = F.struct(order, value)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("opening"), F.transform(F.array_sort(F.collect_list(s)), lambda x: x[value]).alias("values"))


def _hull(x: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Blocks of rising means (boundary, n, total) of cells in order of x: the lower hull of their running sums."""
    out: list[tuple[float, float, float]] = []
    for b, k, t in zip(x.tolist(), n.tolist(), total.tolist()):
        while out and out[-1][2] * k >= t * out[-1][1]:
            _, k0, t0 = out.pop()
            k, t = k + k0, t + t0
        out.append((b, k, t))
    return tuple(zip(*out))


def pooled(cells: DataFrame, x: str = "x", n: str = "n", total: str = "total") -> DataFrame:
    """Isotonic blocks of cells (x, n, total), pool adjacent violators: boundary (largest x), n, total and mean.

    The blocks are the edges of the lower hull of the running sums of n and total
    in order of x. Each range of x finds its own hull; then neighbouring ranges,
    pairs of these, and so on are joined by the tangent that touches both hulls,
    and what lies above it goes. So a task holds one range, however many blocks
    there are. Null x are left out.
    """
    merged = cells.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("boundary")).agg(F.sum(n).cast("double").alias("n"), F.sum(total).cast("double").alias("total")).where("n > 0")
    now = written(merged, "pool")
    ranges = max(1, -(-now.count() // RANGE_CELLS))

    def hulls(batches):
        parts = list(batches)
        held = [np.concatenate([np.zeros(0), *(b.column(i).to_numpy(zero_copy_only=False) for b in parts)]) for i in range(3)]
        if len(held[0]):
            blocks = [pa.array(c, pa.float64()) for c in _hull(*held)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(blocks[0])), *blocks], names=["range", "boundary", "n", "total"])

    dealt = now.repartitionByRange(ranges, "boundary") if ranges > 1 else now.coalesce(1)
    blocks = written(dealt.sortWithinPartitions("boundary").mapInArrow(hulls, "range long, boundary double, n double, total double"), "pool-hulls")
    forget(now)
    if ranges == 1:
        return blocks.select("boundary", "n", "total", (F.col("total") / F.col("n")).alias("mean"))
    return _joined(blocks)


def _joined(blocks: DataFrame) -> DataFrame:
    """Blocks of neighbouring ranges pooled where their means don't rise."""
    # a row a range: its place and what lies before it
    sums = blocks.groupBy("range").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(sums.select("range", (F.row_number().over(Window.orderBy("range")) - 1).alias("group"), F.coalesce(F.sum("n").over(before), F.lit(0.0)).alias("u"), F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("v")), "pool-ranges")
    within = Window.partitionBy("range").orderBy("boundary")
    corner = lambda c, o: (F.col(o) + F.sum(c).over(within)).alias(o)
    # corners of hulls: running sums (u, v) at the end of each block
    now = written(blocks.join(ranges, "range").select("group", "boundary", corner("n", "u"), corner("total", "v")), "pool-corners")
    left = ranges.count()
    starts = ranges.select((F.col("group") - 1).alias("group"), F.lit(None).cast("double").alias("boundary"), "u", "v").where("group = -1")
    while left > 1:
        pair, right = F.floor(F.col("group") / 2), F.col("group") % 2 == 1
        both = now.unionByName(starts.withColumn("group", F.lit(0).cast("int"))).withColumn("pair", pair).withColumn("right", right)
        # p: a corner of the left hull, q: one of the right; each in turn the one whose line to the other lies under its hull
        p = both.where("not right").groupBy("pair").agg(F.max(F.struct("u", "v")).alias("p"))
        line = written(p.withColumn("q", F.lit(None).cast("struct<u:double,v:double>")), "pool-line")
        while True:
            slope = lambda a, b: (b["v"] - a["v"]) / (b["u"] - a["u"])
            here = F.struct("u", "v")
            q = both.where("right").join(line.select("pair", "p"), "pair").groupBy("pair").agg(F.min(F.struct(slope(F.col("p"), here).alias("s"), (-F.col("u")).alias("far"), here.alias("c"))).alias("m")).select("pair", F.col("m.c").alias("new_q"))
            q = written(q, "pool-q")
            p = both.where("not right").join(q, "pair").groupBy("pair").agg(F.max(F.struct(slope(here, F.col("new_q")).alias("s"), (-F.col("u")).alias("far"), here.alias("c"))).alias("m")).select("pair", F.col("m.c").alias("new_p"))
            new = written(line.join(q, "pair", "left").join(p, "pair", "left").select("pair", F.coalesce("new_p", "p").alias("p"), F.col("new_q").alias("q"), (~F.col("p").eqNullSafe(F.coalesce("new_p", "p")) | ~F.col("q").eqNullSafe(F.col("new_q"))).alias("moved")), "pool-line")
            moved = new.where("moved").limit(1).count()
            forget(q, line)
            line = new.drop("moved")
            line._lotline_path = new._lotline_path
            if not moved:
                break
        kept = now.withColumn("pair", pair).withColumn("right", right).join(line, "pair").where("q is null or (not right and u <= p.u) or (right and u >= q.u)")
        new = written(kept.select(F.col("pair").cast("int").alias("group"), "boundary", "u", "v"), "pool-corners")
        forget(now, line)
        now, left = new, -(-left // 2)
    # blocks between neighbouring corners; ranges of corners are found anew, their ends are a row a range
    placed = written(now.repartitionByRange("boundary").sortWithinPartitions("boundary").select("boundary", "u", "v", F.spark_partition_id().alias("part")), "pool-placed")
    ends = placed.groupBy("part").agg(F.max(F.struct("boundary", "u", "v")).alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("last"))
    order = Window.partitionBy("part").orderBy("boundary")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(order), F.col(f"last.{c}"), F.lit(0.0))
    out = written(placed.join(ends, "part").select("boundary", step("u").alias("n"), step("v").alias("total")), "pool-blocks")
    forget(now, placed, ranges)
    forget(blocks)
    return out.select("boundary", "n", "total", (F.col("total") / F.col("n")).alias("mean"))


def calibrated(scores: DataFrame, score: str, cells: DataFrame) -> DataFrame:
    """Adds the mean of the first cell whose boundary is at least the score (the last cell beyond all); null for a null score.

    The cells left by pooling go to the tasks as two sorted arrays, which each row
    looks up by binary search; over LOOK_UP cells raise an error.
    """
    if cells.count() > LOOK_UP:
        raise ValueError(f"more than {LOOK_UP} cells can't be sent to all tasks")
    rows = cells.orderBy("boundary").select("boundary", "mean").toPandas()
    edges, means = rows["boundary"].to_numpy(float), rows["mean"].to_numpy(float)

    @F.pandas_udf("double")
    def look_up(s: pd.Series) -> pd.Series:
        if not len(edges):
            return pd.Series([None] * len(s), dtype=float)
        found = pd.Series(means[np.minimum(np.searchsorted(edges, s.to_numpy(float)), len(edges) - 1)])
        return found.where(s.notna())

    return scores.withColumn("calibrated", look_up(F.col(score)))


def smoothed(x: str, order: str, by: str, df: DataFrame, keep: float = 0.9) -> DataFrame:
    """Exponential smoothing of each series: s = keep * s + (1 - keep) * x, from the first value; a null repeats the last s.

    Rows are sorted within partitions and pass through with one number carried
    on, so a series may be of any length.
    """

    def run(batches):
        now, s = None, None
        for batch in batches:
            out = []
            for k, v in zip(batch.column(by).to_pylist(), batch.column(x).to_pylist()):
                if (k,) != now:
                    now, s = (k,), None
                if v is not None:
                    s = float(v) if s is None else keep * s + (1 - keep) * v
                out.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "smoothed"])

    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, StructType([*df.schema.fields]).add("smoothed", "double"))
