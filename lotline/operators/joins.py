"""Lookups, gathers and pairings as joins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one part of a table whose pairs are made, and rows whose values with a part are held at once.
PAIR_ROWS, PAIR_STEP = 4096, 64


def lookup(tokens: DataFrame, dictionary: DataFrame, token: str, vector: str, unknown: list[float], missing: str = "NA") -> DataFrame:
    """Each token's vector; the unknown one where the dictionary lacks it, null where the token is missing."""
    found = tokens.join(dictionary.select(F.col(token), F.col(vector)), token, "left")
    default = F.array(*(F.lit(float(v)) for v in unknown))
    return found.withColumn(vector, F.when(F.col(token).isNull() | (F.col(token) == missing), None).otherwise(F.coalesce(vector, default)))


def gather(df: DataFrame, row: str, index: str, value: str, name: str) -> DataFrame:
    """The value of the row that each row's index names."""
    return df.join(df.select(F.col(row).alias(index), F.col(value).alias(name)), index, "left")


def permute(df: DataFrame, row: str, permutation: DataFrame) -> DataFrame:
    """Rows in the places that a permutation (row, to) gives them."""
    return df.join(permutation, row).drop(row).withColumnRenamed("to", row)


def zip_rows(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """Rows of equal number side by side."""
    return a.join(b, row)


def quadratic_pairs(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, kernel) with (x.y + 2)^2 for all pairs i <= j of an integer key, rows with themselves included.

    All pairs are the result, so the work is the square of the rows. The table is
    dealt to parts of about PAIR_ROWS rows by hash, and each pair of parts is one
    task's work, which holds their rows and PAIR_STEP lines of values; each row is
    shuffled once for each part. Products are added one after another, as a loop
    over the components does. Null vectors, null components and vectors of unequal
    length give null; rows without a key are in no pair.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x")).where("key is not null")
    n = rows.count()
    # small tables are cut so that each core has some pairs of parts, if a part keeps PAIR_STEP rows
    parts = max(1, -(-n // PAIR_ROWS), min(n // PAIR_STEP, math.isqrt(4 * df.sparkSession.sparkContext.defaultParallelism)))
    cell = lambda k: F.struct(F.least("part", k).alias("p"), F.greatest("part", k).alias("q"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", "x"), F.lit(parts)).cast("int")).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), cell)))
    number = (F.col("cell.q") * (F.col("cell.q") + 1) / 2 + F.col("cell.p")).cast("int")
    dealt = dealt.select(number.alias("cell"), (F.col("part") == F.col("cell.q")).alias("second"), "key", "x").repartitionById(parts * (parts + 1) // 2, F.col("cell"))

    def values(table: pa.Table, cell: int):
        second, keys, lists = (table.column(k).combine_chunks() for k in ("second", "key", "x"))
        second, keys = second.to_numpy(zero_copy_only=False), keys.to_numpy()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        flat = lists.flatten()
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        x = np.zeros((len(keys), max(size.max(), 1)))
        x[np.repeat(np.arange(len(keys)), size), at] = pc.fill_null(flat, 0.0).to_numpy()
        lost = lists.is_null().to_numpy(zero_copy_only=False)
        lost[np.repeat(np.arange(len(keys)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        q = (math.isqrt(8 * cell + 1) - 1) // 2
        within = cell == q * (q + 1) // 2 + q
        a, b = (np.arange(len(keys)),) * 2 if within else (np.flatnonzero(~second), np.flatnonzero(second))
        columns = np.ascontiguousarray(x[b].T)
        for s in range(0, len(a), PAIR_STEP):
            mine = a[s : s + PAIR_STEP]
            sums = np.zeros((len(mine), len(b)))
            with np.errstate(all="ignore"):
                for u, v in zip(x[mine].T, columns):
                    sums += u[:, None] * v
                sums += 2
                sums *= sums
            if within:
                i, j = np.nonzero(mine[:, None] <= b)
            else:
                i, j = (k.ravel() for k in np.indices(sums.shape))
            twice = (keys[mine[i]] == keys[b[j]]) & (mine[i] != b[j])  # i <= j holds both ways
            i, j = np.append(i, i[twice]), np.append(j, j[twice])
            one, two = keys[mine[i]], keys[b[j]]
            none = lost[mine[i]] | lost[b[j]] | (size[mine[i]] != size[b[j]])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(sums[i, j], mask=none)], names=["i", "j", "kernel"])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            for cell in pc.unique(table.column("cell")).to_pylist():
                yield from values(table.filter(pc.equal(table.column("cell"), cell)), cell)

    return dealt.mapInArrow(run, "i long, j long, kernel double")
