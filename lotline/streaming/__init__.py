"""Structured Streaming forms of the mergeable and stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.gram import products


def gram_updates(stream: DataFrame, columns: dict[str, Column], path: str, checkpoint: str):
    """Appends each micro-batch's cross-products to a table; gram_total() merges them."""

    def write(batch: DataFrame, number: int) -> None:
        products(batch, columns).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gram_total(updates: DataFrame) -> DataFrame:
    """Sums over batches; a batch that was written twice counts once."""
    return updates.dropDuplicates(["batch", "by", "i", "j"]).groupBy("by", "i", "j").agg(F.sum("s").alias("s"))


def windowed(stream: DataFrame, time: str, value: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Count, mean and sum over tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))


def kalman(stream: DataFrame, by: str, order: str, value: str, q: float = 1.0, r: float = 1.0) -> DataFrame:
    """Filtered level of each key's values as they come; state is the level and its variance."""
    kind = dict(stream.dtypes)[by]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, p = state.get if state.exists else (0.0, 1e6)
        for pdf in batches:
            rows = []
            for o, y in pdf.sort_values(order)[[order, value]].itertuples(index=False):
                p += q
                z, v = y - s, p + r
                s, p = s + p / v * z, p * (1 - p / v)
                rows.append((key[0], o, s, p, z))
            state.update((float(s), float(p)))
            yield pd.DataFrame(rows, columns=[by, order, "state", "variance", "innovation"])

    order_kind = dict(stream.dtypes)[order]
    return stream.select(by, order, value).groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, `{order}` {order_kind}, state double, variance double, innovation double", "s double, p double", "append", GroupStateTimeout.NoTimeout)
