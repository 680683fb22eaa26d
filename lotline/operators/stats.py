"""Statistics with explicit divisors and weights, and evaluation of scored rows, as one-pass aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cost ratios at which errors are told.
COST_RATIOS = (1 / 199, 1 / 99, 1 / 49, 1 / 19, 1 / 9, 1 / 6, 1 / 4, 1 / 3, 1 / 2, 1.0, 2.0, 3.0, 4.0, 6.0, 9.0, 19.0, 49.0, 99.0, 199.0)


def total(x: Column) -> Column:
    return F.sum(x)


def inner_product(x: Column, y: Column, w: Column | None = None) -> Column:
    return F.sum(x * y if w is None else x * y * w)


def average(x: Column, divisor, w: Column | None = None) -> Column:
    return F.sum(x if w is None else x * w) / divisor


def sum_of_squares(x: Column, centre=0.0, w: Column | None = None) -> Column:
    d = (x - centre) * (x - centre)
    return F.sum(d if w is None else d * w)


def variance(x: Column, centre, df, w: Column | None = None) -> Column:
    return sum_of_squares(x, centre, w) / df


def covariance(x: Column, y: Column, cx, cy, df, w: Column | None = None) -> Column:
    return inner_product(x - cx, y - cy, w) / df


def cross_product(x: Column, y: Column) -> Column:
    """Sum of xy about the averages."""
    return F.sum(x * y) - F.count(x) * F.avg(x) * F.avg(y)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def weighted_variance(x: Column, w: Column) -> Column:
    """About the weighted mean, divided by the sum of weights."""
    return F.sum(w * x * x) / F.sum(w) - F.pow(weighted_mean(x, w), 2)


def reduce_array(op, values: Column) -> Column:
    """An associative operation across an array."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, 0), op)


def mands(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Count, mean, sd, standard error, least and largest of each column, a row a column."""
    aggs = []
    for c in columns:
        aggs.append(F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("se"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("largest")))
    return df.groupBy(*by).agg(F.array(*aggs).alias("x")).select(*by, F.inline("x"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least, largest, average, distinct values, scale and whether constant or 0/1, for all columns in one pass.

    Cells are counted by column and value before the shuffle, so what is shuffled
    are the distinct values of each task, not the rows once a column.
    """
    cells = df.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("at", "x"))
    values = cells.groupBy("at", "x").agg(F.count("*").alias("k"))
    plain = values.groupBy("at").agg(F.min("x").alias("least"), F.max("x").alias("largest"), F.try_divide(F.sum(F.col("x") * F.col("k")), F.sum(F.when(F.col("x").isNotNull(), F.col("k")))).alias("average"), F.count("x").alias("n_unique"))
    named = plain.select(F.get(F.array(*map(F.lit, columns)), F.col("at")).alias("name"), "least", "largest", "average", "n_unique")
    return named.select("*", ((F.col("largest") - F.col("least")) / 6).alias("scale"), (F.col("n_unique") == 1).alias("is_constant"), ((F.col("n_unique") == 2) & (F.col("least") == 0) & (F.col("largest") == 1)).alias("is_dummy"))


def without_constants(df: DataFrame) -> DataFrame:
    """The columns that take more than one value; one pass over least and largest."""
    names = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))]
    row = df.agg(*(F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"v{i}") for i, c in enumerate(names))).first()
    drop = {c for i, c in enumerate(names) if not row[f"v{i}"]}
    return df.select(*(c for c in df.columns if c not in drop))


def confusion(df: DataFrame, y: Column, yhat: Column, threshold: float = 0.5) -> DataFrame:
    """Counts of the four outcomes (below the threshold is 0) and what follows from them."""
    hit, real = yhat >= threshold, y == 1
    n = df.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return n.select("*", share("tp", "fn").alias("sensitivity"), share("tn", "fp").alias("specificity"), share("tp", "fp").alias("precision"), F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), F.try_divide(100.0 * (F.col("tp") + F.col("tn")), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("percent_correct"))


def cost_curve(df: DataFrame, y: Column, yhat: Column, ratios=COST_RATIOS) -> DataFrame:
    """Errors of both types at the threshold 1/(1 + rho) of each cost ratio, and e1 + rho e2; one pass."""
    aggs = []
    for rho in ratios:
        t = 1 / (1 + rho)
        aggs.append(F.struct(F.lit(rho).alias("rho"), F.count_if((yhat >= t) & (y == 0)).alias("type1"), F.count_if((yhat < t) & (y == 1)).alias("type2")))
    out = df.agg(F.array(*aggs).alias("x"), F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    return out.select(F.inline("x"), "n0", "n1").withColumn("cost", F.col("type1") + F.col("rho") * F.col("type2"))


def auc_trapezoid(curve: DataFrame) -> DataFrame:
    """Area under the curve through the points of a cost curve and the corners; the curve has a row a ratio."""
    points = curve.select((F.col("type1") / F.col("n0")).alias("x"), (1 - F.col("type2") / F.col("n1")).alias("y"))
    corners = points.agg(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))).alias("c")).select(F.inline("c"))
    w = Window.partitionBy().orderBy("x", "y")
    step = points.unionByName(corners).select("x", "y", F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"))
    return step.agg(F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2).alias("auc"))


def error_area(curve: DataFrame) -> DataFrame:
    """Area under the points of a cost curve in order of rho, both errors divided by the number of all rows, from (0, 0) to (1, 1)."""
    n = F.col("n0") + F.col("n1")
    points = curve.select("rho", (F.col("type1") / n).alias("x"), (1 - F.col("type2") / n).alias("y"))
    before = F.struct(F.lag("x", 1, 0.0).over(Window.partitionBy().orderBy("rho")).alias("x"), F.lag("y", 1, 0.0).over(Window.partitionBy().orderBy("rho")).alias("y"))
    step = points.withColumn("was", before)
    sums = step.agg(F.sum((F.col("x") - F.col("was.x")) * (F.col("y") + F.col("was.y")) / 2).alias("s"), F.max_by(F.struct("x", "y"), "rho").alias("last"))
    return sums.select((F.col("s") + (1 - F.col("last.x")) * (1 + F.col("last.y")) / 2).alias("area"))


def loglik_sse(df: DataFrame, y: Column, p: Column, edge: float = 1e-10) -> DataFrame:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return df.agg(F.count("*").alias("n"), F.sum(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("loglik"), F.sum((y - p) * (y - p)).alias("sse"))


def autocovariance(df: DataFrame, value: str, order: str, by: list[str], lags: int, centred: bool = True) -> DataFrame:
    """Sums of lagged products about the mean, divided by the number of values, at lags 0 to lags of each series."""
    w = Window.partitionBy(*by).orderBy(order)
    x = F.col(value) - (F.avg(value).over(Window.partitionBy(*by)) if centred else 0.0)
    rows = df.withColumn("__x", x)
    for k in range(lags + 1):
        rows = rows.withColumn(f"__p{k}", F.col("__x") * F.lag("__x", k).over(w) if k else F.col("__x") * F.col("__x"))
    sums = rows.groupBy(*by).agg(F.array(*(F.struct(F.lit(k).alias("lag"), (F.coalesce(F.sum(f"__p{k}"), F.lit(0.0)) / F.count(value)).alias("autocovariance")) for k in range(lags + 1))).alias("x"))
    out = sums.select(*by, F.inline("x"))
    first = F.first("autocovariance").over(Window.partitionBy(*by).orderBy("lag"))
    return out.withColumn("autocorrelation", F.try_divide(F.col("autocovariance"), first))


def item_summary(answers: DataFrame, person: str, item: str, right: str) -> DataFrame:
    """Per item: percent right and correlation with the person's total."""
    totals = answers.groupBy(person).agg(F.sum(right).alias("total"))
    return answers.join(totals, person).groupBy(item).agg(F.count("*").alias("n"), (100 * F.avg(right)).alias("percent"), F.corr(right, "total").alias("item_total"))


def item_choices(answers: DataFrame, item: str, choice: str) -> DataFrame:
    """(item, choice, n, percent): how often each choice of an item was made; a missing one counts as a choice."""
    n = answers.groupBy(item, choice).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(item)))


def pair_distance_scale(df: DataFrame, vector: str, key: str, rows: int = 500) -> DataFrame:
    """Mean euclidean distance over all ordered pairs (of a row with itself too) of a stated number of sampled rows."""
    from .sample import exact_sample

    s = exact_sample(df.select(key, vector), key, rows)
    pairs = s.select(F.col(key).alias("a"), F.col(vector).alias("x")).join(F.broadcast(s.select(F.col(key).alias("b"), F.col(vector).alias("y"))), F.lit(True))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda u, v: u + v))
    return pairs.agg(F.avg(d).alias("scale"))


def entropy_bits(p: Column) -> Column:
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
    return part(p) + part(1 - p)


def normal_code_bits(z: Column) -> Column:
    return 0.5 * math.log2(2 * math.pi) + z * z / (2 * math.log(2))
