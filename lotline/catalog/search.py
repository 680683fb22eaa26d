"""Search and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import auction as A
from ..plans import streams as S
from ..plans.features import base_features
from .registry import query, table


def small_auction(spark, sf, rounds: int = 40) -> A.Auction:
    """Price of a line item from its numbers, their products and powers."""
    df = table(spark, sf, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int")).withColumn("open", (F.col("l_linestatus") == "O").cast("int"))
    base = base_features(df, ["l_quantity", "l_discount", "l_tax", "l_linenumber", "returned", "open"])
    model = A.Model(df, F.log("l_extendedprice"), F.col("l_orderkey") % 4 != 0)
    wealth = A.shares(1.0)
    names = model.in_model
    auction = A.Auction(model, [])
    auction.experts += [
        A.Expert("main", wealth["main"], A.bounded_universal_bid, S.cyclic("main", base, names)),
        A.Expert("powers", wealth["interaction"] / 2, A.finite_bid, S.polynomials("powers", base, names, 3)),
        A.Expert("products", wealth["interaction"] / 2, A.universal_bid, S.interactions("products", base), "scavenger"),
        A.Expert("calibration", A.CALIBRATION_WEALTH, A.fit_bid(A.CALIBRATION_BID), S.calibrations("calibration", model.fitted_powers), "calibrate"),
    ]
    return auction.run(rounds)


@query()
def auction_progress(spark, sf):
    return small_auction(spark, sf).progress(spark)


@query()
def auction_model(spark, sf):
    f = small_auction(spark, sf).model.fit()
    return spark.createDataFrame([(t, float(b), float(s)) for t, b, s in zip(["1", *f.xs], f.beta, f.errors())], "term string, beta double, se double")


@query()
def auction_scores(spark, sf):
    """Rows with role, fit and residual, as a saved model scores them."""
    auction = small_auction(spark, sf, 12)
    terms = A.saved(auction.model)
    df = auction.model.df
    base = {f.name: f for f in base_features(df, ["l_quantity", "l_discount", "l_tax", "l_linenumber", "returned", "open"])}
    fitted = A.restored(terms, base)
    return df.select(F.when(F.col("l_orderkey") % 4 != 0, "est").otherwise("val").alias("role"), "l_orderkey", "l_linenumber", fitted.alias("fit"), (F.log("l_extendedprice") - fitted).alias("residual"))
