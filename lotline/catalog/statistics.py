"""Aggregates and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as A
from ..operators.gram import products
from .registry import query, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS largest, round(avg({c}), 4) AS average, count(DISTINCT {c}) AS n_unique, round((max({c}) - min({c})) / 6, 6) AS scale, count(DISTINCT {c}) = 1 AS is_constant, count(DISTINCT {c}) = 2 AND min({c}) = 0 AND max({c}) = 1 AS is_dummy FROM lineitem" for c in [*NUM, "l_linenumber"]))
def column_profile(spark, sf):
    p = A.profile(table(spark, sf, "lineitem"), [*NUM, "l_linenumber"])
    return p.withColumn("average", F.round("average", 4)).withColumn("scale", F.round("scale", 6))


@query("SELECT o_orderpriority, 'o_totalprice' AS name, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se, min(o_totalprice) AS least, max(o_totalprice) AS largest FROM orders GROUP BY 1")
def mean_sd_summary(spark, sf):
    m = A.mands(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderpriority"])
    return m.select("o_orderpriority", "name", "n", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "se")), "least", "largest")


@query("""SELECT l_returnflag, round(sum(l_quantity * l_tax) / sum(l_quantity), 8) AS mean_tax, round(sum(l_quantity * l_tax * l_tax) / sum(l_quantity) - pow(sum(l_quantity * l_tax) / sum(l_quantity), 2), 8) AS var_tax,
round(sum(l_quantity * pow(l_discount - 0.05, 2)), 4) AS wss, round(sum(pow(l_discount - 0.05, 2)) / 100, 6) AS variance, round(sum((l_discount - 0.05) * (l_tax - 0.04) * l_quantity) / 50, 4) AS wcov, round(sum(l_tax * l_quantity), 4) AS wsum FROM lineitem GROUP BY 1""")
def weighted_stats(spark, sf):
    q, t, d = (F.col(c) for c in ("l_quantity", "l_tax", "l_discount"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(A.weighted_mean(t, q), 8).alias("mean_tax"), F.round(A.weighted_variance(t, q), 8).alias("var_tax"), F.round(A.sum_of_squares(d, 0.05, q), 4).alias("wss"), F.round(A.variance(d, 0.05, 100), 6).alias("variance"), F.round(A.covariance(d, t, 0.05, 0.04, 50, q), 4).alias("wcov"), F.round(A.inner_product(t, q), 4).alias("wsum"))


@query("""SELECT round(sum(l_quantity * l_tax) - count(*) * avg(l_quantity) * avg(l_tax), 3) AS qt, round(sum(l_quantity * l_discount) - count(*) * avg(l_quantity) * avg(l_discount), 3) AS qd, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov, round(corr(l_quantity, l_extendedprice), 8) AS r, round(corr(l_discount, l_tax), 8) AS r2, round(var_samp(l_tax), 10) AS v FROM lineitem""")
def cross_products(spark, sf):
    q, t, d, e = (F.col(c) for c in ("l_quantity", "l_tax", "l_discount", "l_extendedprice"))
    return table(spark, sf, "lineitem").agg(F.round(A.cross_product(q, t), 3).alias("qt"), F.round(A.cross_product(q, d), 3).alias("qd"), F.round(F.covar_samp(q, e), 3).alias("cov"), F.round(F.corr(q, e), 8).alias("r"), F.round(F.corr(d, t), 8).alias("r2"), F.round(F.var_samp(t), 10).alias("v"))


_G = ["1", *NUM]


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(CAST({_G[i]} AS DOUBLE) * {_G[j]}) / 1e6, 4) AS s FROM lineitem" for i in range(5) for j in range(i, 5)))
def gram_matrix(spark, sf):
    return products(table(spark, sf, "lineitem"), {c: F.col(c) for c in NUM}).select("i", "j", F.round(F.col("s") / 1e6, 4).alias("s"))


_WIDE = [f"{a} * {k}" for k in range(1, 5) for a in ("l_discount", "l_tax", "(l_discount * l_tax)", "(l_quantity / 50)", "(l_linenumber / 7e0)")]


@query("SELECT i, j, round(sum(a[i + 1] * a[j + 1]) + 3e-5, 3) AS s FROM (SELECT [1e0, " + ", ".join(_WIDE) + "] AS a FROM lineitem), range(21) x(i), range(21) y(j) WHERE i <= j GROUP BY i, j")
def gram_wide(spark, sf):
    """More columns than plain sums are made for. The sums are short decimals that may lie on a tie, so a little is added before they are rounded, in the SQL too."""
    return products(table(spark, sf, "lineitem"), {c: F.expr(c) for c in _WIDE}).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round(F.col("s") + 3e-5, 3).alias("s"))


_SCORED = "(SELECT l.toxic AS y, least(0.99, greatest(0.01, 0.15 + 0.1 * l.quality + (d.doc_id % 10) / 20.0 + d.n_chars / 100000.0)) AS p, d.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def scored_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), 0.15 + 0.1 * F.col("quality") + (F.col("doc_id") % 10) / 20.0 + F.col("n_chars") / 100000.0))
    return d.select(F.col("toxic").alias("y"), p.alias("p"), "doc_id")


@query(f"""SELECT tp, fp, fn, tn, round(tp / CAST(tp + fn AS DOUBLE), 8) AS sensitivity, round(tn / CAST(tn + fp AS DOUBLE), 8) AS specificity, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END, 8) AS "precision", round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1, round(100.0 * (tp + tn) / (tp + fp + fn + tn), 8) AS percent_correct
FROM (SELECT count(*) FILTER (p >= .5 AND y = 1) AS tp, count(*) FILTER (p >= .5 AND y = 0) AS fp, count(*) FILTER (p < .5 AND y = 1) AS fn, count(*) FILTER (p < .5 AND y = 0) AS tn FROM {_SCORED})""")
def confusion_metrics(spark, sf):
    c = A.confusion(scored_rows(spark, sf), F.col("y"), F.col("p"))
    return c.select("tp", "fp", "fn", "tn", *(F.round(x, 8).alias(x) for x in ("sensitivity", "specificity", "precision", "f1", "percent_correct")))


_RHO = ", ".join(f"({r!r})" for r in A.COST_RATIOS)
_COST = f"SELECT rho, count(*) FILTER (p >= 1 / (1 + rho) AND y = 0) AS type1, count(*) FILTER (p < 1 / (1 + rho) AND y = 1) AS type2, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM {_SCORED}, (SELECT CAST(r AS DOUBLE) AS rho FROM (VALUES {_RHO}) v(r)) GROUP BY rho"


@query(f"SELECT rho, type1, type2, n0, n1, round(type1 + rho * type2, 6) AS cost FROM ({_COST})")
def cost_curve(spark, sf):
    return A.cost_curve(scored_rows(spark, sf), F.col("y"), F.col("p")).withColumn("cost", F.round("cost", 6))


@query(f"SELECT round(sum((x - x0) * (y + y0) / 2), 8) AS auc FROM (SELECT x, y, lag(x) OVER (ORDER BY x, y) AS x0, lag(y) OVER (ORDER BY x, y) AS y0 FROM (SELECT type1 / CAST(n0 AS DOUBLE) AS x, 1 - type2 / CAST(n1 AS DOUBLE) AS y FROM ({_COST}) UNION ALL VALUES (0.0::DOUBLE, 0.0::DOUBLE), (1.0::DOUBLE, 1.0::DOUBLE)))")
def roc_auc_trapezoid(spark, sf):
    return A.auc_trapezoid(A.cost_curve(scored_rows(spark, sf), F.col("y"), F.col("p"))).select(F.round("auc", 8).alias("auc"))


@query(f"""WITH c AS ({_COST}), p AS (SELECT rho, type1 / CAST(n0 + n1 AS DOUBLE) AS x, 1 - type2 / CAST(n0 + n1 AS DOUBLE) AS y FROM c UNION ALL SELECT 1e9, 1, 1 UNION ALL SELECT -1, 0, 0)
SELECT round(sum((x - x0) * (y + y0) / 2), 8) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY rho) AS x0, lag(y) OVER (ORDER BY rho) AS y0 FROM p)""")
def error_area(spark, sf):
    return A.error_area(A.cost_curve(scored_rows(spark, sf), F.col("y"), F.col("p"))).select(F.round("area", 8).alias("area"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for i, a in enumerate(NUM) for b in NUM[i:]))
def corr_matrix(spark, sf):
    pairs = [(a, b) for i, a in enumerate(NUM) for b in NUM[i:]]
    row = table(spark, sf, "lineitem").agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 8).alias("r")) for a, b in pairs)).alias("x"))
    return row.select(F.inline("x"))


@query(f"SELECT count(*) AS n, round(sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS loglik, round(sum((y - p) * (y - p)), 6) AS sse FROM {_SCORED}")
def loglik_sse(spark, sf):
    return A.loglik_sse(scored_rows(spark, sf), F.col("y"), F.col("p")).select("n", F.round("loglik", 6).alias("loglik"), F.round("sse", 6).alias("sse"))


@query("""WITH c AS (SELECT user_id, ts, event_id, value, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events),
l AS (SELECT *, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, count(*) AS n, sum(x * x) AS s0, coalesce(sum(x * x1), 0) AS s1, coalesce(sum(x * x2), 0) AS s2 FROM l GROUP BY user_id)
SELECT user_id, k AS lag, round(CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END / n, 5) AS autocovariance, round(CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END / nullif(s0, 0), 6) AS autocorrelation FROM s, (VALUES (0), (1), (2)) v(k)""")
def autocorr(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return A.autocovariance(e, "value", "at", ["user_id"], 2).select("user_id", "lag", F.round("autocovariance", 5).alias("autocovariance"), F.round("autocorrelation", 6).alias("autocorrelation"))


@query("""WITH a AS (SELECT o_custkey AS person, o_orderpriority AS item, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS ok FROM orders), t AS (SELECT person, sum(ok) AS total FROM a GROUP BY person)
SELECT item, count(*) AS n, round(100 * avg(ok), 6) AS percent, round(corr(ok, total), 6) AS item_total FROM a JOIN t USING (person) GROUP BY item""")
def item_summary(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("item"), (F.col("o_totalprice") > 200000).cast("int").alias("ok"))
    return A.item_summary(a, "person", "item", "ok").select("item", "n", F.round("percent", 6).alias("percent"), F.round("item_total", 6).alias("item_total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) FILTER (l_discount > 0.05) AS over FROM lineitem GROUP BY 1, 2")
def category_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count_if(F.col("l_discount") > 0.05).alias("over"))


@query("SELECT user_id, max(value) AS reduced_max, round(sum(value), 4) AS reduced_sum, count(*) AS n FROM events GROUP BY user_id")
def array_reduce(spark, sf):
    """Arrays of at most 100 values are reduced by themselves, and their results by plain aggregates, so no series is gathered whole."""
    part = F.floor(F.col("event_id") / 100)
    a = table(spark, sf, "events").groupBy("user_id", part).agg(F.sort_array(F.collect_list("value")).alias("v"))
    r = a.select("user_id", A.reduce_array(lambda x, y: F.greatest(x, y), F.col("v")).alias("m"), A.reduce_array(lambda x, y: x + y, F.col("v")).alias("s"), F.size("v").cast("long").alias("n"))
    return r.groupBy("user_id").agg(F.max("m").alias("reduced_max"), F.round(F.sum("s"), 4).alias("reduced_sum"), F.sum("n").alias("n"))


@query("SELECT l_linenumber, l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linenumber), 6) AS percent FROM lineitem GROUP BY l_linenumber, l_returnflag")
def item_choices(spark, sf):
    return A.item_choices(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag").withColumn("percent", F.round("percent", 6))


@query("SELECT word, freq FROM (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word HAVING count(*) > 5) ORDER BY freq DESC, word LIMIT 200")
def frequent_keywords(spark, sf):
    from ..operators.expand import keywords

    return keywords(table(spark, sf, "documents"), "text", 5, 200)
