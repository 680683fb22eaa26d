"""Scalar, string and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from .registry import query, table


@query("""SELECT c_custkey, abs(c_acctbal) AS abs_bal, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE -7.7 END, 6) AS log_bal,
round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) ELSE -7.7 END, 6) AS sqrt_bal, round(c_acctbal * c_acctbal, 2) AS sq,
round(pow((c_acctbal - 5000) / 1000, 3), 6) + 0.0 AS cube_c, round(pow((c_acctbal - 5000) / 1000, 5), 4) + 0.0 AS quint_c, round((c_acctbal - 4500) / 3000, 6) AS z FROM customer""")
def safe_transforms(spark, sf):
    x = F.col("c_acctbal")
    k = x / 1000 - 5
    return table(spark, sf, "customer").select("c_custkey", S.absolute(x).alias("abs_bal"), F.round(S.safe_log(x), 6).alias("log_bal"), F.round(S.safe_sqrt(x), 6).alias("sqrt_bal"), F.round(S.power(x, 2), 2).alias("sq"), F.round(S.centered_power((x - 5000) / 1000, 3, 0.0), 6).alias("cube_c"), F.round(S.power((x - 5000) / 1000, 5), 4).alias("quint_c"), F.round(S.standardize(x, 4500, 3000), 6).alias("z"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(1 / (1 + exp(-10 * l_discount)), 8) AS pos, round(1 / (1 + exp(10 * l_discount)), 8) AS neg,
round(ln(greatest(1e-6, least(1 - 1e-6, l_discount)) / (1 - greatest(1e-6, least(1 - 1e-6, l_discount)))), 6) AS logit,
round((CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * (l_tax * 50 - 2) - ln(1 + exp(l_tax * 50 - 2)), 8) AS ll, round(l_tax * (1 - l_tax), 8) AS var, round(2.5 * l_tax + l_discount, 8) AS axpy FROM lineitem""")
def logit_logistic(spark, sf):
    d, t = F.col("l_discount"), F.col("l_tax")
    y = (F.col("l_returnflag") == "R").cast("int")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(S.logistic(10 * d), 8).alias("pos"), F.round(S.logistic_reverse(10 * d), 8).alias("neg"), F.round(S.logit(d), 6).alias("logit"), F.round(S.logistic_loglik(y, t * 50 - 2), 8).alias("ll"), F.round(S.binomial_variance(t), 8).alias("var"), F.round(S.axpy(2.5, t, d), 8).alias("axpy"))


@query("""SELECT o_orderkey, round(exp(t / m - (t / m + 1 / (m * m)) * ln(1 + m * t)), 9) AS p, round(0.3 * pow(0.7, k - 1), 9) AS geo, round(1 / ((1 + k * k) * 1.07667), 9) AS cau,
round(-log2(1 / ((1 + k * k) * 1.07667)), 6) AS bits, round(0.5 * log2(2 * pi()) + t * t / (2 * ln(2)), 6) AS normal_bits
FROM (SELECT o_orderkey, o_totalprice / 100000 AS t, 0.5 + (o_custkey % 10) / 10.0 AS m, 1 + o_orderkey % 20 AS k FROM orders)""")
def code_lengths(spark, sf):
    from ..operators.stats import normal_code_bits

    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("t"), (0.5 + (F.col("o_custkey") % 10) / 10.0).alias("m"), (1 + F.col("o_orderkey") % 20).alias("k"))
    return o.select("o_orderkey", F.round(S.bennett_pvalue(F.col("t"), F.col("m")), 9).alias("p"), F.round(S.geometric_pdf(F.col("k"), 0.3), 9).alias("geo"), F.round(S.discrete_cauchy_pdf(F.col("k")), 9).alias("cau"), F.round(-F.log2(S.discrete_cauchy_pdf(F.col("k"))), 6).alias("bits"), F.round(normal_code_bits(F.col("t")), 6).alias("normal_bits"))


@query("""SELECT event_id, round(CASE WHEN x < 0 THEN 0.5 * (exp(x) - 1) WHEN x > 1 THEN 1 + 0.5 * (1 - exp(1 - x)) ELSE x END, 8) AS soft, greatest(0.0, least(1.0, x)) AS hard,
round(exp(-x * x / 2) / sqrt(2 * pi()), 8) AS npdf, round(1 / (pi() * (1 + x * x)), 8) AS cpdf, round(0.5 + atan(x) / pi(), 8) AS ccdf FROM (SELECT event_id, value / 50 - 0.5 AS x FROM events)""")
def soft_limits(spark, sf):
    x = F.col("value") / 50 - 0.5
    return table(spark, sf, "events").select("event_id", F.round(S.soft_limits(x), 8).alias("soft"), S.hard_limits(x).alias("hard"), F.round(S.normal_pdf(x), 8).alias("npdf"), F.round(S.cauchy_pdf(x), 8).alias("cpdf"), F.round(S.cauchy_cdf(x), 8).alias("ccdf"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 4.0 WHEN 1 THEN 3.67 WHEN 2 THEN 3.0 WHEN 3 THEN 0.67 WHEN 4 THEN 0.0 ELSE 2.33 END::DOUBLE AS points FROM orders""")
def grade_points(spark, sf):
    letter = F.get(F.array(*map(F.lit, ["A+", "A-", "B", "D-", "F", "C+"])), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", S.grade_points(letter).cast("double").alias("points"))


@query("""SELECT p_partkey, replace(replace(replace(trim(p_name), ' ', '_'), '*', ''), '^', '') AS clean, split_part(ltrim(p_name), ' ', 1) AS first_word, lower(p_brand) AS low,
split_part(p_type, ' ', 1) AS stream, replace(p_name, ',', '_') AS no_comma FROM part""")
def name_cleanup(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.clean_name(F.col("p_name")).alias("clean"), T.first_word(F.col("p_name")).alias("first_word"), F.lower("p_brand").alias("low"), F.substring_index("p_type", " ", 1).alias("stream"), T.without_commas(F.col("p_name")).alias("no_comma"))


@query("""SELECT event_id, event_type AS role, CAST(user_id % 7 AS VARCHAR) AS parent, 'parent=' || (user_id % 7) || ',role=' || event_type AS text, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def attribute_parse(spark, sf):
    line = F.concat(F.lit("role="), F.col("event_type"), F.lit(" , parent = "), (F.col("user_id") % 7).cast("string"))
    a = table(spark, sf, "events").select("event_id", T.attributes(line).alias("a"), "props")
    return a.select("event_id", F.col("a")["role"].alias("role"), F.col("a")["parent"].alias("parent"), T.attribute_text(F.col("a")).alias("text"), T.number(F.get_json_object("props", "$.k")).alias("k"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 16 AS INT) AS digit, o_orderkey % 5 = 0 AS nan, [10, 20, 30][(o_custkey % 3) + 1] AS element, round(o_totalprice / 50) * 50 AS rounded,
o_orderpriority || ', x' AS field, o_orderstatus AS bare, round(sqrt(abs(o_totalprice - 100000)), 6) AS composed, round(tan(pi() * ((o_custkey % 9 + 0.5) / 10 - 0.5)), 6) AS quantile, (o_custkey % 7) * 4 + o_orderkey % 4 AS quarter FROM orders""")
def values_of_text(spark, sf):
    price, key, customer = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    fields = T.csv_fields(F.concat(F.lit('"'), "o_orderpriority", F.lit(', x", '), F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))))
    quarter = F.concat_ws(".", customer % 7 + 1992, key % 4 + 1)
    return table(spark, sf, "orders").select("o_orderkey", T.hex_value(F.substring(F.hex("o_orderkey"), -1, 1)).alias("digit"), S.is_nan(F.when(key % 5 == 0, float("nan")).otherwise(price)).alias("nan"), F.get(F.array(*map(F.lit, (10, 20, 30))), (customer % 3).cast("int")).alias("element"), T.round_to_scale(price, 50000.0).alias("rounded"), S.element(fields, 0).alias("field"), S.element(fields, 1).alias("bare"), F.round(S.compose(F.sqrt, F.abs)(price - 100000), 6).alias("composed"), F.round(S.cauchy_quantile((customer % 9 + 0.5) / 10), 6).alias("quantile"), T.quarter_of_text(quarter).cast("long").alias("quarter"))


@query("""SELECT o_orderkey, (year(o_orderdate) - 1992) * 4 + quarter(o_orderdate) - 1 AS q, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def quarter_number(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", T.quarter_number(d).cast("long").alias("q"), T.day_of_number(F.date_format(d, "yyyyMMdd").cast("int")).cast("string").alias("day"))


@query("""SELECT p_partkey, CASE WHEN n > 1 THEN p_type || '_dup_' || n ELSE p_type END AS name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)""")
def distinct_names(spark, sf):
    return T.distinct_names(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("name")), "name", "p_partkey")
