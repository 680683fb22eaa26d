"""Reshaping, join and expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expand as E
from ..operators import joins as J
from ..operators import reshape as R
from .registry import query, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUS = ["F", "O", "P"]


@query("SELECT year(o_orderdate) AS y, " + ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{s}') AS {s}" for s in STATUS) + " FROM orders GROUP BY 1")
def pivot_wide(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return R.pivot(o, "y", "o_orderstatus", "o_totalprice", "o_orderkey", STATUS)


@query("SELECT o_custkey % 50 AS g, " + ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{s}') AS {s}" for s in STATUS) + " FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def pivot_threshold(spark, sf):
    o = table(spark, sf, "orders").withColumn("g", F.col("o_custkey") % 50)
    return R.pivot_over(o, "g", "o_orderstatus", "o_totalprice", "o_orderkey", F.abs("o_totalprice"), 150000.0, STATUS)


@query("SELECT o_orderstatus AS s, o_custkey % 20 AS e, " + ", ".join(f"round(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 2) AS \"{y}\"" for y in range(1995, 1999)) + " FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1998 GROUP BY 1, 2")
def series_tables(spark, sf):
    o = table(spark, sf, "orders").where(F.year("o_orderdate").between(1995, 1998))
    sums = o.groupBy(F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 20).alias("e"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return R.series_tables(sums, "s", "e", "y", "v", list(range(1995, 1999)), -7.777777)


@query("SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_long(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return R.unpivot(p, ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT name, " + ", ".join(f"max(value) FILTER (s_suppkey = {k}) AS \"{k}\"" for k in range(1, 6)) + " FROM (SELECT s_suppkey, 's_acctbal' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier) WHERE s_suppkey BETWEEN 1 AND 5 GROUP BY name")
def transpose_rows(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey between 1 and 5").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return R.transpose(s, "s_suppkey", ["s_acctbal", "s_nationkey"], list(range(1, 6)))


@query("SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return R.append(c, table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))


@query("SELECT s_suppkey, count(*) AS n FROM supplier, range(3) WHERE range < [2, 0, 3][(s_suppkey % 3) + 1] GROUP BY 1")
def expand_rows(spark, sf):
    return R.repeat_cyclic(table(spark, sf, "supplier"), "s_suppkey", [2, 0, 3]).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT c_custkey, c_acctbal, (((c_custkey % 1073741824 + 7) * 2654435761) % 4294967296 + 0.5) / 4294967296 AS u, (((c_custkey * 40503 % 1073741824 + 7) * 2654435761) % 4294967296 + 0.5) / 4294967296 AS v FROM customer)
SELECT c_custkey, round(c_acctbal + (SELECT stddev_samp(c_acctbal) FROM customer) * sqrt(0.64 / 0.36) * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 5) AS x FROM u""")
def correlated_column(spark, sf):
    return R.correlated(table(spark, sf, "customer"), "c_acctbal", 0.6, "c_custkey", 7).select("c_custkey", F.round("x", 5).alias("x"))


@query("SELECT a.n_nationkey, b.n_name AS neighbor FROM nation a LEFT JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7) % 30")
def neighborhood_gather(spark, sf):
    n = table(spark, sf, "nation").withColumn("index", F.col("n_nationkey") * 7 % 30)
    return J.gather(n, "n_nationkey", "index", "n_name", "neighbor").select("n_nationkey", "neighbor")


@query("SELECT s_suppkey AS key, c_name AS other FROM supplier JOIN customer ON s_suppkey = c_custkey")
def zip_rows(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    return J.zip_rows(s, table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("other")), "key")


@query("""SELECT a.vec_id AS i, b.vec_id AS j, round(pow(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 2, 2), 4) AS kernel FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id WHERE a.label = 1 AND b.label = 1""")
def distance_quadratic(spark, sf):
    e = table(spark, sf, "embeddings").where("label = 1")
    k = J.quadratic_pairs(e, "vec_id", "embedding")
    return k.select("i", "j", F.round("kernel", 4).alias("kernel"))


@query("""SELECT d.doc_id, round(coalesce(l.quality, avg(l.quality) OVER ()), 8) AS quality, CAST(l.quality IS NULL AS INT) AS quality_missing FROM documents d LEFT JOIN labels l USING (doc_id)""")
def missing_fill_indicator(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    return E.numeric_with_missing(d, ["quality"]).withColumn("quality", F.round("quality", 8))


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT p_brand FROM c WHERE n < 75)
SELECT p_partkey, CASE WHEN (SELECT count(*) FROM r) >= 2 AND p_brand IN (SELECT p_brand FROM r) THEN 'OTHERS' ELSE p_brand END AS p_brand FROM part""")
def recode_rare(spark, sf):
    return E.rare_recoded(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 75)


@query("SELECT event_id, " + ", ".join(f"CAST(event_type = '{v}' AS INT) AS event_type_{v}" for v in ("click", "error", "purchase", "signup", "view")) + " FROM events")
def category_bundle(spark, sf):
    out = E.category_bundle(table(spark, sf, "events").select("event_id", "event_type"), "event_type")
    return out.drop("event_type")


@query("SELECT event_type AS level, row_number() OVER (ORDER BY n * (t - n) DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY 1)")
def level_order(spark, sf):
    names = E.levels(table(spark, sf, "events"), "event_type")
    return spark.createDataFrame([(v, i) for i, v in enumerate(names, 1)], "level string, place long")


@query("SELECT count(*) AS n, CAST(sum(CAST(l_linestatus = 'O' AS INT)) AS BIGINT) AS l_linestatus_O FROM lineitem")
def two_level_dummy(spark, sf):
    out = E.declared_dummies(table(spark, sf, "lineitem").select("l_linestatus"), "l_linestatus", ["F", "O"])
    return out.agg(F.count("*").alias("n"), F.sum("l_linestatus_O").alias("l_linestatus_O"))


@query("""WITH d(token, a, b) AS (VALUES ('click', 1.0, 2.0), ('view', 3.0, 5.0), ('signup', 0.5, 0.25)),
f AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE coalesce(a, 9.0) END AS e0, CASE WHEN event_type = 'error' THEN NULL ELSE coalesce(b, 8.0) END AS e1, event_type FROM events LEFT JOIN d ON token = event_type)
SELECT event_id, round(coalesce(e0, avg(e0) OVER ()), 6) AS w_ew0, round(coalesce(e1, avg(e1) OVER ()), 6) AS w_ew1, CAST(e0 IS NULL AS INT) AS w_Missing FROM f""")
def word_bundle_oov(spark, sf):
    d = spark.createDataFrame([("click", [1.0, 2.0]), ("view", [3.0, 5.0]), ("signup", [0.5, 0.25])], "token string, vector array<double>")
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "NA").otherwise(F.col("event_type")).alias("w"))
    out = E.word_bundle(e, "w", d, 2, [9.0, 8.0])
    return out.select("event_id", F.round("w_ew0", 6).alias("w_ew0"), F.round("w_ew1", 6).alias("w_ew1"), "w_Missing")


@query("SELECT doc_id, " + ", ".join(f"len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t = '{w}')) AS \"{w}\"" for w in ("the", "of", "and", "der", "que")) + ", CAST(list_last(string_split_regex(trim(text), '\\s+')) = 'the.' AS INT) AS y FROM documents")
def bag_of_words(spark, sf):
    d = table(spark, sf, "documents")
    bag = E.bag_of_words(d, "doc_id", "text", ["the", "of", "and", "der", "que"], E.last_word_is(F.col("text"), "the.").alias("y"))
    return bag.select("doc_id", *(F.col(w).cast("long").alias(w) for w in ("the", "of", "and", "der", "que")), "y")


@query("SELECT word, count(*) AS freq FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1 HAVING count(*) > 50")
def word_frequencies(spark, sf):
    return E.word_counts(table(spark, sf, "documents"), "text", 50)
