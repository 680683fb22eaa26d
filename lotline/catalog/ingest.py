"""Queries on sources and sinks: a table is written in a format, then read back from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import stats as A
from ..sources import files as S
from ..storage import shared_dir
from .registry import query, table


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, name: str, *order: str) -> str:
    """Writes the column value as lines, in order, and tells where."""
    path = _path(df.sparkSession, name)
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).select("value").write.text(path)
    return path


@query("SELECT 'v_' || vec_id AS name, CAST(label AS VARCHAR) AS label, unnest(range(len(embedding))) AS row, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def column_file(spark, sf):
    e = table(spark, sf, "embeddings")
    values = F.concat_ws(" ", F.transform("embedding", lambda v: F.coalesce(v.cast("string"), F.lit(S.MISSING))))
    triples = e.select(F.concat_ws("\n", F.concat(F.lit("v "), "vec_id"), F.concat(F.lit("role=x, label="), "label"), values).alias("value"))
    path = _lines(spark.createDataFrame([("64",)], "value string").coalesce(1).union(triples), "columns")
    stream = S.column_stream(spark, path)
    rows = S.long_values(stream).join(stream.select("field", "attrs"), "field")
    return rows.select("name", F.col("attrs")["label"].alias("label"), F.col("row").cast("long").alias("row"), F.col("value").cast("float").cast("double").alias("value"))


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, p_brand, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS p_size, p_retailprice FROM part")
def csv_file(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_partkey") % 7 > 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    path = _path(spark, "csv")
    p.toDF("p_partkey", "p_name {role=x; stream=NAMES}", "p_brand", "p_size", "p_retailprice {role=y}").write.option("header", True).csv(path)
    return S.typed(S.csv_table(spark, path)[0])


@query("SELECT CASE WHEN p_partkey % 5 > 0 THEN p_name END AS p_name, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def c45_file(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).alias("p_name"), "p_size", "p_retailprice")
    path = _path(spark, "c45")
    S.write_c45(p, path)
    names = spark.createDataFrame([("| parts",), ("p_retailprice.",), ("p_name: widget, bolt.",), ("p_size: continuous.",), ("p_retailprice: continuous.",)], "value string")
    return S.c45_table(spark, _lines(names.coalesce(1), "names"), path)


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS p_size, p_retailprice FROM part")
def rows_and_names_file(spark, sf):
    size = F.when(F.col("p_partkey") % 3 > 0, F.col("p_size").cast("string")).otherwise(S.MISSING)
    data = _lines(table(spark, sf, "part").select(F.concat_ws(" ", "p_partkey", size, "p_retailprice").alias("value")), "rows")
    names = _lines(spark.createDataFrame([("p_partkey p_size",), ("p_retailprice",)], "value string").coalesce(1), "names")
    return S.rows_with_names(spark, data, names)


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS line, CAST(label % 2 = 1 AS INT) AS y, unnest(range(len(embedding))) AS index, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def sparse_file(spark, sf):
    cells = F.concat_ws(" ", F.transform("embedding", lambda v, i: F.concat_ws(":", i + 1, v)))
    e = table(spark, sf, "embeddings").select("vec_id", F.concat_ws(" ", F.when(F.col("label") % 2 == 1, "+1").otherwise("-1"), cells).alias("value"))
    s = S.sparse_rows(spark, _lines(e, "sparse", "vec_id"))
    return s.select("line", S.binary_label(F.col("label")).alias("y"), F.col("index").cast("long").alias("index"), F.col("value").cast("float").cast("double").alias("value"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, unnest([p_size % 8, 8 + p_partkey % 4]) AS index, CAST(1 AS DOUBLE) AS value FROM part")
def indicator_file(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.col("p_size") % 8 + 1, F.col("p_partkey") % 4 + 9).alias("value"))
    s = S.indicator_rows(spark, _lines(p, "indicators", "p_partkey"))
    return s.select("line", F.col("index").cast("long").alias("index"), "value")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, CAST(row_number() OVER (ORDER BY p_partkey) <= 500 AS INT) AS y, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1 FROM part")
def positional_label_file(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_size", "p_retailprice").alias("value"))
    s = S.positional_rows(spark, _lines(p, "positional", "p_partkey"), 500)
    return s.select("line", "y", *(F.get("values", i).alias(f"x{i}") for i in range(2)))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS f0, o_orderpriority AS f1, o_orderstatus AS f2 FROM orders")
def fixed_width_file(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, " "), F.rpad("o_orderpriority", 18, " "), "o_orderstatus").alias("value"))
    f = S.fixed_width(spark, _lines(o, "fixed"), [(1, 12), (13, 30), (31, 31)])
    return f.select(*(F.trim(c).alias(c) for c in f.columns))


@query("SELECT o_orderstatus AS status, count(*) AS lines, 3 AS fields FROM orders GROUP BY 1")
def file_sizes(spark, sf):
    path = _path(spark, "counted")
    table(spark, sf, "orders").select(F.concat_ws(" ", "o_orderkey", "o_custkey", "o_totalprice").alias("value"), "o_orderstatus").write.partitionBy("o_orderstatus").text(path)
    status = F.regexp_extract("file", "o_orderstatus=([^/]*)/", 1)
    return S.file_counts(spark, path).groupBy(status.alias("status")).agg(F.sum("lines").alias("lines"), F.max("fields").alias("fields"))


@query("SELECT p_partkey AS row, p_brand AS id, p_size % 3 AS rating, lower(p_type) AS text FROM part WHERE p_size % 3 <> 0")
def review_rows(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "row")
    return S.reviews(p.select("row", F.col("p_brand").alias("id")), p.select("row", (F.col("p_size") % 3).alias("rating")), p.select("row", F.col("p_type").alias("text")))


@query("SELECT c_custkey, c_acctbal FROM customer")
def varying_columns(spark, sf):
    """Constant columns are left out."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(1.0).alias("one"), F.lit("x").alias("same"))
    return A.without_constants(c)


@query("SELECT (n_nationkey * 7 + 3) % 25 AS n_nationkey, n_name FROM nation")
def permuted_rows(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return J.permute(n, "n_nationkey", n.select("n_nationkey", ((F.col("n_nationkey") * 7 + 3) % 25).alias("to")))
