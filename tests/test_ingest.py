import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline import streaming
from lotline.operators import expand, ordered, sample
from lotline.operators.gram import gram
from lotline.sources import files


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def written(folder, name, text):
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)
    return f"{folder}/{name}"


COLUMNS = """6
W one
type=map, domain=words
cat dog cat NA owl cat
POS
role=x, type=map,domain=categories
a b a c a b
X1*
role=y
1 2 NA 4 5 6
X1
role=x
6 5 4 3 2 1
"""


def test_column_stream(spark, folder):
    s = files.column_stream(spark, written(folder, "c.dat", COLUMNS))
    rows = {r["field"]: r for r in s.collect()}
    assert [rows[i]["name"] for i in range(4)] == ["W_one", "POS", "X1", "X1_dup_2"]
    assert rows[0]["attrs"] == {"type": "map", "domain": "words"} and rows[2]["attrs"]["role"] == "y"
    assert files.by_role(s) == {"x": ["W_one", "POS", "X1_dup_2"], "y": ["X1"]}
    t = files.table_of(s).orderBy("row").collect()
    assert [r["X1"] for r in t] == ["1", "2", None, "4", "5", "6"] and [r["X1_dup_2"] for r in t] == list("654321")


def test_expansion(spark, folder):
    s = files.column_stream(spark, written(folder, "c.dat", COLUMNS))
    t = files.table_of(s).withColumn("X1", F.col("X1").cast("double"))
    filled = expand.numeric_with_missing(t, ["X1"])
    got = filled.orderBy("row").collect()
    assert [r["X1"] for r in got] == [1, 2, 3.6, 4, 5, 6] and [r["X1_missing"] for r in got] == [0, 0, 1, 0, 0, 0]
    assert expand.levels(t, "POS") == ["a", "b", "c"]
    bundle = expand.category_bundle(t, "POS", 2)
    assert "POS_c" in bundle.columns and bundle.schema["POS_a"].metadata["parent"] == "POS"
    assert "POS_OTHERS" in expand.category_bundle(t, "POS", 3).columns
    assert expand.declared_dummies(t, "POS", ["a", "b"]).columns[-1] == "POS_b"


def test_csv_and_c45(spark, folder):
    path = written(folder, "m.csv", 'sel,"A b {role=x; stream=S}",C\nIN, 1.5e1 ,red\nout,,"x, y"\nin,3,\n')
    df, attrs = files.csv_table(spark, path)
    assert df.columns == ["sel", "A_b", "C"] and attrs["A_b"] == {"role": "x", "stream": "S"}
    t = files.selector(files.typed(df))
    assert dict(t.dtypes)["A_b"] == "double" and [r["is_est"] for r in t.collect()] == [True, False, True]
    names = written(folder, "d.names", "| comment\nY.\nX: continuous.\nZ: a, b, c, d.\n")
    rows = files.c45_table(spark, names, written(folder, "d.data", "1.5,a\n?,b\n2,?\n")).collect()
    assert [tuple(r) for r in rows] == [(1.5, "a"), (None, "b"), (2.0, None)]
    sparse = files.sparse_rows(spark, written(folder, "s.txt", "1 3:2.5 7:1\n-1 1:4\n")).orderBy("line", "index").collect()
    assert [(r["line"], r["label"], r["index"], r["value"]) for r in sparse] == [(0, 1.0, 2, 2.5), (0, 1.0, 6, 1.0), (1, -1.0, 0, 4.0)]
    assert [tuple(r) for r in files.fixed_width(spark, written(folder, "f.txt", "abcdef\n"), [(1, 2), (4, 6)]).collect()] == [("ab", "def")]


def test_lines_of_several_files_keep_their_order(spark, folder):
    sizes = (3, 5000, 40, 900)
    for i, n in enumerate(sizes):
        written(folder, f"part-{i}.txt", "".join(f"{i} {j}\n" for j in range(n)))
    want = [f"{i} {j}" for i, n in enumerate(sizes) for j in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered_lines(spark, f"{folder}/*.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in sorted(rows, key=lambda r: r["number"])] == want
    assert sorted(r["number"] for r in rows) == list(range(len(want)))


def test_rows_without_values_and_binary_rows(spark, folder):
    cells = files.indicator_rows(spark, written(folder, "i.txt", "2 5\n\n1\n")).orderBy("line", "index").collect()
    assert [tuple(r) for r in cells] == [(0, 1, 1.0), (0, 4, 1.0), (2, 0, 1.0)]
    rows = files.positional_rows(spark, written(folder, "p.txt", "1 2\n3 x\n5 6\n"), 2).orderBy("line").collect()
    assert [(r["y"], r["values"]) for r in rows] == [(1, [1.0, 2.0]), (1, [3.0, None]), (0, [5.0, 6.0])]
    matrix = np.arange(3000, dtype="<f4").reshape(-1, 3) / 8
    with open(f"{folder}/m.bin", "wb") as f:
        f.write(matrix.tobytes())
    got = files.binary_matrix(spark, f"file://{folder}/m.bin", ["a", "b", "c"]).orderBy("row").collect()
    assert [tuple(r[c] for c in "abc") for r in got] == [tuple(map(float, r)) for r in matrix] and [r["row"] for r in got] == list(range(1000))


def test_writers(spark, folder):
    df = spark.createDataFrame([(0, 1.5, "a"), (1, None, "b.c")], "row long, x double, s string")
    files.write_columns(df, "row", f"{folder}/cols")
    lines = [r["value"] for r in spark.read.text(f"{folder}/cols/variable=x").collect()]
    assert lines == ["2 x", "1.5 NA"]
    files.write_rows(df, f"{folder}/rows")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/rows").count() == 2
    files.write_c45(df, f"{folder}/c45")
    assert sorted(r["value"] for r in spark.read.text(f"{folder}/c45").collect()) == ["0,1.5,a", "1,?,b_c"]


def test_samples_are_exact_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r["k"] for r in sample.exact_sample(df, "k", 77).collect()}
    assert len(a) == 77 and a == {r["k"] for r in sample.exact_sample(df.repartition(7), "k", 77).collect()}
    assert sample.block_indicator(df, "k", 10, 5).where("selected = 1").count() == 50
    f = sample.folds(df, "k", 5, 3).groupBy("fold").count().collect()
    assert len(f) == 5 and all(150 < r["count"] < 250 for r in f)
    n = ordered.row_numbers(df.repartition(5), ["k"]).collect()
    assert all(r["k"] == r["row"] for r in n)


def test_streams(spark, folder):
    rows = [(i, i % 3, float(i), f"2024-01-01 00:{i % 60:02d}:00") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, u long, v double, t string").withColumn("t", F.to_timestamp("t"))
    df.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = streaming.gram_updates(stream, {"v": F.col("v")}, f"{folder}/gram", f"{folder}/ck1")
    q.awaitTermination()
    total = {(r["i"], r["j"]): r["s"] for r in streaming.gram_total(spark.read.parquet(f"{folder}/gram")).collect()}
    g = gram(df, {"v": F.col("v")}).matrix
    assert total == {(0, 0): g[0, 0], (0, 1): g[0, 1], (1, 1): g[1, 1]}
    q = streaming.kalman(stream, "u", "id", "v").writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", f"{folder}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("levels").count() == 120
    w = streaming.windowed(stream, "t", "v", "10 minutes", "1 minute", ["u"])
    q = w.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{folder}/ck3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 120
