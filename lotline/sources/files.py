"""Readers and writers of the typed text formats."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attributes, clean_name, distinct_names
from ..operators.ordered import row_numbers

MISSING = "NA"
#: Lines of a declaration, and names of variables, that the driver takes at most.
MOST_LINES = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, value): the lines of files with their numbers from 0, in the order of file names and offsets.

    Spark reads large files first, so the order comes from each line's file and split.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    return row_numbers(spark.read.text(path).select(place.alias("at"), "value"), ["at"], "number").drop("at")


def column_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file of one variable every three lines after the count, as fields: (field, name, attrs, values).

    Lines are name, attributes, values. Repeated names are numbered; values stay
    an array of text, so a variable is a row.
    """
    lines = numbered_lines(spark, path).where("number > 0")
    triple = lines.groupBy(F.floor((F.col("number") - 1) / 3).cast("long").alias("field")).agg(*(F.max(F.when((F.col("number") - 1) % 3 == i, F.col("value"))).alias(n) for i, n in enumerate(("name", "attrs", "values"))))
    rows = triple.where("name is not null").select("field", clean_name(F.col("name")).alias("name"), attributes(F.coalesce("attrs", F.lit(""))).alias("attrs"), F.split(F.trim(F.coalesce("values", F.lit(""))), r"\s+").alias("values"))
    return distinct_names(rows, "name", "field")


def long_values(stream: DataFrame) -> DataFrame:
    """(row, field, name, value) with missing values null."""
    return stream.select("field", "name", F.posexplode("values").alias("row", "value")).withColumn("value", F.when(F.col("value") != MISSING, F.col("value")))


def table_of(stream: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Variables as columns of text, rows in order of row."""
    keep = stream if names is None else stream.where(F.col("name").isin(names))
    names = names or [r["name"] for r in stream.orderBy("field").select("name").collect()]
    return long_values(keep).groupBy("row").pivot("name", names).agg(F.first("value"))


def by_role(stream: DataFrame, default: str = "x") -> dict[str, list[str]]:
    """Names of variables for each role."""
    out: dict[str, list[str]] = {}
    for r in stream.orderBy("field").select("name", F.coalesce(F.try_element_at("attrs", F.lit("role")), F.lit(default)).alias("role")).collect():
        out.setdefault(r["role"], []).append(r["name"])
    return out


def responses_first(stream: DataFrame, ny: int) -> tuple[list[str], list[str]]:
    """The first ny names and the others."""
    names = [r["name"] for r in stream.orderBy("field").select("name").collect()]
    return names[:ny], names[ny:]


def csv_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """A CSV file as text columns, empty cells null, and the attributes {a=v; ...} of its header names."""
    raw = spark.read.option("header", True).option("nullValue", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names, attrs = [], {}
    for c in raw.columns:
        name, _, rest = c.partition("{")
        name = re.sub(r"\s+", "_", name.strip().strip('"'))
        names.append(name)
        attrs[name] = dict(p.strip().split("=", 1) for p in rest.rstrip("} ").split(";") if "=" in p)
    return raw.toDF(*names), attrs


def typed(df: DataFrame) -> DataFrame:
    """Columns of which each value that isn't missing is a number become doubles; one pass for all."""
    bad = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(f"b{i}") for i, c in enumerate(df.columns))).first()
    return df.select(*(F.col(c).cast("double").alias(c) if not bad[f"b{i}"] else F.col(c) for i, c in enumerate(df.columns)))


def selector(df: DataFrame) -> DataFrame:
    """Adds is_est if the first column holds exactly in and out, in any case."""
    c = df.columns[0]
    seen = {r[0] for r in df.select(F.lower(F.trim(c))).distinct().limit(3).collect()}
    return df.withColumn("is_est", F.lower(F.trim(c)) == "in") if seen == {"in", "out"} else df


def declared(spark: SparkSession, path: str) -> list[str]:
    """The lines of a file of declarations, whole, in order; raises over MOST_LINES, as each line becomes a column."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value").limit(MOST_LINES + 1).collect()
    if len(lines) > MOST_LINES:
        raise ValueError(f"{path} has more than {MOST_LINES} lines")
    return [r["value"] for r in sorted(lines)]


def c45_names(spark: SparkSession, path: str) -> tuple[str, dict[str, list[str] | None]]:
    """(response, fields): levels of each field, None if continuous. The declaration is small and read whole."""
    text = declared(spark, path)
    lines = [s for s in (t.partition("|")[0].strip().rstrip(".") for t in text) if s]
    fields = {}
    for line in lines[1:]:
        name, _, kind = line.partition(":")
        fields[name.strip()] = None if kind.strip() == "continuous" else [v.strip() for v in kind.split(",")]
    return lines[0], fields


def c45_table(spark: SparkSession, names: str, data: str) -> DataFrame:
    """Rows of a C4.5 file; "?" and empty cells are null, continuous fields doubles."""
    _, fields = c45_names(spark, names)
    raw = spark.read.option("nullValue", "?").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(", ".join(f"`{n}` string" for n in fields)).csv(data)
    return raw.select(*(F.col(n).try_cast("double").alias(n) if v is None else F.when(F.col(n) != "", F.col(n)).alias(n) for n, v in fields.items()))


def rows_with_names(spark: SparkSession, data: str, names: str) -> DataFrame:
    """Rows of numbers whose column names are in another file."""
    columns = " ".join(declared(spark, names)).split()
    cells = F.split(F.trim("value"), r"\s+")
    return spark.read.text(data).select(*(F.get(cells, i).try_cast("double").alias(c) for i, c in enumerate(columns)))


def sparse_rows(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """(line, label, index, value) of rows "label i:v i:v ..."; without label where the first item has a colon."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = numbered_lines(spark, path).select(F.col("number").alias("line"), F.when(~F.contains(F.get(cells, 0), F.lit(":")), F.get(cells, 0)).try_cast("double").alias("label"), F.explode(F.filter(cells, lambda c: F.contains(c, F.lit(":")))).alias("c"))
    return rows.select("line", "label", (F.split_part("c", F.lit(":"), F.lit(1)).cast("int") - base).alias("index"), F.split_part("c", F.lit(":"), F.lit(2)).cast("double").alias("value"))


def indicator_rows(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """(line, index, value) of rows that list the indexes of their ones; an empty line has no cells."""
    cells = F.filter(F.split(F.trim("value"), r"\s+"), lambda c: c != "")
    return numbered_lines(spark, path).select(F.col("number").alias("line"), F.explode(F.transform(cells, lambda c: c.cast("int") - base)).alias("index"), F.lit(1.0).alias("value"))


def positional_rows(spark: SparkSession, path: str, ones: int) -> DataFrame:
    """(line, y, values) of rows of numbers whose label is their place: 1 for the first ones lines, then 0."""
    values = F.transform(F.split(F.trim("value"), r"\s+"), lambda c: c.try_cast("double"))
    return numbered_lines(spark, path).select(F.col("number").alias("line"), (F.col("number") < ones).cast("int").alias("y"), values.alias("values"))


def binary_matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A file of rows of little-endian 4-byte floats as (row, names...); splits are read side by side.

    A last row that is cut short raises.
    """
    size = 4 * len(names)
    records = spark.createDataFrame(spark.sparkContext.binaryRecords(path, size).map(lambda r: (bytearray(r),)), "cells binary")

    def floats(batches):
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(float)) for c in cells.T)], names=["id", *names])

    rows = records.select(F.monotonically_increasing_id().alias("id"), "cells").mapInArrow(floats, ", ".join(["id long", *(f"`{n}` double" for n in names)]))
    return row_numbers(rows, ["id"]).drop("id")


def binary_label(y: Column) -> Column:
    """Labels of -1 and 1 (or any sign) as 0 and 1."""
    return F.when(y > 0, 1).otherwise(0)


def fixed_width(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Substrings from..to, counted from 1, of each line."""
    return spark.read.text(path).select(*(F.substring("value", a, b - a + 1).alias(f"f{i}") for i, (a, b) in enumerate(ranges)))


def reviews(ids: DataFrame, ratings: DataFrame, texts: DataFrame, row: str = "row") -> DataFrame:
    """Reviews put together by row: lower-case text, without those rated 0."""
    return ids.join(ratings, row).join(texts, row).where("rating <> 0").withColumn("text", F.lower("text"))


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, fields): lines of each file and fields of its widest."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.size(F.split(F.trim("value"), r"\s+")).alias("f"))
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.max("f").alias("fields"))


def write_columns(df: DataFrame, row: str, path: str) -> None:
    """A directory a variable: its values in row order as one line, after a line with its name and the count.

    Values are gathered a variable at a time, so this is for tables whose columns
    fit a task.
    """
    names = [c for c in df.columns if c != row]
    long = df.select(row, *(F.col(c).cast("string").alias(c) for c in names)).unpivot([row], names, "variable", "value")
    lines = long.groupBy("variable").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(row, F.coalesce("value", F.lit(MISSING)).alias("v")))), lambda s: s["v"]).alias("v"))
    lines.select(F.concat_ws("\n", F.concat_ws(" ", "n", "variable"), F.concat_ws(" ", "v")).alias("value"), "variable").write.partitionBy("variable").mode("overwrite").text(path)


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_c45(df: DataFrame, path: str) -> None:
    """Cells without commas and periods, missing ones as "?"."""
    clean = df.select(*(F.translate(F.col(c).cast("string"), ",.", "__").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    clean.write.mode("overwrite").option("nullValue", "?").csv(path)
