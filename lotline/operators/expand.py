"""Ingest-time expansion: one field into several numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import lookup


def numeric_with_missing(df: DataFrame, fields: list[str]) -> DataFrame:
    """Each field filled with its mean, and <field>_missing where any value is; one pass for all means."""
    stats = df.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(fields)), *(F.count_if(F.col(f).isNull()).alias(f"n{i}") for i, f in enumerate(fields))).first()
    out = df
    for i, f in enumerate(fields):
        if stats[f"n{i}"]:
            out = out.withColumn(f"{f}_missing", F.col(f).isNull().cast("int")).withColumn(f, F.coalesce(F.col(f).cast("double"), F.lit(stats[f"m{i}"])))
    return out


def category_counts(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(field).agg(F.count("*").alias("n"))


def rare_recoded(df: DataFrame, field: str, least: int, others: str = "OTHERS") -> DataFrame:
    """Categories of fewer rows than least become one, if there are two of them or more."""
    counts = category_counts(df, field).withColumn("__rare", F.col("n") < least)
    several = counts.agg(F.count_if("__rare") >= 2).first()[0]
    if not several:
        return df
    rare = counts.where("__rare").select(field, "__rare")
    return df.join(rare, field, "left").withColumn(field, F.when(F.col("__rare"), others).otherwise(F.col(field))).drop("__rare")


def levels(df: DataFrame, field: str, most: int = 10_000) -> list[str]:
    """Categories by n(N - n), largest first, ties by name; raises where there are more than most, as each becomes a column."""
    rows = category_counts(df.where(F.col(field).isNotNull()), field)
    total = F.sum("n").over(Window.partitionBy())
    found = [r[0] for r in rows.withColumn("__s", F.col("n") * (total - F.col("n"))).orderBy(F.desc("__s"), field).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{field} has more than {most} levels")
    return found


def dummies(field: str, values: list[str], name=lambda f, v: f"{f}_{v}") -> list[Column]:
    """A 0/1 column a level, with its lineage as metadata."""
    return [
        (F.col(field) == v).cast("int").alias(name(field, v), metadata={"parent": field, "category": v, "stream": f"{field}_category"})
        for v in values
    ]


def category_bundle(df: DataFrame, field: str, least: int = 0) -> DataFrame:
    coded = rare_recoded(df, field, least) if least else df
    return coded.select("*", *dummies(field, levels(coded, field)))


def bracket_bundle(df: DataFrame, field: str) -> DataFrame:
    """Columns named Var[label]."""
    return df.select("*", *dummies(field, levels(df, field), lambda f, v: f"{f}[{v}]"))


def declared_dummies(df: DataFrame, field: str, declared: list[str]) -> DataFrame:
    """Declared levels that are used: all if over two were declared, the second only if two."""
    used = set(levels(df, field))
    keep = declared[1:] if len(declared) == 2 else declared
    return df.select("*", *dummies(field, [v for v in keep if v in used]))


def word_bundle(df: DataFrame, field: str, dictionary: DataFrame, width: int, unknown: list[float], missing: str = "NA") -> DataFrame:
    """A column <field>_ew<i> for each coordinate of the word's vector, mean filled, and <field>_Missing."""
    found = lookup(df, dictionary.withColumnRenamed("token", field), field, "vector", unknown, missing)
    wide = found.select("*", *(F.get("vector", i).alias(f"{field}_ew{i}") for i in range(width)), F.col("vector").isNull().cast("int").alias(f"{field}_Missing")).drop("vector")
    means = wide.agg(*(F.avg(f"{field}_ew{i}").alias(str(i)) for i in range(width))).first()
    for i in range(width):
        wide = wide.withColumn(f"{field}_ew{i}", F.coalesce(f"{field}_ew{i}", F.lit(means[str(i)])))
    return wide


def word_counts(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(word, freq) of the lower-case words over a frequency."""
    words = docs.select(F.explode(F.split(F.lower(text), r"[^a-z]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") > least)


def keywords(docs: DataFrame, text: str, least: int, most: int | None = None) -> DataFrame:
    """word_counts() by falling frequency, then by word; the first most of them."""
    ordered = word_counts(docs, text, least).orderBy(F.desc("freq"), "word")
    return ordered if most is None else ordered.limit(most)


def bag_of_words(docs: DataFrame, key: str, text: str, words: list[str], *more: Column) -> DataFrame:
    """A row a document with the count of each keyword, and more columns, without a shuffle; counts carry their stream.

    Keywords are of the letters a-z. A text is split once and kept down to its
    keywords, which are then counted.
    """
    one = "|".join(sorted(words))
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"(?<![a-z])(?:{one})(?![a-z])"), F.lit(0))
    bag = docs.select(key, found.alias("__found"), *more)
    counts = [F.size(F.filter("__found", _equals(w))).alias(w, metadata={"stream": "BAG"}) for w in words]
    return bag.select(key, *counts, *(c for c in bag.columns if c not in (key, "__found")))


def _equals(word: str):
    return lambda t: t == word


def last_word_is(text: Column, word: str) -> Column:
    return (F.element_at(F.split(F.trim(text), r"\s+"), -1) == word).cast("int")
