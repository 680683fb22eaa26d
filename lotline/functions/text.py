"""String, date and map functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def left_trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+", "")


def right_trim(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+$", "")


def clean_name(s: Column) -> Column:
    """A field name: trimmed, blanks as "_", without "*" and "^"."""
    return F.translate(F.trim(s), " *^", "_")


def without_commas(s: Column) -> Column:
    return F.translate(s, ",", "_")


def first_word(s: Column) -> Column:
    return F.split_part(F.ltrim(s), F.lit(" "), F.lit(1))


def hex_value(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("int")


def number(s: Column) -> Column:
    """The number that a text is; null where it is none."""
    return s.try_cast("double")


def unquoted(s: Column) -> Column:
    return F.regexp_replace(s, r'^\s*"|"\s*$', "")


def csv_fields(line: Column) -> Column:
    """The fields of a line, commas inside quotes kept."""
    return F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), unquoted)


def attributes(s: Column) -> Column:
    """Text such as "role=x, parent=POS" as a map."""
    return F.str_to_map(F.regexp_replace(s, r"\s*([,=])\s*", "$1"), F.lit(","), F.lit("="))


def attribute_text(m: Column) -> Column:
    """A map as text, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def stream_of(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def quarter_number(d: Column, first_year: int = 1992) -> Column:
    return (F.year(d) - first_year) * 4 + F.quarter(d) - 1


def quarter_of_text(s: Column, first_year: int = 1992) -> Column:
    """Quarters written as 1992.1."""
    return (F.split_part(s, F.lit("."), F.lit(1)).cast("int") - first_year) * 4 + F.split_part(s, F.lit("."), F.lit(2)).cast("int") - 1


def day_of_number(n: Column) -> Column:
    """Dates written as YYYYMMDD numbers."""
    return F.to_date(n.cast("string"), "yyyyMMdd")


def distinct_names(fields: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get _dup_2, _dup_3, ... in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return fields.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("_dup_"), n)).otherwise(F.col(name)))


def round_to_scale(x: Column, scale: float, parts: int = 1000) -> Column:
    """x to a tolerance of a part of a typical magnitude."""
    step = abs(scale) / parts
    return F.round(x / step) * step if step else x
