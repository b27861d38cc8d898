"""Delimited text kept as one row per physical line: delimiters, headers and strict field splitting.

Everything here is a column expression, so files are split inside the JVM. A line is cut with one
anchored pattern per delimiter: each match consumes a delimiter and one whole field, and matching
stops at the first place that breaks the quoting rules. A line is well formed exactly if the matches
consume all of it. The pattern has no nested repetition over alternatives, so long lines are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
NUMBER_LETTERS = "0123456789+-.eE"
BLANKS = " \t\r\n\f\v"
MISSING_WORDS = ("", "NULL", "null", "NaN")


def clean_line(line: Column) -> Column:
    """The line without the carriage return and line feed at its end and without a byte-order mark."""
    return F.regexp_replace(line, "^﻿|[\r\n]+$", "")


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def is_missing(value: Column) -> Column:
    return value.isNull() | trimmed(value).isin(*MISSING_WORDS)


def number_of(value: Column) -> Column:
    """The value of a plainly written number, else null. Only ASCII digits count.

    A text of these letters alone that casts to double is a sign, digits with at most one point and
    an exponent; names of special values and type suffixes contain other letters.
    """
    v = trimmed(value)
    return F.when(F.translate(v, NUMBER_LETTERS, "") == "", v.try_cast("double"))


def detect_delimiter(header: Column) -> Column:
    """The candidate that occurs most often outside double quotes; the earlier one of DELIMITERS on ties."""
    bare = F.regexp_replace(header, '"[^"]*"', "")
    counted = [F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    return F.greatest(*counted)["d"]


def raw_fields(line: Column, delimiter: Column) -> Column:
    """The leading well-formed fields of a line, still in their quotes."""

    def cut(d: str) -> Column:
        e = "\\" + d if d == "|" else d
        pattern = f'\\G{e}("[^"]*+(?:""[^"]*+)*+"|[^"{e}]*+)(?={e}|\\z)'
        return F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(pattern), F.lit(1))

    out = cut(DELIMITERS[0])
    for d in DELIMITERS[1:]:
        out = F.when(delimiter == d, cut(d)).otherwise(out)
    return out


def materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with computed columns that later filters and projections reuse instead of computing them again.

    The generator keeps the optimizer from copying the expressions into every place that mentions them.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made)


def is_well_formed(fields: Column, line: Column) -> Column:
    return F.length(F.array_join(fields, "")) + F.size(fields) == F.length(line) + 1


def unquote(field: Column) -> Column:
    return F.when(field.startswith('"'), F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def normal_name(name: Column) -> Column:
    """Column names trimmed, lower-cased, blanks as underscores, without quotes or byte-order mark."""
    return F.regexp_replace(trimmed(F.lower(F.regexp_replace(name, '["﻿]', ""))), r"\s", "_")


def file_headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file that has a line 1: file_id, dataset, prev_file_id, delimiter, names (array).

    A header that breaks the quoting rules is cut at every delimiter. If line 1 occurs twice with
    different text, the smaller text is the header.
    """
    first = lines.where("line_no = 1").groupBy("file_id").agg(F.min(clean_line(F.col("line"))).alias("header"))
    cut = first.withColumn("delimiter", detect_delimiter(F.col("header"))).withColumn("_f", raw_fields(F.col("header"), F.col("delimiter")))
    plain = F.split(F.col("header"), F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))
    cut = cut.withColumn("names", F.transform(F.when(is_well_formed(F.col("_f"), F.col("header")), F.transform("_f", unquote)).otherwise(plain), normal_name))
    known = files.select("file_id", "dataset", "prev_file_id").dropDuplicates(["file_id"])
    return cut.join(known, "file_id", "left").select("file_id", "dataset", "prev_file_id", "delimiter", "names")
