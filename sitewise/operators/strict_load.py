"""Rows that fail to parse: strict load, anti-join against the raw offsets, diagnosis of the remainder.

``strict_load`` lets only conforming rows through and keeps their offset (file_id, line_no).
``rejected`` subtracts those offsets from all offsets and explains what is left. The two together are
the whole input: a data line is either loaded or rejected, never both.

Whether a line conforms is first asked of one pattern per file, made from the domains of its columns: a
line that matches it as a whole is right in shape and values, and most lines do. Only lines in unusual
spelling (signs, exponents, quotes within quotes) or out of order are split and checked field by field;
the pattern never accepts what the check would refuse.

Defined results: null and blank lines are no rows and are skipped; lines of a file without a header
fail with ``columns``; a file of an unknown dataset is checked for shape only; a line repeated under
the same offset is judged by its own text; files of any size and skew: the header side of the joins is
one row per file, the line side is split by adaptive execution if one file holds most lines.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.operators.schema_drift import domain_rules
from sitewise.sources import raw_csv as rc

ANY_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'


def whole_numbers(low: int, high: int) -> str:
    """A pattern for the whole numbers from ``low`` to ``high`` (0 or more) without leading zeros."""
    parts = []
    while len(str(low)) < len(str(high)):
        edge = 10 ** len(str(low))
        parts.append(_digits(str(low), str(edge - 1)))
        low = edge
    return "|".join([*parts, _digits(str(low), str(high))])


def _digits(a: str, b: str) -> str:
    """A pattern for the digits from ``a`` to ``b``, both of one width, leading zeros included."""
    if len(a) == 1:
        return f"[{a}-{b}]"
    if a[0] == b[0]:
        return f"{a[0]}(?:{_digits(a[1:], b[1:])})"
    parts, first, last = [], int(a[0]), int(b[0])
    if set(a[1:]) != {"0"}:
        parts.append(f"{first}(?:{_digits(a[1:], '9' * (len(a) - 1))})")
        first += 1
    tail = [] if set(b[1:]) == {"9"} else [f"{last}(?:{_digits('0' * (len(b) - 1), b[1:])})"]
    last -= len(tail)
    if first <= last:
        parts.append(f"[{first}-{last}]" + "[0-9]" * (len(a) - 1))
    return "|".join([*parts, *tail])


def _range_pattern(low: float | None, high: float | None) -> str:
    """Plainly written numbers of a range: some of them, and nothing else."""
    if low is None and high is None:
        return r"[0-9]{1,15}(?:\.[0-9]*+)?"
    low, high = (-1e9 if low is None else max(low, -1e9)), (1e9 if high is None else min(high, 1e9))
    parts = []
    for sign, a, b in (("", max(low, 0.0), high), ("-", max(-high, 0.0), -low)):
        if b < 0 or b < a:
            continue
        if math.ceil(a) <= math.floor(b) - 1:
            parts.append(f"{sign}(?:{whole_numbers(math.ceil(a), math.floor(b) - 1)})" + r"(?:\.[0-9]*+)?")
        if b == math.floor(b):
            parts.append(f"{sign}{int(b)}" + r"(?:\.0*+)?")
    return "|".join(parts) or "(?!)"


def field_patterns(domains: DataFrame) -> list[tuple[str, str, str]]:
    """(dataset, key, pattern of values that are missing or in the domain) from the fixed table of domains."""
    missing = "|".join(re.escape(w) for w in rc.MISSING_WORDS if w)
    out = []
    for r in domain_rules(domains).where("kind in ('number', 'category')").collect():
        if r.kind == "number":
            inner = _range_pattern(r.lo, r.hi)
        else:
            words = [re.escape(w) for w in r.words or [] if w.strip(rc.BLANKS) == w and not set(w) & {'"', *rc.DELIMITERS}]
            inner = "|".join([rf"{int(x)}(?:\.0*+)?" for x in r.numbers or [] if x == int(x) and 0 <= x < 1e15] + words) or "(?!)"
        out.append((r.dataset, r.key, rf" *+(?:(?:{missing}|{inner}) *+)?"))
    return out


def parse_specs(headers: DataFrame, cols: DataFrame, domains: DataFrame) -> DataFrame:
    """What a line of each file must look like: file_id, delimiter, width, specs (one struct per place), pattern."""
    made = F.broadcast(domains.sparkSession.createDataFrame(field_patterns(domains), "dataset string, key string, inner string"))  # one row per column of the fixed table
    checked = cols.where("is_domain").join(F.broadcast(domain_rules(domains)), ["dataset", "key"]).where("kind in ('number', 'category')").join(made, ["dataset", "key"])
    specs = checked.groupBy("file_id").agg(F.collect_list(F.struct("pos", "kind", "lo", "hi", "numbers", "words")).alias("specs"), F.map_from_entries(F.collect_list(F.struct("pos", "inner"))).alias("inner"))
    x = headers.select("file_id", "delimiter", F.size("names").alias("width")).join(specs, "file_id", "left")
    mark = F.when(F.col("delimiter") == "|", F.lit("\\|")).otherwise(F.col("delimiter"))
    plain = F.concat(F.lit("(?:" + ANY_QUOTED + '|[^"'), mark, F.lit("]*+)"))
    tight = lambda p: F.concat(F.lit('(?:"'), p, F.lit('"|'), p, F.lit(")"))
    each = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(tight(F.try_element_at("inner", i.cast("int"))), plain))
    return x.withColumn("pattern", F.when(F.col("width") > 0, F.concat(F.lit("\\A"), F.call_function("array_join", each, mark), F.lit("\\z")))).drop("inner")


def breaks_domain(value: Column, number: Column, spec: Column) -> Column:
    """A trimmed value, with its number if it is one, that is not missing and not in its domain."""
    number_ok = number.isNotNull() & F.coalesce(number >= spec["lo"], F.lit(True)) & F.coalesce(number <= spec["hi"], F.lit(True))
    category_ok = F.coalesce(F.array_contains(spec["numbers"], number), F.lit(False)) | F.coalesce(F.array_contains(spec["words"], value), F.lit(False))
    return ~value.isin(*rc.MISSING_WORDS) & ~F.when(spec["kind"] == "number", number_ok).otherwise(category_ok)


def _data_lines(lines: DataFrame) -> DataFrame:
    body = lines.where((F.col("line_no") > 1) & (rc.trimmed(F.col("line")) != ""))
    return body.select("file_id", "line_no", F.xxhash64("line").alias("text_key"), rc.clean_line(F.col("line")).alias("line"))


def strict_load(lines: DataFrame, specs: DataFrame) -> DataFrame:
    """The rows that conform: file_id, line_no, text_key, raw (the fields as they are written)."""
    cut = _data_lines(lines).join(specs, "file_id")
    raw = rc.raw_fields(F.col("line"), F.col("delimiter"))

    def checked(raw: Column) -> Column:
        value = lambda s: rc.trimmed(rc.unquote(F.get(raw, s["pos"])))
        bad = F.exists("specs", lambda s: breaks_domain(value(s), rc.number_of(value(s)), s))
        return rc.is_well_formed(raw, F.col("line")) & (F.size(raw) == F.col("width")) & ~F.coalesce(bad, F.lit(False))

    # the second branch is evaluated for lines that the pattern does not settle, and only for them
    slow = F.exists(F.array(raw), checked)
    return cut.where(F.when(F.expr("regexp_extract(line, pattern, 0) <> ''"), True).otherwise(slow)).select("file_id", "line_no", "text_key", raw.alias("raw"))


def rejected(lines: DataFrame, specs: DataFrame, loaded: DataFrame) -> DataFrame:
    """The raw offsets that did not load, with the reason and the text: file_id, line_no, reason, line."""
    left = _data_lines(lines).join(loaded.select("file_id", "line_no", "text_key"), ["file_id", "line_no", "text_key"], "left_anti")
    known = rc.materialised(left.join(specs.select("file_id", "delimiter", "width"), "file_id", "left"), raw=rc.raw_fields(F.col("line"), F.coalesce("delimiter", F.lit(","))))
    shaped = F.coalesce(rc.is_well_formed(F.col("raw"), F.col("line")), F.lit(False))
    reason = F.when(F.col("width").isNull(), "columns").when(~shaped, "quoting").when(F.size("raw") != F.col("width"), "columns").otherwise("value")
    return known.select("file_id", "line_no", reason.alias("reason"), "line")
