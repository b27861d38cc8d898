"""Kinds of columns: numeric, categorical, binary, temporal, identifier, by one aggregation per table.

Rules look at all values, not at the first ones, so the answer does not depend on row order. Constant
columns of 0 or of 1 count as binary. Text that looks like numbers stays categorical and is reported
as quasi-numeric if not all of it does. Columns without any value have no kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc

# Words in a column's name that mark a sparse 0/1 column as an indicator.
INDICATOR_WORDS = {
    "hypertension", "diabetes", "cardiovasc", "cardiac", "cardio", "coronary", "chd",
    "asthma", "copd", "crd", "ckd", "cld", "renal", "hepatic", "pulmonary",
    "neuro", "psych", "psychiatric", "neurological",
    "tumor", "cancer", "oncol", "malignant", "lesion",
    "immuno", "transplant", "comorb",
    "metabol", "obesity", "obese",
    "hiv", "tb", "tuberculosis", "infectious",
    "fever", "cough", "dyspnea", "fatigue", "malaise", "anosmia",
    "pain", "confusion", "diarrhea", "nausea", "rash", "fainting",
    "headache", "myalgia", "arthralgia", "ageusia", "anorexia",
    "tinnitus", "dizziness", "seizures", "tremors", "constipation",
    "dismobility", "depressive", "parasthesia",
    "memory", "acute",
    "hospitalization", "icu", "admission", "discharge",
    "mortality", "death",
    "treated", "treatment", "therapy", "procedure", "surgery",
    "oxygen", "ventil",
    "viral", "antiviral", "anti", "antibiotic",
    "glucocorticoid", "steroid", "corticoid",
    "monoclonal", "antibody", "antagonist", "inhibitor",
    "lopinavir", "remdesivir", "molnupiravir", "paxlovid", "ribavirin",
    "il1", "il6",
    "vaccination", "vaccin", "vac",
    "flag", "indicator",
}
# Words in a column's name that mark identifiers, always and if nearly all values differ.
STRONG_ID_WORDS = {
    "id", "identifier", "identifikator", "pid", "name", "surname", "firstname", "lastname", "rownames",
    "vorname", "nachname", "familienname", "telefon", "phone", "email", "adresse", "address",
    "postcode", "zip", "ssn", "dob", "birthdate", "geburtsdatum",
}
WEAK_ID_WORDS = {"patient", "person", "subject", "record", "case"}
ID_PATTERN = r"(?i)^(patient|pat|subject|sub|person|record|case|participant)[_-]?\d+$"
WORD_PAIRS = [("yes", "no"), ("y", "n"), ("true", "false"), ("t", "f"), ("ja", "nein")]
LEAST_BINARY = 3
# formats with the shape of the texts they fit; a text is only parsed by the format whose shape it has
DATE_FORMATS = {
    "yyyy-MM-dd HH:mm:ss.SSSSSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$", "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$",
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$", "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}$", "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$", "dd MMM yyyy": r"^\d{2} [A-Za-z]{3} \d{4}$", "yyyy-MM": r"^\d{4}-\d{2}$",
}


def parsed_date(c: Column) -> Column:
    """A timestamp by the one of DATE_FORMATS that fits the whole text, else null."""
    t = F.trim(c.cast("string"))
    out = F.lit(None).cast("timestamp")
    for f, shape in DATE_FORMATS.items():
        out = F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f))).otherwise(out)
    return F.when(t.rlike("^[0-9]"), out)


@dataclass
class ColumnKind:
    column: str
    data_type: str
    n_rows: int
    n_values: int
    n_distinct: int
    numeric_share: float
    date_share: float
    kind: str
    is_binary: bool
    is_identifier: bool


def _group(kind: str) -> str:
    if kind == "boolean":
        return "boolean"
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return "temporal"
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return "number"
    return "text" if kind == "string" or kind.startswith(("varchar", "char")) else "other"


def column_kinds(df: DataFrame) -> list[ColumnKind]:
    """The kind of every column of a table; array, map and struct columns are 'unsupported'."""
    groups = {c: _group(t) for c, t in df.dtypes}
    aggs = [F.count("*").alias("n")]
    for i, (c, g) in enumerate(groups.items()):  # only what the column's type leaves open
        q = F.col(f"`{c}`")
        v = F.when(~F.isnan(q), q) if dict(df.dtypes)[c] in ("double", "float") else q
        aggs.append(F.count(v).alias(f"v{i}"))
        if g == "text" or (g == "number" and sc.name_tokens(c) & WEAK_ID_WORDS):
            aggs.append(F.approx_count_distinct(v).alias(f"d{i}"))
        if g == "number":
            aggs.append(F.count_if(v.isin(0, 1)).alias(f"b{i}"))
        if g == "text":
            num, word = sc.as_number(q), F.lower(F.trim(q))
            aggs += [F.count(num).alias(f"u{i}"), F.count_if(num.isin(0.0, 1.0)).alias(f"b{i}"), F.count_if(q.rlike(ID_PATTERN)).alias(f"i{i}"), F.count(parsed_date(q)).alias(f"t{i}"), *[F.count_if(word.isin(*p)).alias(f"p{i}_{k}") for k, p in enumerate(WORD_PAIRS)]]
    r = df.agg(*aggs).first().asDict()
    # the share of distinct values decides about weakly named identifiers, so near the limit it is counted exactly
    close = [(i, c) for i, c in enumerate(groups) if sc.name_tokens(c) & WEAK_ID_WORDS and f"d{i}" in r and r[f"v{i}"] and r[f"d{i}"] / r[f"v{i}"] > 0.7]
    if close:
        exact = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in close]).first().asDict()
        r |= exact
    out = []
    for i, (c, g) in enumerate(groups.items()):
        n, nv, nd, nb = r["n"], r[f"v{i}"], r.get(f"d{i}", 0), r.get(f"b{i}", 0)
        words = sc.name_tokens(c)
        is_id = g != "temporal" and (bool(words & STRONG_ID_WORDS) or (g == "text" and nv > 0 and r[f"i{i}"] == nv) or bool(words & WEAK_ID_WORDS and nv and nd / nv > 0.9))
        zero_one = nv > 0 and nb == nv and (nv >= LEAST_BINARY or bool(words & INDICATOR_WORDS))
        binary = g in ("number", "text", "boolean") and nv > 0 and (g == "boolean" or zero_one or (g == "text" and any(r[f"p{i}_{k}"] == nv for k in range(len(WORD_PAIRS)))))
        kind = "empty" if not nv else "unsupported" if g == "other" else "temporal" if g == "temporal" else "categorical" if binary or g in ("text", "boolean") else "numeric"
        out.append(ColumnKind(c, dict(df.dtypes)[c], n, nv, nd, (r.get(f"u{i}", nv if g == "number" else 0)) / n if n else 0.0, r.get(f"t{i}", 0) / nv if nv else 0.0, kind, bool(binary), is_id))
    return out


def kinds_table(spark, kinds: list[ColumnKind]) -> DataFrame:
    return spark.createDataFrame([(k.column, k.kind, k.is_binary, k.is_identifier) for k in kinds], "column_name string, kind string, is_binary boolean, is_identifier boolean")


def quasi_numeric(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Text columns of which at least ``threshold`` but not all values are numbers."""
    v = {c: F.col(f"`{c}`") for c in columns}
    one = df.agg(*[x for i, c in enumerate(columns) for x in (F.count(v[c]).alias(f"v{i}"), F.count(sc.as_number(v[c])).alias(f"u{i}"))])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("n_values"), F.col(f"u{i}").alias("n_numbers")) for i, c in enumerate(columns)])))
    share = sc.safe_ratio(F.col("n_numbers"), F.col("n_values"))
    return rows.withColumn("numeric_share", share).where((share >= threshold) & (share < 1))


def date_columns(df: DataFrame, columns: list[str], numeric_limit: float = 0.9, date_limit: float = 0.6) -> DataFrame:
    """Which text columns become dates: not mostly numbers of all rows, and mostly dates of the values."""
    v = {c: F.col(f"`{c}`") for c in columns}
    one = df.agg(F.count("*").alias("n"), *[x for i, c in enumerate(columns) for x in (F.count(v[c]).alias(f"v{i}"), F.count(sc.as_number(v[c])).alias(f"u{i}"), F.count(parsed_date(v[c])).alias(f"t{i}"))])
    rows = one.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("v"), F.col(f"u{i}").alias("u"), F.col(f"t{i}").alias("t")) for i, c in enumerate(columns)])))
    numbers, dates = sc.safe_ratio(F.col("u"), F.col("n")), sc.safe_ratio(F.col("t"), F.col("v"))
    return rows.select("column_name", numbers.alias("numeric_share"), dates.alias("date_share"), F.coalesce((numbers <= numeric_limit) & (dates > date_limit), F.lit(False)).alias("promoted"))


def promote_dates(df: DataFrame) -> DataFrame:
    """Text columns that are mostly dates become timestamps; what does not parse becomes null."""
    text = [c for c, t in df.dtypes if _group(t) == "text"]
    if not text:
        return df
    up = [r.column_name for r in date_columns(df, text).where("promoted").collect()]
    return df.withColumns({c: parsed_date(F.col(f"`{c}`")) for c in up}) if up else df


def identifiers(kinds: list[ColumnKind]) -> list[str]:
    return [k.column for k in kinds if k.is_identifier]


def of_kind(kinds: list[ColumnKind], kind: str) -> list[str]:
    """Analytical columns of a kind, identifiers left out."""
    return [k.column for k in kinds if k.kind == kind and not k.is_identifier]


def reduction_gate(kinds: list[ColumnKind], least_numeric: int = 10, least_categorical: int = 8, max_levels: int = 30) -> dict[str, bool]:
    """Whether there are enough columns for principal components and correspondence analysis."""
    return {"pca": len(of_kind(kinds, "numeric")) >= least_numeric, "mca": sum(k.kind == "categorical" and not k.is_identifier and k.n_distinct <= max_levels for k in kinds) >= least_categorical}


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact number of levels of each column, NaN left out; the basis of the cardinality shortlists."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    x = df.select(F.inline(cells)).where("v is not null and v <> 'NaN'").groupBy("column_name", "v").agg(F.lit(1).alias("one"))
    return x.groupBy("column_name").agg(F.count("*").alias("n_levels"))
