"""Schemas that drift between files: a registry of versions, migration steps between them, and routing.

Every schema that occurs is a *version*: a fingerprint of its columns (name, measurement, type; their
order does not matter), numbered within its dataset. Between two versions that follow each other in a
series there is one *migration*: the list of steps (added, removed, renamed, type) that leads from one
to the other, made once however many files take it. ``route`` sends every file along the migration from
its previous file's version to its own and records each step applied; that log is the report of changes.
``rules_of`` chains for each version what brings its rows into the consistent table: rename each column
to its measurement, default what the version lacks, cast what is left; ``consistent_table`` applies them.

Which names are one measurement is not listed anywhere; ``learn_names`` finds it. A new column that
appears in the same file in which a known measurement disappears is taken for its new name if the two
never meet in a header although by their numbers they would have to (then no values are read), or if its values
agree with the values before (or fit the measurement's domain) and the name, the place or the lack of
any other column that agrees supports it. A name that stands beside a measurement in any file of the dataset is never its
new name. What is learned for a name holds for the whole dataset; passes go on until nothing is new, so
that a name that followed a learned name is learned too.

Defined results for odd input: no tables rows -> no rows out; files without a line 1 have no columns
and no steps; a prev_file_id that is unknown gives no steps; a name occurring twice in a header keeps
its first place and later ones are ignored; two columns of one measurement in one file: the one
named like the domain (else the first) is the measurement, the other stands for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import cut_lineage
from sitewise.sources import raw_csv as rc

# Codes of words in typed columns.
WORD_CODES = {"thal": {"normal": 3.0, "fixed": 6.0, "reversible": 7.0}}
TYPE_NAMES = {1: "whole", 2: "decimal", 3: "text"}
FIT = 0.8
CHANCE = 1e-6


def file_columns(headers: DataFrame, domains: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """One row per file and column: file_id, dataset, prev_file_id, pos (from 0), name, key, is_domain.

    ``key`` identifies a measurement across files; ``is_domain`` says that field_domains has it.
    ``learned`` (dataset, name, canonical) holds other names of measurements.
    """
    cols = headers.select("file_id", "dataset", "prev_file_id", F.posexplode("names").alias("pos", "name"))
    cols = cols.groupBy("file_id", "dataset", "prev_file_id", "name").agg(F.min("pos").alias("pos"))
    known = domains.selectExpr("dataset", "column_name as name", "column_name as _own").distinct()
    cols = cols.join(F.broadcast(known), ["dataset", "name"], "left")  # field_domains is a fixed, narrow table
    guess = "_own"
    if learned is not None:
        cols = cols.join(learned, ["dataset", "name"], "left")
        guess = "coalesce(_own, canonical)"
    cols = cols.selectExpr("file_id", "dataset", "prev_file_id", "pos", "name", f"{guess} is not null as _known", f"coalesce({guess}, name) as _c")
    # one column per measurement and file; headers are narrow, so these windows are small
    w = Window.partitionBy("file_id", "_c").orderBy(F.expr("case when name = _c then 0 else 1 end"), "pos")
    return cols.withColumn("_first", F.row_number().over(w) == 1).selectExpr("file_id", "dataset", "prev_file_id", "pos", "name", "case when _first then _c else concat(_c, '#', name) end as key", "_first and _known as is_domain")


def _value_profile(lines: DataFrame, headers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Deciles and kinds of the values at the wanted (file_id, pos, key), and how many fit the domain of key."""
    spots = wanted.groupBy("file_id").agg(F.collect_set(F.struct("pos", "key", "category", "lo", "hi", "numbers", "words")).alias("spots"))
    body = lines.where("line_no > 1").join(headers.join(spots, "file_id").select("file_id", "delimiter", "spots", F.size("names").alias("width")), "file_id")
    body = rc.materialised(body.withColumn("line", rc.clean_line(F.col("line"))), f=rc.raw_fields(F.col("line"), F.col("delimiter")))
    body = body.where(rc.is_well_formed(F.col("f"), F.col("line")) & (F.size("f") == F.col("width")))
    values = body.select("file_id", F.explode("spots").alias("s"), "f").select("file_id", "s.*", rc.trimmed(rc.unquote(F.get("f", F.col("s.pos")))).alias("v")).where(~F.col("v").isin(*rc.MISSING_WORDS))
    values = rc.materialised(values, num=rc.number_of(F.col("v")))
    fits = "case when category then array_contains(numbers, num) or array_contains(words, v) else num >= coalesce(lo, num) and num <= coalesce(hi, num) end"
    return values.groupBy("file_id", "pos", "key").agg(F.expr("avg(case when num is not null then 1d else 0d end)").alias("numeric_share"), F.expr("percentile_approx(num, array(0.1, 0.5, 0.9), 200)").alias("deciles"), F.expr("approx_count_distinct(v) / count(*)").alias("distinct_share"), F.expr(f"avg(case when coalesce({fits}, false) then 1d else 0d end)").alias("fit"))


def _candidates(cols: DataFrame) -> DataFrame:
    """Every measurement that disappears from a file with every name that is new in it: dataset, file_id, prev_file_id, key, name, pos, prev_pos."""
    prev = cols.where("is_domain").selectExpr("file_id as prev_file_id", "key", "pos as prev_pos")
    here = cols.where("prev_file_id is not null").select("file_id", "dataset", "prev_file_id").distinct()
    gone = here.join(prev, "prev_file_id").join(cols.select("file_id", "key"), ["file_id", "key"], "left_anti")
    fresh = cols.where("not is_domain and name <> ''").select("file_id", "prev_file_id", "name", "pos")
    fresh = fresh.join(cols.selectExpr("file_id as prev_file_id", "name"), ["prev_file_id", "name"], "left_anti").drop("prev_file_id")
    pairs = gone.join(fresh, "file_id")
    beside = pairs.select("dataset", "name", "key").distinct().join(cols.select("dataset", "file_id", "name"), ["dataset", "name"]).join(cols.where("is_domain").select("file_id", "key"), ["file_id", "key"]).select("dataset", "name", "key").distinct()
    return pairs.join(beside, ["dataset", "name", "key"], "left_anti")


def _by_absence(cols: DataFrame, pairs: DataFrame) -> DataFrame:
    """Names with one candidate left that stand in so many headers that, were they columns of their own, they would have met it.

    A name in n headers misses a measurement that stands in a share p of all headers by chance with
    probability (1 - p)^n, which must be below CHANCE. dataset, name, canonical.
    """
    single = pairs.select("dataset", "name", "key").distinct().groupBy("dataset", "name").agg(F.min("key").alias("key"), F.count("*").alias("k")).where("k = 1").drop("k")
    files = cols.groupBy("dataset").agg(F.count_distinct("file_id").alias("n_files"))
    named = cols.groupBy("dataset", "name").agg(F.count("*").alias("n_name"))
    keyed = cols.where("is_domain").groupBy("dataset", "key").agg(F.count("*").alias("n_key"))
    x = single.join(named, ["dataset", "name"]).join(keyed, ["dataset", "key"]).join(files, "dataset")
    return cut_lineage(x.where(f"n_name * ln(greatest(1 - n_key / n_files, 1e-9)) < {math.log(CHANCE)!r}").selectExpr("dataset", "name", "key as canonical"))


def learn_names(lines: DataFrame, headers: DataFrame, domains: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Other names of known measurements (dataset, name, canonical; None if there are none), and ``file_columns`` by them."""
    learned, judged = None, None
    rules = domain_rules(domains).selectExpr("dataset", "key", "kind = 'category' as category", "lo", "hi", "numbers", "words")
    while True:
        cols = cut_lineage(file_columns(headers, domains, learned))  # one row per file and column
        pairs = _candidates(cols)
        if judged is not None:
            pairs = pairs.join(judged, ["dataset", "name", "key"], "left_anti")
        pairs = cut_lineage(pairs)  # changes of headers, not lines
        if pairs.isEmpty():
            return learned, cols
        absent = _by_absence(cols, pairs)
        if not absent.isEmpty():
            learned = absent if learned is None else learned.unionByName(absent)
            continue
        ruled = pairs.join(F.broadcast(rules), ["dataset", "key"], "left")
        rule = ["category", "lo", "hi", "numbers", "words"]
        wanted = ruled.select("file_id", "pos", "key", *rule).union(ruled.select("prev_file_id", "prev_pos", "key", *rule)).distinct()
        profile = cut_lineage(_value_profile(lines, headers, wanted))
        measures = "struct(numeric_share, deciles, distinct_share, fit)"
        fit = ruled.join(profile.selectExpr("file_id as prev_file_id", "pos as prev_pos", "key", f"{measures} as a"), ["prev_file_id", "prev_pos", "key"], "left").join(profile.selectExpr("file_id", "pos", "key", f"{measures} as b"), ["file_id", "pos", "key"], "left")
        spread = "greatest(a.deciles[2] - a.deciles[0], b.deciles[2] - b.deciles[0], 1d)"
        near = f"(a.numeric_share > {FIT} and b.numeric_share > {FIT} and abs(a.distinct_share - b.distinct_share) < 0.5 and abs(a.deciles[1] - b.deciles[1]) <= 0.35 * {spread} and abs(a.deciles[2] - b.deciles[2]) <= 0.6 * {spread})"
        fits = f"(kind_known and a.fit >= {FIT} and b.fit >= {FIT})"
        worded = f"({fits} and category and size(words) > 0 and least(a.numeric_share, b.numeric_share) < 0.5)"
        tokens = r"split(name, '[^\\p{L}\\p{N}]+')"
        similar = f"(array_contains({tokens}, key) or name rlike concat('^', array_join(split(key, ''), '.*')) and length(key) > 2 or startswith(name, key) or startswith(name, substring(key, 1, 2)) or levenshtein(name, key) <= greatest(length(key) div 3, 1))"
        fit = fit.withColumn("kind_known", F.expr("category is not null"))
        fit = fit.withColumn("agrees", F.expr(f"coalesce({near} or {worded}, false)"))
        fit = fit.selectExpr("*", *[f"count_if(agrees) over (partition by file_id, {c}) = 1 as only_{c}" for c in ("name", "key")])  # changes of one header
        score = f"case when {similar} and ({near} or {fits}) then 3 when {worded} then 3 when agrees and (pos = prev_pos or only_name and only_key) then 2 when {similar} and (a is null or b is null) then 1 else 0 end"
        votes = fit.withColumn("score", F.expr(f"coalesce({score}, 0)")).groupBy("dataset", "name", "key").agg(F.sum("score").alias("votes"))
        best = Window.partitionBy("dataset", "name").orderBy(F.desc("votes"), "key")
        votes = cut_lineage(votes.withColumn("r", F.row_number().over(best)))  # one row per pair of names
        found = votes.where("r = 1 and votes > 0").selectExpr("dataset", "name", "key as canonical")
        judged = votes.select("dataset", "name", "key") if judged is None else judged.unionByName(votes.select("dataset", "name", "key"))
        if found.isEmpty():
            return learned, cols
        learned = found if learned is None else learned.unionByName(found)


def domain_rules(domains: DataFrame) -> DataFrame:
    """The domain of every measurement: dataset, key, kind, lo, hi, numbers and words of its allowed values."""
    values = F.split("allowed_values", "\\|")
    return domains.select(
        "dataset", F.col("column_name").alias("key"), "kind", F.expr("nanvl(min_value, null)").alias("lo"), F.expr("nanvl(max_value, null)").alias("hi"),
        F.filter(F.transform(values, rc.number_of), lambda x: x.isNotNull()).alias("numbers"), F.filter(values, lambda x: rc.number_of(x).isNull()).alias("words"),
    )


def value_class(value: str) -> str:
    """SQL for the class of a raw field: 1 whole number, 2 number with a decimal point, 3 text; null for a missing value."""
    missing = ", ".join(f"'{w}'" for w in rc.MISSING_WORDS)
    return rf"case when {value} is null or {value} in ({missing}) then null when {value} rlike '^[+-]?[0-9]+(?:[eE][+-]?[0-9]+)?\\z' then 1 when {value} rlike '^[+-]?(?:[0-9]+\\.[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?\\z' then 2 else 3 end"


def column_types(loaded: DataFrame) -> DataFrame:
    """Type of each file's columns over the rows that loaded: file_id, pos, type_code."""
    values = loaded.select("file_id", F.posexplode("raw").alias("pos", "v")).select("file_id", "pos", rc.trimmed(rc.unquote(F.col("v"))).alias("v"))
    return rc.materialised(values, cls=F.expr(value_class("v"))).groupBy("file_id", "pos").agg(F.max("cls").alias("type_code")).where("type_code is not null")


def fingerprints(cols: DataFrame, types: DataFrame) -> DataFrame:
    """The schema of every file: file_id, dataset, prev_file_id, fingerprint, columns (name, key, pos, type_code)."""
    entry = F.expr("concat_ws(':', name, key, coalesce(cast(type_code as string), '0'))")
    made = cols.join(types, ["file_id", "pos"], "left").groupBy("file_id", "dataset", "prev_file_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "|"), 256).alias("fingerprint"), F.array_sort(F.collect_list(F.struct("pos", "name", "key", "type_code"))).alias("columns"))
    return cut_lineage(made)


def versions(prints: DataFrame) -> DataFrame:
    """The registry: every schema of a dataset with its number (by the first file that has it), files and columns."""
    once = prints.groupBy("dataset", "fingerprint").agg(F.min("file_id").alias("first_file_id"), F.count("*").alias("n_files"), F.size(F.min_by("columns", "file_id")).alias("n_columns"), F.expr("min_by(columns, file_id)").alias("columns"))
    return once.withColumn("version", F.row_number().over(Window.partitionBy("dataset").orderBy("first_file_id", "fingerprint")))  # schemas, not files


def migrations(prints: DataFrame) -> DataFrame:
    """The steps between versions that follow each other: dataset, prev_fingerprint, fingerprint, change_kind, old_name, new_name.

    Made once for each pair of versions. Types are compared where both have values.
    """
    before = prints.selectExpr("file_id as prev_file_id", "fingerprint as prev_fingerprint", "columns as prev_columns")
    edge = ["dataset", "prev_fingerprint", "fingerprint"]
    edges = prints.where("prev_file_id is not null").join(before, "prev_file_id").where("fingerprint <> prev_fingerprint").dropDuplicates(edge)
    edges = cut_lineage(edges.select(*edge, "prev_columns", "columns"))
    old = edges.select(*edge, F.explode("prev_columns").alias("c")).selectExpr(*edge, "c.key as key", "c.name as old_name", "c.type_code as old_type")
    new = edges.select(*edge, F.explode("columns").alias("c")).selectExpr(*edge, "c.key as key", "c.name as new_name", "c.type_code as new_type")
    cond = [F.expr(f"o.{c} <=> n.{c}") for c in [*edge, "key"]]
    both = old.alias("o").join(new.alias("n"), cond, "full_outer").selectExpr(*[f"coalesce(o.{c}, n.{c}) as {c}" for c in edge], "old_name", "new_name", "old_type", "new_type")
    kind = "case when old_name is null then 'added' when new_name is null then 'removed' when old_name <> new_name then 'renamed' when old_type <> new_type then 'type' end"
    return both.withColumn("change_kind", F.expr(kind)).where("change_kind is not null").selectExpr(*edge, "change_kind", "coalesce(old_name, '-') as old_name", "coalesce(new_name, '-') as new_name")


def route(prints: DataFrame, steps: DataFrame) -> DataFrame:
    """The log of routing: every step of the migration each file takes from its previous file's version to its own."""
    before = prints.selectExpr("file_id as prev_file_id", "fingerprint as prev_fingerprint")
    taken = prints.where("prev_file_id is not null").select("file_id", "dataset", "prev_file_id", "fingerprint").join(before, "prev_file_id")
    hit = F.expr("f.dataset <=> s.dataset and f.prev_fingerprint = s.prev_fingerprint and f.fingerprint = s.fingerprint")
    return taken.alias("f").join(steps.alias("s"), hit).selectExpr("f.file_id", "change_kind", "old_name", "new_name")


def rules_of(registry: DataFrame, domains: DataFrame, dataset: str) -> DataFrame:
    """The chain of rules of every version of a dataset: fingerprint, renames, defaults, casts.

    ``renames`` holds the target of every name; ``defaults`` the columns of the consistent table
    the version lacks; ``casts`` the target kind of each one it has.
    """
    kinds = domains.where(F.col("dataset") == dataset).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("column_name", "kind")))).alias("kinds"))
    x = registry.where(F.col("dataset") == dataset).crossJoin(F.broadcast(kinds))  # one row
    return x.selectExpr("fingerprint", "map_from_entries(transform(columns, c -> struct(c.name as name, c.key as target))) as renames", "array_except(map_keys(kinds), transform(columns, c -> c.key)) as defaults", "map_filter(kinds, (k, v) -> array_contains(transform(columns, c -> c.key), k)) as casts")


def consistent_table(loaded: DataFrame, prints: DataFrame, rules: DataFrame, domains: DataFrame, dataset: str) -> DataFrame:
    """All loaded rows of a dataset in one schema: file_id, line_no, the columns of field_domains, extras.

    The chain of a row is that of its file's version. Rename: a column goes to its measurement. Default: a
    measurement the version lacks is null, as is a missing value. Cast: numbers and categories to double
    (words by WORD_CODES, else null); identifiers stay text, since nodes also send them as codes. Columns
    of their own stay as text in ``extras``.
    """
    target = sorted((r.column_name, r.kind) for r in domains.where(F.col("dataset") == dataset).select("column_name", "kind").collect())  # fixed, narrow table
    own = ", ".join(f"'{c}'" for c, _ in target)
    chain = prints.where(F.col("dataset") == dataset).select("file_id", "fingerprint", "columns").join(rules, "fingerprint").drop("fingerprint")
    rows = loaded.join(chain, "file_id").withColumn("fields", F.transform("raw", lambda x: rc.trimmed(rc.unquote(x))))
    missing = ", ".join(f"'{w}'" for w in rc.MISSING_WORDS)
    renamed = f"map_from_entries(filter(transform(columns, c -> struct(renames[c.name] as key, get(fields, c.pos) as value)), e -> e.value is not null and e.value not in ({missing})))"
    rows = rc.materialised(rows, m=F.expr(renamed))

    def cast(column: str, kind: str) -> Column:
        v = F.expr(f"case when not array_contains(defaults, '{column}') then try_element_at(m, '{column}') end")
        if kind == "identifier":
            return v.alias(column)
        out = rc.number_of(v)
        for word, code in WORD_CODES.get(column, {}).items():
            out = F.when(v == word, F.lit(code)).otherwise(out)
        return out.alias(column)

    return rows.select("file_id", "line_no", *[cast(c, k) for c, k in target], F.expr(f"map_filter(m, (k, v) -> k not in ({own}))" if own else "m").alias("extras"))


def version_log(prints: DataFrame, registry: DataFrame, log: DataFrame) -> DataFrame:
    """Each file with its version, whether that differs from the version before, and its number of steps."""
    counted = log.groupBy("file_id").agg(F.count("*").alias("n_steps"))
    before = prints.selectExpr("file_id as prev_file_id", "fingerprint as prev_fingerprint")
    x = prints.join(registry.select("dataset", "fingerprint", "version", "n_columns"), ["dataset", "fingerprint"], "left").join(before, "prev_file_id", "left").join(counted, "file_id", "left")
    return x.selectExpr("file_id", "dataset", "prev_file_id", "fingerprint", "version", "coalesce(fingerprint <> prev_fingerprint, true) as new_version", "n_columns", "coalesce(n_steps, 0) as n_steps")
