"""Intake of raw files against a character-by-character reader and literal cases."""

import re

import pytest

from sitewise.operators import schema_drift as sd
from sitewise.operators import strict_load as sl
from sitewise.queries.raw_intake import QUERIES, intake
from sitewise.session import table
from sitewise.sources import raw_csv as rc

MISSING = {"", "NULL", "null", "NaN"}
NUM = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")


def split_strict(line, d):
    """Fields of a CSV line by a state machine; None if the quoting is broken."""
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != d:
                return None
        else:
            j = line.find(d, i)
            j = len(line) if j < 0 else j
            text = line[i:j]
            if '"' in text:
                return None
            i = j
        out.append(text)
        if i >= len(line):
            return out
        i += 1


def norm(name):
    return re.sub(r"\s", "_", name.replace('"', "").replace("﻿", "").lower().strip())


def _steps(cols, loaded):
    prints = sd.fingerprints(cols, sd.column_types(loaded))
    return sd.route(prints, sd.migrations(prints))


def brute_p4(files, lines, domains, alias):
    rules = {(r.dataset, r.column_name): r for r in domains.itertuples()}
    head = {r.file_id: r.line for r in lines.itertuples() if r.line_no == 1}
    dataset = dict(zip(files.file_id, files.dataset))
    found = set()
    for r in lines.itertuples():
        if r.line_no <= 1 or r.line is None or not r.line.strip():
            continue
        h = head[r.file_id].lstrip("﻿").rstrip("\r\n")
        d = max(rc.DELIMITERS, key=lambda c: re.sub('"[^"]*"', "", h).count(c))
        names = [norm(x) for x in (split_strict(h, d) or h.split(d))]
        f = split_strict(r.line.rstrip("\r\n"), d)
        if f is None:
            found.add((r.file_id, r.line_no, "quoting"))
        elif len(f) != len(names):
            found.add((r.file_id, r.line_no, "columns"))
        else:
            for n, v in zip(names, f):
                ds = dataset[r.file_id]
                rule = rules.get((ds, alias.get((ds, n), n)))
                v = v.strip()
                if rule is None or v in MISSING or rule.kind == "identifier":
                    continue
                x = float(v) if NUM.match(v) else None
                allowed = (rule.allowed_values or "").split("|")
                ok = (x is not None and rule.min_value <= x <= rule.max_value) if rule.kind == "number" else v in [a for a in allowed if not NUM.match(a)] or (x is not None and x in [float(a) for a in allowed if NUM.match(a)])
                if not ok:
                    found.add((r.file_id, r.line_no, "value"))
                    break
    return found


def test_p4_equals_brute_force(spark, small):
    made = [table(spark, small, t) for t in ("raw_files", "raw_lines", "field_domains")]
    learned, _ = sd.learn_names(made[1], rc.file_headers(*made[:2]), made[2])
    alias = {(r.dataset, r.name): r.canonical for r in learned.collect()}
    assert ("heart_disease_cleveland", "major_vessels") in alias and not any(n in ("bmi", "smoker", "remark", "device") for _, n in alias)
    got = {tuple(r) for r in QUERIES["p4_found"](spark, small).collect()}
    assert got == brute_p4(*[t.toPandas() for t in made], alias)


def test_loaded_and_rejected_are_the_whole_input(spark, small):
    x = intake(spark, small)
    bad = sl.rejected(x["lines"], x["specs"], x["loaded"])
    total = x["lines"].where("line_no > 1 and trim(regexp_replace(line, '\\\\s', '')) <> ''").count()
    assert bad.count() + x["loaded"].count() == total


def _world(spark, heads_and_rows, dataset="heart_disease_cleveland"):
    """Files of one series from [[line, ...], ...]."""
    files = spark.createDataFrame([(i + 1, dataset, "n", f"f{i}", i if i else None) for i in range(len(heads_and_rows))], "file_id long, dataset string, node_id string, file_name string, prev_file_id long")
    rows = [(i + 1, k + 1, x) for i, ls in enumerate(heads_and_rows) for k, x in enumerate(ls)]
    return files, spark.createDataFrame(rows, "file_id long, line_no int, line string")


def _run(spark, small, files, lines):
    domains = table(spark, small, "field_domains")
    headers = rc.file_headers(files, lines)
    _, cols = sd.learn_names(lines, headers, domains)
    specs = sl.parse_specs(headers, cols, domains)
    loaded = sl.strict_load(lines, specs)
    return headers, cols, specs, loaded, domains


def test_line_cases(spark, small):
    files, lines = _world(spark, [["age;chol;note", "50;200;x", '"51";"20""0";', '52;200;"a";', '53;"200" ;x', '54;2"0;x', '55;200;"open', "", None, " ;NULL;", "56;700.5;x", "57;2e2;x\r", "５;200;x", ";;", '58;200;"a;b"']])
    headers, cols, specs, loaded, _ = _run(spark, small, files, lines)
    bad = {r.line_no: r.reason for r in sl.rejected(lines, specs, loaded).collect()}
    assert bad == {3: "value", 4: "columns", 5: "quoting", 6: "quoting", 7: "quoting", 11: "value", 13: "value"}
    assert {r.line_no for r in loaded.collect()} == {2, 10, 12, 14, 15}


def test_long_line_does_not_overflow(spark, small):
    many = ";".join(["1"] * 20000)
    quoted = '"' + 'a""' * 20000 + '"'
    files, lines = _world(spark, [["age;note", many, f"5;{quoted}", "5;" + "x" * 300000]])
    headers, cols, specs, loaded, _ = _run(spark, small, files, lines)
    assert {r.line_no: r.reason for r in sl.rejected(lines, specs, loaded).collect()} == {2: "columns"}


def test_drift_kinds_order_case_and_delimiter(spark, small):
    a = ["﻿Age,thal,chol,ca", "50,3,200,0", "51,7,210,1"]
    b = ['"chol"|"thal scan"|" age"|"bmi"', "200|3|50|22.5", "210.5|6|51|23"]
    c = ["age;chol;thal_scan;bmi", "50;200.0;normal;22.5", "bad;1;2;3"]
    files, lines = _world(spark, [a, b, c])
    headers, cols, specs, loaded, _ = _run(spark, small, files, lines)
    got = {tuple(r) for r in _steps(cols, loaded).collect()}
    assert got == {(2, "renamed", "thal", "thal_scan"), (2, "added", "-", "bmi"), (2, "removed", "ca", "-"), (2, "type", "chol", "chol"), (3, "type", "thal_scan", "thal_scan")}


def test_unknown_name_is_learned_from_values(spark, small):
    rows = [f"{50 + i % 9},{200 + i * 3 % 90},{i % 2}" for i in range(60)]
    files, lines = _world(spark, [["age,chol,sex", *rows], ["age,chol_total_mg,sex", *rows], ["age,sex,remark2", *[f"{50 + i % 9},{i % 2},free text" for i in range(60)]]])
    headers, cols, specs, loaded, _ = _run(spark, small, files, lines)
    got = {tuple(r) for r in _steps(cols, loaded).collect()}
    assert got == {(2, "renamed", "chol", "chol_total_mg"), (3, "removed", "chol_total_mg", "-"), (3, "added", "-", "remark2")}


def _consistent(loaded, cols, domains, dataset):
    prints = sd.fingerprints(cols, sd.column_types(loaded))
    return sd.consistent_table(loaded, prints, sd.rules_of(sd.versions(prints), domains, dataset), domains, dataset)


def test_consistent_table_keeps_every_loaded_row(spark, small):
    x = intake(spark, small)
    n = sum(_consistent(x["loaded"], x["cols"], x["domains"], d).count() for d in ("heart_disease_cleveland", "breast_cancer_gbsg"))
    assert n == x["loaded"].count()
    words = _world(spark, [["thal,age", "3,40", "7,41"], ["thal_code,bmi,age", "fixed,20,50", "7,,"], ["age,thal_code,bmi", "60,3,"]])
    _, cols, _, loaded, domains = _run(spark, small, *words)
    rows = _consistent(loaded, cols, domains, "heart_disease_cleveland").where("file_id > 1").orderBy("file_id", "line_no").collect()
    assert [(r.thal, r.age, r.chol, r.extras) for r in rows] == [(6.0, 50.0, None, {"bmi": "20"}), (7.0, None, None, {}), (3.0, 60.0, None, {})]


def test_versions_are_numbered_once_and_migrations_shared(spark, small):
    """Two series that change alike share versions and the migration between them; order of columns is no version."""
    files = spark.createDataFrame([(i, "heart_disease_cleveland", "n", f"f{i}", p) for i, p in [(1, None), (2, 1), (3, None), (4, 3), (5, 4)]], "file_id long, dataset string, node_id string, file_name string, prev_file_id long")
    heads = {1: "age,chol", 2: "age,chol,bmi", 3: "chol,age", 4: "bmi,age,chol", 5: "age,chol"}
    lines = spark.createDataFrame([(i, k + 1, x) for i, h in heads.items() for k, x in enumerate([h, ",".join({"age": "50", "chol": "200", "bmi": "20"}[c] for c in h.split(","))])], "file_id long, line_no int, line string")
    _, cols, _, loaded, _ = _run(spark, small, files, lines)
    prints = sd.fingerprints(cols, sd.column_types(loaded))
    steps = sd.migrations(prints)
    assert {(r.version, r.n_files) for r in sd.versions(prints).collect()} == {(1, 3), (2, 2)} and steps.count() == 2
    assert {tuple(r) for r in sd.route(prints, steps).collect()} == {(2, "added", "-", "bmi"), (4, "added", "-", "bmi"), (5, "removed", "bmi", "-")}


def test_fast_pattern_never_accepts_more_than_the_check(spark, small):
    for a, b in [(0, 0), (0, 9), (7, 23), (80, 700), (99, 1000), (1, 4000), (105, 105), (0, 120)]:
        p = re.compile(sl.whole_numbers(a, b) and f"(?:{sl.whole_numbers(a, b)})\\Z")
        assert [i for i in range(b + 1200) if p.match(str(i))] == list(range(a, b + 1))
    for low, high in [(-3.0, 10.0), (80.0, 700.0), (0.5, 2.5), (-7.5, -2.0), (None, None), (3.2, 3.4)]:
        p = re.compile(f"(?:{sl._range_pattern(low, high)})\\Z")
        for x in [f"{s}{i}{d}" for s in ("", "-") for i in range(0, 720) for d in ("", ".", ".0", ".5", ".99")]:
            assert not p.match(x) or ((low is None or float(x) >= low) and (high is None or float(x) <= high)), x
    rows = ["age\tchol\tnote", "50\t200\tx", "\t50\t200\tx", "50\t\t200\tx", "x\t\t5", "50\t200\t\"a\tb\"", '"50"\t"200"\tx', "50\t+200\t", " 50 \t 2e2 \t "]
    files, lines = _world(spark, [rows, ["note\tage", "x\t\t5", "x\t 5"]])
    _, cols, specs, loaded, _ = _run(spark, small, files, lines)
    assert {(r.file_id, r.line_no) for r in loaded.collect()} == {(1, 2), (1, 5), (1, 6), (1, 7), (1, 8), (1, 9), (2, 3)} - {(1, 5)}


@pytest.mark.parametrize("name", ["p1_found", "p4_found"])
def test_empty_tables(spark, small, name, tmp_path):
    for t in ("raw_files", "raw_lines"):
        table(spark, small, t).limit(0).withColumn("label", __import__("pyspark").sql.functions.lit(1)).write.parquet(f"{tmp_path}/{t}.parquet")
    table(spark, small, "field_domains").write.parquet(f"{tmp_path}/field_domains.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_nulls_strangers_and_repeats(spark, small):
    files = spark.createDataFrame([(1, None, "n", "f", None, "x"), (1, None, "n", "f", None, "x"), (2, "breast_cancer_gbsg", None, None, 99, "x"), (None, None, None, None, None, None)], "file_id long, dataset string, node_id string, file_name string, prev_file_id long, delimiter string")
    rows = [(1, 1, "age,note"), (1, 2, "500,x"), (1, 2, "500,x"), (2, 1, "pid;age"), (2, 2, "a1;500"), (3, 1, "age"), (3, 2, "500"), (4, 2, "no header"), (None, 1, "age"), (None, 2, "5"), (2, None, "1;2"), (2, 3, None)]
    lines = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "file_id long, line_no int, line string, raw string, fields string")
    headers, cols, specs, loaded, _ = _run(spark, small, files, lines)
    bad = {(r.file_id, r.line_no, r.reason) for r in sl.rejected(lines, specs, loaded).collect()}
    assert bad == {(2, 2, "value"), (4, 2, "columns"), (None, 2, "columns")}
    assert loaded.count() == 3  # both copies of the repeated line, and the line of the file nobody listed
    assert _steps(cols, loaded).count() == 0


def test_empty_column_names_and_repeated_headers(spark, small):
    files, lines = _world(spark, [["age,,age,thal,thal_scan", "50,,1,3,7"], [",age,thal_scan", "x,51,3"]])
    headers, cols, specs, loaded, _ = _run(spark, small, files, lines)
    got = {tuple(r) for r in _steps(cols, loaded).collect()}
    assert got == {(2, "removed", "thal", "-")}  # names that stood side by side are two measurements
    assert loaded.count() == 2


def test_names_are_learned_by_absence_without_values(spark, small):
    """A name in many headers that never meets a common measurement is that measurement; one that meets it is not."""
    heads = [["age,chol,sex"], ["age,lipids,sex"], ["age,chol,sex,extra"]] * 16
    files, lines = _world(spark, heads)
    learned, cols = sd.learn_names(lines, rc.file_headers(files, lines), table(spark, small, "field_domains"))
    assert [tuple(r) for r in learned.collect()] == [("heart_disease_cleveland", "lipids", "chol")]
    assert cols.where("key = 'chol' and is_domain").count() == 48
