"""Queries of sources, typing, labels, genomic and imaging statistics, JSON and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from sitewise.functions import scalars as sc
from sitewise.operators import column_typing as ct
from sitewise.operators import descriptive as ds
from sitewise.operators import labels as lb
from sitewise.operators import narrative as nar
from sitewise.queries import profile as pf
from sitewise.session import ensure_checkpoint_dir, nan_to_null, table
from sitewise.sources import datasets as dsrc
from sitewise.sources import genomic as gen
from sitewise.sources import imaging as img
from sitewise.sources import raw_csv as rc
from sitewise.sources import sinks
from sitewise.streaming import profile as st

_r = pf._rounded
HEART = "heart_disease_cleveland"


def s1(spark, d):
    """Files of the data directory."""
    return dsrc.file_listing(spark, d).select("file_name", "length")


def s3(spark, d):
    ends = F.array(*[F.lit(e) for e in ("", ".gz", ".xlsx", ".fq.gz", ".BAM", ".vcf", ".fa", ".jpeg", ".unknown", ".json")])
    n = table(spark, d, "raw_files").select("file_id", F.concat("file_name", F.element_at(ends, (F.col("file_id") % 10 + 1).cast("int"))).alias("file_name"))
    return n.select("file_id", dsrc.file_type(F.col("file_name")).alias("file_type"))


def s4(spark, d):
    n = table(spark, d, "raw_files").select("node_id", F.when(F.col("file_id") % 7 == 0, F.concat(F.lit("x_unlabeled"), F.col("file_id").cast("string"), F.lit("_unlabeled.csv"))).when(F.col("file_id") % 3 == 0, F.concat(F.lit("a_labeled_"), F.col("file_name"))).otherwise(F.col("file_name")).alias("file_name"))
    return dsrc.chosen_files(n).select("node_id", "file_name", "rank")


def s5(spark, d):
    h = rc.file_headers(table(spark, d, "raw_files"), table(spark, d, "raw_lines"))
    return h.select("file_id", "delimiter", F.size("names").alias("n_columns"))


def p1(spark, d):
    x = table(spark, d, "raw_lines").select(F.explode(F.split(rc.clean_line(F.col("line")), "[,;\t|]")).alias("v"))
    return x.agg(F.count("*").alias("n_cells"), F.count(sc.null_tokens(F.col("v"))).alias("n_values"))


def p2(spark, d):
    names = sc.clean_names([" Blood Pressure", "blood_pressure", "BLOOD PRESSURE", "age ", "Age_1", "age"])
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")


def p4(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("n/a").alias("half"), F.col("o_totalprice").cast("string").alias("price"), "o_orderpriority")
    return _r(ct.date_columns(o, o.columns))


def p5(spark, d):
    return ct.kinds_table(spark, ct.column_kinds(table(spark, d, HEART)))


def p8(spark, d):
    k = [x for t in (HEART, "breast_cancer_gbsg", "longitudinal", "orders", "customer") for x in ct.column_kinds(table(spark, d, t))]
    return spark.createDataFrame(sorted({(x.column,) for x in k if x.is_identifier}), "column_name string")


def p10(spark, d):
    g = table(spark, d, "breast_cancer_gbsg").select("grade", F.col("node_id").alias("node"), F.col("nodes").cast("string").alias("nodes_text"))
    return _r(ct.quasi_numeric(g, ["grade", "node", "nodes_text"]))


def p7(spark, d):
    names = ["Diabetes", "chest-pain", "age", "ICU_days", "painting", "flag.x"]
    return spark.createDataFrame([(n, bool(sc.name_tokens(n) & ct.INDICATOR_WORDS)) for n in names], "name string, suggests_binary boolean")


def p9(spark, d):
    """Identifiers keep their names but belong to no analytical kind."""
    k = ct.column_kinds(table(spark, d, "breast_cancer_gbsg"))
    rows = [(x, c) for x in ("numeric", "categorical", "temporal") for c in ct.of_kind(k, x)]
    return spark.createDataFrame(rows, "kind string, column_name string")


def p11(spark, d):
    v = sc.as_number(F.col("grade"))
    return table(spark, d, "breast_cancer_gbsg").groupBy("node_id").agg(F.count(v).alias("n_numbers"), F.count("grade").alias("n_values"))


def n4(spark, d):
    """The notices about quasi-numeric columns, ages out of range and excluded columns."""
    quasi = [r.column_name for r in p10(spark, d).collect()]
    far = ds.out_of_range(table(spark, d, HEART), "age").first().n_out_of_range
    texts = [nar.names_notice(quasi, "quasi_numeric"), nar.names_notice([str(far)] if far else [], "out_of_range_age"), nar.names_notice([], "excluded")]
    return spark.createDataFrame([(t,) for t in texts if t], "text string")


def p14(spark, d):
    gate = ct.reduction_gate(ct.column_kinds(table(spark, d, HEART)))
    return spark.createDataFrame([(k, v) for k, v in sorted(gate.items())], "method string, applies boolean")


def p20(spark, d):
    return ct.level_counts(table(spark, d, HEART), ["sex", "cp", "fbs", "restecg", "exang", "slope", "ca", "thal", "num"]).where("n_levels <= 30")


def p21(spark, d):
    return spark.createDataFrame([(c,) for c in lb.symptom_columns(["age", "Chest_Pain", "fatigue_flag", "bmi", "heart_rate", "sleep_hours", "memory"])], "column_name string")


def p22(spark, d):
    h = nan_to_null(table(spark, d, HEART)).select("record_id", F.col("exang").alias("chest_pain"), F.when(F.col("fbs") == 1, "yes").when(F.col("fbs") == 0, "No").alias("fatigue"), (F.col("num") > 2).cast("int").alias("icu"))
    return _r(h.select("record_id", lb.probability(h.columns).alias("probability")), 8)


def p23(spark, d):
    return table(spark, d, "documents").groupBy(sc.or_unknown(F.col("source")).alias("source")).agg(F.count("*").alias("cnt"))


def _fastq_names(spark, d):
    x = table(spark, d, "raw_files").select("node_id", F.col("n_lines").cast("long").alias("length"), F.explode(F.array(*[F.lit(s) for s in ("_L001_R1_001.fastq.gz", "_L001_R2_001.FASTQ.gz", "_L002.bam", ".fa", ".txt")])).alias("s"))
    return x.select(F.concat("node_id", "s").alias("file_name"), "length")


def g1(spark, d):
    return gen.samples(_fastq_names(spark, d)).select("n_samples", F.array_join("samples", ",").alias("samples"))


def g2(spark, d):
    return gen.format_overview(_fastq_names(spark, d))


def g3(spark, d):
    return gen.size_statistics(table(spark, d, "documents").select((F.coalesce("n_chars", F.lit(0)) * 1024).alias("length")))


def _vcf(spark, d):
    """VCF lines written from line items: position, alleles and two genotypes."""
    x = table(spark, d, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    ref = F.element_at(F.array(*[F.lit(v) for v in ("A", "AT", "A", "ACG", "G", "AT", "C", "T")]), (k + 1).cast("int"))
    alt = F.element_at(F.array(*[F.lit(v) for v in ("G", "A", "ATT", "TTT", "<DEL>", "A,ATG", "*", "A,C")]), (k + 1).cast("int"))
    gt = lambda c: F.element_at(F.array(*[F.lit(v) for v in ("0/0", "0/1", "1|1", "./.")]), (F.col(c) % 4 + 1).cast("int"))
    rec = F.concat_ws("\t", F.lit("chr1"), F.col("l_orderkey").cast("string"), F.lit("."), ref, alt, F.lit("50"), F.lit("PASS"), F.lit("."), F.lit("DP:GT"), F.concat(F.lit("9:"), gt("l_partkey")), F.concat(F.lit("7:"), gt("l_suppkey")))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",)], "value string")
    return head.unionByName(x.select(rec.alias("value")))


def g4(spark, d):
    x = table(spark, d, "lineitem")
    cigar = F.element_at(F.array(F.lit("10M"), F.lit("2S6M3D4M"), F.lit("5M20N5M")), (F.col("l_partkey") % 3 + 1).cast("int"))
    flag = F.when(F.col("l_suppkey") % 10 == 0, 4).when(F.col("l_suppkey") % 10 == 1, 1024).otherwise(16)
    return gen.coverage(x.select(F.concat_ws("\t", F.lit("r"), flag.cast("string"), "l_returnflag", (F.col("l_orderkey") % 5000 + 1).cast("string"), F.lit("60"), cigar, F.lit("*")).alias("value")))


def g5(spark, d):
    return gen.variants_per_sample(_vcf(spark, d))


def g6(spark, d):
    return gen.variant_types(_vcf(spark, d))


def g7(spark, d):
    p = table(spark, d, "part")
    return _r(gen.sequence_statistics(gen.sequence_lengths(p.select(F.concat(F.lit(">"), "p_brand", F.lit(" part\n"), F.repeat(F.lit("ACGT\n"), F.col("p_size"))).alias("record")))))


def g8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50 + 1).cast("int").alias("n"))
    lines = o.select("o_orderkey", F.posexplode(F.array(F.concat(F.lit("@r"), F.col("o_orderkey").cast("string")), F.repeat(F.lit("A"), F.col("n")), F.lit("+"), F.repeat(F.lit("I"), F.col("n")))).alias("line_no", "value"))
    return _r(gen.read_lengths(lines))


def _headers(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_size") * 10).alias("width"), (F.col("p_size") + 7).alias("height"), (F.col("p_partkey") % 5).cast("int").alias("depth"), F.when(F.col("p_partkey") % 3 == 0, "DICOM").otherwise("PNG").alias("format"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("modality"), F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.col("p_type")).alias("body_part"), (F.col("p_partkey") * 1000).alias("length"), F.col("p_brand").alias("folder"))


def m1(spark, d):
    return img.resolution(_headers(spark, d))


def m2(spark, d):
    return img.modalities(_headers(spark, d))


def m3(spark, d):
    return img.regions(_headers(spark, d)).select("region", "n_files", "is_degenerate")


def m4(spark, d):
    return img.folder_table(_headers(spark, d)).select("folder", "format", "n_files", "width", "height")


def s15(spark, d):
    return sinks.rows_as_json(table(spark, d, "region"))


def s16(spark, d):
    import base64

    text = sinks.pack({"a/b.csv": b"x,y\n1,2\n", "c.json": b"{}"})
    with tempfile.TemporaryDirectory() as t:
        names = sinks.unpack(text, t)
    return spark.createDataFrame([(n, len(base64.b64decode(text)) > 0) for n in sorted(names)], "name string, packed boolean")


def s18(spark, d):
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("cnt"))


def s18_rows(spark, d):
    """Examinations as JSON objects by the serialiser: dates in ISO form, NaN and infinities as null."""
    import json

    import pandas as pd

    def run(batches):
        for b in batches:
            rows = b.to_dict(orient="records")
            yield pd.DataFrame({"json": [json.dumps(sinks.plain(r)) for r in rows]})

    x = table(spark, d, HEART).selectExpr("record_id", "cast(visit_date as string) as day", "trestbps", "case when fbs = 0 then double('infinity') when fbs = 1 then double('-infinity') else 2.5d end as odd")
    return x.mapInPandas(run, "json string")


def s12(spark, d):
    """A result table written by the executors as CSV by site, in the shared folder, and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/sitewise-tables/{uuid.uuid4().hex}"
    counts = table(spark, d, HEART).groupBy("node_id", "cp").agg(F.count("*").alias("cnt"), F.map_from_arrays(F.array(F.lit("n, \"quoted\"")), F.array(F.count("chol"))).alias("held"))
    sinks.write_table(counts, path, "node_id")
    return spark.read.option("header", True).option("escape", '"').schema("cp double, cnt long, held string, node_id string").csv(path)


def stream(spark, d):
    """Daily counts of a stream over the event files, run until all input is read."""
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"event_windows_{abs(hash((d, id(s)))) % 10**9}"
    q = st.windowed_counts(s, "ts", ["event_type"], "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="sitewise-stream-")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "cnt")


QUERIES = {
    "S1_file_listing": s1, "S3_file_types": s3, "S4_chosen_files": s4, "S5_delimiters": s5, "P1_null_tokens": p1, "P2_P3_clean_names": p2, "P4_date_columns": p4, "P5_P6_column_kinds": p5, "P8_identifiers": p8, "P10_quasi_numeric": p10, "P7_name_keywords": p7, "P9_analytical_columns": p9, "P11_numeric_coercion": p11, "N4_notices": n4, "P14_reduction_gate": p14, "P20_level_counts": p20, "P21_symptom_columns": p21, "P22_label_probability": p22, "P23_unknown_default": p23,
    "S12_tables_by_site": s12, "S18_serialised_rows": s18_rows, "G1_samples": g1, "G2_format_overview": g2, "G3_size_statistics": g3, "G4_coverage": g4, "G5_variants_per_sample": g5, "G6_variant_types": g6, "G7_fasta": g7, "G8_fastq": g8, "M1_resolution": m1, "M2_modalities": m2, "M3_regions": m3, "M4_folders": m4, "S15_rows_as_json": s15, "S16_archive": s16, "S18_json_values": s18, "streaming_windows": stream,
}

_HK = {c: "numeric" for c in ("age", "cp", "trestbps", "chol", "restecg", "thalach", "oldpeak", "slope", "ca", "thal")}
_BIN = "SELECT '{c}' AS column_name, CASE WHEN count(*) FILTER ({c} IS NOT NULL AND NOT isnan({c}) AND {c} NOT IN (0, 1)) = 0 THEN 'categorical' ELSE 'numeric' END AS kind, count(*) FILTER ({c} IS NOT NULL AND NOT isnan({c}) AND {c} NOT IN (0, 1)) = 0 AS is_binary, FALSE AS is_identifier FROM " + HEART
_DEPTH = "(SELECT l_returnflag AS ref, l_orderkey % 5000 + 1 AS pos, l_partkey % 3 AS c FROM lineitem WHERE l_suppkey % 10 > 1)"
ORACLE = {
    "S3_file_types": "WITH n AS (SELECT file_id, lower(file_name || (['', '.gz', '.xlsx', '.fq.gz', '.BAM', '.vcf', '.fa', '.jpeg', '.unknown', '.json'])[file_id % 10 + 1]) AS f FROM raw_files) SELECT file_id, CASE WHEN suffix(f, '.csv') THEN 'csv' WHEN suffix(f, '.xlsx') THEN 'excel' WHEN suffix(f, '.json') THEN 'json' WHEN suffix(f, '.jpeg') THEN 'image' WHEN suffix(f, '.fq.gz') THEN 'fastq' WHEN suffix(f, '.bam') THEN 'alignment' WHEN suffix(f, '.vcf') THEN 'vcf' WHEN suffix(f, '.fa') THEN 'fasta' END AS file_type FROM n",
    "S4_chosen_files": "WITH n AS (SELECT node_id, CASE WHEN file_id % 7 = 0 THEN 'x_unlabeled' || file_id || '_unlabeled.csv' WHEN file_id % 3 = 0 THEN 'a_labeled_' || file_name ELSE file_name END AS file_name FROM raw_files), r AS (SELECT *, CAST(CASE WHEN suffix(lower(file_name), 'unlabeled.csv') THEN 0 WHEN NOT contains(lower(file_name), 'labeled') THEN 1 ELSE 2 END AS INTEGER) AS rank FROM n) SELECT node_id, first(file_name ORDER BY rank, file_name) AS file_name, min(rank) AS rank FROM r GROUP BY node_id",
    "S5_delimiters": "WITH h AS (SELECT file_id, rtrim(line, chr(13)) AS l FROM raw_lines WHERE line_no = 1), c AS (SELECT file_id, unnest([',', ';', chr(9), '|']) AS d, unnest([length(l) - length(replace(l, ',', '')), length(l) - length(replace(l, ';', '')), length(l) - length(replace(l, chr(9), '')), length(l) - length(replace(l, '|', ''))]) AS n FROM h) SELECT file_id, max_by(d, n) AS delimiter, CAST(max(n) + 1 AS INTEGER) AS n_columns FROM c GROUP BY file_id",
    "P1_null_tokens": r"WITH v AS (SELECT unnest(regexp_split_to_array(regexp_replace(line, '[\r\n]+$', ''), '[,;\t|]')) AS v FROM raw_lines WHERE line IS NOT NULL) SELECT count(*) AS n_cells, count(*) FILTER (v NOT IN ('', 'NULL', 'null', 'NaN')) AS n_values FROM v",
    "P2_P3_clean_names": "SELECT * FROM (VALUES (0, 'blood_pressure'), (1, 'blood_pressure_1'), (2, 'blood_pressure_2'), (3, 'age'), (4, 'age_1'), (5, 'age_2')) t(pos, name)",
    "P4_date_columns": "SELECT 'day' AS column_name, 0.0 AS numeric_share, 1.0 AS date_share, TRUE AS promoted UNION ALL SELECT 'half', 0.0, round(count(*) FILTER (o_orderkey % 2 = 0) * 1.0 / count(*), 4), count(*) FILTER (o_orderkey % 2 = 0) > 0.6 * count(*) FROM orders UNION ALL SELECT 'price', 1.0, 0.0, FALSE UNION ALL SELECT 'o_orderpriority', 0.0, 0.0, FALSE",
    "P5_P6_column_kinds": " UNION ALL ".join(_BIN.format(c=c) for c in pf._HEART_DBL) + " UNION ALL SELECT * FROM (VALUES ('record_id', 'numeric', FALSE, TRUE), ('patient_id', 'categorical', FALSE, TRUE), ('node_id', 'categorical', FALSE, TRUE), ('load_id', 'numeric', FALSE, TRUE), ('visit_date', 'temporal', FALSE, FALSE), ('num', 'numeric', FALSE, FALSE)) t(a, b, c, d)",
    "P8_identifiers": "SELECT unnest(['c_name', 'load_id', 'node_id', 'patient_id', 'pid', 'record_id', 'rownames']) AS column_name",
    "P10_quasi_numeric": "SELECT 'grade' AS column_name, count(grade) AS n_values, count(TRY_CAST(trim(grade) AS DOUBLE)) AS n_numbers, round(count(TRY_CAST(trim(grade) AS DOUBLE)) * 1.0 / count(grade), 4) AS numeric_share FROM breast_cancer_gbsg HAVING count(TRY_CAST(trim(grade) AS DOUBLE)) BETWEEN 0.5 * count(grade) AND count(grade) - 1",
    "P7_name_keywords": "SELECT * FROM (VALUES ('Diabetes', TRUE), ('chest-pain', TRUE), ('age', FALSE), ('ICU_days', TRUE), ('painting', FALSE), ('flag.x', TRUE)) t(name, suggests_binary)",
    "P9_analytical_columns": "SELECT * FROM (VALUES ('numeric', 'age'), ('numeric', 'size'), ('numeric', 'nodes'), ('numeric', 'pgr'), ('numeric', 'er'), ('numeric', 'rfstime'), ('categorical', 'meno'), ('categorical', 'grade'), ('categorical', 'hormon'), ('categorical', 'status'), ('temporal', 'surgery_date')) t(kind, column_name)",
    "P11_numeric_coercion": "SELECT node_id, count(TRY_CAST(trim(grade) AS DOUBLE)) AS n_numbers, count(grade) AS n_values FROM breast_cancer_gbsg GROUP BY ALL",
    "N4_notices": f"SELECT 'Mostly numbers, but not entirely, so treated as categories: grade.' AS text FROM breast_cancer_gbsg HAVING count(TRY_CAST(trim(grade) AS DOUBLE)) BETWEEN 0.5 * count(grade) AND count(grade) - 1 UNION ALL SELECT count(*) || ' age value(s) lie outside 0-100 years and are not in the age distribution.' FROM {HEART} WHERE NOT isnan(age) AND (age < 0 OR age > 100) HAVING count(*) > 0",
    "P14_reduction_gate": "SELECT * FROM (VALUES ('mca', FALSE), ('pca', TRUE)) t(method, applies)",
    "P20_level_counts": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, count(DISTINCT {c}) FILTER (NOT isnan(CAST({c} AS DOUBLE))) AS n_levels FROM {HEART}) WHERE n_levels BETWEEN 1 AND 30" for c in ("sex", "cp", "fbs", "restecg", "exang", "slope", "ca", "thal", "num")),
    "P21_symptom_columns": "SELECT unnest(['Chest_Pain', 'fatigue_flag', 'sleep_hours', 'memory']) AS column_name",
    "P22_label_probability": f"SELECT record_id, round(1 / (1 + exp(-(-1.2 + 2.6 * (greatest(coalesce(CASE WHEN isnan(exang) THEN NULL ELSE exang END, 0), 0) + CASE WHEN fbs = 1 THEN 1 ELSE 0 END) / 2 + 0.8 * CASE WHEN num > 2 THEN 1 ELSE 0 END))), 8) AS probability FROM {HEART}",
    "P23_unknown_default": "SELECT coalesce(nullif(trim(source), ''), 'Unknown') AS source, count(*) AS cnt FROM documents GROUP BY ALL",
    "G1_samples": "SELECT count(DISTINCT s) AS n_samples, string_agg(DISTINCT s, ',' ORDER BY s) AS samples FROM (SELECT node_id AS s FROM raw_files)",
    "G2_format_overview": "SELECT unnest(['FASTQ', 'BAM', 'FASTA']) AS format, unnest([count(*) * 2, count(*), count(*)]) AS n_files FROM raw_files",
    "G3_size_statistics": "WITH s AS (SELECT coalesce(n_chars, 0) * 1024 / (1024.0 * 1024.0) AS mb FROM documents) SELECT count(*) AS n_files, round(sum(CAST(mb AS DOUBLE)), 3) AS total_size, round(avg(CAST(mb AS DOUBLE)), 3) AS average_size, round(min(CAST(mb AS DOUBLE)), 3) AS min_size, round(max(CAST(mb AS DOUBLE)), 3) AS max_size FROM s",
    "G4_coverage": f"WITH b AS (SELECT ref, pos, c FROM {_DEPTH}), r AS (SELECT ref, pos AS a, 10 AS n FROM b WHERE c = 0 UNION ALL SELECT ref, pos, 13 FROM b WHERE c = 1 UNION ALL SELECT ref, pos, 5 FROM b WHERE c = 2 UNION ALL SELECT ref, pos + 25, 5 FROM b WHERE c = 2), e AS (SELECT ref, a + unnest(range(n)) AS p FROM r), d AS (SELECT ref, p, count(*) AS depth FROM e GROUP BY ALL) SELECT round(avg(depth), 3) AS mean_depth, min(depth) AS min_depth, max(depth) AS max_depth, median(depth) AS median_depth FROM d",
    "G5_variants_per_sample": "SELECT 's1' AS sample, count(*) FILTER (l_partkey % 4 IN (1, 2)) AS n_variants FROM lineitem UNION ALL SELECT 's2', count(*) FILTER (l_suppkey % 4 IN (1, 2)) FROM lineitem",
    "G6_variant_types": "SELECT (['SNP', 'deletion', 'insertion', 'MNP', 'SV', 'insertion', 'other', 'SNP'])[(l_orderkey + l_linenumber) % 8 + 1] AS variant_type, count(*) AS n_variants FROM lineitem GROUP BY ALL",
    "G7_fasta": "SELECT count(*) AS n_sequences, min(p_size * 4) AS min_length, max(p_size * 4) AS max_length, round(avg(p_size * 4), 4) AS average_length FROM part",
    "G8_fastq": "SELECT count(*) AS n_reads, count(*) AS total_reads, min(o_custkey % 50 + 1) AS min_length, max(o_custkey % 50 + 1) AS max_length, round(avg(o_custkey % 50 + 1), 4) AS average_length FROM orders",
    "M1_resolution": "SELECT count(*) AS n_images, min(p_size * 10) AS min_width, max(p_size * 10) AS max_width, round(avg(p_size * 10), 3) AS average_width, min(p_size + 7) AS min_height, max(p_size + 7) AS max_height, round(avg(p_size + 7), 3) AS average_height, min(p_partkey % 5) FILTER (p_partkey % 5 > 1) AS min_depth, max(p_partkey % 5) FILTER (p_partkey % 5 > 1) AS max_depth, round(avg(p_partkey % 5) FILTER (p_partkey % 5 > 1), 3) AS average_depth FROM part",
    "M2_modalities": "SELECT CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE 'Unknown' END AS modality, count(*) AS n_files FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL",
    "M3_regions": "SELECT CASE WHEN p_partkey % 6 = 0 THEN 'Unknown' ELSE p_type END AS region, count(*) AS n_files, FALSE AS is_degenerate FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL",
    "M4_folders": "SELECT p_brand AS folder, string_agg(DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'DICOM' ELSE 'PNG' END, '+' ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 'DICOM' ELSE 'PNG' END) AS format, count(*) AS n_files, min(p_size * 10) || '–' || max(p_size * 10) AS width, min(p_size + 7) || '–' || max(p_size + 7) AS height FROM part GROUP BY ALL",
    "S15_rows_as_json": """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""",
    "S16_archive": "SELECT * FROM (VALUES ('a/b.csv', TRUE), ('c.json', TRUE)) t(name, packed)",
    "S18_json_values": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS cnt FROM events GROUP BY ALL",
    "S18_serialised_rows": f"""SELECT '{{"record_id": ' || record_id || ', "day": "' || visit_date || '", "trestbps": ' || CASE WHEN trestbps IS NULL OR isnan(trestbps) THEN 'null' ELSE CAST(trestbps AS VARCHAR) END || ', "odd": ' || CASE WHEN fbs IN (0, 1) THEN 'null' ELSE '2.5' END || '}}' AS json FROM {HEART}""",
    "S12_tables_by_site": f"""SELECT node_id, cp, count(*) AS cnt, '{{"n, \\"quoted\\"":' || count(chol) || '}}' AS held FROM {HEART} GROUP BY node_id, cp""",
    "streaming_windows": "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS cnt FROM events GROUP BY ALL",
}
