"""Files: genomic text, image headers, sites of CSV files, archives; generators, series, streams, the pipeline."""

import gzip
import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import labels as lb
from sitewise.operators import reduction as rd
from sitewise.operators import series as se
from sitewise.plans import pipeline
from sitewise.session import table
from sitewise.sources import datasets, generators, genomic, imaging, sinks
from sitewise.streaming import profile as st

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo
c\t1\t.\tA\tG\t9\tPASS\t.\tGT\t0/1\t0/0
c\t2\t.\tAT\tA\t9\tPASS\t.\tGT:DP\t1/1:3\t0|1:2
c\t3\t.\tA\tATT\t9\tPASS\t.\tDP:GT\t1:0/0\t2:1/1
c\t4\t.\tA\tC\t9\tPASS\t.\tGT\t./1\t.
c\t5\t.\tN\t<DEL>\t9\tPASS\tSVTYPE=DEL\tGT\t0/0\t0/1
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text(VCF)
    got = genomic.analyze(spark, f"{tmp_path}/v.vcf", "vcf")
    assert {r.sample: r.n_variants for r in got["variants_per_sample"].collect()} == {"one": 2, "two": 3}
    assert {r.variant_type: r.n_variants for r in got["variant_types"].collect()} == {"SNP": 2, "deletion": 1, "insertion": 1, "SV": 1}


def test_fastq_plain_gzip_and_empty(spark, tmp_path):
    text = "@r1\nACGTACGT\n+\nIIIIIIII\n@r2\nACGT\n+\n@III\n"
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "c.fastq").write_text("")
    for name in ("a.fastq", "b.fastq.gz"):
        r = genomic.analyze(spark, f"{tmp_path}/{name}", "fastq")["read_lengths"].first()
        assert (r.n_reads, r.min_length, r.max_length, r.average_length) == (2, 4, 8, 6.0)
    assert genomic.analyze(spark, f"{tmp_path}/c.fastq", "fastq")["read_lengths"].count() == 0
    with pytest.raises(ValueError):
        genomic.analyze(spark, f"{tmp_path}/a.fastq", "unknown")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACGT\nAC\n>s2\nA\n")
    got = genomic.analyze(spark, f"{tmp_path}/a.fa", "fasta")
    assert {r.id: r.length for r in got["sequences"].collect()} == {"s1": 6, "s2": 1}
    assert got["statistics"].first().average_length == 3.5


def test_sam_depth(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1\t0\tc\t1\t60\t4M\t*\nr2\t16\tc\t3\t60\t1S2M2N1M\t*\nr3\t4\tc\t1\t0\t*\t*\nr4\t1024\tc\t1\t60\t4M\t*\n")
    r = genomic.analyze(spark, f"{tmp_path}/a.sam", "alignment")["coverage"].first()
    depth = [1, 1, 2, 2, 1]
    assert (r.mean_depth, r.min_depth, r.max_depth, r.median_depth) == (round(np.mean(depth), 3), 1, 2, 1.0)


def _png(w, h):
    ihdr = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + ihdr + struct.pack(">I", zlib.crc32(b"IHDR" + ihdr))


def _element(group, elem, vr, value):
    value += b" " * (len(value) % 2)
    return struct.pack("<HH", group, elem) + vr + struct.pack("<H", len(value)) + value


def _dicom(rows, cols, modality=None, part=None, frames=None):
    body = b"".join([_element(8, 0x60, b"CS", modality) if modality else b"", _element(0x18, 0x15, b"CS", part) if part else b"", _element(0x28, 8, b"IS", frames) if frames else b"", _element(0x28, 0x10, b"US", struct.pack("<H", rows)), _element(0x28, 0x11, b"US", struct.pack("<H", cols))])
    return b"\0" * 128 + b"DICM" + _element(2, 0x10, b"UI", b"1.2.840.10008.1.2.1\0") + body


def test_images(spark, tmp_path):
    d = tmp_path / "scans"
    d.mkdir()
    (d / "a.png").write_bytes(_png(20, 30))
    nii = struct.pack("<i", 348) + b"\0" * 36 + struct.pack("<8h", 3, 10, 12, 5, 1, 1, 1, 1) + b"\0" * 292
    (d / "b.nii").write_bytes(nii)
    (d / "c.nii.gz").write_bytes(gzip.compress(nii))
    (d / "d.dcm").write_bytes(_dicom(64, 48, b"CT", b"CHEST", b"7"))
    (d / "e.dcm").write_bytes(_dicom(32, 16))
    (d / "broken.png").write_bytes(b"no image")
    h = imaging.headers(spark, str(d)).cache()
    assert h.count() == 6 and h.where("error is not null").count() == 1
    r = imaging.resolution(h).first()
    assert (r.n_images, r.min_width, r.max_width, r.min_height, r.max_height, r.min_depth, r.max_depth) == (5, 10, 48, 12, 64, 5, 7)
    assert {x.modality: x.n_files for x in imaging.modalities(h).collect()} == {"CT": 1, "Unknown": 1}
    assert {x.region for x in imaging.regions(h).collect()} == {"CHEST", "Unknown"}
    assert imaging.folder_table(h).first().format == "DICOM+NIfTI+PNG"


def test_site_files_and_reading(spark, tmp_path):
    for node, files in {"n1": {"x_labeled.csv": "a\n1\n", "x_unlabeled.csv": "Age ;Blood Group;age\n50;A;1\n;NULL;2\n61;\"B;0\";3\n"}, "n2": {"readme.txt": "-", "only_labeled.csv": "a,b\n1.5,x\n"}, "n3": {"z.txt": "-"}}.items():
        (tmp_path / node).mkdir()
        for name, text in files.items():
            (tmp_path / node / name).write_text(text)
    files = datasets.file_listing(spark, str(tmp_path))
    chosen = {r.node_id: r for r in datasets.chosen_files(files).collect()}
    assert {n: r.file_name for n, r in chosen.items()} == {"n1": "x_unlabeled.csv", "n2": "only_labeled.csv"}
    assert datasets.sites_without_csv(files) == ["n3"]
    df = datasets.read_site(spark, chosen["n1"].path)
    assert df.dtypes == [("age", "int"), ("blood_group", "string"), ("age_1", "int")]
    assert [tuple(r) for r in df.orderBy("age_1").collect()] == [(50, "A", 1), (None, None, 2), (61, "B;0", 3)]
    assert datasets.read_or_none(spark, f"{tmp_path}/missing.csv") is None


def test_archive_round_trip(tmp_path):
    text = sinks.pack({"a/b.csv": b"x\n1\n", "s.json": b"{}"})
    assert sorted(sinks.unpack(text, str(tmp_path))) == ["a/b.csv", "s.json"] and (tmp_path / "a/b.csv").read_bytes() == b"x\n1\n"
    assert sinks.parsed_cell("{'a': 1}") == {"a": 1} and sinks.parsed_cell("[1, 2]") == [1, 2] and sinks.parsed_cell("{x") == "{x"
    assert sinks.plain({"a": float("nan"), "b": [np.int64(3), pd.Timestamp("2020-01-01")]}) == {"a": None, "b": [3, "2020-01-01T00:00:00"]}
    assert sinks.csv_records(f"{tmp_path}/none.csv") is None
    (tmp_path / "empty.csv").write_text("")
    assert sinks.csv_records(f"{tmp_path}/empty.csv") == []


def test_pipeline_end_to_end(spark, tmp_path):
    root, out = tmp_path / "data", tmp_path / "out"
    for i, drop in enumerate([(), ("ldl_cholesterol",), ("crp_level", "followup_date")]):
        node = root / f"node{i + 1}"
        node.mkdir(parents=True)
        generators.hospital(spark, 150, seed=i + 1, drop=drop).toPandas().to_csv(node / "h.csv", index=False)
    local, whole = pipeline.run(spark, str(root), str(out), pipeline.SiteAnalyzer(screen=True))
    assert set(local) == {"node1", "node2", "node3"} and whole["overview"].first().total_rows == 450
    cover = {r.column_name: r.coverage for r in whole["coverage"].collect()}
    assert cover["age"] == "common_all" and cover["ldl_cholesterol"] == "common_partial"
    kinds = {r.column_name: r.kind for r in local["node1"]["kinds"].collect()}
    assert kinds["admission_date"] == "temporal" and kinds["diabetes"] == "categorical" and kinds["bmi"] == "numeric"
    assert local["node1"]["screening"].where("var1 = 'bmi' and var2 = 'weight_kg' or var2 = 'bmi' and var1 = 'weight_kg'").first().significant
    assert "pca" in local["node1"] and "mca" in local["node1"] and "comparisons" in local["node1"]
    summary = json.loads((out / "local/node1/summary.json").read_text())
    assert summary["numeric"] and summary["comparisons_by_outcome"] and summary["significant_associations"]
    assert json.loads((out / "federated/summary.json").read_text())["numeric"]
    merged = {r.column_name: r for r in whole["numeric"].collect()}
    ages = pd.concat([pd.read_csv(root / f"node{i}" / "h.csv").age for i in (1, 2, 3)])
    assert abs(merged["age"].variance - ages.var()) < 1e-6 and abs(merged["age"].mean - ages.mean()) < 1e-9
    assert sinks.pack_directory(str(out))


def test_genomic_and_imaging_runs(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "A_S1_L001_R1_001.fastq").write_text("@r\nACGT\n+\nIIII\n")
    (tmp_path / "g" / "v.vcf").write_text(VCF)
    (tmp_path / "g" / "x.bam").write_bytes(b"BAM")
    got = pipeline.run_genomic(spark, f"{tmp_path}/g", f"{tmp_path}/go")
    assert got["samples"][0]["samples"] == ["A_S1", "v", "x"] and got["v.vcf.variant_types"] and got["A_S1_L001_R1_001.fastq.read_lengths"][0]["n_reads"] == 1
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(_png(20, 30))
    assert pipeline.run_imaging(spark, f"{tmp_path}/i", f"{tmp_path}/io")["resolution"][0]["min_height"] == 30


def test_regressions(spark):
    from sitewise.operators import regression as rg

    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["y"] = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 500)
    pdf["z"] = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0])))).astype(float)
    pdf.loc[0, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {r.term: r for r in rg.linear(df, ["a", "b"], "y").collect()}
    want = np.linalg.lstsq(np.c_[np.ones(499), x[1:]], pdf.y[1:], rcond=None)[0]
    assert np.allclose([got[t].coefficient for t in ("intercept", "a", "b")], want) and got["a"].p_value < 1e-9 and got["a"].n == 499
    lo = {r.term: r.coefficient for r in rg.logistic(df, ["a"], "z").collect()}
    assert 1.0 < lo["a"] < 2.1 and abs(lo["intercept"] - 0.5) < 0.4


def test_generators_are_stable(spark):
    for make in (generators.visits, generators.event_log, generators.panel, lambda s: generators.hospital(s, 50)):
        assert make(spark).exceptAll(make(spark)).count() == 0
    assert len(generators.hospital(spark, 10).columns) >= 34
    gone = generators.missing_blocks(generators.hospital(spark, 200), ["crp_level", "wbc_count"], 0.2, 9)
    assert gone.where("crp_level is null and wbc_count is not null").count() == 0 < gone.where("crp_level is null").count()


def test_series_of_generated_tables(spark):
    p = generators.panel(spark, 2, 60)
    s = se.seasonality(p.select("hospital_id", F.unix_date("month").alias("x"), F.col("admissions").cast("double").alias("value")), "hospital_id").collect()
    assert all(330 < r.dominant_period < 400 for r in s)
    assert se.spectrum(np.arange(5.0)) is None and se.spectrum(np.ones(20), np.array([0, 1, 50, 51, 400, *range(500, 515)], float)) is None
    v = se.longitudinal(generators.visits(spark), "patient_id", "visit_date", "weight_kg", ["visit_number"])
    assert v.count() == 100 and v.where("slope is null").count() == 0
    assert se.panel(p, "hospital_id", "month", "admissions").where("slope > 0").count() == 2
    flat = spark.createDataFrame([("c", float(i), 1.0) for i in range(5)], "k string, x double, y double")
    assert [(r.x, r.place) for r in se.peaks(flat, ["k"], "x", "y", 3).collect()] == [(0.0, 1)]


def test_reductions(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(120, 6)), columns=[f"num_{i}" for i in range(6)])
    pdf["num_1"] += pdf["num_0"] * 2
    pdf.loc[3, "num_2"] = np.nan
    pdf["gone"] = np.nan
    df = spark.createDataFrame(pdf)
    m = rd.pca(df, [*pdf.columns])
    assert abs(m.ratio.sum() - 1) < 1e-9 and (np.diff(m.values) <= 1e-9).all() and m.excluded == ["gone"]
    z = pdf.drop(columns="gone").fillna(pdf.mean())
    z = (z - z.mean()) / z.std(ddof=0)
    assert np.allclose(m.values, np.linalg.eigvalsh(np.cov(z.T))[::-1])
    c = rd.pca_coordinates(df, m, [], 2).toPandas()
    assert abs(c.pc1.var() - m.values[0]) < 1e-6
    cat = pd.DataFrame({"a": rng.choice(["x", "y"], 200), "b": rng.choice(["1", "2", "3"], 200), "c": rng.choice(["u", "v"], 200)})
    q = rd.mca(spark.createDataFrame(cat), ["a", "b", "c"])
    ind = pd.get_dummies(cat).to_numpy(float)
    pm = ind / ind.sum()
    r, k = pm.sum(1), pm.sum(0)
    sv = np.linalg.svd((pm - np.outer(r, k)) / np.sqrt(np.outer(r, k)), compute_uv=False) ** 2
    assert np.allclose(q.values, np.sort(sv)[::-1][: len(q.values)], atol=1e-9) and len(q.values) == 4
    rows = rd.mca_coordinates(spark.createDataFrame(cat), q, [], 1).toPandas()
    assert abs((rows.dim1**2).mean() - q.values[0]) < 1e-6
    with pytest.raises(ValueError):
        rd.pca(spark.createDataFrame(cat), ["a", "b"])
    with pytest.raises(ValueError):
        rd.mca(spark.createDataFrame(pd.DataFrame({"a": [str(i) for i in range(100)], "b": ["x"] * 100})), ["a", "b"])


def test_labels(spark):
    df = spark.createDataFrame([("yes", 1, 0), ("no", 0, 0), (None, None, 1)], "cough string, icu int, hospitalization int")
    p = [r.p for r in df.select(lb.probability(df.columns).alias("p")).collect()]
    assert np.allclose(p, [1 / (1 + np.exp(-(-1.2 + 2.6 + 0.8))), 1 / (1 + np.exp(1.2)), 1 / (1 + np.exp(0.6))])
    out = lb.add_label(df)
    assert set(r.pasc for r in out.collect()) <= {0, 1} and lb.add_label(out) is out


def test_incremental_profile_equals_the_batch(spark, small, tmp_path):
    events = table(spark, small, "events")
    src = tmp_path / "in"
    events.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    p = st.IncrementalProfile(str(tmp_path / "partials"), "event_type", ["value"])
    p.start(stream, str(tmp_path / "cp")).awaitTermination()
    got, want = p.current(spark).first(), events.agg(F.count("value"), F.avg("value"), F.var_samp("value")).first()
    assert got["count"] == want[0] and abs(got.mean - want[1]) < 1e-9 and abs(got.variance - want[2]) < 1e-6


def test_tables_above_the_bound_are_written(spark, tmp_path):
    big = spark.range(200_001).select("id", F.concat(F.lit(' "a, '), "id").alias("name"))
    got = pipeline._write_tables({"big": big, "few": big.limit(2)}, str(tmp_path / "o"))
    assert got["big"] == {"file": "big.csv"} and got["large_tables"] == ["big.csv"] and len(got["few"]) == 2
    read = pd.concat(pd.read_csv(p) for p in (tmp_path / "o/big.csv").glob("part-*.csv"))
    assert sorted(read.id) == list(range(200_001)) and read.name[read.id == 7].item() == ' "a, 7'
    assert pipeline._write_tables({"big": big.limit(3)}, str(tmp_path / "o"))["big"][2]["id"] == 2
