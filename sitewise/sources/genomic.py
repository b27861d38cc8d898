"""Genomic files: FASTQ, VCF, FASTA and SAM as line tables, and statistics over them.

Every operator takes a table of lines (``value``, and where order matters ``line_no`` from 0 within
``file``), so that any reader can feed it; ``text_lines`` reads plain and gzip files. BAM and CRAM are
binary and need a library that is not here; their SAM form is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.sources.datasets import ends_with

# Formats by extension, and the extensions that count as samples.
FORMATS = [("FASTA", (".fasta", ".fa", ".fasta.gz")), ("FASTQ", (".fastq", ".fq", ".fastq.gz", ".fq.gz")), ("BAM", (".bam",)), ("SAM", (".sam",)), ("VCF", (".vcf", ".vcf.gz"))]
SAMPLE_EXTENSIONS = r"(?i)\.(fastq|fq|vcf)(\.gz)?$|(?i)\.bam$"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their number; one task per file, as for any gzip file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return whole


def format_of(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, suffixes in reversed(FORMATS):
        out = F.when(ends_with(F.lower(name), suffixes), label).otherwise(out)
    return out


def format_overview(files: DataFrame) -> DataFrame:
    return files.select(format_of(F.col("file_name")).alias("format")).where("format is not null").groupBy("format").agg(F.count("*").alias("n_files"))


def sample_name(name: Column) -> Column:
    """The file name without extension and without read, lane and part suffixes, from the end."""
    out = F.regexp_replace(name, SAMPLE_EXTENSIONS, "")
    for suffix in ("_001$", "_R[12]$", r"_L\d+$"):
        out = F.regexp_replace(out, suffix, "")
    return out


def samples(files: DataFrame) -> DataFrame:
    """n_samples and the sorted names."""
    names = files.where(F.col("file_name").rlike(SAMPLE_EXTENSIONS)).select(sample_name(F.col("file_name")).alias("s")).distinct()
    return names.agg(F.count("*").alias("n_samples"), F.array_sort(F.collect_list("s")).alias("samples"))


def size_statistics(files: DataFrame) -> DataFrame:
    """Sizes in MB; no row without files."""
    mb = F.col("length") / (1024.0**2)
    return files.agg(F.count("*").alias("n_files"), F.round(F.sum(mb), 3).alias("total_size"), F.round(F.avg(mb), 3).alias("average_size"), F.round(F.min(mb), 3).alias("min_size"), F.round(F.max(mb), 3).alias("max_size")).where("n_files > 0")


def read_lengths(lines: DataFrame) -> DataFrame:
    """FASTQ reads (four lines each): n_reads and lengths; no row for an empty file."""
    reads = lines.where("line_no % 4 = 1 and value <> ''").select(F.length("value").alias("l"))
    return reads.agg(F.count("*").alias("n_reads"), F.count("*").alias("total_reads"), F.min("l").alias("min_length"), F.max("l").alias("max_length"), F.avg("l").alias("average_length")).where("n_reads > 0")


def _records(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.where("value <> '' and not startswith(value, '#')").select(f.alias("f"), F.upper(f[3]).alias("ref"), F.upper(f[4]).alias("alt"), F.get(f, F.lit(7)).alias("info"))


def variant_types(lines: DataFrame) -> DataFrame:
    """SNP, insertion, deletion, SV, MNP or other, over all alternative alleles of a record.

    An insertion or deletion needs every alternative to be plain bases and one to differ in length from the reference; a deletion has one
    alternative, shorter than the reference.
    """
    alts = F.split("alt", ",")
    plain = F.forall(alts, lambda a: a.rlike("^[ACGTN]+$")) & F.col("ref").rlike("^[ACGTN]+$")
    symbolic = F.exists(alts, lambda a: a.startswith("<") | a.contains("[") | a.contains("]")) | F.coalesce(F.col("info").rlike("(^|;)SVTYPE="), F.lit(False))
    snp = (F.length("ref") == 1) & F.forall(alts, lambda a: a.isin("A", "C", "G", "T"))
    indel = plain & F.exists(alts, lambda a: F.length(a) != F.length("ref")) & ~symbolic
    deletion = (F.size(alts) == 1) & (F.length(alts[0]) < F.length("ref"))
    kind = F.when(snp, "SNP").when(indel & deletion, "deletion").when(indel, "insertion").when(symbolic, "SV").when(plain & (F.length("ref") > 1), "MNP").otherwise("other")
    return _records(lines).groupBy(kind.alias("variant_type")).agg(F.count("*").alias("n_variants"))


def variants_per_sample(lines: DataFrame) -> DataFrame:
    """Records whose genotype carries an alternative allele, per sample column; samples without any count 0."""
    header = lines.where("startswith(value, '#CHROM')").select(F.split("value", "\t").alias("h")).select(F.posexplode("h").alias("pos", "sample")).where("pos >= 9")
    calls = _records(lines).select(F.array_position(F.split(F.get("f", F.lit(8)), ":"), "GT").alias("at"), F.posexplode("f").alias("pos", "call")).where("pos >= 9 and at > 0")
    alleles = F.split(F.element_at(F.split("call", ":"), F.col("at").cast("int")), "[/|]")
    called = F.forall(alleles, lambda a: a != ".")
    carried = calls.where(called & F.exists(alleles, lambda a: a.rlike("^[1-9]"))).groupBy("pos").agg(F.count("*").alias("n"))
    return header.join(F.broadcast(carried), "pos", "left").select("sample", F.coalesce("n", F.lit(0)).alias("n_variants"))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records (id, length), read with '>' as the record separator; text before the first one is no record."""
    recs = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    return sequence_lengths(recs.select(F.concat(F.lit(">"), "value").alias("record")))


def sequence_lengths(records: DataFrame) -> DataFrame:
    """id and length of records that begin with '>'."""
    parts = F.split("record", "\r?\n", 2)
    body = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")
    return records.where("startswith(record, '>')").select(F.regexp_extract(parts[0], r"^>\s*(\S*)", 1).alias("id"), F.length(body).alias("length"))


def sequence_statistics(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.count("*").alias("n_sequences"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.avg("length").alias("average_length")).where("n_sequences > 0")


def coverage(lines: DataFrame) -> DataFrame:
    """Depth over the covered positions of a SAM: mapped, primary, not duplicate, passing reads; aligned and deleted bases.

    Every read becomes +1 and -1 at the ends of its aligned blocks; depths are running sums per reference,
    weighted by the length of the stretch, so that no row per base is made.
    """
    f = F.split("value", "\t")
    reads = lines.where("value <> '' and not startswith(value, '@')").select(f[1].cast("int").alias("flag"), f[2].alias("ref"), f[3].cast("long").alias("pos"), f[5].alias("cigar"))
    used = reads.where((F.col("flag").bitwiseAND(4 + 256 + 512 + 1024) == 0) & (F.col("cigar") != "*"))
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    start = F.struct(F.col("pos").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("blocks"))

    def step(acc: Column, op: Column) -> Column:
        n, kind = F.regexp_extract(op, r"^(\d+)", 1).cast("long"), F.substring(op, -1, 1)
        moves = kind.isin("M", "=", "X", "D", "N")
        covers = kind.isin("M", "=", "X", "D")
        block = F.array(F.struct(acc["at"].alias("a"), (acc["at"] + n).alias("b")))
        return F.struct(F.when(moves, acc["at"] + n).otherwise(acc["at"]).alias("at"), F.when(covers, F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"))

    blocks = used.select("ref", F.explode(F.aggregate(ops, start, step)["blocks"]).alias("x"))
    ends = blocks.select("ref", F.explode(F.array(F.struct(F.col("x.a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("x.b").alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy("ref", "e.at").agg(F.sum("e.d").alias("d"))
    from pyspark.sql import Window

    w = Window.partitionBy("ref").orderBy("at")
    runs = ends.select("ref", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), (F.lead("at").over(w) - F.col("at")).alias("bases")).where("depth > 0 and bases > 0")
    depth = runs.groupBy("depth").agg(F.sum("bases").alias("bases"))
    every = Window.partitionBy(F.lit(1))  # one row per distinct depth
    d = depth.withColumn("upto", F.sum("bases").over(every.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("bases").over(every))
    lo, hi = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    return d.agg(F.round(F.sum(F.col("depth") * F.col("bases")) / F.sum("bases"), 3).alias("mean_depth"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), ((F.min(F.when(F.col("upto") > lo, F.col("depth"))) + F.min(F.when(F.col("upto") > hi, F.col("depth")))) / 2).alias("median_depth")).where("min_depth is not null")


def analyze(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """Everything there is to say about a file of a kind (fastq, vcf, fasta, alignment)."""
    if kind == "fastq":
        return {"read_lengths": read_lengths(text_lines(spark, path))}
    if kind == "vcf":
        lines = text_lines(spark, path)
        return {"variants_per_sample": variants_per_sample(lines), "variant_types": variant_types(lines)}
    if kind == "fasta":
        s = sequences(spark, path)
        return {"sequences": s, "statistics": sequence_statistics(s)}
    if kind == "alignment":
        if not path.lower().endswith(".sam"):
            raise ValueError("binary alignments are not read; convert them to SAM")
        return {"coverage": coverage(text_lines(spark, path))}
    raise ValueError(f"unknown genomic file type: {kind}")
