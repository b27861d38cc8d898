"""Imaging files by their headers: PNG, JPEG, NIfTI-1 and DICOM, read batch by batch on the executors."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc
from sitewise.sources.datasets import ends_with

DICOM, NIFTI, RASTER = (".dcm",), (".nii", ".nii.gz"), (".png", ".jpg", ".jpeg")
HEADER_SCHEMA = "path string, folder string, file_name string, length long, format string, width int, height int, depth int, modality string, body_part string, error string"
LONG_VR = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UR", b"UT", b"UN"}


def png_size(b: bytes) -> tuple[int, int]:
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    return struct.unpack(">II", b[16:24])


def jpeg_size(b: bytes) -> tuple[int, int]:
    if b[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    i = 2
    while i + 9 < len(b):
        if b[i] != 0xFF:
            i += 1
            continue
        marker = b[i + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[i + 5 : i + 9])
            return w, h
        i += 2 if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD9 else 2 + struct.unpack(">H", b[i + 2 : i + 4])[0]
    raise ValueError("no JPEG frame")


def nifti_shape(b: bytes) -> list[int]:
    if b[:2] == b"\x1f\x8b":
        b = gzip.decompress(b)
    order = "<" if struct.unpack("<i", b[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", b[40:56])
    if not 1 <= dim[0] <= 7:
        raise ValueError("no NIfTI-1")
    return list(dim[1 : dim[0] + 1])


def dicom_tags(b: bytes) -> dict[tuple[int, int], bytes]:
    """Data elements before the pixel data, sequences skipped; explicit and implicit little endian."""
    i = 132 if b[128:132] == b"DICM" else 0
    out: dict[tuple[int, int], bytes] = {}
    explicit = i > 0
    while i + 8 <= len(b):
        group, elem = struct.unpack("<HH", b[i : i + 4])
        if (group, elem) == (0x7FE0, 0x0010):
            break
        meta = group == 2
        if explicit or meta:
            vr = b[i + 4 : i + 6]
            if vr in LONG_VR:
                n, j = struct.unpack("<I", b[i + 8 : i + 12])[0], i + 12
            else:
                n, j = struct.unpack("<H", b[i + 6 : i + 8])[0], i + 8
        else:
            n, j = struct.unpack("<I", b[i + 4 : i + 8])[0], i + 8
        if n == 0xFFFFFFFF:
            end = b.find(b"\xfe\xff\xdd\xe0", j)
            i = len(b) if end < 0 else end + 8
            continue
        out[(group, elem)] = b[j : j + n]
        i = j + n
        if meta and (group, elem) == (2, 0x10):
            explicit = out[(2, 0x10)].strip(b"\x00 ") != b"1.2.840.10008.1.2"
    return out


def _number(v: bytes | None) -> int | None:
    if not v:
        return None
    return struct.unpack("<H", v[:2])[0] if len(v) == 2 and not v.strip(b" \x00").isdigit() else int(v.strip(b" \x00") or 0)


def _short(v: bytes | None) -> int | None:
    return struct.unpack("<H", v[:2])[0] if v and len(v) >= 2 else None


def _text(v: bytes | None) -> str | None:
    return v.strip(b" \x00").decode("latin-1") if v else None


def header_of(name: str, content: bytes) -> dict:
    low = name.lower()
    if low.endswith(DICOM):
        t = dicom_tags(content)
        frames = _text(t.get((0x28, 8)))
        return {"format": "DICOM", "width": _short(t.get((0x28, 0x11))), "height": _short(t.get((0x28, 0x10))), "depth": int(frames) if frames else None, "modality": _text(t.get((8, 0x60))), "body_part": _text(t.get((0x18, 0x15)))}
    if low.endswith(NIFTI):
        s = nifti_shape(content) + [None, None, None]
        return {"format": "NIfTI", "width": s[0], "height": s[1], "depth": s[2]}
    w, h = png_size(content) if low.endswith(".png") else jpeg_size(content)
    return {"format": low.rsplit(".", 1)[1].upper(), "width": w, "height": h}


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per image file below a directory; files that cannot be read carry the error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(ends_with(F.lower("path"), DICOM + NIFTI + RASTER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in HEADER_SCHEMA.split(", ")])
        for b in batches:
            rows = []
            for path, length, content in zip(*[b.column(i) for i in range(3)]):
                parts = path.as_py().split("/")
                row = dict.fromkeys(schema.names) | {"path": path.as_py(), "folder": parts[-2], "file_name": parts[-1], "length": length.as_py()}
                try:
                    row |= header_of(parts[-1], content.as_py())
                except (ValueError, struct.error, IndexError, OSError) as e:
                    row["error"] = str(e)[:200]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "length", "content").mapInArrow(run, HEADER_SCHEMA)


def size_statistics(h: DataFrame) -> DataFrame:
    mb = F.col("length") / (1024.0**2)
    return h.agg(F.count("*").alias("n_files"), F.round(F.sum(mb), 3).alias("total_size"), F.round(F.avg(mb), 3).alias("average_size"), F.round(F.min(mb), 3).alias("min_size"), F.round(F.max(mb), 3).alias("max_size")).where("n_files > 0")


def resolution(h: DataFrame) -> DataFrame:
    """Width and height over all images; depth over volumes of more than one layer (null without any)."""
    deep = F.when(F.col("depth") > 1, F.col("depth"))
    s = h.agg(F.count("width").alias("n_images"), *[x for c in ("width", "height") for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.avg(c), 3).alias(f"average_{c}"))], F.min(deep).alias("min_depth"), F.max(deep).alias("max_depth"), F.round(F.avg(deep), 3).alias("average_depth"))
    return s.where("min_width is not null and min_height is not null")


def modalities(h: DataFrame) -> DataFrame:
    return h.where("format = 'DICOM'").groupBy(sc.or_unknown(F.col("modality")).alias("modality")).agg(F.count("*").alias("n_files"))


REGION_NOTE = "Body parts are entered irregularly; read this distribution as a rough guide."


def regions(h: DataFrame) -> DataFrame:
    """Counts by body part, whether there is only one, and a note on their reliability."""
    counts = h.where("format = 'DICOM'").groupBy(sc.or_unknown(F.col("body_part")).alias("region")).agg(F.count("*").alias("n_files"))
    n = counts.count()
    return counts.withColumn("is_degenerate", F.lit(n == 1)).withColumn("note", F.lit(REGION_NOTE))


def folder_table(h: DataFrame) -> DataFrame:
    """One display row per folder: formats, number of files, and intervals of size and resolution."""
    def interval(c: str) -> object:
        lo, hi = F.min(c).cast("string"), F.max(c).cast("string")
        return F.when(F.min(c) == F.max(c), lo).otherwise(F.concat(lo, F.lit("–"), hi))

    x = h.withColumn("size_mb", F.round(F.col("length") / (1024.0**2), 3))
    return x.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_set("format")), "+").alias("format"), F.count("*").alias("n_files"), interval("size_mb").alias("size_mb"), interval("width").alias("width"), interval("height").alias("height"))
