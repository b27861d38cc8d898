"""Parquet files seen chunk by chunk: footers, dictionary pages, and scans of single row groups.

A *chunk* is one column of one row group. Its footer gives the number of nulls and, where the writer
stored them, the extrema; its dictionary page lists the values that occur, if every data page refers
to the dictionary. Both are read on the executors; the driver only lists file names.
"""

from __future__ import annotations

import datetime as dt
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_SCHEMA = (
    "file string, row_group int, n_rows long, key_min long, key_max long, column_name string, n_null long, "
    "num_min double, num_max double, text_min string, text_max string, dictionary_size long, has_nan boolean, "
    "num_values array<double>, text_values array<string>"
)
COUNT_SCHEMA = "key long, column_name string, num double, text string, cnt long"
EXACT_SCHEMA = "key long, column_name string, num double, whole long, text string, cnt long"
EXACT = 1 << 53  # whole numbers up to here are the same as doubles; larger ones go by ``whole``


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        out |= (x & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if x < 0x80:
            return out, i


def _compact(b: bytes, i: int) -> tuple[dict, int]:
    """A Thrift struct in compact protocol as {field id: value}; values of no interest are skipped over."""
    out, field = {}, 0
    while True:
        head, i = b[i], i + 1
        if head == 0:
            return out, i
        kind = head & 0x0F
        if head >> 4:
            field += head >> 4
        else:
            z, i = _varint(b, i)
            field = (z >> 1) ^ -(z & 1)
        out[field], i = _compact_value(b, i, kind)


def _compact_value(b: bytes, i: int, kind: int):
    if kind in (1, 2):
        return kind == 1, i
    if kind == 3:
        return b[i], i + 1
    if kind in (4, 5, 6):
        z, i = _varint(b, i)
        return (z >> 1) ^ -(z & 1), i
    if kind == 7:
        return struct.unpack_from("<d", b, i)[0], i + 8
    if kind == 8:
        n, i = _varint(b, i)
        return b[i : i + n], i + n
    if kind in (9, 10):
        n, inner, i = b[i] >> 4, b[i] & 0x0F, i + 1
        if n == 15:
            n, i = _varint(b, i)
        items = []
        for _ in range(n):
            x, i = (b[i] == 1, i + 1) if inner in (1, 2) else _compact_value(b, i, inner)
            items.append(x)
        return items, i
    if kind == 12:
        return _compact(b, i)
    raise ValueError(f"compact type {kind}")


def _page_header(f, at: int, end: int) -> tuple[dict, int]:
    """The page header at an offset and its length; reads more until the header is whole."""
    size = 512
    while True:
        f.seek(at)
        b = f.read(min(size, end - at))
        try:
            return _compact(b, 0)
        except (IndexError, struct.error):
            if size >= end - at:
                raise ValueError("damaged page header") from None
            size *= 8


def _plain_values(data: bytes, kind: str, n: int) -> list:
    if kind == "BYTE_ARRAY":
        out, i = [], 0
        for _ in range(n):
            (k,) = struct.unpack_from("<I", data, i)
            out.append(data[i + 4 : i + 4 + k])
            i += 4 + k
        return out
    code = {"INT32": "i", "INT64": "q", "DOUBLE": "d", "FLOAT": "f"}[kind]
    return list(struct.unpack_from(f"<{n}{code}", data, 0))


def dictionary_of(f, chunk) -> list | None:
    """The values of a chunk's dictionary page, if all its data pages use the dictionary; else None."""
    if not chunk.has_dictionary_page or chunk.physical_type not in ("INT32", "INT64", "DOUBLE", "FLOAT", "BYTE_ARRAY"):
        return None
    at = min(x for x in (chunk.dictionary_page_offset, chunk.data_page_offset) if x)
    end, values = at + chunk.total_compressed_size, None
    try:
        while at < end:
            head, n = _page_header(f, at, end)
            if head[1] == 2:
                f.seek(at + n)
                data = f.read(head[3])
                if chunk.compression != "UNCOMPRESSED":
                    data = pa.decompress(data, decompressed_size=head[2], codec=chunk.compression.lower(), asbytes=True)
                values = _plain_values(data, chunk.physical_type, head[7][1])
            elif (head[1] == 0 and head[5][2] not in (2, 8)) or (head[1] == 3 and head[8][4] not in (2, 8)):
                return None
            at += n + head[3]
    except (KeyError, ValueError, IndexError, struct.error, pa.ArrowException):
        return None  # a page kind this reader does not know: the chunk is scanned instead
    return values


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _extrema(chunk, text: bool) -> tuple:
    """Exact extrema by the footer, else (None, None). Long texts may be cut there, so they do not count."""
    s = chunk.statistics
    if s is None or not s.has_min_max:
        return None, None
    lo, hi = s.min, s.max
    if text:
        return (lo, hi) if isinstance(lo, str) and len(lo) < 60 and len(hi) < 60 else (None, None)
    if type(lo) is dt.date:
        lo, hi = ((x - dt.date(1970, 1, 1)).days for x in (lo, hi))
    if isinstance(lo, bool) or not isinstance(lo, (int, float)) or (isinstance(lo, float) and (math.isnan(lo) or math.isnan(hi))):
        return None, None
    if isinstance(lo, int) and max(abs(lo), abs(hi)) > EXACT:
        return None, None
    return float(lo), float(hi)


def footers(key: str, columns: list[str], dictionaries: str = "all"):
    """For mapInPandas: rows of CHUNK_SCHEMA of the files in column ``file``.

    dictionaries: 'all', or 'single' for those of row groups with one key only.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow.parquet as pq

        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            for uri in batch["file"]:
                rows = []
                with _open(uri) as f:
                    meta = pq.read_metadata(f)
                    kinds = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        at = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
                        k = at[key].statistics if key in at else None
                        whole = k is not None and k.has_min_max and k.null_count == 0
                        for c in columns:
                            if c not in at:
                                continue
                            chunk = at[c]
                            text = str(meta.schema.column(kinds[c]).logical_type.type) == "STRING"
                            lo, hi = _extrema(chunk, text)
                            values = dictionary_of(f, chunk) if dictionaries == "all" or (whole and k.min == k.max) else None
                            if values is not None and any(isinstance(v, int) and abs(v) > EXACT for v in values):
                                values = None
                            nan = None if values is None else any(isinstance(v, float) and v != v for v in values)
                            if chunk.physical_type not in ("DOUBLE", "FLOAT"):
                                nan = False
                            nums = None if values is None or text else sorted(float(v) for v in values if v == v)
                            texts = sorted(v.decode("utf-8", "replace") for v in values) if text and values is not None else None
                            n_null = chunk.statistics.null_count if chunk.statistics is not None and chunk.statistics.has_null_count else None
                            rows.append((uri, g, group.num_rows, k.min if whole else None, k.max if whole else None, c, n_null, None if text else lo, None if text else hi, lo if text else None, hi if text else None, None if values is None else len(values), nan, nums, texts))
                out = pd.DataFrame(rows, columns=names)
                for c in ("key_min", "key_max", "n_null", "dictionary_size"):
                    out[c] = out[c].astype("Int64")
                yield out

    return run


def chunk_table(spark: SparkSession, df: DataFrame, key: str, columns: list[str], dictionaries: str = "all") -> DataFrame:
    """Every chunk of the files behind ``df`` for the given columns."""
    files = df.inputFiles()
    if not files:
        return spark.createDataFrame([], CHUNK_SCHEMA)
    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.repartition(min(len(files), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(footers(key, columns, dictionaries), CHUNK_SCHEMA)


def _exact_lanes(v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Numbers as doubles where a double holds them, else as whole numbers; dates as days since 1970-01-01."""
    import pyarrow.compute as pc

    if pa.types.is_date32(v.type):
        v = v.cast(pa.int32())
    elif pa.types.is_temporal(v.type):
        v = v.cast(pa.int64())
    if v.type != pa.int64():
        return v.cast(pa.float64()), pa.nulls(len(v), pa.int64())
    fits = pc.and_(pc.less_equal(v, EXACT), pc.greater_equal(v, -EXACT))
    none = pa.scalar(None, pa.int64())
    return pc.if_else(fits, v, none).cast(pa.float64()), pc.if_else(fits, none, v)


def _count_group(f, group: int, key: str | None, columns: list[str], exact: bool = False) -> Iterator[pa.RecordBatch]:
    """Value counts by key of one row group, read in slices so that memory stays bounded."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    whole = [("whole", pa.int64())] if exact else []
    out = pa.schema([("key", pa.int64()), ("column_name", pa.string()), ("num", pa.float64()), *whole, ("text", pa.string()), ("cnt", pa.int64())])
    for b in pq.ParquetFile(f).iter_batches(batch_size=131_072, row_groups=[group], columns=[*([key] if key else []), *columns]):
        keys = b.column(b.schema.get_field_index(key)).cast(pa.int64()) if key else pa.nulls(b.num_rows, pa.int64())
        for c in columns:
            v, big = b.column(b.schema.get_field_index(c)), pa.nulls(b.num_rows, pa.int64())
            text = pa.types.is_string(v.type) or pa.types.is_large_string(v.type)
            if pa.types.is_dictionary(v.type):
                v, text = v.cast(pa.string()), True
            if not text:
                v, big = _exact_lanes(v) if exact else (v.cast(pa.float64()), big)
                v = pc.if_else(pc.is_nan(v), pa.scalar(None, pa.float64()), v)
            by = {"key": keys, "v": v} | ({"whole": big} if exact else {})
            t = pa.table(by).group_by(list(by), use_threads=False).aggregate([([], "count_all")])
            n = t.num_rows
            nums, texts = (pa.nulls(n, pa.float64()), t["v"].cast(pa.string())) if text else (t["v"], pa.nulls(n, pa.string()))
            yield from pa.table([t["key"], pa.array([c] * n, pa.string()), nums, *([t["whole"]] if exact else []), texts, t["count_all"]], schema=out).to_batches()


def scan_counts(key: str | None, exact: bool = False):
    """For mapInArrow over (file, row_group, columns array<string>): rows of COUNT_SCHEMA, or of EXACT_SCHEMA if ``exact``; without a key, of the whole row group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                with _open(unit["file"]) as f:
                    yield from _count_group(f, unit["row_group"], key, unit["columns"], exact)

    return run
