"""Encoding of whole tables of texts, batch by batch, and its round trip.

Texts are never collected or shuffled: each Arrow batch is encoded where it was read. The result of a
batch is one flat array of ids with offsets, so no Python object per id is kept. Null and empty texts
give the empty list; columns other than the key and the text are not touched; repeated keys and texts
are encoded as often as they occur; texts of any length are cut into chunks and emitted piecewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm import bpe_fst


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """key and ids (array<int>) of every row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        fst = bpe_fst.compiled(vocabulary or bpe_fst.default_vocabulary())  # the public file as the worker's machine has it
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for t in batch.column(1):
                flat.extend(fst.encode(t.as_py()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str | None = None) -> DataFrame:
    """The ``keep`` columns and n_tokens of every row."""
    schema = df.select(*keep).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = bpe_fst.compiled(vocabulary or bpe_fst.default_vocabulary())  # the public file as the worker's machine has it
        for batch in batches:
            counts = pa.array([len(fst.encode(t.as_py())) for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """key, n_tokens, and whether decoding the ids gives the text back (true for null and empty texts)."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = bpe_fst.compiled(vocabulary or bpe_fst.default_vocabulary())  # the public file as the worker's machine has it
        for batch in batches:
            n, same = [], []
            for t in batch.column(1):
                ids = fst.encode(t.as_py())
                n.append(len(ids))
                same.append(bpe_fst.decode(fst, ids) == (t.as_py() or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], names=[key, "n_tokens", "same"])

    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, same boolean")
