"""Session helpers: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of float and double columns becomes null; other columns stay as they are."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    q = lambda c: F.col(f"`{c}`")
    return df.select(*[F.when(~F.isnan(q(c)), q(c)).alias(c) if c in floats else q(c) for c in df.columns])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's ``spark.checkpoint.dir`` wins. Only where it is unset on a local master (tests, a laptop)
    a folder of this machine is made; on a cluster, where executors would not share it, that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sitewise-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder; later plans start from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows, else leave the choice to the planner.

    The count looks at no more than ``max_rows + 1`` rows. Meant for aggregated tables of narrow rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
