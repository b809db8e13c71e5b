"""Shared scratch storage and text normalisation used by every operator here."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of texts that a Python worker gets at once, and that a function of ``map_rows`` does.
BATCH, SLICE = 1024, 256

_local_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where the session names none and runs in local mode (tests) a temporary folder is made.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dir:
        _local_dir[app] = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"file://{_local_dir[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` is the fast way for texts that are pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_keys(text: str = "text") -> list[Column]:
    """Two hashes of a text that stand for it beside its ``doc_id``, which may be null or repeated."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(1), whole)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small_batches(spark: SparkSession) -> None:
    """Send Python workers at most ``BATCH`` rows at once: the default of 10,000 is gigabytes where texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def map_rows(df: DataFrame, key: str, columns: list[str], start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``key`` and, for each row, what a function of batches of ``columns`` gives; ``start`` makes it once a task.

    A null key travels as a flag, because pandas would turn a column of longs with nulls into doubles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = start()
        for whole in batches:
            for lo in range(0, len(whole), SLICE):  # what a function makes of long texts is held for few rows at once
                b = whole.iloc[lo : lo + SLICE]
                out = f(b)
                out["_key"], out["_null"] = b["_key"].to_numpy(), b["_null"].to_numpy()
                yield out

    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_key"), F.col(key).isNull().alias("_null"), *columns)
    out = rows.mapInPandas(run, f"{schema}, _key long, _null boolean")
    return out.select(F.when(~F.col("_null"), F.col("_key")).alias(key), *[c for c in out.columns if c not in ("_key", "_null")])
