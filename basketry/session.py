"""Session settings and shared scratch storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_local_dir: dict[str, str] = {}

#: Rows that one task sorts or groups, about; what a task holds then does not grow with the input.
ROWS_A_TASK = 250_000
PARTITIONS = "spark.sql.shuffle.partitions"


def session(app: str = "basketry", **conf: str) -> SparkSession:
    """A session with what results depend on: UTC, ANSI and adaptive execution. The master comes from the environment."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as ``rows`` need, and as many as the session shuffles to at least."""
    return max(int(spark.conf.get(PARTITIONS)), -(-rows // ROWS_A_TASK))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by ``keys`` to as many tasks as ``rows`` need; joins and groups by them, and groups by more, then move nothing."""
    return df.repartition(tasks_for(df.sparkSession, rows), *keys)


def beside(df: DataFrame, rows: int) -> DataFrame:
    """For a join with a table of ``rows`` rows: many are merged where they lie, however small their files are; few may be sent to every task."""
    return df.hint("merge") if rows > ROWS_A_TASK else df


def written(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Write to the folder that ``spark.checkpoint.dir`` names and read back; a temporary folder only in local mode, where it is unset.

    Shuffles on the way go to as many tasks as ``rows`` need.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local_dir.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-scratch-")
        _local_dir[app] = base
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(tasks_for(spark, rows)))  # read when the write is planned
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(PARTITIONS, was)
    return spark.read.schema(df.schema).parquet(path)


def by_bucket(df: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 20_000) -> DataFrame:
    """``run`` for buckets of whole groups of ``key``, by hash, of about ``rows`` rows: many small groups a call."""
    n = max(df.count() // rows, 2 * int(df.sparkSession.conf.get(PARTITIONS)))
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("_bucket").applyInPandas(run, schema)


def in_buckets(df: DataFrame, key: str, solve: Callable[[pd.DataFrame], list[tuple]], schema: str, rows: int = 20_000) -> DataFrame:
    """``solve`` for every group of ``key``, many a call: it gets one group and gives rows of the schema."""
    names = StructType.fromDDL(schema).names

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(key, kind="stable", ignore_index=True)
        at = b[key].to_numpy()
        cuts = [0, *((at[1:] != at[:-1]).nonzero()[0] + 1).tolist(), len(b)]
        return pd.DataFrame([r for lo, hi in zip(cuts, cuts[1:], strict=False) for r in solve(b.iloc[lo:hi])], columns=names)

    return by_bucket(df, key, run, schema, rows)
