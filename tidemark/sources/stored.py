"""Intermediate tables written once and read many times.

A daily return table or a model table is read by several branches of a risk plan. Written to the shared folder
named in ``spark.checkpoint.dir`` it costs one pass over the raw rows instead of one per branch, survives lost
executors, and has a known size, from which the planner decides whether it may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local session that names none."""
    named = spark.conf.get(_DIR, None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_DIR} to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set(_DIR, made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
