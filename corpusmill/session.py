"""Shared storage of a job: the folder all executors share, tables staged there, and joins that split hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else the checkpoint folder that was set
    on the context. Only a local session (tests) may fall back to a folder of its own; a cluster without either raises."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = os.path.join(tempfile.gettempdir(), f"corpusmill-{os.getuid()}")
    sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, columns can be pruned, and the sizes the
    planner sees are those of the files. (A checkpointed plan keeps the estimate of the plan it came from, which in a
    loop of joins grows to millions of digits.)"""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage; what is written survives the loss of executors."""
    return staged(df, "cut")


def drop(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again; anything else is left alone."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, how: str = "inner", parts: int = 512, few: int = 100_000) -> DataFrame:
    """Join ``big`` with ``small`` (one row a key), whatever share of big one key holds.

    ``weight`` is a column of small: how many rows of big have the key. A key with more than a ``parts``-th of all rows
    is hot, so there are fewer than ``parts`` of them: their rows of small are broadcast and their rows of big stay where
    they are. All others are joined by a shuffle, none of whose keys can exceed that share. ``few`` rows of one key are
    no burden to any task: where no key has more, the plan is a plain join. Null keys match nothing.
    """
    total, most = small.agg(F.sum(weight), F.max(weight)).first()
    least = max((total or 0) / parts, few)
    small_cols = [c for c in small.columns if c not in (key, weight)]
    if (most or 0) <= least:
        return big.join(small.select(key, *small_cols), key, how).select(*big.columns, *small_cols)
    hot = small.where(F.col(weight) > least).select(key, F.lit(True).alias("_hot"), *small_cols)
    rest = small.where((F.col(weight) <= least) | F.col(weight).isNull()).select(key, *small_cols)
    marked = big.join(F.broadcast(hot.withColumnsRenamed({c: f"_hot_{c}" for c in small_cols})), key, "left")
    cols = [*big.columns, *(f"_hot_{c}" for c in small_cols)]
    at_once = marked.where("_hot").select(*cols).toDF(*big.columns, *small_cols)
    return at_once.unionByName(marked.where("_hot is null").select(*big.columns).join(rest, key, how).select(*big.columns, *small_cols))
