"""Shared pieces of the training-data operators.

A *word* is a maximal run of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); ``bytes.split()`` cuts exactly there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: cells of one block of a count table that partitions exchange
BLOCK = 1 << 18
#: partial blocks that a task adds up at once
FAN = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, a new one where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="probelens-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before the interpreter
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that extra or clashing columns can't disturb it."""
    return df.select(*names)


def fold(col: str, mod: int):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def sparse_rows(key: int, counts: np.ndarray) -> pd.DataFrame:
    """The non-zero cells of a flat count array as rows (key, blk, salt, idx, val) of packed blocks."""
    salt = TaskContext.get().partitionId() if TaskContext.get() else 0
    rows = []
    for blk, start in enumerate(range(0, len(counts), BLOCK)):
        part = counts[start : start + BLOCK]
        at = np.flatnonzero(part)
        if len(at):
            rows.append((key, blk, salt, at.astype("<u4").tobytes(), part[at].astype("<i8").tobytes()))
    return pd.DataFrame(rows, columns=["key", "blk", "salt", "idx", "val"])


SPARSE = "key int, blk int, salt int, idx binary, val binary"


def merged(partials: DataFrame, most: int | None = None) -> DataFrame:
    """Add up packed partial blocks in a tree: a task adds those of FAN partitions, so what it holds does not grow.

    most: saturate there (a sketch that only asks for "repeated" needs no more than 2).
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for idx, val in zip(pdf["idx"], pdf["val"]):
            total[np.frombuffer(idx, "<u4")] += np.frombuffer(val, "<i8")
        if most:
            np.minimum(total, most, out=total)
        at = np.flatnonzero(total)
        return pd.DataFrame([(int(pdf["key"].iloc[0]), int(pdf["blk"].iloc[0]), int(pdf["salt"].iloc[0]) // FAN, at.astype("<u4").tobytes(), total[at].astype("<i8").tobytes())], columns=["key", "blk", "salt", "idx", "val"])

    left = partials.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        partials = partials.groupBy("key", "blk", F.expr(f"salt div {FAN}").cast("int").alias("s")).applyInPandas(add, SPARSE)
    return partials.groupBy("key", "blk").applyInPandas(add, SPARSE)


def gathered(partials: DataFrame, keys: int, cells: int, most: int | None = None, dtype: str = "int64") -> np.ndarray:
    """The merged table on the driver: keys x cells numbers, a size that the parameters fix, not the data."""
    out = np.zeros((keys, -(-cells // BLOCK) * BLOCK), dtype)
    for row in merged(partials, most).select("key", "blk", "idx", "val").toLocalIterator():
        out[row["key"], row["blk"] * BLOCK + np.frombuffer(row["idx"], "<u4").astype(np.int64)] = np.frombuffer(row["val"], "<i8")
    return out[:, :cells]
