"""Helpers that the training-data operators share: shared-folder tables, checked broadcasts, text words."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir, as in local tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"

#: A side is broadcast only when it was counted and has at most so many slim rows.
BROADCAST_ROWS = 400_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a folder of this machine only where the master is local too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: cuts the lineage, and a lost executor costs no recomputation.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._tributary_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that saved() wrote, once no later plan reads it."""
    path = getattr(df, "_tributary_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it, else df for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def ascii_words(text: str | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` with A-Z in lower case, as UTF-8.

    bytes.lower and bytes.split know ASCII only, which is just what is asked for.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Nothing is remembered: hashing a word costs no more than finding it in a table."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles; of the whole sequence where it is shorter; none for no words."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < width:
            return mixed(np.array([np.sum(hashes * _STEPS[:n]) + np.uint64(n)], np.uint64))
        total = np.full(n - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            total += hashes[k : n - width + 1 + k] * _STEPS[k]
        return np.unique(mixed(total))
