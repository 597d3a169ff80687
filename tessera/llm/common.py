"""Shared helpers of the corpus operators: word columns and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: the six ASCII white-space characters; a word is a run of anything else
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: stop words of the languages served (fixed values)
STOP_WORDS = ("the of and to in a is that it for was on with as be by from this are at or an "
              "de la le les des et un une est que dans pour qui du en au sur "
              "der die und das den von zu mit für ist im nicht ein eine auf "
              "el los las y del por con una para es se no").split()


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words_of(col: Column) -> Column:
    """Words of a text as array<string>; null and blank texts give the empty array."""
    t = F.btrim(text_or_empty(col), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+"))


def held_out(id_col: Column, folds: int, fold_test) -> Column:
    """``fold_test`` applied to crc32(id as text) mod folds; a null id is never held out."""
    return F.coalesce(fold_test(F.crc32(id_col.cast("string").cast("binary")) % folds), F.lit(False))


#: parts of a group among which its first rows are sought before they meet in one task
SALTS = 64


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group in ``order``. Each of SALTS parts of a group keeps
    its own first ``n``, so the task that ranks a group reads at most SALTS * n rows of it,
    however many partitions and rows hold that group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order, F.lit("salt")), F.lit(SALTS)))
    for keys in ([group, "_salt"], [group]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")
    return salted.drop("_salt")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session's spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the
    lineage, so that a lost executor costs a reread and every reader sees the same rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLE: dict = {}


def worker_table(key, make):
    """This worker process's table for ``key``. A worker keeps one: tasks of one job share
    it, and it is freed as soon as a task asks for another."""
    if key not in _TABLE:
        _TABLE.clear()
        give_back()
        _TABLE[key] = make()
    return _TABLE[key]


def give_back() -> None:
    """Return what this worker process has freed to the system: it stays for other stages' tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
