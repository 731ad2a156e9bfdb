"""Words as the contracts define them: runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words in order; an empty array for null or blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """How many words; 0 for null or blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a local one only where that is unset and all runs on this machine."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        here = "file:///tmp/cartmill-checkpoints"
        os.makedirs(here.removeprefix("file://"), exist_ok=True)
    spark.sparkContext.setCheckpointDir(here)
    return here.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder. Results may be read from it later, so it stays, but within `scratch_of`."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(folder)
    return folder


@contextmanager
def scratch_of(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that `scratch` named within it: what rests on them must be written elsewhere by then."""
    token = _made.set([])
    try:
        yield
    finally:
        for folder in _made.get():
            delete(spark, folder)
        _made.reset(token)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this package wrote, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
