"""Session helpers: tables by name, the shared checkpoint folder, and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder (one file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix=f"labloom-{os.getpid()}-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: a lost executor costs nothing, lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most units of the reference list.
MAX_UNITS = 10_000


def listed_units(unit_dim: DataFrame, *columns: str) -> list:
    """The distinct values of columns of unit_dim, in rows whose code and factor (where asked for) aren't null; a list beyond its bound raises."""
    rows = unit_dim.where(" and ".join(f"{c} is not null" for c in columns if c != "kind")).select(*columns).distinct().limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"unit_dim is a list of at most {MAX_UNITS} units")
    return rows
