"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder, any other an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        sc.setCheckpointDir(where)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, what: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, its lineage cut; lost executors don't cost a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text):
    """Lower-cased (A-Z only) words of a text column: maximal runs without ASCII white space; null gives none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")
