"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.sources.scratch import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NULL_ID = 2**63 - 1


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to pure ASCII, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def tasks(df: DataFrame) -> int:
    """Tasks for small keyed exchanges: what the session sets for shuffles."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
