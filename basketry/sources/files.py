"""Delimited text files: order items (``;``), metrics and price bars (``,``)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from basketry.session import checkpoint_dir


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";") -> DataFrame:
    """Read text with a header line under an explicit schema. Names come from
    the schema by position; those in the file are overridden. A value that
    does not fit its type fails the read."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=True, mode="FAILFAST")


def write_delimited(df: DataFrame, name: str, sep: str = ";") -> str:
    """Write text with a header line under the shared folder; returns its path."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.csv(path, sep=sep, header=True)
    return path
