"""Intermediate tables of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from shelfspark.session import checkpoint_dir


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again: what several plans read is made once,
    and a lost executor does not make it anew."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
