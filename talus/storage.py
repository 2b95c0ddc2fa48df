"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from talus.session import shared_folder


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The rows are computed once, and plans on top go by the size of the files.  A checkpoint keeps the estimate of
    the plan that it cuts instead; joins multiply estimates, so loops that join a table with itself end in
    numbers of millions of digits.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
