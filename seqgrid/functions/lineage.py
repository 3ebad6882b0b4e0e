"""Cutting the lineage of iterative jobs."""

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the folder that spark.checkpoint.dir names, which driver and executors share.

    A checkpoint would hand on the estimated size of the plan it replaces; joins multiply those, so that the
    number's digits double with every round of an iterative job and the planner ends up busy with it. Files
    have their own size. A local master may leave the folder unset (tests): a temporary one is made then.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    typed = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes])
    typed.write.parquet(path)
    return df.sparkSession.read.schema(typed.schema).parquet(path)
