"""Lines of text files in their order, read by split: no file is one task's, and none is held whole."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines in order of block (where the file's split starts), then of at."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "\r$", "").alias("value"),
    )


def counted(lines: DataFrame, flag: Column, name: str) -> DataFrame:
    """Lines with `name`: how many lines of their file, up to and with their own, have the flag.

    Lines are counted within their split, and what the splits before hold is added, a row for each split.
    """
    df = lines.withColumn("_flag", F.coalesce(flag.cast("long"), F.lit(0)))
    per = df.groupBy("file", "block").agg(F.sum("_flag").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("file", "block", before.alias("_before"))
    within = F.sum("_flag").over(W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, within).join(per, ["file", "block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_flag", "_before")
