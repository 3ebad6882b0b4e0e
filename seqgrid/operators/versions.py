"""Versions of alignments: a table of versions, a dictionary of names, and rows by reference to it.

versions: (version_id, name, parent_id); rows: (version_id, row_ix, name, aligned).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def name_table(rows: DataFrame) -> DataFrame:
    """(name, ref): different names numbered in the order of their first version and row.

    Numbers run within a version's new names and start behind those of the versions before.
    """
    first = rows.groupBy("name").agg(F.min(F.struct("version_id", "row_ix")).alias("f"))
    part = first.withColumn("part", F.col("f.version_id"))
    size = part.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per version
    start = size.select("part", before.alias("before"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("f", "name")) - 1
    return part.withColumn("nth", nth).join(F.broadcast(start), "part").select("name", (F.col("before") + F.col("nth")).alias("ref"))


def save(versions: DataFrame, rows: DataFrame, path: str) -> None:
    """Writes versions, names and rows as Parquet, rows in a folder per version."""
    names = name_table(rows)
    versions.write.mode("overwrite").parquet(f"{path}/versions")
    names.write.mode("overwrite").parquet(f"{path}/names")
    names = rows.sparkSession.read.parquet(f"{path}/names")
    rows.join(names, "name").select("version_id", "row_ix", "ref", "aligned").write.mode("overwrite").partitionBy("version_id").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str, version_id: int | None = None) -> DataFrame:
    """Rows of all versions, or of one, which reads its folder alone. A reference without a name reads as "?"."""
    rows = spark.read.parquet(f"{path}/rows")
    if version_id is not None:
        rows = rows.where(F.col("version_id") == version_id)
    names = spark.read.parquet(f"{path}/names")
    return rows.join(names, "ref", "left").select("version_id", "row_ix", F.coalesce("name", F.lit("?")).alias("name"), "aligned")


def fork(versions: DataFrame, rows: DataFrame, parent_id: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Versions and rows with a copy of one version under the next free id."""
    new = versions.agg((F.max("version_id") + 1).alias("version_id"))  # one row
    made = new.select("version_id", F.lit(name).alias("name"), F.lit(parent_id).cast(versions.schema["parent_id"].dataType).alias("parent_id"))
    copy = rows.where(F.col("version_id") == parent_id).drop("version_id").crossJoin(F.broadcast(new)).select(rows.columns)
    return versions.unionByName(made), rows.unionByName(copy)


def rename(versions: DataFrame, version_id: int, name: str) -> DataFrame:
    return versions.withColumn("name", F.when(F.col("version_id") == version_id, name).otherwise(F.col("name")))


def remove(versions: DataFrame, version_id: int) -> DataFrame:
    """Versions without one, except that the last one stays. Its children keep their parent_id."""
    rest = versions.select("*", F.count("*").over(W.partitionBy()).alias("_n"))  # versions are few
    return rest.where((F.col("version_id") != version_id) | (F.col("_n") == 1)).drop("_n")


def merge(own: DataFrame, foreign: DataFrame) -> DataFrame:
    """(version_id, name, parent_id, old_id): own versions and foreign ones with fresh ids, in the order of theirs.

    Parents are followed within the foreign set and dropped outside of it. A name that is taken gets the
    first free number from 2 behind its stem, one version after the other: versions are few, so that rule
    runs on the driver over their names alone.
    """
    start = own.agg(F.coalesce(F.max("version_id"), F.lit(0)).alias("top"))  # one row
    nth = F.row_number().over(W.orderBy("version_id"))
    ids = foreign.crossJoin(F.broadcast(start)).select(F.col("version_id").alias("old_id"), "name", F.col("parent_id").alias("old_parent"), (F.col("top") + nth).alias("version_id"))
    parents = ids.select(F.col("old_id").alias("old_parent"), F.col("version_id").alias("parent_id"))
    ids = ids.join(F.broadcast(parents), "old_parent", "left")
    taken = {r["name"] for r in own.select("name").collect()}
    names = []
    for r in ids.select("version_id", "name").orderBy("version_id").collect():
        name, n = r["name"], 2
        if name in taken:
            words = name.rsplit(" ", 1)
            stem = words[0] if len(words) == 2 and words[1].isascii() and words[1].isdigit() else name
            while f"{stem} {n}" in taken:
                n += 1
            name = f"{stem} {n}"
        taken.add(name)
        names.append((r["version_id"], name))
    named = own.sparkSession.createDataFrame(names, f"version_id {dict(ids.dtypes)['version_id']}, name string")
    new = ids.drop("name").join(F.broadcast(named), "version_id").select("version_id", "name", "parent_id", "old_id")
    return own.select("version_id", "name", "parent_id", F.lit(None).cast(dict(new.dtypes)["old_id"]).alias("old_id")).unionByName(new)
