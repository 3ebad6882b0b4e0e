"""Helpers that the training-data operators share: table access, written tables, words."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for local masters that name none, by application.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    A local master may leave it unset (tests): a temporary folder is made for the application then. The
    setting itself is Spark's alone, and stays as it is.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _LOCAL_DIRS.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _LOCAL_DIRS[context.applicationId] = path
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/seqgrid-{label}-{uuid.uuid4().hex}"


#: Tables written within `temporary_tables`, innermost last.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def temporary_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is materialized within, but for the tables passed to the function it yields."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _SCOPES.append([])
    try:
        yield keep
    finally:
        made = _SCOPES.pop()
        for df in made:
            if not any(df is k for k in kept):
                drop_table(df)
        if _SCOPES:
            _SCOPES[-1] += kept


def release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Cuts the lineage, so lost executors cost a read rather than a recomputation; a read also
    prunes columns. The files stay until the application's shared folder is cleared or
    `drop_table` is called, since the returned frame is lazy.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with `_key`: the id, or a number from 2**62 on, by id and text, for null and ambiguous ids.

    An id is ambiguous if its rows differ in text. Rows with equal id and text share a key.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    by = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
    odd = materialize(by.where("a != b").select(F.col("doc_id").alias("_odd")), "ambiguous")
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    if odd.isEmpty():
        return docs.withColumn("_key", F.when(F.col("doc_id").isNull(), own).otherwise(F.col("doc_id")))
    out = docs.join(odd, F.col("doc_id") == F.col("_odd"), "left")
    return out.withColumn("_key", F.when(F.col("doc_id").isNull() | F.col("_odd").isNotNull(), own).otherwise(F.col("doc_id"))).drop("_odd")


def drop_table(df: DataFrame) -> None:
    """Deletes what `materialize` wrote for df; df must not be used afterwards."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_path)
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path.getFileSystem(conf).delete(path, True)


def extra_columns_apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage over documents whose further columns travel in one struct, so that their names clash with none."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        known = ("doc_id", "text", "lang", "source", "n_chars")
        extra = [c for c in docs.columns if c not in known]
        if not extra:
            return stage(docs, *args, **options)
        packed = F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra_columns")
        out = stage(docs.select(*[c for c in docs.columns if c in known], packed), *args, **options)
        return out.select(*[F.col(c) if c in known else F.col(f"extra_columns.`{c}`").alias(c) for c in docs.columns])

    return run


def word_array(text: Column) -> Column:
    """Words of the text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; text of ASCII alone takes the quicker built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def shifted(arr: Column, by: int) -> Column:
    """The array without its first `by` elements."""
    return F.slice(arr, by + 1, F.greatest(F.size(arr) - by, F.lit(0)))
