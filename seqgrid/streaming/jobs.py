"""Streaming forms of the batch jobs."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET
from seqgrid.functions.joins import same_keys
from seqgrid.operators.cells import to_cells
from seqgrid.operators.motif import find_motifs
from seqgrid.operators.conservation import scored
from seqgrid.operators.profile import column_counts, count_vectors
from seqgrid.operators.variants import placed, score_variants


def stream_motifs(arriving: DataFrame, regex: str) -> DataFrame:
    """Stateless: append mode."""
    return find_motifs(arriving, regex)


def stream_profile(arriving: DataFrame) -> DataFrame:
    """Counts add up over batches: update or complete mode."""
    return column_counts(to_cells(arriving))


def stream_variants(arriving: DataFrame, seqs: DataFrame, stats: DataFrame, track: DataFrame, scores: DataFrame) -> DataFrame:
    """Arriving variants scored against a fixed alignment and its profile: stream-static joins, append mode."""
    return score_variants(placed(arriving, seqs), stats, track, scores)


#: Batches whose counts are read one by one before they are added up.
COMPACT_EVERY = 20
_STATE = "aln_id string, col int, n array<bigint>, rows bigint"


def _ids(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the complete parts of one kind in the folder of a profile."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{kind}=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """What adds up to the profile: the last sum, and the batches behind it."""
    sums = _ids(spark, folder, "upto")
    last = sums[-1] if sums else -1
    return ([f"{folder}/upto={last}"] if sums else []) + [f"{folder}/batch={k}" for k in _ids(spark, folder, "batch") if k > last]


def profile_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(aln_id, col, n, rows) of all rows that have arrived: count vectors, as a batch would count them."""
    parts = _parts(spark, folder)
    if not parts:
        return spark.createDataFrame([], _STATE)
    found = spark.read.schema(_STATE).parquet(*parts)
    total = F.array(*[F.sum(F.col("n")[k]) for k in range(len(ALPHABET))])
    rows = found.where("col = -1").groupBy("aln_id").agg(F.sum("rows").alias("rows"))
    return same_keys(found.where("col >= 0").groupBy("aln_id", "col").agg(total.alias("n")), rows, ["aln_id"])


def _state(vectors: DataFrame) -> DataFrame:
    """Count vectors with the number of rows in a row of its own, so that parts add up."""
    none = F.array_repeat(F.lit(0).cast("long"), len(ALPHABET))
    rows = vectors.groupBy("aln_id").agg(F.max("rows").alias("rows")).select("aln_id", F.lit(-1).alias("col"), none.alias("n"), "rows")
    return vectors.select("aln_id", "col", "n", F.lit(None).cast("long").alias("rows")).unionByName(rows)


def merge_batch(folder: str, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds a batch's counts to the profile in a shared folder.

    A batch is a part under its own number, written over if the batch is replayed, so it counts once. Now
    and then the parts are added up into one; a part that isn't complete is no part.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _ids(spark, folder, "upto")
        if done and number <= done[-1]:
            return  # replayed after its sum was made
        _state(count_vectors(batch.select("aln_id", "aligned"))).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if len(_parts(spark, folder)) > compact_every:
            _state(profile_so_far(spark, folder)).write.mode("overwrite").parquet(f"{folder}/upto={number}")

    return merge


def scores_so_far(spark: SparkSession, folder: str, methods: list[str], scores: DataFrame | None = None) -> DataFrame:
    """Column scores of all rows that have arrived."""
    return scored(profile_so_far(spark, folder), methods, scores)
