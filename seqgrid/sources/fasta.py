"""FASTA folders in and out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.sources.lines import counted, split_lines


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq_no, name, residues): a record per header; text before the first header is dropped.

    Files are read by split, headers counted in each, so that a large file is many tasks'; a record may span splits.
    """
    header = F.col("value").rlike("^[>;]")
    rows = counted(split_lines(spark, path), header, "seq_no").where("seq_no > 0")
    body = F.when(~header, F.struct("block", "at", F.regexp_replace("value", "[ \t]", "").alias("s")))
    parts = F.sort_array(F.collect_list(body))
    return rows.groupBy("file", "seq_no").agg(
        F.max(F.when(header, F.trim(F.substring("value", 2, 1 << 30)))).alias("name"),
        F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("residues"),
    )


def wrap(aligned, width: int = 60):
    return F.regexp_replace(aligned, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_records(seqs: DataFrame, width: int = 60) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrap(F.col("aligned"), width)).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    fasta_records(seqs, width).write.text(path)
