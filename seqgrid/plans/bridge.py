"""Driver tables as alignments: one alignment per source, a row per document, whole texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import normalise


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aln_id, row_ix, name, grp, aligned); rows may be ragged: what is missing at the end is gap."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("source").alias("aln_id"),
        F.col("doc_id").cast("int").alias("row_ix"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.col("lang").alias("grp"),
        normalise(F.coalesce("text", F.lit(""))).alias("aligned"),
    )


#: The same rows in SQL, as the start of every oracle statement.
SQL = r"""
with recursive seqs as (
  select source as aln_id, doc_id::int as row_ix, 'doc_' || doc_id as name, lang as grp,
    regexp_replace(regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'),
      '[.~ \n\t-]', '-', 'g'), '[^ACDEFGHIKLMNPQRSTVWYBZXUO*-]', 'X', 'g') as aligned
  from documents
),
cells as (
  select aln_id, row_ix, grp, i - 1 as col, aligned[i] as ch, instr('-ACDEFGHIKLMNPQRSTVWYBZXUO*', aligned[i])::int - 1 as code
  from (select *, unnest(range(1, length(aligned) + 1)) as i from seqs)
),
counts as (select aln_id, col, code, count(*) as n from cells where code > 0 group by all),
canon as (select *, sum(n) over (partition by aln_id, col) as t, n::double / sum(n) over (partition by aln_id, col) as p from counts where code between 1 and 20)
"""
