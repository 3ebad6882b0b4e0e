"""Orders of rows and gap layouts."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ungap


def move_rows(seqs: DataFrame, chosen: DataFrame, to: int) -> DataFrame:
    """Rows with the chosen ones (aln_id, row_ix) side by side at slot `to`, all renumbered from 0.

    The slot is counted in the old order: chosen rows come behind the others that stood before it.
    """
    picked = seqs.join(chosen.select("aln_id", "row_ix", F.lit(1).alias("_moved")).distinct(), ["aln_id", "row_ix"], "left")
    slot = F.row_number().over(W.partitionBy("aln_id").orderBy("row_ix")) - 1
    picked = picked.withColumn("_slot", slot)
    part = F.when(F.col("_moved") == 1, 1).when(F.col("_slot") < to, 0).otherwise(2)
    order = W.partitionBy("aln_id").orderBy(part, "row_ix")
    new = picked.withColumn("_new", F.row_number().over(order) - 1)
    return new.drop("_moved", "_slot", "row_ix").withColumnRenamed("_new", "row_ix").select(seqs.columns)


def in_order(seqs: DataFrame, order: DataFrame) -> DataFrame:
    """Rows renumbered by an order (aln_id, row_ix, position); rows that it lacks come last, as they were."""
    ranked = seqs.join(order.select("aln_id", "row_ix", "position"), ["aln_id", "row_ix"], "left")
    nth = F.row_number().over(W.partitionBy("aln_id").orderBy(F.col("position").asc_nulls_last(), "row_ix")) - 1
    return ranked.withColumn("_new", nth).drop("position", "row_ix").withColumnRenamed("_new", "row_ix").select(seqs.columns)


def apply_layout(seqs: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows with the gaps of a layout (aln_id, name, nth, aligned), and `applied`.

    The first row of a name takes the layout's row; names that the alignment lacks are skipped. Rows that
    are laid out share out their own places by nth, all others stay. A row whose residues differ
    from the layout's keeps its text and is not `applied`.
    """
    first = seqs.groupBy("aln_id", "name").agg(F.min("row_ix").alias("row_ix"))
    given = layout.groupBy("aln_id", "name").agg(F.min(F.struct("nth", "aligned")).alias("g")).select("aln_id", "name", "g.nth", F.col("g.aligned").alias("new"))
    met = first.join(given, ["aln_id", "name"]).drop("name")
    place = F.row_number().over(W.partitionBy("aln_id").orderBy("row_ix"))
    turn = F.row_number().over(W.partitionBy("aln_id").orderBy("nth"))
    slots = met.select("aln_id", F.col("row_ix").alias("slot"), place.alias("k"))
    moved = met.select("aln_id", "row_ix", "new", turn.alias("k")).join(slots, ["aln_id", "k"]).drop("k")
    df = seqs.join(moved, ["aln_id", "row_ix"], "left")
    same = ungap(F.col("aligned")) == ungap(F.col("new"))
    done = F.coalesce(same, F.lit(False))
    df = df.withColumn("applied", done).withColumn("aligned", F.when(done, F.col("new")).otherwise(F.col("aligned")))
    df = df.withColumn("row_ix", F.coalesce("slot", "row_ix"))
    return df.select(*seqs.columns, "applied")
