"""Logs of gap edits, applied to packed rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgrid.functions.joins import same_keys
from seqgrid.operators.cells import delete_gaps, insert_gaps, shift_right


def apply_log(seqs: DataFrame, log: DataFrame) -> DataFrame:
    """Rows after their edits (aln_id, row_ix, seq_no, op, col, count), in the order of seq_no.

    Rows without edits stay as they are; a negative shift removes leading gaps only. A row's edits
    meet in one array, as each builds on the one before.
    """
    steps = log.groupBy("aln_id", "row_ix").agg(F.sort_array(F.collect_list(F.struct("seq_no", "op", "col", "count"))).alias("steps"))
    shifted = lambda a, k: F.when(k >= 0, shift_right(a, k)).otherwise(delete_gaps(a, F.lit(0), -k))
    one = lambda a, e: F.when(e["op"] == "insert", insert_gaps(a, e["col"], e["count"])).when(e["op"] == "delete", delete_gaps(a, e["col"], e["count"])).otherwise(shifted(a, e["count"]))
    done = F.when(F.col("steps").isNull(), F.col("aligned")).otherwise(F.aggregate("steps", F.col("aligned"), one))
    return seqs.join(steps, ["aln_id", "row_ix"], "left").withColumn("aligned", done).drop("steps")


def edit_block(seqs: DataFrame, chosen: DataFrame, op: str, col: int, count: int = 1) -> DataFrame:
    """Rows with `count` gaps inserted or deleted at a column of the chosen rows (aln_id, row_ix), and `changed`.

    A deletion takes gaps alone, as many as stand there; a row that ends before the column gets gaps at its end.
    """
    if op not in ("insert", "delete"):
        raise ValueError(f"insert or delete, not {op!r}")
    edited = {"insert": insert_gaps, "delete": delete_gaps}[op](F.col("aligned"), F.lit(col), F.lit(count))
    picked = same_keys(seqs, chosen.select("aln_id", "row_ix").distinct().withColumn("_chosen", F.lit(True)), ["aln_id", "row_ix"], "left")
    new = picked.withColumn("_new", F.when(F.col("_chosen"), edited).otherwise(F.col("aligned")))
    return new.withColumn("changed", ~F.col("_new").eqNullSafe(F.col("aligned"))).withColumn("aligned", F.col("_new")).select(*seqs.columns, "changed")
