"""Parts of alignments: rectangles, subsets, names, residue classes, motif coverage."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.residues import CLASS_OF, RESIDUES, by_code


def slice_rows(seqs: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The rectangle of both ranges, ends included."""
    part = F.substring("aligned", cols[0] + 1, cols[1] - cols[0] + 1)
    return seqs.where(F.col("row_ix").between(*rows)).withColumn("aligned", part)


def subset(seqs: DataFrame, chosen: DataFrame, others: bool = False) -> DataFrame:
    """The rows that `chosen` (aln_id, row_ix) lists, or all others."""
    return seqs.join(chosen.select("aln_id", "row_ix"), ["aln_id", "row_ix"], "left_anti" if others else "left_semi")


def named_like(seqs: DataFrame, part: str) -> DataFrame:
    """Rows whose name holds the text, whatever the case; an empty text finds all."""
    return seqs.where(F.lower("name").contains(part.strip().lower()))


def class_counts(cells: DataFrame) -> DataFrame:
    """(aln_id, cls, residues) by property class; null for residues without one."""
    kinds = cells.where("code > 0").select("aln_id", by_code(CLASS_OF, F.col("code")).alias("cls"))
    return kinds.groupBy("aln_id", "cls").agg(F.count("*").alias("residues"))


def aligned_motifs(found: DataFrame, residues: DataFrame) -> DataFrame:
    """(aln_id, row_ix, match_ix, col_from, col_to): matches on aligned columns, gaps inside included."""
    start = residues.select("aln_id", "row_ix", F.col("residue_ix").alias("u_start"), F.col("col").alias("col_from"))
    end = residues.select("aln_id", "row_ix", (F.col("residue_ix") + 1).alias("u_end"), (F.col("col") + 1).alias("col_to"))
    both = found.join(start, ["aln_id", "row_ix", "u_start"]).join(end, ["aln_id", "row_ix", "u_end"])
    return both.select("aln_id", "row_ix", "match_ix", "col_from", "col_to")


def coverage(ranges: DataFrame, members: DataFrame) -> DataFrame:
    """(aln_id, grp, col, matches): how many matches of a group's rows cover a column."""
    each = ranges.join(members.select("aln_id", "row_ix", "grp"), ["aln_id", "row_ix"])
    each = each.select("aln_id", "grp", F.explode(F.sequence("col_from", F.col("col_to") - 1)).alias("col"))
    return each.groupBy("aln_id", "grp", "col").agg(F.count("*").alias("matches"))


def foldable(to_aa: Column) -> Column:
    """Whether a variant's target is one canonical residue."""
    return to_aa.rlike("(?i)^[ACDEFGHIKLMNPQRSTVWY]$")


def cell_variants(sited: DataFrame, order: str) -> DataFrame:
    """(aln_id, row_ix, col, seq_name, to_aa): the first variant at each cell by the order column."""
    at = sited.where("col is not null").groupBy("aln_id", "row_ix", "col")
    return at.agg(F.min_by(F.struct("seq_name", "to_aa"), F.col(order)).alias("v")).select("aln_id", "row_ix", "col", "v.*")


def with_external(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """Variants with score (0..100, rounded) and confidence of a table; 0 where it has none."""
    df = variants.join(scores.select("seq_name", "position", "to_aa", "score", "confidence"), ["seq_name", "position", "to_aa"], "left")
    score = F.least(F.greatest(F.floor(F.coalesce("score", F.lit(0.0)) + 0.5), F.lit(0)), F.lit(100))
    return df.withColumns({"score": score.cast("long"), "confidence": F.coalesce("confidence", F.lit(0.0))})


def overview(seqs: DataFrame, width: int, height: int) -> DataFrame:
    """(aln_id, x, y, row_ix, col, ch): a grid of width times height places of each alignment, by nearest sample.

    Only the sampled rows are read further, and only their sampled columns are cut out.
    """
    size = seqs.groupBy("aln_id").agg(F.count("*").alias("n"), F.max(F.length("aligned")).alias("w"))
    pick = lambda k, of, n: F.expr(f"least({n} - 1, {k} * {n} div {of})")
    ys = size.select("aln_id", "w", "n", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("aln_id", "w", "y", pick("y", height, "n").alias("nth"))
    order = W.partitionBy("aln_id").orderBy("row_ix")
    ranked = seqs.select("aln_id", "row_ix", "aligned", (F.row_number().over(order) - 1).alias("nth"))
    rows = ranked.join(ys, ["aln_id", "nth"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).where("w > 0")
    rows = rows.withColumn("col", pick("x", width, "w"))
    ch = F.substring("aligned", F.col("col").cast("int") + 1, F.lit(1))
    return rows.select("aln_id", "x", "y", "row_ix", F.col("col").cast("int").alias("col"), F.when(ch == "", "-").otherwise(ch).alias("ch"))


def described(cells: DataFrame) -> DataFrame:
    """Cells with the residue's name, three letters and kind; what the table lacks counts as any residue."""
    columns = {"residue": 0, "three": 1, "kind": 2}
    return cells.withColumns({n: by_code({a: v[k] for a, v in RESIDUES.items()}, F.col("code"), RESIDUES["X"][k]) for n, k in columns.items()})
