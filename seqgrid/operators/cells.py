"""Cells of alignments: packed rows to long form, residue maps, runs, splices."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, canonicalise, encode, substitutions, ungap

#: Rows that a task hands on at once.
HANDED = 200_000


def to_cells(seqs: DataFrame) -> DataFrame:
    """(aln_id, row_ix, grp, col, ch, code); cells behind a ragged row's end are left out."""
    chars = F.posexplode_outer(F.split("aligned", "")).alias("col", "ch")
    df = seqs.select("aln_id", "row_ix", "grp", chars).where("ch != ''")
    return df.withColumn("code", encode(F.col("ch")))


def codes_of(text: str | None) -> np.ndarray:
    """The code of each letter of a row, -1 for what is no residue code."""
    return _CODES[np.frombuffer((text or "").encode("latin-1", "replace"), np.uint8)]


_CODES = np.full(256, -1, np.int8)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def in_place(seqs: DataFrame, made: Callable[[np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """(aln_id, row_ix, schema): the columns that `made` gives for each row's codes. Rows are read where they lie, nothing is shuffled."""
    kinds = dict(seqs.dtypes)
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k) for k in ("aln_id", "row_ix")]
            row, parts, held = [], [], 0

            def handed() -> pa.RecordBatch:
                take = pa.array(np.repeat(row, [len(x[0]) for x in parts]), pa.int64())
                return pa.RecordBatch.from_arrays([*(k.take(take) for k in keys), *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))], names=["aln_id", "row_ix", *names])

            for k, text in enumerate(batch.column("aligned")):
                parts.append(made(codes_of(text.as_py())))
                row.append(k)
                held += len(parts[-1][0])
                if held > HANDED:
                    yield handed()
                    row, parts, held = [], [], 0
            if held:
                yield handed()

    return seqs.select("aln_id", "row_ix", "aligned").mapInArrow(run, f"aln_id {kinds['aln_id']}, row_ix {kinds['row_ix']}, {schema}")


def row_residues(seqs: DataFrame) -> DataFrame:
    """`residue_map` of rows, without their cells."""

    def made(code: np.ndarray) -> list[np.ndarray]:
        col = np.flatnonzero(code > 0).astype(np.int32)
        return [col, np.arange(len(col), dtype=np.int32)]

    return in_place(seqs, made, "col int, residue_ix int")


def row_index(seqs: DataFrame) -> DataFrame:
    """(aln_id, row_ix, col, ungapped): `running_index` of rows, without their cells; 0 stands for null until the end."""

    def made(code: np.ndarray) -> list[np.ndarray]:
        return [np.arange(len(code), dtype=np.int32), np.where(code > 0, np.cumsum(code > 0), 0)]

    return in_place(seqs, made, "col int, ungapped bigint").withColumn("ungapped", F.nullif("ungapped", F.lit(0)))


def row_gap_runs(seqs: DataFrame) -> DataFrame:
    """`gap_runs` of rows, without their cells."""

    def made(code: np.ndarray) -> list[np.ndarray]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], code == 0, [False]]).astype(np.int8)))
        return [edge[::2].astype(np.int32), edge[1::2] - edge[::2]]

    return in_place(seqs, made, "start int, `count` bigint")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells as pieces of text: neighbours of one row that come in order are one piece."""
    for batch in batches:
        n, ch = len(batch), batch.column("ch")
        if not n:
            continue
        aln = batch.column("aln_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        row, col = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_ix", "col"))
        new = np.concatenate([[True], (aln[1:] != aln[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)])
        at = np.flatnonzero(new)
        ends = np.frombuffer(ch.buffers()[1], np.int32)[ch.offset : ch.offset + n + 1]
        text = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(ends[at], ends[-1]).astype(np.int32)), ch.buffers()[2])
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("aln_id", "row_ix", "col")), text], names=["aln_id", "row_ix", "col", "ch"])


def to_rows(cells: DataFrame) -> DataFrame:
    """Rows of cells; neighbouring cells are joined before the shuffle, so cells in order travel as text."""
    kinds = dict(cells.dtypes)
    cells = cells.select("aln_id", "row_ix", "col", "ch").mapInArrow(_pieces, ", ".join(f"{c} {kinds[c]}" for c in ("aln_id", "row_ix", "col", "ch")))
    parts = F.sort_array(F.collect_list(F.struct("col", "ch")))
    return cells.groupBy("aln_id", "row_ix").agg(F.array_join(F.transform(parts, lambda x: x["ch"]), "").alias("aligned"))


def residue_map(cells: DataFrame) -> DataFrame:
    """(aln_id, row_ix, col, residue_ix) of the residues, numbered from 0."""
    order = W.partitionBy("aln_id", "row_ix").orderBy("col")
    return cells.where("code > 0").select("aln_id", "row_ix", "col", (F.row_number().over(order) - 1).alias("residue_ix"))


def running_index(cells: DataFrame) -> DataFrame:
    """Cells with `ungapped`, the number of the residue within its row from 1; null on gaps. No window is wider than a row."""
    upto = W.partitionBy("aln_id", "row_ix").orderBy("col").rowsBetween(W.unboundedPreceding, W.currentRow)
    return cells.withColumn("_n", F.sum(F.when(F.col("code") > 0, 1).otherwise(0)).over(upto)).withColumn("ungapped", F.when(F.col("code") > 0, F.col("_n"))).drop("_n")


def gap_runs(cells: DataFrame) -> DataFrame:
    """(aln_id, row_ix, start, count) of neighbouring gaps."""
    order = W.partitionBy("aln_id", "row_ix").orderBy("col")
    gaps = cells.where("code = 0").withColumn("island", F.col("col") - F.row_number().over(order))
    return gaps.groupBy("aln_id", "row_ix", "island").agg(F.min("col").alias("start"), F.count("*").alias("count")).drop("island")


def gap_only_columns(cells: DataFrame) -> DataFrame:
    return cells.groupBy("aln_id", "col").agg(F.max("code").alias("m")).where("m = 0").select("aln_id", "col")


def insert_gaps(aligned: Column, col: Column, count: Column) -> Column:
    return F.concat(F.substring(aligned, F.lit(1), col), F.repeat(F.lit("-"), count), F.substring(aligned, col + 1, F.length(aligned)))


def delete_gaps(aligned: Column, col: Column, count: Column) -> Column:
    """Removes the gaps at col, count of them at most."""
    rest = F.substring(aligned, col + 1, F.length(aligned))
    run = F.length(rest) - F.length(F.ltrim(F.translate(rest, "-", " ")))
    return F.concat(F.substring(aligned, F.lit(1), col), F.substring(rest, F.least(run, count) + 1, F.length(aligned)))


def shift_right(aligned: Column, count: Column) -> Column:
    return F.concat(F.repeat(F.lit("-"), count), aligned)


def substitute(aligned: Column, position: Column, to: Column) -> Column:
    """The ungapped sequence with the residue at a 1-based position replaced; null if out of range."""
    s = ungap(aligned)
    ok = (position >= 1) & (position <= F.length(s)) & to.rlike("^[ACDEFGHIKLMNPQRSTVWY]$")
    return F.when(ok, F.concat(F.substring(s, F.lit(1), position - 1), to, F.substring(s, position + 1, F.length(s))))


def fold_inputs(seqs: DataFrame) -> DataFrame:
    """(aln_id, row_ix, sequence, raw, substitutions): rows as a structure predictor takes them, the ungapped text
    before, and how many residues were replaced. Both texts have the same length, so places agree."""
    a = F.col("aligned")
    return seqs.select("aln_id", "row_ix", canonicalise(a).alias("sequence"), ungap(a).alias("raw"), substitutions(a).alias("substitutions"))
