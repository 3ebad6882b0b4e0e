"""Column profiles and conservation scores, from counts alone."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, BACKGROUND
from seqgrid.functions.joins import same_keys
from seqgrid.functions.lineage import cut

#: Letters that a task holds before it counts them, and the columns of a batch that it hands on.
_HELD = 32_000_000
_HANDED = 20_000


def _counted(keys: list[str]):
    """Counts of each column's codes over the rows of a task; column -1 holds the number of rows."""
    code = np.full(256, ALPHABET.index("X"), np.int64)
    for k, ch in enumerate(ALPHABET):
        code[ord(ch)] = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        types, size = None, 0

        def batch_of(key: tuple, cols: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            flat = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * len(ALPHABET), pa.array(n.ravel()))
            return pa.RecordBatch.from_arrays([*(pa.array([k] * len(n), t) for k, t in zip(key, types, strict=True)), pa.array(cols, pa.int32()), flat], names=[*keys, "col", "n"])

        def handed() -> Iterator[pa.RecordBatch]:
            while held:
                key, texts = held.popitem()
                whole = np.zeros((1, len(ALPHABET)), np.int64)
                whole[0, 0] = len(texts)
                yield batch_of(key, np.array([-1]), whole)
                texts.sort(key=len, reverse=True)
                for start in range(0, len(texts[0]), _HANDED):
                    counts = np.zeros((min(_HANDED, len(texts[0]) - start), len(ALPHABET)), np.uint32)  # a task's rows fit 32 bits
                    for letters in texts:
                        if len(letters) <= start:
                            break
                        codes = code[letters[start : start + _HANDED]]
                        counts[np.arange(len(codes)), codes] += 1
                    at = np.flatnonzero(counts.any(axis=1))
                    if len(at):
                        yield batch_of(key, start + at, counts[at].astype(np.int64))

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            for *key, text in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("aligned").to_pylist(), strict=True):
                letters = np.frombuffer((text or "").encode("latin-1", "replace"), np.uint8)
                held.setdefault(tuple(key), []).append(letters)
                size += len(letters) + 128  # an array has a size of its own
                if size > _HELD:
                    yield from handed()
                    size = 0
        yield from handed()

    return run


def merged_counts(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, col, n, rows): counts added up over what the keys leave out."""
    size = vectors.select(*[c for c in vectors.columns if c not in ("col", "n")]).distinct().groupBy(*keys).agg(F.sum("rows").alias("rows"))
    total = F.array(*[F.sum(F.col("n")[k]) for k in range(len(ALPHABET))])
    return same_keys(vectors.groupBy(*keys, "col").agg(total.alias("n")), size, list(keys))


def count_vectors(seqs: DataFrame, *group: str) -> DataFrame:
    """(aln_id, group, col, n array<bigint>, rows): how often each of the 27 codes stands in a column, and all rows.

    One scan of the rows, counted in tasks before anything is shuffled; written, as all scores come from it.
    Cells behind a ragged row's end are in `rows` alone. Null keys are groups of their own.
    """
    keys = ["aln_id", *group]
    kinds = dict(seqs.dtypes)
    found = seqs.select(*keys, "aligned").mapInArrow(_counted(keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", col int, n array<bigint>")
    total = F.array(*[F.sum(F.col("n")[k]) for k in range(len(ALPHABET))])
    whole = cut(found.groupBy(*keys, "col").agg(total.alias("n")))
    rows = whole.where("col = -1").select(*keys, F.col("n")[0].alias("rows"))
    return same_keys(whole.where("col >= 0"), rows, keys)


def long_counts(vectors: DataFrame) -> DataFrame:
    """(keys, col, code, n) of the non-gap cells, as `column_counts` gives them."""
    keys = [c for c in vectors.columns if c not in ("n", "rows")]
    return vectors.select(*keys, F.posexplode("n").alias("code", "n")).where("code > 0 and n > 0")


def column_counts(cells: DataFrame, *group: str) -> DataFrame:
    """(aln_id, [group], col, code, n) of the non-gap cells; partial counts shuffle, not cells."""
    return cells.where("code > 0").groupBy("aln_id", *group, "col", "code").agg(F.count("*").alias("n"))


def column_stats(counts: DataFrame, *group: str) -> DataFrame:
    """total, consensus (most frequent code, lowest on ties) and its share of the non-gap cells."""
    best = F.max(F.struct("n", (-F.col("code")).alias("c")))
    df = counts.groupBy("aln_id", *group, "col").agg(F.sum("n").alias("total"), best.alias("b"))
    return df.select("aln_id", *group, "col", "total", (-F.col("b.c")).alias("consensus"), (F.col("b.n") / F.col("total")).alias("consensus_frac"))


def _shares(counts: DataFrame) -> DataFrame:
    canon = counts.where("code between 1 and 20")
    return canon.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("aln_id", "col")))


def _clamped(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def threshold_track(counts: DataFrame) -> DataFrame:
    return _shares(counts).groupBy("aln_id", "col").agg(_clamped(F.max("p") * 100).alias("score"))


def shannon_track(counts: DataFrame) -> DataFrame:
    h = -F.sum(F.col("p") * F.log2("p"))
    return _shares(counts).groupBy("aln_id", "col").agg(_clamped((1 - h / math.log2(20)) * 100).alias("score"))


def background(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ALPHABET.index(a), q) for a, q in BACKGROUND.items()], "code int, q double")


def jsd_track(counts: DataFrame) -> DataFrame:
    """Divergence from the background; residues a column lacks give q / 2 each."""
    q = F.broadcast(background(counts.sparkSession))  # 20 rows
    m = (F.col("p") + F.col("q")) / 2
    own = F.col("p") * F.log2(F.col("p") / m) / 2 + F.col("q") * F.log2(F.col("q") / m) / 2
    seen = _shares(counts).join(q, "code").groupBy("aln_id", "col").agg(F.sum(own - F.col("q") / 2).alias("d"))
    return seen.select("aln_id", "col", _clamped((F.col("d") + sum(BACKGROUND.values()) / 2) * 100).alias("score"))


def group_tracks(cells: DataFrame) -> DataFrame:
    """threshold per column over all rows (grp null) and per group, in one pass of grouping sets."""
    cells.createOrReplaceTempView("_group_cells")
    sets = cells.sparkSession.sql(
        "select aln_id, grp, col, code, count(*) n, grouping(grp) = 1 as whole from _group_cells"
        " where code between 1 and 20 group by grouping sets ((aln_id, col, code), (aln_id, grp, col, code))"
    )
    return sets.groupBy("aln_id", "whole", "grp", "col").agg((F.max("n") / F.sum("n") * 100).alias("score"), F.sum("n").alias("n"))
