"""Labels of columns by their score: 2 strictly, 1 widely, 0 poorly conserved."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgrid.functions.joins import same_keys

#: The residues a column needs, the most rounds.
MIN_RESIDUES = 6
ROUNDS = 40


def _fitted(x: np.ndarray, n: np.ndarray) -> tuple[list[float], list[int]]:
    """Centroids of different values x that occur n times, and the label of each centroid's cluster."""
    k = min(3, len(x))
    c = x.min() + (np.arange(k) + 0.5) * (x.max() - x.min()) / k
    nearest = lambda: np.abs(x[:, None] - c[None, :]).argmin(axis=1)
    for _ in range(ROUNDS):
        at = nearest()
        size = np.bincount(at, n, k)
        new = np.where(size > 0, np.bincount(at, x * n, k) / np.maximum(size, 1), c)
        if (new == c).all():
            break
        c = new
    # The best of the clusters that hold a score gets 2, the next 1.
    held = sorted(set(nearest().tolist()), key=lambda i: (-c[i], i))
    return c.tolist(), [max(0, 2 - held.index(i)) if i in held else 0 for i in range(k)]


def auto_labels(scores: DataFrame, *more: str) -> DataFrame:
    """(aln_id, more, col, label) of (aln_id, more, col, score, total): clusters of the scores, ranked by their means.

    One-dimensional k-means of three clusters at most, from centroids spread evenly over the range, ties
    to the lower one. Columns with too few residues or no score get 0. A task fits the different scores of
    one track, 32-bit numbers of which there are no more than columns; tracks are fitted side by side.
    """
    keys = ["aln_id", *more]
    kinds = dict(scores.dtypes)
    fit = scores.where((F.col("total") >= MIN_RESIDUES) & F.col("score").isNotNull())
    values = fit.groupBy(*keys, F.col("score").cast("float").cast("double").alias("x")).agg(F.count("*").alias("n"))

    def run(key: tuple, track: pa.Table) -> pa.Table:
        order = np.argsort(track["x"].to_numpy())
        c, label = _fitted(track["x"].to_numpy()[order], track["n"].to_numpy()[order])
        own = [pa.array([k.as_py()], track[name].type) for k, name in zip(key, keys, strict=True)]
        return pa.table([*own, pa.array([c], pa.list_(pa.float64())), pa.array([label], pa.list_(pa.int32()))], names=[*keys, "c", "labels"])

    fitted = values.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", c array<double>, labels array<int>")
    sited = same_keys(scores, fitted, keys, "left").withColumn("x", F.col("score").cast("float").cast("double"))
    near = F.expr("array_position(transform(c, y -> abs(y - x)), array_min(transform(c, y -> abs(y - x))))").cast("int")
    label = F.when((F.col("total") >= MIN_RESIDUES) & F.col("score").isNotNull(), F.try_element_at("labels", near)).otherwise(0)
    return sited.select(*keys, "col", F.coalesce(label, F.lit(0)).cast("int").alias("label"))


def label_tally(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """(aln_id, label, columns) over the columns that have a score."""
    return same_keys(labels, scores.where("score is not null").select("aln_id", "col").distinct(), ["aln_id", "col"]).groupBy("aln_id", "label").agg(F.count("*").alias("columns"))
