"""Column scores that weigh residues by their properties, background or likeness.

All take column counts (aln_id, col, code, n). Substitution scores (a, b, s) have at most a row for
each pair of the 27 codes, so they are broadcast.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, BACKGROUND, CANONICAL
from seqgrid.functions.joins import same_keys
from seqgrid.functions.lineage import cut
from seqgrid.functions.residues import POLARITY, VOLUME, by_code, z_scored
from seqgrid.operators.labels import auto_labels
from seqgrid.operators.profile import _clamped, _shares, count_vectors, jsd_track, merged_counts, shannon_track, threshold_track

KEY = ["aln_id", "col"]


def log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, brought back by the recurrence."""
    y, low = x + 8, x
    for i in range(1, 8):
        low = low * (x + i)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(low)


def vector_norm_track(counts: DataFrame, seqs: DataFrame) -> DataFrame:
    """Length of the summed property vectors against the sum of lengths, times the share of rows with a residue."""
    v, w = (by_code(z_scored(t), F.col("code")) for t in (VOLUME, POLARITY))
    n = F.col("n")
    sums = counts.where("code between 1 and 20").groupBy(*KEY).agg(
        F.sum(n).alias("nc"), F.sum(n * v).alias("v"), F.sum(n * w).alias("w"), F.sum(n * F.sqrt(v * v + w * w)).alias("m")
    )
    rows = seqs.groupBy("aln_id").agg(F.count("*").alias("rows"))
    score = F.col("nc") / F.col("rows") * (F.sqrt(F.col("v") * F.col("v") + F.col("w") * F.col("w")) / F.col("m")) * 100
    return sums.join(rows, "aln_id").select(*KEY, _clamped(score).alias("score"))


def bild_track(counts: DataFrame) -> DataFrame:
    """Log odds of the counts under a Dirichlet prior shaped as the background, against the background."""
    q, n = by_code(BACKGROUND, F.col("code")), F.col("n")
    own = log_gamma(n + q) - log_gamma(q) - n * F.log(q)
    sums = counts.where("code between 1 and 20").groupBy(*KEY).agg(F.sum(n).alias("t"), F.sum(own).alias("s"))
    t = F.col("t")
    score = (F.col("s") - log_gamma(t + 1)) / (-t * math.log(min(BACKGROUND.values()))) * 100
    return sums.select(*KEY, _clamped(score).alias("score"))


def mean_distance_track(counts: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score of the pairs of a column against the mean of their residues' own scores."""
    own = scores.where("a = b").select("a", F.col("s").alias("own"))
    pairs = scores.join(F.broadcast(own), "a").join(F.broadcast(own.toDF("b", "own_b")), "b").select("a", "b", "s", ((F.col("own") + F.col("own_b")) / 2).alias("best"))
    x = counts.where("code between 1 and 20").select(*KEY, F.col("code").alias("a"), "n")
    y = x.toDF(*KEY, "b", "m")
    ways = F.when(F.col("a") == F.col("b"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m"))
    met = x.join(y, KEY).where("a <= b").join(F.broadcast(pairs), ["a", "b"]).withColumn("k", ways)
    sums = met.groupBy(*KEY).agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("s")).alias("s"), F.sum(F.col("k") * F.col("best")).alias("best"))
    top = F.col("best") / F.col("k") + 4
    ratio = F.when(top > 0, _clamped((F.col("s") / F.col("k") + 4) / top * 100))
    return sums.select(*KEY, F.when(F.col("k") == 0, 100.0).when(F.col("k") > 0, ratio).alias("score"))


def liu_track(counts: DataFrame, scores: DataFrame) -> DataFrame:
    """Entropy of shares spread over the residues of positive score; plain entropy where there are none."""
    near = F.broadcast(scores.where("s > 0").select(F.col("b").alias("code"), "a", "s"))
    spread = _shares(counts).join(near, "code").groupBy(*KEY, "a").agg(F.sum(F.col("p") * F.col("s")).alias("x"))
    p = F.col("x") / F.sum("x").over(W.partitionBy(*KEY))
    h = spread.withColumn("p", p).groupBy(*KEY).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    plain = shannon_track(counts).withColumnRenamed("score", "plain")
    score = F.coalesce(_clamped((1 - F.col("h") / math.log2(20)) * 100), "plain")
    return plain.join(h, KEY, "left").select(*KEY, score.alias("score"))


def all_tracks(counts: DataFrame, seqs: DataFrame, scores: DataFrame) -> DataFrame:
    """(aln_id, col, method, score) of the seven methods."""
    made = {
        "threshold": threshold_track(counts), "shannon": shannon_track(counts), "jsd": jsd_track(counts), "mean_distance": mean_distance_track(counts, scores),
        "vector_norm": vector_norm_track(counts, seqs), "bild": bild_track(counts), "liu": liu_track(counts, scores),
    }
    out = None
    for name, track in made.items():
        part = track.select(*KEY, F.lit(name).alias("method"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def multi_track(counts: DataFrame, seqs: DataFrame, scores: DataFrame) -> DataFrame:
    return all_tracks(counts, seqs, scores).groupBy(*KEY).agg(F.avg("score").alias("score"))


METHODS = ("threshold", "shannon", "jsd", "mean_distance", "vector_norm", "bild", "liu")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """`log_gamma` of arrays."""
    low = x.copy()
    for i in range(1, 8):
        low *= x + i
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y - np.log(low)


def _entropy(p: np.ndarray) -> np.ndarray:
    return -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0).sum(axis=1)


def column_scores(n: np.ndarray, rows: np.ndarray, methods: list[str], like: np.ndarray) -> dict[str, np.ndarray]:
    """0 to 100 for each method and row of counts (27 codes); nan where a method has no score.

    like: 20 x 20 substitution scores, for mean_distance and liu. multi is the mean of the scores there are.
    """
    c = n[:, 1:21].astype(float)
    t = c.sum(axis=1)
    q = np.array([BACKGROUND[a] for a in CANONICAL])
    spread = lambda h: (1 - h / math.log2(20)) * 100
    with np.errstate(divide="ignore", invalid="ignore"):
        p = c / t[:, None]
        made = {}

        def threshold():
            return p.max(axis=1) * 100

        def shannon():
            return spread(_entropy(p))

        def jsd():
            m = (p + q) / 2
            return (np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0) / m), 0.0).sum(axis=1) + (q * np.log2(q / m)).sum(axis=1)) / 2 * 100

        def mean_distance():
            # Over pairs of residues: their score, and the mean of what both score with themselves.
            own = c @ np.diag(like)
            met = (np.einsum("ij,jk,ik->i", c, like, c) - own) / (t * (t - 1))
            top = own / t + 4
            return np.where(t == 1, 100.0, np.where(top > 0, np.clip((met + 4) / top * 100, 0, 100), np.nan))

        def vector_norm():
            x, y = (np.array([table[a] for a in CANONICAL]) for table in (z_scored(VOLUME), z_scored(POLARITY)))
            whole = c @ np.hypot(x, y)
            share = t / np.where(rows > 0, rows, t)
            return np.where(whole > 0, share * np.hypot(c @ x, c @ y) / whole * 100, np.nan)

        def bild():
            odds = (_log_gamma(c + q) - _log_gamma(q) - c * np.log(q)).sum(axis=1) - _log_gamma(t + 1)
            return odds / (-t * math.log(q.min())) * 100

        def liu():
            x = p @ np.maximum(like, 0)
            mass = x.sum(axis=1, keepdims=True)
            return np.where(mass[:, 0] > 0, spread(_entropy(x / mass)), shannon())

        each = {f.__name__: f for f in (threshold, shannon, jsd, mean_distance, vector_norm, bild, liu)}
        for name in METHODS if "multi" in methods else methods:
            made[name] = np.where(t > 0, np.clip(each[name](), 0, 100), np.nan)
    if "multi" in methods:
        known = np.stack([made[m] for m in METHODS])
        count = np.isfinite(known).sum(axis=0)
        made["multi"] = np.where(count > 0, np.nansum(known, axis=0) / np.maximum(count, 1), np.nan)
    return {m: made[m] for m in methods}


def _likeness(scores: DataFrame | None) -> np.ndarray:
    """Substitution scores (a, b, s) of the canonical codes as a matrix; at most a row for each pair of codes."""
    like = np.zeros((len(ALPHABET), len(ALPHABET)))
    for r in scores.select("a", "b", "s").collect() if scores is not None else []:
        like[r["a"], r["b"]] = r["s"]
    return like[1:21, 1:21]


def scored(vectors: DataFrame, methods: list[str], scores: DataFrame | None = None) -> DataFrame:
    """Count vectors with canonical, total, consensus, consensus_frac and a column for each method, null without score."""
    like = _likeness(scores)
    keys = [c for c in vectors.columns if c not in ("n", "rows")]
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n = batch.column("n").flatten().to_numpy().reshape(len(batch), -1)
            found = column_scores(n, batch.column("rows").to_numpy(), methods, like)
            total, best = n[:, 1:].sum(axis=1), n[:, 1:].max(axis=1)
            facts = [n[:, 1:21].sum(axis=1), total, np.where(total > 0, 1 + n[:, 1:].argmax(axis=1), 0).astype(np.int32), best / np.maximum(total, 1)]
            tracks = [pa.array(found[m], mask=~np.isfinite(found[m])) for m in methods]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *map(pa.array, facts), *tracks], names=[*keys, "canonical", "total", "consensus", "consensus_frac", *methods])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", canonical bigint, total bigint, consensus int, consensus_frac double" + "".join(f", {m} double" for m in methods)
    return vectors.select(*keys, "n", "rows").mapInArrow(run, schema)


def track(vectors: DataFrame, method: str, scores: DataFrame | None = None) -> DataFrame:
    """(aln_id, col, score) of the columns that hold a canonical residue."""
    return scored(vectors, [method], scores).where("canonical > 0").select("aln_id", "col", F.col(method).alias("score"))


def conservation_job(seqs: DataFrame, methods: list[str], scores: DataFrame | None = None, group: str = "grp") -> DataFrame:
    """(aln_id, whole, group, col, method, score, total, label): tracks of all rows and of each group, labels of the former.

    Rows are read and counted once, by group; counts of all rows are sums of those. Rows without a group
    count in the whole only. Columns without a residue have a null score.
    """
    by_group = cut(count_vectors(seqs, group))
    kind = dict(seqs.dtypes)[group]
    whole = merged_counts(by_group, "aln_id").withColumn(group, F.lit(None).cast(kind)).withColumn("whole", F.lit(True))
    both = whole.unionByName(by_group.where(F.col(group).isNotNull()).withColumn("whole", F.lit(False)))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])).alias("x")
    tracks = cut(scored(both, methods, scores).select("aln_id", "whole", group, "col", "total", each).select("aln_id", "whole", group, "col", "x.method", "x.score", "total"))
    labels = auto_labels(tracks.where("whole").select("aln_id", "method", "col", "score", "total"), "method").withColumn("whole", F.lit(True))
    return same_keys(tracks, labels, ["aln_id", "whole", "method", "col"], "left")


def barcode(seqs: DataFrame, ranges: DataFrame | None = None, group: str = "grp") -> DataFrame:
    """(aln_id, whole, group, col, conservation, gap_frac, feature): a lane of all rows and one of each group, the null group
    included, over every column of the alignment.

    conservation is the commonest residue's share of the residues in percent, null where a lane has none;
    gap_frac counts rows that end earlier as gaps; feature says whether a range (aln_id, row_ix, col_from,
    col_to) of the lane's rows covers the column, and is null without ranges. Rows are counted in one scan.
    """
    kind = dict(seqs.dtypes)[group]
    none, lane = F.lit(None).cast(kind).alias(group), ["aln_id", "whole", group]
    in_groups = lambda df: df.withColumn("whole", F.lit(False))
    by_group = count_vectors(seqs, group)
    whole = merged_counts(by_group, "aln_id").select("aln_id", F.lit(True).alias("whole"), none, "col", "n", "rows")
    found = scored(whole.unionByName(in_groups(by_group)), []).select(*lane, "col", "total", "consensus_frac")
    sizes = seqs.groupBy("aln_id", group).agg(F.count("*").alias("rows"))
    sizes = in_groups(sizes).unionByName(sizes.groupBy("aln_id").agg(F.sum("rows").alias("rows")).select("aln_id", F.lit(True).alias("whole"), none, "rows"))
    width = by_group.groupBy("aln_id").agg(F.max("col").alias("last"))
    grid = same_keys(sizes, width, ["aln_id"]).select(*lane, "rows", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("col"))
    lanes = same_keys(grid, found, [*lane, "col"], "left")
    feature = F.lit(None).cast("boolean")
    if ranges is not None:
        own = same_keys(ranges.select("aln_id", "row_ix", "col_from", "col_to"), seqs.select("aln_id", "row_ix", group), ["aln_id", "row_ix"])
        covered = own.select("aln_id", group, F.explode(F.sequence("col_from", F.col("col_to") - 1)).alias("col")).distinct()
        covered = in_groups(covered).unionByName(covered.select("aln_id", F.lit(True).alias("whole"), none, "col").distinct())
        lanes = same_keys(lanes, covered.withColumn("_covered", F.lit(True)), [*lane, "col"], "left")
        feature = F.coalesce("_covered", F.lit(False))
    total = F.coalesce("total", F.lit(0))
    conservation = F.when(total > 0, F.col("consensus_frac") * 100)
    return lanes.select(*lane, "col", conservation.alias("conservation"), ((F.col("rows") - total) / F.col("rows")).alias("gap_frac"), feature.alias("feature"))
