"""Models of Calpha atoms (model_id, residue_ix, x, y, z, plddt): reading, fitting, confidence."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqgrid.sources.lines import counted, split_lines

AXES = "xyz"


def read_ca(spark: SparkSession, path: str) -> DataFrame:
    """Calpha atoms of a folder of PDB files, a model per file; coordinates that aren't numbers are null."""
    is_atom = F.expr("(value like 'ATOM%' or value like 'HETATM%') and trim(substring(value, 13, 4)) = 'CA'")
    atoms = counted(split_lines(spark, path), is_atom, "nth").where(is_atom)
    number = lambda at, n: F.expr(f"try_cast(trim(substring(value, {at}, {n})) as double)")
    model = F.regexp_extract("file", "([^/]+)$", 1).alias("model_id")
    return atoms.select(model, (F.col("nth") - 1).cast("int").alias("residue_ix"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(61, 6).alias("plddt"))


def mean_plddt(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("model_id").agg(F.avg("plddt").alias("plddt"), F.count("*").alias("residues"))


def confidence_band(plddt):
    return F.when(plddt >= 90, "very high").when(plddt >= 70, "high").when(plddt >= 50, "low").when(plddt.isNotNull(), "very low")


def matched(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(mobile, ref, residue_ix, mx..mz, rx..rz) of pairs of models, residues that both have."""
    m = atoms.select(F.col("model_id").alias("mobile"), "residue_ix", *[F.col(c).alias("m" + c) for c in AXES])
    r = atoms.select(F.col("model_id").alias("ref"), "residue_ix", *[F.col(c).alias("r" + c) for c in AXES])
    return pairs.join(m, "mobile").join(r, ["ref", "residue_ix"]).dropna()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rotation(cov: pd.Series) -> pd.Series:
    """3 x 3 rotations, by row, of cross-covariances: the quaternion is the key matrix's top eigenvector."""
    c = np.array(cov.tolist(), dtype=float).reshape(-1, 3, 3)
    key = np.zeros((len(c), 4, 4))
    key[:, 0, 0] = np.trace(c, axis1=1, axis2=2)
    cross = np.stack([c[:, 1, 2] - c[:, 2, 1], c[:, 2, 0] - c[:, 0, 2], c[:, 0, 1] - c[:, 1, 0]], axis=1)
    key[:, 0, 1:] = key[:, 1:, 0] = cross
    key[:, 1:, 1:] = c + c.transpose(0, 2, 1) - key[:, :1, :1] * np.eye(3)
    w, x, y, z = np.linalg.eigh(key)[1][:, :, -1].T
    turn = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    return pd.Series(list(np.stack(turn, axis=1)))


def superpose(pairs_matched: DataFrame) -> DataFrame:
    """(mobile, ref, n, rotation, shift): least squares fits of pairs with three residues at least.

    Fifteen sums per pair are aggregated by Spark; only they reach the eigenvalue solver.
    """
    cov = [F.covar_pop("m" + a, "r" + b).alias(f"c_{a}{b}") for a in AXES for b in AXES]
    sums = pairs_matched.groupBy("mobile", "ref").agg(F.count("*").alias("n"), *[F.avg(s + a).alias(s + a) for s in "mr" for a in AXES], *cov).where("n >= 3")
    df = sums.withColumn("rotation", _rotation(F.array(*[F.col(f"c_{a}{b}") for a in AXES for b in AXES])))
    shift = [F.col("r" + a) - sum(F.col("rotation")[3 * k + i] * F.col("m" + b) for i, b in enumerate(AXES)) for k, a in enumerate(AXES)]
    return df.select("mobile", "ref", "n", "rotation", F.array(*shift).alias("shift"))


def turned(df: DataFrame, x: str, y: str, z: str) -> list:
    """The columns x, y, z of df after the fit in its columns rotation and shift."""
    return [F.col("shift")[k] + sum(F.col("rotation")[3 * k + i] * F.col(c) for i, c in enumerate((x, y, z))) for k in range(3)]


def transformed(atoms: DataFrame, fits: DataFrame) -> DataFrame:
    """Atoms of each fit's mobile model, moved onto its ref."""
    df = atoms.join(fits.select(F.col("mobile").alias("model_id"), "ref", "rotation", "shift"), "model_id")
    moved = dict(zip(AXES, turned(df, *AXES), strict=True))
    return df.select("model_id", "ref", "residue_ix", *[moved[a].alias(a) for a in AXES], "plddt")


def transformed_lines(lines: DataFrame, fits: DataFrame) -> DataFrame:
    """PDB lines (model_id, line, s) with the coordinates of atoms moved by their model's fit; other columns stay.

    Lines that are no atoms, or whose coordinates aren't numbers, stay as they are.
    """
    df = lines.join(F.broadcast(fits.select(F.col("mobile").alias("model_id"), "rotation", "shift")), "model_id")
    number = lambda at: F.expr(f"try_cast(trim(substring(s, {at}, 8)) as double)")
    df = df.withColumns({"_x": number(31), "_y": number(39), "_z": number(47)})
    new = F.concat(*[F.format_string("%8.3f", c) for c in turned(df, "_x", "_y", "_z")])
    atom = F.col("s").rlike("^(ATOM|HETATM)") & F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("_z").isNotNull()
    text = F.when(atom, F.concat(F.substring("s", 1, 30), new, F.expr("substring(s, 55)"))).otherwise(F.col("s"))
    return df.select("model_id", "line", text.alias("s"))


def deviations(pairs_matched: DataFrame, fits: DataFrame) -> DataFrame:
    """(mobile, ref, residue_ix, dev): distance of each matched residue after the fit."""
    df = pairs_matched.join(fits, ["mobile", "ref"])
    off = [p - F.col("r" + a) for p, a in zip(turned(df, "mx", "my", "mz"), AXES, strict=True)]
    return df.select("mobile", "ref", "residue_ix", F.sqrt(sum(o * o for o in off)).alias("dev"))


def all_deviations(atoms: DataFrame, devs: DataFrame, fits: DataFrame) -> DataFrame:
    """(mobile, ref, residue_ix, dev) of every residue of the mobile model; null where the other has none."""
    mine = fits.select("mobile", "ref").join(atoms.select(F.col("model_id").alias("mobile"), "residue_ix"), "mobile")
    return mine.join(devs, ["mobile", "ref", "residue_ix"], "left").select("mobile", "ref", "residue_ix", "dev")


def mutant_summary(sites: DataFrame, atoms: DataFrame, devs: DataFrame) -> DataFrame:
    """sites (mobile, ref, position from 1) with rmsd, and the deviation and change of confidence at the site.

    A pair without a fit has nulls: it has too few residues in common.
    """
    at = sites.withColumn("residue_ix", F.col("position") - 1)
    p = lambda side: atoms.select(F.col("model_id").alias(side), "residue_ix", F.col("plddt").alias(f"p_{side}"))
    df = at.join(rmsd(devs), ["mobile", "ref"], "left").join(devs, ["mobile", "ref", "residue_ix"], "left")
    df = df.join(p("mobile"), ["mobile", "residue_ix"], "left").join(p("ref"), ["ref", "residue_ix"], "left")
    return df.select("mobile", "ref", "position", "n", "rmsd", "dev", (F.col("p_mobile") - F.col("p_ref")).alias("plddt_change"))


def rmsd(devs: DataFrame) -> DataFrame:
    return devs.groupBy("mobile", "ref").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("dev") * F.col("dev"))).alias("rmsd"))
