"""Tables of residue properties as column expressions, and substitution scores as a table."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, CANONICAL, HYDROPATHY

#: Residue volumes, polarities, property classes, colour groups, pKa and their ends.
VOLUME = {"A": 88.6, "C": 108.5, "D": 111.1, "E": 138.4, "F": 189.9, "G": 60.1, "H": 153.2, "I": 166.7, "K": 168.6, "L": 166.7, "M": 162.9, "N": 114.1, "P": 112.7, "Q": 143.8, "R": 173.4, "S": 89.0, "T": 116.1, "V": 140.0, "W": 227.8, "Y": 193.6}
POLARITY = {"A": 8.1, "C": 5.5, "D": 13.0, "E": 12.3, "F": 5.2, "G": 9.0, "H": 10.4, "I": 5.2, "K": 11.3, "L": 4.9, "M": 5.7, "N": 11.6, "P": 8.0, "Q": 10.5, "R": 10.5, "S": 9.2, "T": 8.6, "V": 5.9, "W": 5.4, "Y": 6.2}
PROPERTY_CLASS = {"aliphatic": "AILMV", "aromatic": "FWY", "positive": "HKR", "negative": "DE", "hydrophilic": "NQST", "special": "GP", "cysteine": "C"}
COLOUR_GROUP = {1: "AFILMVW", 2: "KR", 3: "DE", 4: "NQST", 5: "C", 6: "G", 7: "P", 8: "HY"}
PKA_POSITIVE = {"H": 6.5, "K": 10.8, "R": 12.5}
PKA_NEGATIVE = {"D": 3.9, "E": 4.1, "C": 8.5, "Y": 10.1}
PKA_ENDS = (8.6, 3.6)

#: Name, three letters and kind of each residue.
RESIDUES = {
    "A": ("Alanine", "Ala", "Hydrophobic"),
    "R": ("Arginine", "Arg", "Positive (basic)"),
    "N": ("Asparagine", "Asn", "Polar"),
    "D": ("Aspartate", "Asp", "Negative (acidic)"),
    "C": ("Cysteine", "Cys", "Special (thiol)"),
    "E": ("Glutamate", "Glu", "Negative (acidic)"),
    "Q": ("Glutamine", "Gln", "Polar"),
    "G": ("Glycine", "Gly", "Special (flexible)"),
    "H": ("Histidine", "His", "Positive / aromatic"),
    "I": ("Isoleucine", "Ile", "Hydrophobic (aliphatic)"),
    "L": ("Leucine", "Leu", "Hydrophobic (aliphatic)"),
    "K": ("Lysine", "Lys", "Positive (basic)"),
    "M": ("Methionine", "Met", "Hydrophobic"),
    "F": ("Phenylalanine", "Phe", "Aromatic"),
    "P": ("Proline", "Pro", "Special (rigid)"),
    "S": ("Serine", "Ser", "Polar"),
    "T": ("Threonine", "Thr", "Polar"),
    "W": ("Tryptophan", "Trp", "Aromatic"),
    "Y": ("Tyrosine", "Tyr", "Aromatic"),
    "V": ("Valine", "Val", "Hydrophobic (aliphatic)"),
    "B": ("Asx (Asn/Asp)", "Asx", "Ambiguous"),
    "Z": ("Glx (Gln/Glu)", "Glx", "Ambiguous"),
    "X": ("Any residue", "Xaa", "Unknown"),
    "U": ("Selenocysteine", "Sec", "Special"),
    "O": ("Pyrrolysine", "Pyl", "Special"),
    "*": ("Stop", "*", "\u2014"),
    "-": ("Gap", "\u2014", "Alignment gap"),
}

CLASS_OF = {a: k for k, members in PROPERTY_CLASS.items() for a in members}
GROUP_OF = {a: k for k, members in COLOUR_GROUP.items() for a in members}
#: Each canonical residue as a class of its own, and hydropathy moved to 0 (hydrophilic) to 1 (hydrophobic).
OWN_CLASS = {a: k for k, a in enumerate(CANONICAL, 1)}
HYDRO_SCALE = {a: (x + 4.5) / 9 for a, x in HYDROPATHY.items()}


def by_code(table: dict, code: Column, default=None) -> Column:
    """The entry of a residue code; the default for codes that the table lacks."""
    return F.element_at(F.array(*[F.lit(table.get(a, default)) for a in ALPHABET]), code + 1)


def schemes(code: Column) -> dict[str, Column]:
    """The static classes of a code: zappo, taylor, clustal and hydropathy; null where a scheme has none, clustal 0."""
    return {"zappo": by_code(CLASS_OF, code), "taylor": by_code(OWN_CLASS, code), "clustal": by_code(GROUP_OF, code, 0), "hydropathy": by_code(HYDRO_SCALE, code)}


def z_scored(table: dict[str, float]) -> dict[str, float]:
    mean = sum(table.values()) / len(table)
    sd = math.sqrt(sum((x - mean) ** 2 for x in table.values()) / len(table)) or 1.0
    return {a: (x - mean) / sd for a, x in table.items()}


def class_scores(spark: SparkSession, same: float = 5.0, alike: float = 1.0, other: float = -2.0) -> DataFrame:
    """(a, b, s) by rule: same residue, same property class, or neither."""
    codes = spark.range(1, len(CANONICAL) + 1).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(len(CANONICAL)))).alias("b"))
    near = by_code(CLASS_OF, F.col("a")) == by_code(CLASS_OF, F.col("b"))
    return codes.withColumn("s", F.when(F.col("a") == F.col("b"), same).when(near, alike).otherwise(other))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, s) of a published matrix: comments with #, a line of residues, then a line per residue."""
    lines = spark.read.text(path).where("trim(value) != '' and value not like '#%'").select(F.split(F.trim("value"), r"\s+").alias("f"))
    numeric = F.try_element_at("f", F.lit(2)).rlike(r"^-?\d")
    head = lines.where(~numeric).select(F.col("f").alias("names"))
    cells = lines.where(numeric).join(F.broadcast(head), F.lit(True)).select(F.col("f")[0].alias("x"), F.posexplode(F.slice("f", 2, 100)).alias("at", "s"), "names")
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = cells.select(place(F.col("x")).alias("a"), place(F.col("names")[F.col("at")]).alias("b"), F.col("s").cast("double").alias("s"))
    return pairs.where("a > 0 and b > 0")


def with_unknown(scores: DataFrame) -> DataFrame:
    """(a, b, s) of all 27 x 27 codes: a code that scores (a, b, s) lack (gaps, U and O in published matrices) takes X's.

    Without X in the scores, only what they name is returned.
    """
    x, codes = ALPHABET.index("X"), list(range(len(ALPHABET)))
    known = scores.select("a").distinct().groupBy().agg(F.collect_set("a").alias("known"))  # 27 codes at most
    each = scores.sparkSession.createDataFrame([(a, b) for a in codes for b in codes], "a int, b int").crossJoin(F.broadcast(known))  # one row
    stands = lambda c: F.when(F.array_contains("known", F.col(c)), F.col(c)).otherwise(F.lit(x))
    return each.select("a", "b", stands("a").alias("_a"), stands("b").alias("_b")).join(F.broadcast(scores.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "s")), ["_a", "_b"]).select("a", "b", "s")
