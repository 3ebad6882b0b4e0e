"""Residue alphabet as column expressions. Codes are places in ALPHABET; 0 is the gap."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 27 residue codes in order, the background frequencies and the residue scales.
ALPHABET = "-ACDEFGHIKLMNPQRSTVWYBZXUO*"
CANONICAL = ALPHABET[1:21]
BACKGROUND = dict(zip(CANONICAL, (0.078, 0.024, 0.052, 0.059, 0.044, 0.083, 0.025, 0.062, 0.056, 0.092, 0.024, 0.041, 0.043, 0.034, 0.051, 0.059, 0.055, 0.073, 0.014, 0.034), strict=True))
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalise(raw: Column) -> Column:
    """Any text as residues: ASCII upper case, gaps for . ~ and white space, X for all unknown."""
    up = F.translate(raw, _UPPER.lower(), _UPPER)
    gaps = F.regexp_replace(up, r"[.~ \n\t-]", "-")
    return F.regexp_replace(gaps, r"[^ACDEFGHIKLMNPQRSTVWYBZXUO*-]", "X")


def encode(ch: Column) -> Column:
    return F.instr(F.lit(ALPHABET), ch).cast("int") - 1


def decode(code: Column) -> Column:
    return F.when((code >= 0) & (code < len(ALPHABET)), F.substring(F.lit(ALPHABET), code + 1, F.lit(1))).otherwise("X")


def ungap(aligned: Column) -> Column:
    return F.regexp_replace(aligned, "-", "")


def canonicalise(aligned: Column) -> Column:
    return F.translate(ungap(aligned), "BZXUO*", "DEACKA")


def substitutions(aligned: Column) -> Column:
    """How many residues `canonicalise` replaces."""
    return F.length(ungap(aligned)) - F.length(F.regexp_replace(aligned, f"[^{CANONICAL}]", ""))


def ungapped_at(aligned: Column, col: Column) -> Column:
    """Number, from 1, of the residue at a column from 0; null on a gap and outside the row."""
    here = F.substring(aligned, col + 1, F.lit(1))
    return F.when((col >= 0) & ~here.isin("-", ""), F.length(ungap(F.substring(aligned, F.lit(1), col + 1))))
