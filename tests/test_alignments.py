"""Small golden cases of the alignment operators."""

import math

import pytest

from seqgrid.functions.alphabet import canonicalise, normalise
from seqgrid.operators import cells, features, identity, motif, profile
from seqgrid.sources.fasta import read_fasta
from pyspark.sql import functions as F


def seqs(spark, *rows):
    data = [("a", i, f"s{i}", "g", r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "aln_id string, row_ix int, name string, grp string, aligned string")


def test_counts_and_stats(spark):
    c = cells.to_cells(seqs(spark, "AA--", "ACC-", "AD--"))
    got = {r.col: r for r in profile.column_stats(profile.column_counts(c)).collect()}
    assert [got[i].total for i in range(3)] == [3, 3, 1] and 3 not in got
    assert got[0].consensus == 1 and got[1].consensus == 1


def test_even_column_scores(spark):
    c = profile.column_counts(cells.to_cells(seqs(spark, "A", "C")))
    assert profile.shannon_track(c).first().score == pytest.approx((1 - 1 / math.log2(20)) * 100)
    assert profile.threshold_track(c).first().score == 50


def test_identity(spark):
    rows = identity.pair_identity(seqs(spark, "ACDE", "ACDE", "FGHI", "ACHI")).collect()
    assert {(r.i, r.j): r.pct for r in rows}[(0, 1)] == 100
    assert {(r.i, r.j): r.pct for r in rows}[(0, 3)] == 50


def test_motif_ranges(spark):
    find = lambda s, p: [(r.u_start, r.u_end) for r in motif.find_motifs(seqs(spark, s), p).orderBy("match_ix").collect()]
    assert find("ACWDE", "CWD") == [(1, 4)]
    assert find("AAAAA", "A{2,4}") == [(0, 4)]
    assert find("A-CAC", "AC") == [(0, 2), (2, 4)]
    assert find("", "A") == []


def test_round_trips_and_edits(spark):
    s = seqs(spark, "A-CD--E", "")
    assert [r.aligned for r in cells.to_rows(cells.to_cells(s)).collect()] == ["A-CD--E"]
    runs = {(r.start, r["count"]) for r in cells.gap_runs(cells.to_cells(s)).collect()}
    assert runs == {(1, 1), (4, 2)}
    a = F.col("aligned")
    r = s.select(cells.insert_gaps(a, F.lit(2), F.lit(3)).alias("i"), cells.delete_gaps(a, F.lit(4), F.lit(5)).alias("d")).first()
    assert (r.i, r.d) == ("A----CD--E", "A-CDE")
    assert spark.range(1).select(canonicalise(F.lit("BZXUO"))).first()[0] == "DEACK"
    assert spark.range(1).select(normalise(F.lit("mkv.~J"))).first()[0] == "MKV--X"


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b"junk\r\n>a\r\nMK\r\nV L\r\n\r\n;b\r\nMKVL\r\n>c\r\n")
    rows = [(r.name, r.residues) for r in read_fasta(spark, str(tmp_path)).orderBy("seq_no").collect()]
    assert rows == [("a", "MKVL"), ("b", "MKVL"), ("c", "")]
