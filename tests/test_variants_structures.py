"""Golden cases of variants, patterns, edit logs, trees and structures."""

import math

import pytest
from pyspark.sql import functions as F

from seqgrid.functions.residues import class_scores, read_scores
from seqgrid.operators import columns, conservation, edits, motif, profile, structures, trees, variants
from seqgrid.operators.cells import to_cells
from seqgrid.streaming.jobs import stream_motifs, stream_profile

SEQ = "aln_id string, row_ix int, name string, grp string, aligned string"


def seqs(spark, *rows):
    return spark.createDataFrame([("a", i, f"s{i}", "g", r) for i, r in enumerate(rows)], SEQ)


@pytest.mark.parametrize(
    "source, text, found",
    [("CWD", "ACWDE", ["CWD"]), ("(AC){1,3}", "ACACAC", ["ACACAC"]), ("~(A,T)", "ACT", ["C"]), ("<A", "AA", ["A"]), ("C>", "CC", ["C"]), ("x", "A*", ["A"]), ("B", "BDNA", ["B", "D", "N"]), ("E(A,N)", "EANEN", ["EA", "EN"])],
)
def test_patterns(source, text, found):
    import re

    assert [m.group(0) for m in re.finditer(motif.compile_pattern(source), text)] == found


@pytest.mark.parametrize("source", ["", "A{3,1}", "G-X-G", "A<", "(A", "~(AC)", "()"])
def test_bad_patterns(source):
    with pytest.raises(ValueError):
        motif.compile_pattern(source)


def test_variant_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("name,pos,from,to\ns0,x,A,C\ns0\t2\tW\n# no\n\ns1,3,A,-,two,words\ns1,1,ZZ\ns1,2\n")
    rows = {r.line: r for r in variants.read_variants(spark, str(tmp_path)).collect()}
    assert [rows[i].error for i in sorted(rows)] == ["bad position", None, None, "bad residue", "too few fields"]
    assert (rows[3].position, rows[3].from_aa, rows[3].to_aa) == (2, None, "W")
    assert (rows[6].to_aa, rows[6].label) == ("-", "two words")
    good = variants.read_variants(spark, str(tmp_path)).where("error is null")
    assert sorted(r.value for r in variants.variant_lines(good).collect()) == ["s0,2,,W,", "s1,3,A,-,two words"]


def test_variant_places_and_scores(spark):
    s = seqs(spark, "A-CD--E", "A-CD--W")
    v = spark.createDataFrame([("s0", p, None, "C") for p in (1, 2, 3, 4, 5)] + [("no", 1, None, "A")], "seq_name string, position int, from_aa string, to_aa string")
    sited = variants.placed(v, s)
    assert {(r.seq_name, r.position): (r.col, r.wild, r.row_ix) for r in sited.collect()} == {
        ("s0", 1): (0, "A", 0), ("s0", 2): (2, "C", 0), ("s0", 3): (3, "D", 0), ("s0", 4): (6, "E", 0), ("s0", 5): (None, None, 0), ("no", 1): (None, None, -1),
    }
    counts = profile.column_counts(to_cells(s))
    got = {(r.seq_name, r.position): r for r in variants.score_variants(sited, profile.column_stats(counts), profile.jsd_track(counts), class_scores(spark)).collect()}
    assert got[("s0", 2)].score == 0 and got[("s0", 5)].score == 0 and got[("s0", 3)].kind == "radical" and got[("s0", 3)].score > 33
    twice = v.union(v).withColumn("ord", F.monotonically_increasing_id())
    assert variants.first_of_each(twice, "ord").count() == 6


def test_score_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# note\n   A  C\nA  4 -1\nC -1  9\n")
    assert {(r.a, r.b): r.s for r in read_scores(spark, str(tmp_path)).collect()} == {(1, 1): 4, (1, 2): -1, (2, 1): -1, (2, 2): 9}


def test_scores_of_even_columns(spark):
    s = seqs(spark, "AA-", "AC-", "AD-")
    counts = profile.column_counts(to_cells(s))
    first = lambda df: {r.col: r.score for r in df.collect()}
    assert first(conservation.mean_distance_track(counts, class_scores(spark)))[0] == 100
    assert first(conservation.vector_norm_track(counts, s))[0] == pytest.approx(100)
    liu = first(conservation.liu_track(counts, class_scores(spark)))
    assert liu[0] > liu[1] and set(liu) == {0, 1}
    assert {r.method for r in conservation.all_tracks(counts, s, class_scores(spark)).collect()} >= {"bild", "liu", "jsd"}
    for x in (0.014, 1.0, 7.5, 3e6):
        assert spark.range(1).select(conservation.log_gamma(F.lit(x))).first()[0] == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)


def test_columns(spark):
    s = seqs(spark, "A--K", "A-CK", "V-CE")
    cells = to_cells(s)
    counts = profile.column_counts(cells)
    assert sorted(r.col for r in columns.ungapped_columns(counts, s).collect()) == [0, 3]
    zones = spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "aln_id string, first int, last int")
    assert columns.in_zones(cells, zones).count() == 12
    gone = spark.createDataFrame([("a", 1)], "aln_id string, col int")
    assert sorted({r.col for r in columns.without_gap_only(cells, gone).collect()}) == [0, 1, 2]
    gates = {(r.row_ix, r.col): r.gate for r in columns.gated_groups(cells, counts).collect()}
    assert gates[(0, 0)] == gates[(2, 0)] == 1 and gates[(0, 3)] == 2 and gates[(2, 3)] is None


def test_edit_log(spark):
    log = spark.createDataFrame([("a", 0, 2, "delete", 1, 9), ("a", 0, 1, "insert", 1, 2), ("a", 0, 3, "shift", 0, 2), ("a", 0, 4, "shift", 0, -1)], "aln_id string, row_ix int, seq_no int, op string, col int, count int")
    got = {r.row_ix: r.aligned for r in edits.apply_log(seqs(spark, "A-C", "AC"), log).collect()}
    assert got == {0: "-AC", 1: "AC"}


def test_trees(spark):
    nodes = spark.createDataFrame([("r", None, 0.0), ("x", "r", 2.0), ("y", "r", 2.0), ("a", "x", 1.0), ("b", "x", 1.0), ("c", "y", 1.0), ("d", "y", 1.0)], "node_id string, parent_id string, length double")
    t = trees.tree_stats(nodes).first()
    assert (t.leaves, t.total, t.height, t.mean_branch) == (4, 8, 3, pytest.approx(8 / 6))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("a", "zz")], "a string, b string")
    assert {(r.a, r.b): r.dist for r in trees.patristic(nodes, pairs).collect()} == {("a", "b"): 2, ("a", "c"): 6, ("a", "a"): 0, ("a", "zz"): None}
    turned = {r.node_id: (r.parent_id, r.length) for r in trees.reroot(nodes, "x").collect()}
    assert turned["x"] == (None, 0) and turned["r"] == ("x", 2) and turned["a"] == ("x", 1) and len(turned) == 7
    kids = trees.swapped(trees.ladderize(nodes), "x")
    assert {r.node_id: r.child_ix for r in kids.collect()} == {"x": 0, "y": 1, "a": 1, "b": 0, "c": 0, "d": 1}


def test_superpose(spark):
    points = [(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3), (1, 1, 1), (2, 0, 1), (3, 1, 2)]
    c, s = math.cos(0.7), math.sin(0.7)
    moved = [(c * x - s * y + 3, s * x + c * y - 2, z + 5) for x, y, z in points]
    rows = [(m, i, *map(float, p), None) for m, ps in ((1, points), (2, moved)) for i, p in enumerate(ps)]
    a = spark.createDataFrame(rows, "model_id int, residue_ix int, x double, y double, z double, plddt double")
    met = structures.matched(a, spark.createDataFrame([(1, 2), (1, 9)], "mobile int, ref int"))
    r = structures.rmsd(structures.deviations(met, structures.superpose(met))).collect()
    assert len(r) == 1 and r[0].n == 7 and r[0].rmsd < 1e-6


def test_pdb(spark, tmp_path):
    line = "ATOM      1  CA  ALA A   1    {:8.3f}{:8.3f}{:8.3f}  1.00{:6.2f}           C\n"
    (tmp_path / "m.pdb").write_text(line.format(1.5, 0, 0, 88.1) + line.format(3, 1, 0, 95.3) + "ATOM      2  CB\n")
    rows = structures.read_ca(spark, str(tmp_path)).orderBy("residue_ix").collect()
    assert [(r.x, r.y, r.plddt) for r in rows] == [(1.5, 0, 88.1), (3, 1, 95.3)]


def test_streams(spark, tmp_path):
    for i, t in enumerate(["AC-A", "ACC", ""]):
        spark.createDataFrame([("a", i, f"s{i}", "g", t)], SEQ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(SEQ).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("hits", stream_motifs(arriving, "AC"), "append"), ("prof", stream_profile(arriving), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
    assert spark.table("hits").count() == 2
    assert {(r.col, r.code): r.n for r in spark.table("prof").collect()} == {(0, 1): 2, (1, 2): 2, (2, 2): 1, (3, 1): 1}
