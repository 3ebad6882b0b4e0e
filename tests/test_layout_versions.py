"""Orders, gap layouts, versions, match lists, far variants, moved structures, arriving variants."""

import math

import pytest
from pyspark.sql import functions as F

from seqgrid.functions.residues import class_scores
from seqgrid.operators import layout, motif, profile, rows, structures, variants, versions
from seqgrid.operators.cells import residue_map, to_cells
from seqgrid.streaming.jobs import stream_variants


@pytest.fixture(scope="module")
def seqs(spark):
    data = [("x", 0, "a", "g", "AC-D"), ("x", 1, "b", "g", "A-CD"), ("x", 2, "c", "h", "ACD-"), ("x", 3, "a", "h", "WW--")]
    return spark.createDataFrame(data, "aln_id string, row_ix int, name string, grp string, aligned string")


def test_layout_permutes_named_rows_in_their_places(spark, seqs):
    new = spark.createDataFrame([("x", "c", 0, "--ACD"), ("x", "nobody", 1, "A"), ("x", "a", 2, "A-C-D"), ("x", "b", 3, "ACCD")], "aln_id string, name string, nth int, aligned string")
    got = {r.row_ix: (r.name, r.aligned, r.applied) for r in layout.apply_layout(seqs, new).collect()}
    assert got == {0: ("c", "--ACD", True), 1: ("a", "A-C-D", True), 2: ("b", "A-CD", False), 3: ("a", "WW--", False)}


def test_moved_block(seqs):
    move = lambda to: [r.aligned for r in layout.move_rows(seqs, seqs.where("row_ix in (0, 2)"), to).orderBy("row_ix").collect()]
    assert move(0) == ["AC-D", "ACD-", "A-CD", "WW--"] and move(4) == ["A-CD", "WW--", "AC-D", "ACD-"] and move(2) == ["A-CD", "AC-D", "ACD-", "WW--"]
    order = seqs.select("aln_id", "row_ix", (-F.col("row_ix")).alias("position")).where("row_ix > 1")
    assert [r.aligned for r in layout.in_order(seqs, order).orderBy("row_ix").collect()] == ["WW--", "ACD-", "AC-D", "A-CD"]


def test_versions(spark, seqs, tmp_path):
    v = spark.createDataFrame([(1, "one", None), (2, "two 2", 1), (5, "x", 9)], "version_id int, name string, parent_id int")
    r = seqs.select(F.lit(1).alias("version_id"), "row_ix", "name", "aligned").unionByName(seqs.select(F.lit(2).alias("version_id"), "row_ix", F.lit("z").alias("name"), "aligned"))
    names = {x.name: x.ref for x in versions.name_table(r).collect()}
    assert names == {"a": 0, "b": 1, "c": 2, "z": 3}
    versions.save(v, r, str(tmp_path / "v"))
    back = versions.load(spark, str(tmp_path / "v"), 1)
    assert sorted(back.collect()) == sorted(r.where("version_id = 1").collect())
    v2, r2 = versions.fork(v, r, 2, "copy")
    assert r2.where("version_id = 6").count() == 4 and v2.where("version_id = 6").first().parent_id == 2
    assert versions.remove(v.where("version_id = 1"), 1).count() == 1 and versions.remove(v, 1).count() == 2
    got = [tuple(x) for x in versions.merge(v, v).orderBy("version_id").collect()]
    assert got[3:] == [(6, "one 2", None, 1), (7, "two 3", 6, 2), (8, "x 2", None, 5)]


def test_match_list_goes_round(seqs):
    found = motif.match_list(rows.aligned_motifs(motif.find_motifs(seqs, "C|D"), residue_map(to_cells(seqs))))
    got = sorted((r.nth, r.row_ix, r.col_from, r.next, r.previous) for r in found.collect())
    assert got == [(0, 0, 1, 1, 5), (1, 0, 3, 2, 0), (2, 1, 2, 3, 1), (3, 1, 3, 4, 2), (4, 2, 1, 5, 3), (5, 2, 2, 0, 4)]
    table = seqs.sparkSession.createDataFrame([("C",), ("W",)], "pattern string")
    assert motif.count_motifs(seqs, table).agg(F.sum("matches")).first()[0] == 5


def test_far_positions_and_saturation(spark, seqs):
    long = spark.createDataFrame([("x", 0, "far", "g", "-A" * 60_000 + "W"), ("x", 1, "gaps", "g", "---")], "aln_id string, row_ix int, name string, grp string, aligned string")
    asked = spark.createDataFrame([("far", 50_000), ("far", 60_001), ("far", 60_002), ("far", 1), ("gaps", 1), ("nobody", 1), ("far", 0)], "seq_name string, position int")
    got = {(r.seq_name, r.position): (r.col, r.wild, r.row_ix) for r in variants.placed(asked, long).collect()}
    assert got["far", 50_000] == (99_999, "A", 0) and got["far", 60_001] == (120_000, "W", 0) and got["far", 1] == (1, "A", 0)
    assert got["far", 60_002][0] is None and got["gaps", 1] == (None, None, 1) and got["nobody", 1] == (None, None, -1) and got["far", 0][0] is None
    assert variants.of_known_sequences(asked, long).count() == 6
    scan = variants.saturation(residue_map(to_cells(seqs)), seqs)
    assert scan.count() == 11 * 20
    counts = profile.column_counts(to_cells(seqs))
    scored = variants.score_variants(scan, profile.column_stats(counts), profile.jsd_track(counts), class_scores(spark)).collect()
    assert all(0 <= r.score <= 100 for r in scored)
    known = spark.createDataFrame([("a", 1, "W")], "seq_name string, position int, to_aa string")
    new = spark.createDataFrame([("a", 1, "W", 0), ("a", 2, "W", 1), ("a", 2, "W", 2)], "seq_name string, position int, to_aa string, ord int")
    assert [tuple(r) for r in variants.new_variants(new, known, "ord").collect()] == [("a", 2, "W", 1)]


def test_moved_atoms_and_lines(spark):
    fit = spark.createDataFrame([("m", "r", 3, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0])], "mobile string, ref string, n long, rotation array<double>, shift array<double>")
    atoms = spark.createDataFrame([("m", i, float(i), 2.0, 3.0, 50.0 + i) for i in range(4)] + [("r", i, -1.0, 2.0 + i, 6.0, 40.0) for i in range(3)], "model_id string, residue_ix int, x double, y double, z double, plddt double")
    got = [(r.x, r.y, r.z) for r in structures.transformed(atoms, fit).orderBy("residue_ix").collect()]
    assert got[0] == (-1.0, 2.0, 6.0) and got[3] == (-1.0, 5.0, 6.0)
    pairs = spark.createDataFrame([("m", "r")], "mobile string, ref string")
    devs = structures.deviations(structures.matched(atoms, pairs), fit)
    every = {r.residue_ix: r.dev for r in structures.all_deviations(atoms, devs, fit).collect()}
    assert every[0] == 0 and every[3] is None
    site = structures.mutant_summary(pairs.withColumn("position", F.lit(2)), atoms, devs).first()
    assert site.rmsd == 0 and site.plddt_change == 11 and site.n == 3
    line = "ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00 90.00           C"
    lines = spark.createDataFrame([("m", 0, line), ("m", 1, "TER")], "model_id string, line int, s string")
    out = [r.s for r in structures.transformed_lines(lines, fit).orderBy("line").collect()]
    assert out[0] == line[:30] + "  -1.000   3.000   6.000" + line[54:] and out[1] == "TER" and math.isclose(len(out[0]), len(line))


def test_overview_and_descriptions(seqs):
    got = {(r.x, r.y): r.ch for r in rows.overview(seqs, 2, 2).collect()}
    assert got == {(0, 0): "A", (1, 0): "-", (0, 1): "A", (1, 1): "D"}
    named = {r.ch: r.residue for r in rows.described(to_cells(seqs)).collect()}
    assert named["W"] == "Tryptophan" and named["-"] == "Gap"


def test_arriving_variants_score_as_in_batch(spark, seqs, tmp_path):
    data = spark.createDataFrame([("a", 2, "C", "W"), ("b", 3, None, "E")], "seq_name string, position int, from_aa string, to_aa string")
    counts = profile.column_counts(to_cells(seqs))
    facts = (seqs, profile.column_stats(counts), profile.jsd_track(counts), class_scores(spark))
    data.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    query = stream_variants(arriving, *facts).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table("scored").collect())) == sorted(map(str, stream_variants(data, *facts).collect()))
