"""Clusterings and labels against small known cases."""

import random

import pytest

from seqgrid.operators import clustering, features, labels


@pytest.fixture(scope="module")
def blobs(spark):
    r = random.Random(1)
    rows = [(i, [(0.0 if i < 6 else 9.0) + r.random(), (0.0 if i < 6 else 9.0) + r.random()]) for i in range(12)]
    return spark.createDataFrame(rows, "i int, v array<double>").cache()


def split(df, i="i"):
    got = {r[i]: r["cluster"] for r in df.collect()}
    return [got[k] for k in sorted(got)]


def test_vector_methods_find_two_blobs(blobs):
    assert split(clustering.auto_kmeans(blobs)) == [0] * 6 + [1] * 6
    found, likelihood, parameters = clustering.fit_mixture(blobs, 2)
    assert split(found) == [0] * 6 + [1] * 6 and parameters == 9
    one = clustering.fit_mixture(blobs, 1)[1]
    assert likelihood > one


def test_distance_methods_find_two_blobs(spark, blobs):
    members = blobs.selectExpr("'x' as aln_id", "i as row_ix")
    pairs = features.vector_distances(blobs).selectExpr("'x' as aln_id", "*")
    assert split(clustering.hierarchic(members, pairs), "row_ix") == [0] * 6 + [1] * 6
    peaks = clustering.density_peaks(members, pairs)
    assert split(clustering.peak_clusters(peaks), "row_ix") == [0] * 6 + [1] * 6
    assert peaks.where("denser is null").count() == 1
    two = clustering.hierarchic(members.where("row_ix < 2"), pairs.where("j < 2"))
    assert split(two, "row_ix") == [0, 0]


def test_run_and_layout(spark):
    rows = [("x", i, "g", ("AAAAA" if i % 2 else "WWWWW") + "ACDEF"[i % 3]) for i in range(8)]
    seqs = spark.createDataFrame(rows, "aln_id string, row_ix int, grp string, aligned string")
    for method, criteria in (("hierarchic", ()), ("kmeans", ("composition",)), ("hierarchic", ("length", "hydrophobicity"))):
        got = split(clustering.run_clustering(seqs, method, criteria), "row_ix")
        assert got == [0, 1] * 4, (method, criteria)
    part = seqs.where("row_ix < 6").select("row_ix")
    run = clustering.run_clustering(seqs, "hierarchic", subset=part)
    assert {(r.row_ix, r.cluster) for r in run.where("others").collect()} == {(6, 2), (7, 2)}
    layout = {r.row_ix: (r.group_id, r.name, r.position) for r in clustering.group_layout(run.selectExpr("'x' as aln_id", "*")).collect()}
    assert layout[0] == (0, "Group 1", 0) and layout[1] == (1, "Group 2", 3) and layout[6] == (2, "Others", 6)
    assert split(clustering.run_clustering(seqs.where("row_ix < 3"), "dpc"), "row_ix") == [0, 0, 0]


def test_labels(spark):
    rows = [("x", c, s, 9) for c, s in enumerate([100.0, 98.0, 95.0, 10.0, 8.0, 50.0, 52.0])] + [("x", 7, 99.0, 2), ("x", 8, None, 9), ("y", 0, 5.0, 9), ("y", 1, 5.0, 9), ("z", 0, 5.0, 6), ("z", 1, 7.0, 6)]
    scores = spark.createDataFrame(rows, "aln_id string, col int, score double, total long")
    made = labels.auto_labels(scores)
    got = {(r.aln_id, r.col): r.label for r in made.collect()}
    assert [got["x", c] for c in range(9)] == [2, 2, 2, 0, 0, 1, 1, 0, 0]
    assert got["y", 0] == got["y", 1] == 2 and (got["z", 0], got["z", 1]) == (1, 2)
    tally = {(r.aln_id, r.label): r.columns for r in labels.label_tally(made, scores).collect()}
    assert tally["x", 0] == 3 and tally["x", 2] == 3
