"""Distances by tiles, clusterings beyond one task and count tables, against plain loops."""

import math

import numpy as np
import pytest

from seqgrid.functions.alphabet import ALPHABET
from seqgrid.functions.residues import class_scores
from seqgrid.operators import cells, clustering, conservation, features, groups, profile, tiles


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    return {a: np.concatenate([rng.normal(c, 1.0, (n, 3)) for c in (0.0, 6.0, 13.0)]) for a, n in (("x", 40), ("y", 9))}


@pytest.fixture(scope="module")
def vectors(spark, points):
    rows = [(a, i, [float(x) for x in v]) for a, m in points.items() for i, v in enumerate(m)] + [("x", 900, None)]
    return spark.createDataFrame(rows, "aln_id string, row_ix int, v array<double>").cache()


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles.streamed, "__defaults__", (16,))


def labels_of(df, aln):
    got = {r.row_ix: r.cluster for r in df.collect() if r.aln_id == aln}
    return [got[k] for k in sorted(got)]


def plain_linkage(d):
    """Labels by average linkage over means of all pairs, cut before the first largest rise."""
    parts, heights, states = [[i] for i in range(len(d))], [], []
    while len(parts) > 1:
        height, i, j = min((d[np.ix_(parts[i], parts[j])].mean(), i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)))
        states.append([list(p) for p in parts])
        heights.append(height)
        parts[i] += parts.pop(j)
    k = int(np.argmax(np.diff(heights))) + 1
    label = np.zeros(len(d), int)
    for n, p in enumerate(sorted(states[k], key=min)):
        label[p] = n
    return label.tolist()


@pytest.mark.parametrize("task_rows", [2000, 20])
def test_linkage_in_one_task_and_in_rounds(spark, vectors, points, small_tiles, task_rows):
    found = clustering.hierarchic_vectors(vectors, task_rows).cache()
    for a, m in points.items():
        assert labels_of(found, a) == plain_linkage(tiles.euclid(m, m))
    members = vectors.where("v is not null").select("aln_id", "row_ix")
    pairs = features.euclidean(vectors.where("v is not null").selectExpr("aln_id as label", "row_ix as vec_id", "v as embedding")).withColumnRenamed("label", "aln_id")
    assert sorted(clustering.hierarchic(members, pairs, task_rows).collect()) == sorted(found.collect())


def test_silhouettes_of_many_labellings(vectors, points, small_tiles):
    labelled = vectors.selectExpr("*", "array(row_ix % 2, row_ix % 3, 0) as clusters")
    got = {(r.aln_id, r.nth): r.silhouette for r in clustering.silhouettes(labelled).collect()}
    for a, m in points.items():
        d = tiles.euclid(m, m)
        for nth, k in enumerate((2, 3)):
            c = np.arange(len(m)) % k
            s = []
            for i in range(len(m)):
                own = (c == c[i]) & (np.arange(len(m)) != i)
                x, y = d[i, own].mean(), min(d[i, c == o].mean() for o in range(k) if o != c[i])
                s.append((y - x) / max(x, y))
            assert got[a, nth] == pytest.approx(np.mean(s))
        assert got[a, 2] == -1.0


def test_auto_kmeans_by_tiles(vectors):
    one = vectors.where("aln_id = 'x' and v is not null").selectExpr("row_ix as i", "v")
    got = {r.i: r.cluster for r in clustering.auto_kmeans(one).collect()}
    assert [got[i] for i in range(120)] == [0] * 40 + [1] * 40 + [2] * 40


def test_density_peaks_of_pairs_and_of_tiles(vectors, small_tiles):
    members = vectors.where("v is not null").select("aln_id", "row_ix")
    pairs = features.euclidean(vectors.where("v is not null").selectExpr("aln_id as label", "row_ix as vec_id", "v as embedding")).withColumnRenamed("label", "aln_id")
    a = sorted(clustering.density_peaks(members, pairs).collect())
    b = sorted(clustering.vector_density_peaks(vectors).collect())
    assert len(a) == len(b) == 147
    for x, y in zip(a, b, strict=True):
        assert (x.aln_id, x.row_ix, x.rank, x.denser) == (y.aln_id, y.row_ix, y.rank, y.denser)
        assert x.rho == pytest.approx(y.rho) and x.delta == pytest.approx(y.delta)


def test_equal_points_and_single_rows(spark):
    rows = [("e", i, [1.0, 2.0]) for i in range(8)] + [("s", 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "aln_id string, row_ix int, v array<double>")
    got = {(r.aln_id, r.row_ix): (r.rho, r.delta) for r in clustering.vector_density_peaks(df).collect()}
    assert got["e", 3] == (7.0, 0.0) and got["s", 0] == (0.0, 0.0)
    assert labels_of(clustering.hierarchic_vectors(df), "s") == [0]


def test_counts_of_arrays_equal_those_of_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(["p", "q", None][i % 3], i, [None, "g", "h"][i % 4 % 3], "".join(rng.choice(list(ALPHABET), rng.integers(0, 50)))) for i in range(60)]
    s = spark.createDataFrame(rows, "aln_id string, row_ix int, grp string, aligned string")
    vectors = profile.count_vectors(s, "grp")
    key = lambda r: str((r.aln_id, r.grp, r.col, r.code, r.n))
    assert sorted(map(key, profile.long_counts(vectors).collect())) == sorted(map(key, profile.column_counts(cells.to_cells(s), "grp").collect()))
    assert {(r.aln_id, r.grp): r.rows for r in vectors.collect()} == {(a, g): sum((x[0], x[2]) == (a, g) for x in rows) for a, g in {(x[0], x[2]) for x in rows}}
    whole = profile.merged_counts(vectors, "aln_id").collect()
    assert sum(sum(r.n) for r in whole) == sum(len(x[3]) for x in rows) and {r.rows for r in whole} == {20}


def test_scores_equal_those_of_the_expressions(spark):
    rng = np.random.default_rng(3)
    rows = [("p", i, "g", "".join(rng.choice(list(ALPHABET), 40))) for i in range(30)]
    s = spark.createDataFrame(rows, "aln_id string, row_ix int, grp string, aligned string")
    counts = profile.column_counts(cells.to_cells(s)).cache()
    scores = class_scores(spark)
    want = {"multi": conservation.multi_track(counts, s, scores)}
    want |= {m: conservation.all_tracks(counts, s, scores).where(f"method = '{m}'") for m in conservation.METHODS}
    got = conservation.scored(profile.count_vectors(s), [*conservation.METHODS, "multi"], scores).collect()
    for m, df in want.items():
        by = {r.col: r.score for r in df.collect()}
        assert len(by) == len(got) == 40
        assert all(r[m] == pytest.approx(by[r.col], abs=1e-9) for r in got)


def test_job_of_a_small_matrix(spark):
    rows = [("m", i, g, x) for i, (g, x) in enumerate([("a", "AA--"), ("a", "ACC-"), ("b", "AD--")])]
    s = spark.createDataFrame(rows, "aln_id string, row_ix int, grp string, aligned string")
    got = conservation.conservation_job(s, ["threshold", "shannon"]).collect()
    totals = {r.col: r.total for r in got if r.whole and r.method == "shannon"}
    assert totals == {0: 3, 1: 3, 2: 1, 3: 0}
    first = {(r.whole, r.grp): r.score for r in got if r.method == "threshold" and r.col == 0}
    assert first == {(True, None): 100.0, (False, "a"): 100.0, (False, "b"): 100.0}
    assert {r.label for r in got if r.whole} == {0} and {r.label for r in got if not r.whole} == {None}


def test_silhouette_of_pairs_still_agrees(vectors):
    pairs = features.euclidean(vectors.where("v is not null").selectExpr("aln_id as label", "row_ix as vec_id", "v as embedding")).withColumnRenamed("label", "aln_id")
    members = vectors.where("v is not null").selectExpr("aln_id", "row_ix as i", "row_ix % 2 as cluster")
    want = {r.aln_id: r.silhouette for r in groups.silhouette(pairs, members, "aln_id").collect()}
    got = {r.aln_id: r.silhouette for r in clustering.silhouettes(vectors.selectExpr("*", "array(row_ix % 2) as clusters")).collect()}
    assert all(math.isclose(got[a], want[a], abs_tol=1e-9) for a in want)
