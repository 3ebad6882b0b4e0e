"""Single cells, residue schemes, variants at cells, lanes with features, block edits and pair lookups, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, CANONICAL, HYDROPATHY, ungapped_at
from seqgrid.functions.residues import CLASS_OF, GROUP_OF, PROPERTY_CLASS
from seqgrid.operators import cells, columns, conservation, edits, identity, motif, profile, variants

SEQ = "aln_id string, row_ix int, name string, grp string, aligned string"


def random_rows(seed, n=24, letters="-AACDN*XB"):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(letters) for _ in range(r.choice([0, 1, 7, 40, 61])))
    return [(r.choice(["x", "y", None]), i, f"s{i}", r.choice(["g", "h", None]), text()) for i in range(n)]


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return random_rows(request.param)


@pytest.fixture(scope="module")
def seqs(spark, rows):
    return spark.createDataFrame(rows, SEQ).repartition(3)


def test_residue_numbers(spark, seqs, rows):
    want = {(i, k): len(t[: k + 1].replace("-", "")) if ch != "-" else None for _, i, _, _, t in rows for k, ch in enumerate(t)}
    got = {(r.row_ix, r.col): r.ungapped for r in cells.running_index(cells.to_cells(seqs)).collect()}
    assert got == want
    asked = seqs.select("row_ix", F.explode(F.sequence(F.lit(-2), F.lit(70))).alias("col"), "aligned").select("row_ix", "col", ungapped_at(F.col("aligned"), F.col("col")).alias("u"))
    assert all(r.u == want.get((r.row_ix, r.col)) for r in asked.collect())


def test_fold_inputs(seqs, rows):
    stand = {"B": "D", "Z": "E", "X": "A", "U": "C", "O": "K", "*": "A"}
    got = {r.row_ix: (r.sequence, r.raw, r.substitutions) for r in cells.fold_inputs(seqs).collect()}
    for _, i, _, _, t in rows:
        raw = t.replace("-", "")
        assert got[i] == ("".join(stand.get(a, a) for a in raw), raw, sum(a in stand for a in raw))


def test_schemes(seqs, rows):
    vectors = profile.count_vectors(seqs)
    got = {(r.aln_id, r.code): r for r in columns.scheme_counts(vectors).collect()}
    for aln in {r[0] for r in rows}:
        text = "".join(r[4] for r in rows if r[0] == aln)
        for a in set(text) - {"-"}:
            r = got[aln, ALPHABET.index(a)]
            assert (r.residues, r.zappo, r.clustal) == (text.count(a), CLASS_OF.get(a), GROUP_OF.get(a, 0))
            assert r.taylor == (CANONICAL.index(a) + 1 if a in CANONICAL else None)
            assert r.hydropathy == (pytest.approx((HYDROPATHY[a] + 4.5) / 9) if a in CANONICAL else None)
    found = {(r.aln_id, r.col): r for r in columns.scheme_profile(vectors).collect()}
    want = 0
    for aln in {r[0] for r in rows}:
        own = [r[4] for r in rows if r[0] == aln]
        for k in range(max(map(len, own))):
            column = [t[k] for t in own if k < len(t) and t[k] in CANONICAL]
            if not column:
                assert (aln, k) not in found
                continue
            want += 1
            r, sizes = found[aln, k], {c: sum(a in m for a in column) for c, m in PROPERTY_CLASS.items()}
            best = max(sizes, key=sizes.get)
            assert (r.zappo, r.taylor) == (best, len(set(column))) and r.zappo_share == pytest.approx(sizes[best] / len(column))
            assert r.hydropathy == pytest.approx(sum((HYDROPATHY[a] + 4.5) / 9 for a in column) / len(column))
    assert len(found) == want


def spans(text, regex):
    at = [k for k, ch in enumerate(text) if ch != "-"]
    return [(m.start(), m.end(), at[m.start()], at[m.end() - 1] + 1) for m in re.finditer(regex, text.replace("-", "")) if m.group()]


@pytest.mark.parametrize("regex", ["A{1,2}N", "A+", "Q", "^A", "D*"])
def test_matches_on_columns(seqs, rows, regex):
    got = sorted((r.row_ix, r.match_ix, r.u_start, r.u_end, r.col_from, r.col_to) for r in motif.aligned_matches(seqs, regex).collect())
    assert got == sorted((i, k, *s) for _, i, _, _, t in rows for k, s in enumerate(spans(t, regex)))


def test_scope(spark, seqs, rows):
    assert motif.in_scope(seqs, False).count() == len(rows)
    first = {}
    for aln, i, _, grp, _ in rows:
        if grp is not None:
            first.setdefault((aln, grp), i)
    assert sorted(r.row_ix for r in motif.in_scope(seqs, True).collect()) == sorted(first.values())
    bare = spark.createDataFrame([("x", 0, "a", "g", "A"), ("x", 1, "b", "g", "A"), ("z", 2, "c", None, "A"), ("z", 3, "d", None, "A"), (None, 4, "e", None, "A")], SEQ)
    assert sorted(r.row_ix for r in motif.in_scope(bare, True).collect()) == [0, 2, 3, 4]


def test_barcode(seqs, rows):
    got = {(r.aln_id, r.whole, r.grp, r.col): (r.conservation, r.gap_frac, r.feature) for r in conservation.barcode(seqs, motif.aligned_matches(seqs, "A{1,2}N")).collect()}
    want = {}
    for aln in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == aln]
        for whole, grp in [(True, None), *((False, g) for g in {r[3] for r in own})]:
            lane = [r[4] for r in own if whole or r[3] == grp]
            for k in range(max(len(r[4]) for r in own)):
                column = [t[k] for t in lane if k < len(t) and t[k] != "-"]
                most = max((column.count(a) for a in column), default=None)
                feature = any(a <= k < b for t in lane for _, _, a, b in spans(t, "A{1,2}N"))
                want[aln, whole, grp, k] = (most and pytest.approx(100 * most / len(column)), pytest.approx(1 - len(column) / len(lane)), feature)
    assert got == want
    assert {r.feature for r in conservation.barcode(seqs).collect()} == {None}
    assert conservation.barcode(seqs.limit(0)).count() == 0


def test_variants_at_cells(spark):
    s = spark.createDataFrame([("x", 0, "a", "g", "A-CD")], SEQ)
    v = [(0, "a", 2, None, "W", None), (1, "a", 2, "Q", "Y", 80), (2, "a", 3, None, "-", 33), (3, "a", 9, None, "W", 5), (4, "nobody", 1, None, "W", 5), (5, "a", 1, None, "C", 67)]
    sited = variants.placed(spark.createDataFrame(v, "ord int, seq_name string, position int, from_aa string, to_aa string, score int"), s)
    assert {(r.col, r.from_aa, r.to_aa, r.score, r.band) for r in variants.variants_at(sited, "ord").collect()} == {(2, "C", "W", None, None), (3, "D", "-", 33, "low"), (0, "A", "C", 67, "high")}
    assert sorted((r.col, r.to_aa, r.score, r.band) for r in variants.markers(sited).collect()) == [(0, "C", 67, "high"), (2, "W", 0, "low"), (2, "Y", 80, "high"), (3, "-", 33, "low")]


def test_block_edits(spark):
    s = spark.createDataFrame([("x", 0, "a", "g", "AC--D"), ("x", 1, "b", "g", "A"), (None, 0, "c", "g", "AC-D"), ("x", 2, "d", "g", "ACDEF")], SEQ)
    chosen = spark.createDataFrame([("x", 0), ("x", 0), ("x", 1), (None, 0)], "aln_id string, row_ix int")
    run = lambda *a: {r.name: (r.aligned, r.changed) for r in edits.edit_block(s, chosen, *a).collect()}
    assert run("insert", 2, 2) == {"a": ("AC----D", True), "b": ("A--", True), "c": ("AC---D", True), "d": ("ACDEF", False)}
    assert run("delete", 2, 3) == {"a": ("ACD", True), "b": ("A", False), "c": ("ACD", True), "d": ("ACDEF", False)}
    with pytest.raises(ValueError):
        edits.edit_block(s, chosen, "turn", 0)


def test_pair_lookup(spark, seqs, rows):
    asked = [(a, i, j) for a, i, *_ in rows for j in (i, i + 1, i + 3)]
    got = {(r.aln_id, r.i, r.j): (r.same, r.compared, r.pct) for r in identity.pair_lookup(seqs, spark.createDataFrame([*asked, *asked], "aln_id string, i int, j int")).collect()}
    text = {(r[0], r[1]): r[4] for r in rows}
    want = {}
    for a, i, j in asked:
        if (a, j) in text:
            met = [(x, y) for x, y in zip(text[a, i], text[a, j], strict=False) if x != "-" and y != "-"]
            same = sum(x == y for x, y in met)
            want[a, i, j] = (same, len(met), pytest.approx(100 * same / len(met)) if met else 0.0)
    assert got == want


def test_columns_move_up(seqs, rows):
    c = cells.to_cells(seqs)
    got = {(r.row_ix, r.col): r.ch for r in columns.without_gap_only(c, cells.gap_only_columns(c)).collect()}
    want = {}
    for aln in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == aln]
        kept = [k for k in range(max(len(r[4]) for r in own)) if any(k < len(r[4]) and r[4][k] != "-" for r in own)]
        want |= {(i, n): t[k] for _, i, _, _, t in own for n, k in enumerate(kept) if k < len(t)}
    assert got == want
