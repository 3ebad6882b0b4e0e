"""Files read by split, patterns by automaton, streamed profiles, scores with X as fallback."""

import random
import re

import pytest

from seqgrid.functions.residues import with_unknown
from seqgrid.operators import conservation, motif, profile, variants
from seqgrid.sources.fasta import read_fasta
from seqgrid.sources.lines import counted, split_lines
from seqgrid.streaming import jobs
from pyspark.sql import functions as F


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fasta_and_lines_over_splits(spark, tmp_path, small_splits):
    r = random.Random(6)
    records = [(f"s{i}", "".join(r.choice("ACDE") for _ in range(r.randrange(90)))) for i in range(40)]
    text = "lost\n" + "".join(f">{n}\n" + "".join(s[k : k + 17] + "\n" for k in range(0, len(s), 17)) for n, s in records)
    (tmp_path / "a.fa").write_text(text)
    found = read_fasta(spark, str(tmp_path))
    assert [(x.name, x.residues) for x in found.orderBy("seq_no").collect()] == records
    lines = split_lines(spark, str(tmp_path)).cache()
    assert lines.select("block").distinct().count() > 5
    got = counted(lines, F.lit(True), "line").orderBy("line").collect()
    assert [x.value for x in got] == text.splitlines() and [x.line for x in got] == list(range(1, len(got) + 1))


def test_patterns_by_automaton(spark):
    r = random.Random(2)
    letters = "ACDEFGHIKL"
    patterns = ["".join(r.choice(letters) for _ in range(r.randrange(1, 4))) for _ in range(300)] + ["A{2,4}", "[^A]", "^A", "E(?:A|N)", "(?:AC){1,3}", "K$", "AC(?:D)E"]
    patterns = list(dict.fromkeys(patterns))
    rows = [("x", i, "".join(r.choice(letters) for _ in range(r.randrange(60)))) for i in range(40)] + [("x", 99, "")]
    seqs = spark.createDataFrame(rows, "aln_id string, row_ix int, aligned string")
    got = {(x.row_ix, x.pattern): x.matches for x in motif.count_motifs(seqs, patterns).collect()}
    assert got == {(i, p): len(re.findall(p, s)) for _, i, s in rows for p in patterns}
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    some = {(x.row_ix, x.pattern): x.matches for x in motif.count_motifs(seqs, table, zeros=False).collect()}
    assert some == {k: n for k, n in got.items() if n}
    assert motif.needed_literal("E(?:A|N)") == "E" and motif.needed_literal("[^A]") == "" and motif.needed_literal("(?:AC){1,3}") == "AC"


def test_streamed_profile_survives_replays(spark, tmp_path):
    rows = [("p" if i % 2 else None, i, "ACD-"[: 1 + i % 4]) for i in range(12)]
    seqs = spark.createDataFrame(rows, "aln_id string, row_ix int, aligned string")
    folder = str(tmp_path / "profile")
    merge = jobs.merge_batch(folder, compact_every=2)
    for k in range(4):
        part = seqs.where(f"row_ix % 4 = {k}")
        merge(part, k)
        if k != 1:
            merge(part, k)  # replayed
    merge(seqs.where("row_ix % 4 = 0"), 0)  # replayed long after its sum was made
    key = lambda x: str((x.aln_id, x.col, list(x.n), x.rows))
    assert sorted(map(key, jobs.profile_so_far(spark, folder).collect())) == sorted(map(key, profile.count_vectors(seqs).collect()))
    want = {(x.aln_id, x.col): x.shannon for x in conservation.scored(profile.count_vectors(seqs), ["shannon"]).collect()}
    assert {(x.aln_id, x.col): x.shannon for x in jobs.scores_so_far(spark, folder, ["shannon"]).collect()} == want
    assert jobs.profile_so_far(spark, str(tmp_path / "none")).count() == 0


def test_codes_that_a_matrix_lacks_take_those_of_x(spark):
    codes = {"W": 19, "G": 6, "X": 23}
    pairs = {("W", "W"): 11, ("G", "G"): 6, ("W", "G"): -2, ("W", "X"): -2, ("G", "X"): -1, ("X", "X"): -1}
    rows = [(codes[a], codes[b], float(s)) for (x, y), s in pairs.items() for a, b in {(x, y), (y, x)}]
    got = {(r.a, r.b): r.s for r in with_unknown(spark.createDataFrame(rows, "a int, b int, s double")).collect()}
    assert len(got) == 27 * 27
    assert got[19, 6] == -2 and got[19, 24] == -2 and got[0, 6] == -1 and got[24, 25] == -1 and got[19, 19] == 11


def test_notes_of_scored_variants(spark):
    sited = spark.createDataFrame([("a", 1, "W", "G", "x", 0, 0), ("a", 2, "W", "-", "x", 0, 0), ("a", 3, "W", "W", "x", 0, 0), ("a", 9, "W", "G", "x", 0, None)], "seq_name string, position int, from_aa string, to_aa string, aln_id string, row_ix int, col int")
    stats = spark.createDataFrame([("x", 0, 19, 0.95)], "aln_id string, col int, consensus int, consensus_frac double")
    track = spark.createDataFrame([("x", 0, 95.0)], "aln_id string, col int, score double")
    scores = spark.createDataFrame([(19, 6, -2.0), (6, 19, -2.0), (19, 19, 11.0), (23, 23, -1.0)], "a int, b int, s double")
    got = {r.position: (r.score, r.note) for r in variants.score_variants(sited, stats, track, scores).collect()}
    assert got[1] == (73, "conserved 95 · W→G radical (score -2)") and got[2] == (87, "conserved 95 · W→gap deletion")
    assert got[3] == (0, "conserved 95 · synonymous (no residue change)") and got[9] == (0, "position not mapped to a column")
