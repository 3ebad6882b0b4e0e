"""Cases that failed, or grew with the square of the input, before round 3's findings were settled."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET
from seqgrid.functions.lineage import cut
from seqgrid.operators import cells, features, identity, newick, profile, tiles
from seqgrid.plans import built, grouped

SEQ = "aln_id string, row_ix int, name string, grp string, aligned string"


def _seqs(spark):
    return spark.createDataFrame([("a", 0, "p", "x", "A--CD-"), ("a", 1, "q", None, ""), (None, 2, "r", "x", "-KX*-")], SEQ)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_cells(spark):
    s = _seqs(spark)
    c = cells.to_cells(s)
    for one, other in ((cells.row_residues(s), cells.residue_map(c)), (cells.row_gap_runs(s), cells.gap_runs(c)), (cells.row_index(s), cells.running_index(c).select("aln_id", "row_ix", "col", "ungapped"))):
        assert one.dtypes == other.dtypes
        key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, other.collect()), key=str)
        assert "Window" not in _plan(one) and "Aggregate" not in _plan(one)


def test_motif_queries_make_no_cells(spark):
    d = "/root/testdata/sf0.001"
    for q in (grouped.motif_coverage, built.match_list):
        assert "posexplode" not in _plan(q(spark, d))


def test_pieces(spark):
    c = cells.to_cells(_seqs(spark))
    for given in (c, c.orderBy(F.desc("col"))):
        assert {(r.row_ix, r.aligned) for r in cells.to_rows(given).collect()} == {(0, "A--CD-"), (2, "-KX*-")}
    batches = list(cells._pieces(iter(c.where("row_ix = 0").select("aln_id", "row_ix", "col", "ch").toArrow().to_batches())))
    assert sum(len(b) for b in batches) == 1


def test_tokens_carry_no_text(spark):
    t = spark.createDataFrame([(1, "((a:1,b:2):1,c:3);"), (2, " ")], "tree_id int, text string")
    df = newick.parse_trees(t)
    assert {r.name for r in df.where("tree_id = 1").collect()} >= {"a", "b", "c"} and df.where("tree_id = 2").isEmpty()
    # The text ends below the step that makes rows of tokens.
    generate = next(x for x in _plan(df).splitlines() if "Generate posexplode" in x)
    assert "text#" not in generate
    assert "regexp_extract_all" not in generate


def _pairs_by_hand(texts: list[str]) -> dict:
    out = {}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            met = [(x, y) for x, y in zip(a, texts[j]) if x != "-" and y != "-"]
            out[i, j] = (sum(x == y for x, y in met), len(met))
    return out


def test_pairs_leave_tasks_whole(spark, monkeypatch):
    monkeypatch.setattr(identity, "BLOCK", 4)
    monkeypatch.setattr(identity, "TILE", 3)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACD-"), n)) for n in (0, 3, 4, 9, 17, 17, 5, 12, 1, 16)]
    s = spark.createDataFrame([("a", k, f"n{k}", "x" if k % 3 else None, t) for k, t in enumerate(texts)] + [(None, 0, "n", None, "AC"), (None, 1, "n", None, "AD")], SEQ)
    found = identity.pair_counts(s)
    by_hand = _pairs_by_hand(texts)
    assert {(r.i, r.j): (r.same, r.compared) for r in found.where("aln_id = 'a'").collect()} == by_hand
    assert [(r.i, r.j, r.same, r.compared) for r in found.where("aln_id is null").collect()] == [(0, 1, 1, 2)]
    # Counts are whole when they leave the task: nothing adds up pairs behind it.
    assert "same#" not in _plan(found).split("MapInArrow")[0] or "Aggregate" not in _plan(found).split("MapInArrow")[0]
    pct = {p: 100 * s / c if c else 0.0 for p, (s, c) in by_hand.items()}
    r = identity.identity_summary(identity.pair_identity(s)).where("aln_id = 'a'").first()
    by_tiles = identity.row_summary(s).where("aln_id = 'a'").first()
    assert (by_tiles.min_i, by_tiles.min_j, by_tiles.max_i, by_tiles.max_j, by_tiles.pairs) == (r.min_i, r.min_j, r.max_i, r.max_j, r.pairs)
    assert (by_tiles.mean, by_tiles.sd) == (pytest.approx(r.mean), pytest.approx(r.sd))
    low, high = min(pct.items(), key=lambda x: (x[1], x[0])), min(pct.items(), key=lambda x: (-x[1], x[0]))
    assert (r.min_i, r.min_j, r.max_i, r.max_j, r.pairs) == (*low[0], *high[0], 45)
    assert r.mean == pytest.approx(np.mean([*pct.values()])) and r.sd == pytest.approx(np.std([*pct.values()]))


def test_partners_by_tiles(spark, monkeypatch):
    from seqgrid.operators import groups

    monkeypatch.setattr(identity, "TILE", 3)
    s = spark.createDataFrame([("a", k, f"n{k}", g, t) for k, (g, t) in enumerate([("x", "AC"), ("x", "AD"), ("y", "AC"), (None, "--"), ("y", "CD"), ("x", "C"), (None, "AD")])] + [("b", 9, "n", "x", "A")], SEQ)
    order = sorted(groups.best_partners(identity.pair_identity(s), s).collect())
    assert sorted(identity.row_partners(s).collect()) == order


class _Seen(tiles.Visitor):
    """How many rows, itself included, a row meets, and in how many packs."""

    def start(self, ids, v, *columns):
        super().start(ids, v, *columns)
        self.rows, self.packs = 0, 0

    def meet(self, ids, v, *columns):
        assert (v[:, 0] == ids).all() and (self.v[:, 0] == self.ids).all()
        self.rows, self.packs = self.rows + len(ids), self.packs + 1

    def end(self):
        return [[self.rows] * len(self.ids), [len(self.ids)] * len(self.ids)]


def test_a_tile_holds_many_packs(spark):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = spark.range(100).select(F.lit("a").alias("aln_id"), F.col("id").alias("row_ix"), F.array(F.col("id").cast("double")).alias("v"))
    rows = rows.unionByName(rows.where("row_ix < 3").withColumn("aln_id", F.lit(None).cast("string")))
    got = tiles.streamed(rows, [], _Seen, "met bigint, own bigint", tile=5, own=4).collect()
    assert len(got) == 103 and {r.met for r in got if r.aln_id == "a"} == {100} and {r.met for r in got if r.aln_id is None} == {3}
    assert max(r.own for r in got) > 5


def test_cut_hands_on_no_estimated_size(spark):
    """Sizes that joins multiply had digits that doubled with each round, until the planner never ended."""
    df = cut(spark.range(50).select(F.col("id").alias("k"), F.lit(None).alias("nothing")))
    for _ in range(4):
        df = cut(df.join(df.select("k", F.col("k").alias("other")), "k").select("k", "nothing"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**40
    assert df.count() == 50 and df.where("nothing is not null").isEmpty()


def test_column_counts_are_handed_on_in_small_batches(monkeypatch):
    """A task handed on all that it held of an alignment as one batch, twice as wide as its longest row."""
    monkeypatch.setattr(profile, "_HELD", 40)
    monkeypatch.setattr(profile, "_HANDED", 4)
    rows = [("a", "ACD" * 5), ("b", "K" * 3), ("a", "A" * 30), (None, ""), ("b", "-" * 9), ("a", "W" * 2)] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["aln_id", "aligned"])
    found, want = {}, {}
    for b in profile._counted(["aln_id"])(iter([batch, batch])):
        assert len(b) <= 4
        for k, col, n in zip(*(b.column(c).to_pylist() for c in ("aln_id", "col", "n")), strict=True):
            found[k, col] = np.add(found.get((k, col), 0), n)
    for k, text in rows * 2:
        for col, code in [(-1, 0), *enumerate(map(ALPHABET.index, text))]:
            want.setdefault((k, col), np.zeros(len(ALPHABET), int))[code] += 1
    assert {k: n.tolist() for k, n in found.items()} == {k: n.tolist() for k, n in want.items()}


def test_composition_reads_a_text_once(spark):
    """Each residue was a pass of its own over the text, made again for the total."""
    rows = spark.createDataFrame([("a", 0, "AAC-X"), (None, 1, ""), ("a", 2, None)], "aln_id string, row_ix int, aligned string")
    df = features.composition(rows)
    assert "replace(" not in _plan(df)
    assert df.dtypes == [("aln_id", "string"), ("row_ix", "int"), ("residue", "string"), ("n", "int"), ("share", "double")]
    found = {(r["row_ix"], r["residue"]): (r["n"], r["share"]) for r in df.collect()}
    assert len(found) == 60 and found[0, "A"] == (2, 2 / 3) and found[0, "C"] == (1, 1 / 3) and found[0, "D"] == (0, 0.0)
    assert found[1, "A"] == (0, 0.0) and found[2, "Y"] == (None, 0.0)
