"""Queries of conservation scores, variants, trees, structures and versions, with their SQL."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, BACKGROUND, CANONICAL, ungap
from seqgrid.functions.residues import CLASS_OF, GROUP_OF, PKA_ENDS, PKA_NEGATIVE, PKA_POSITIVE, POLARITY, VOLUME, class_scores, z_scored
from seqgrid.operators import cells as c
from seqgrid.operators import columns, conservation, edits, features, motif, profile, structures, trees, variants
from seqgrid.plans.bridge import SQL, sequences

PATTERNS = ["E", "AN", "E(?:A|N)", "[^E*]", "A{1,2}", "^E"]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(n, 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return profile.count_vectors(sequences(spark, d))


def _track(spark: SparkSession, d: str, method: str) -> DataFrame:
    return rounded(conservation.track(_vectors(spark, d), method, class_scores(spark)))


def variant_rows(spark: SparkSession, d: str) -> DataFrame:
    """A variant for each document; every 13th names an unknown sequence."""
    ix, s = F.col("row_ix"), sequences(spark, d)
    pos = ix % 40 + 1
    own = F.nullif(F.substring(ungap(F.col("aligned")), pos, F.lit(1)), F.lit(""))
    to = F.when(ix % 11 == 0, "-").otherwise(F.substring(F.lit(CANONICAL), ix * 7 % 20 + 1, F.lit(1)))
    name = F.when(ix % 13 == 0, F.concat(F.lit("nobody_"), ix.cast("string"))).otherwise(F.col("name"))
    return s.select(ix.alias("ord"), name.alias("seq_name"), pos.alias("position"), F.when(ix % 3 != 0, own).alias("from_aa"), to.alias("to_aa"))


def variant_scores(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.long_counts(_vectors(spark, d))
    sited = variants.placed(variant_rows(spark, d), sequences(spark, d))
    return rounded(variants.score_variants(sited, profile.column_stats(counts), profile.jsd_track(counts), class_scores(spark)).drop("ref", "note"))


def atoms(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    xyz = [(F.col("embedding")[k].cast("double") * 10).alias(a) for k, a in enumerate("xyz")]
    order = W.partitionBy("label").orderBy("vec_id")
    return e.select(F.col("label").alias("model_id"), (F.row_number().over(order) - 1).alias("residue_ix"), *xyz, F.when(F.col("vec_id") % 17 != 0, (F.col("vec_id") % 100).cast("double")).alias("plddt"))


def superposed(spark: SparkSession, d: str) -> DataFrame:
    """Each model fitted on the next one."""
    a = atoms(spark, d)
    models = a.select(F.col("model_id").alias("mobile")).distinct()
    met = structures.matched(a, models.withColumn("ref", F.col("mobile") + 1))
    return rounded(structures.rmsd(structures.deviations(met, structures.superpose(met))))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.geo_tree(spark, d)


def patristic_next(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each supplier and the next one."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey")
    pairs = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("b"))
    return rounded(trees.patristic(_tree(spark, d), pairs))


def gated(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a residue."""
    rows = columns.row_gates(sequences(spark, d)).groupBy("row_ix").agg(F.sum("residues").alias("residues"), F.sum("gated").alias("gated"))
    return rows.where("residues > 0")


def edit_log(spark: SparkSession, d: str) -> DataFrame:
    """Three edits for each row, dealt as a log."""
    ix = F.col("row_ix")
    one = lambda n, op, col, k: F.struct(F.lit(n).alias("seq_no"), F.lit(op).alias("op"), col.alias("col"), k.alias("count"))
    log = sequences(spark, d).select("aln_id", "row_ix", F.inline(F.array(one(1, "insert", ix % 20, F.lit(3)), one(2, "delete", ix % 10, F.lit(2)), one(3, "shift", F.lit(0), ix % 3))))
    return edits.apply_log(sequences(spark, d), log).select("row_ix", F.md5("aligned").alias("aligned"))


def queries() -> dict:
    return {
        "vector_norm_track": lambda s, d: _track(s, d, "vector_norm"),
        "bild_track": lambda s, d: _track(s, d, "bild"),
        "mean_distance_track": lambda s, d: _track(s, d, "mean_distance"),
        "liu_track": lambda s, d: _track(s, d, "liu"),
        "multi_track": lambda s, d: _track(s, d, "multi"),
        "ungapped_columns": lambda s, d: columns.ungapped_columns(profile.long_counts(_vectors(s, d)), sequences(s, d)),
        "gated_groups": gated,
        "isoelectric": lambda s, d: rounded(features.isoelectric(sequences(s, d))),
        "variants_placed": lambda s, d: variants.placed(variant_rows(s, d), sequences(s, d)),
        "variant_scores": variant_scores,
        "motif_counts": lambda s, d: motif.count_motifs(sequences(s, d), PATTERNS),
        "edit_log": edit_log,
        "same_residues": lambda s, d: features.same_residues(sequences(s, d)),
        "versions": lambda s, d: features.versions(sequences(s, d)),
        "tree_stats": lambda s, d: rounded(trees.tree_stats(_tree(s, d))),
        "patristic": patristic_next,
        "ladderize": lambda s, d: trees.ladderize(_tree(s, d)),
        "reroot": lambda s, d: trees.reroot(_tree(s, d), "n7"),
        "mean_plddt": lambda s, d: rounded(structures.mean_plddt(atoms(s, d)).withColumn("band", structures.confidence_band(F.col("plddt")))),
        "superpose": superposed,
    }


def _case(table: dict, code: str, default: str = "null") -> str:
    return f"case {code} " + " ".join(f"when {ALPHABET.index(a)} then {v!r}" + ("::double" if isinstance(v, float) else "") for a, v in table.items()) + f" else {default} end"


_R = lambda x, n: f"round({x}, 6) + 0.0::double as {n}"
_CLAMP = lambda x: f"greatest(0, least(100, {x}))"
_Z = [z_scored(VOLUME), z_scored(POLARITY)]
_LOG20 = repr(math.log2(20)) + "::double"
_SCORES = f"""sc as (select a, b, case when a = b then 5.0::double when {_case(CLASS_OF, "a")} = {_case(CLASS_OF, "b")} then 1 else -2 end as s
  from (select unnest(range(1, 21))::int as a) cross join (select unnest(range(1, 21))::int as b))"""
_Q = ", ".join(f"({ALPHABET.index(a)}, {q}::double)" for a, q in BACKGROUND.items())
_TRACKS = f"""rw as (select aln_id, count(*) as rows_ from seqs group by 1), q(code, q) as (values {_Q}), {_SCORES},
thr as (select aln_id, col, max(p) * 100 as score from canon group by all),
sha as (select aln_id, col, {_CLAMP(f"(1 + sum(p * log2(p)) / {_LOG20}) * 100")} as score from canon group by all),
jsd as (select aln_id, col, {_CLAMP(f"(sum(p * log2(p / ((p + q) / 2)) / 2 + q * log2(q / ((p + q) / 2)) / 2 - q / 2) + {sum(BACKGROUND.values()) / 2!r}::double) * 100")} as score from canon join q using (code) group by all),
vn0 as (select aln_id, col, sum(n) as nc, sum(n * v) as v, sum(n * w) as w, sum(n * sqrt(v * v + w * w)) as m
  from (select *, {_case(_Z[0], "code")} as v, {_case(_Z[1], "code")} as w from canon) group by all),
vno as (select aln_id, col, {_CLAMP("nc / rows_::double * (sqrt(v * v + w * w) / m) * 100")} as score from vn0 join rw using (aln_id)),
bil as (select aln_id, col, {_CLAMP(f"(sum(lgamma(n + q) - lgamma(q) - n * ln(q)) - lgamma(sum(n)::double + 1)) / (sum(n)::double * {-math.log(min(BACKGROUND.values()))!r}::double) * 100")} as score
  from canon join q using (code) group by all),
md0 as (select x.aln_id, x.col, x.n, y.n as m, x.code = y.code as same, s, case when x.code = y.code then x.n * (x.n - 1) / 2.0::double else x.n * y.n end as k
  from canon x join canon y on x.aln_id = y.aln_id and x.col = y.col and x.code <= y.code join sc on sc.a = x.code and sc.b = y.code),
mea as (select aln_id, col, case when sum(k) = 0 then 100 else {_CLAMP("(sum(k * s) / sum(k) + 4) / 9 * 100")} end as score from md0 group by all),
li0 as (select aln_id, col, a, sum(p * s) as x from canon join sc on sc.b = canon.code where s > 0 group by all),
liu as (select aln_id, col, {_CLAMP(f"(1 + sum(x / t * log2(x / t)) / {_LOG20}) * 100")} as score from (select *, sum(x) over (partition by aln_id, col) as t from li0) group by all)"""
_TREE = """
with recursive nodes as (
  select 'root' as node_id, null as parent_id, 0.0::double as length
  union all select 'r' || r_regionkey, 'root', (r_regionkey % 7 + 1) * 0.5::double from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, (n_nationkey % 7 + 1) * 0.5::double from nation
  union all select 's' || s_suppkey, 'n' || s_nationkey, (s_suppkey % 7 + 1) * 0.5::double from supplier
),
up as (select node_id, node_id as anc, 0.0::double as dist from nodes
  union all select u.node_id, n.parent_id, u.dist + n.length from up u join nodes n on u.anc = n.node_id where n.parent_id is not null),
leaf as (select node_id from nodes where node_id not in (select parent_id from nodes where parent_id is not null))"""
_VARIANTS = f"""vr as (select row_ix as ord, case when row_ix % 13 = 0 then 'nobody_' || row_ix else name end as seq_name, row_ix % 40 + 1 as position,
  case when row_ix % 3 <> 0 then nullif(substr(replace(aligned, '-', ''), row_ix % 40 + 1, 1), '') end as from_aa,
  case when row_ix % 11 = 0 then '-' else substr('{CANONICAL}', row_ix * 7 % 20 + 1, 1) end as to_aa from seqs),
rm as (select aln_id, row_ix, col, ch, row_number() over (partition by aln_id, row_ix order by col) as pos from cells where code > 0),
pl as (select ord, seq_name, position, from_aa, to_aa, s.aln_id, coalesce(s.row_ix, -1) as row_ix, rm.col, rm.ch as wild
  from vr left join seqs s on s.name = seq_name left join rm on rm.aln_id = s.aln_id and rm.row_ix = s.row_ix and rm.pos = position)"""
_CODE = lambda x: f"instr('{ALPHABET}', {x})::int - 1"
_CHARGE = " + ".join(
    [f"1 / (1 + pow(10.0::double, mid - {PKA_ENDS[0]})) - 1 / (1 + pow(10.0::double, {PKA_ENDS[1]} - mid))"]
    + [f"n_{a} / (1 + pow(10.0::double, mid - {k}))" for a, k in PKA_POSITIVE.items()]
    + [f"-n_{a} / (1 + pow(10.0::double, {k} - mid))" for a, k in PKA_NEGATIVE.items()]
)
_IONS = [*PKA_POSITIVE, *PKA_NEGATIVE]
_ANY = " + ".join(f"(length(aligned) - length(replace(aligned, '{a}', '')))" for a in CANONICAL)


def oracle_sql() -> dict:
    track = lambda name: f"{SQL}, {_TRACKS} select aln_id, col, {_R('score', 'score')} from {name}"
    union = " union all ".join(f"select * from {t}" for t in ("thr", "sha", "jsd", "vno", "bil", "mea", "liu"))
    splice = "substr(aligned, 1, row_ix % 20) || repeat('-', 3) || substr(aligned, row_ix % 20 + 1)"
    counted = ", ".join(f"(length(aligned) - length(replace(aligned, '{a}', '')))::double as n_{a}" for a in _IONS)
    pats = " union all ".join(f"select row_ix, '{p}' as pattern, len(regexp_extract_all(u, '{p}'))::int as matches from u" for p in PATTERNS)
    return {
        "vector_norm_track": track("vno"),
        "bild_track": track("bil"),
        "mean_distance_track": track("mea"),
        "liu_track": track("liu"),
        "multi_track": f"{SQL}, {_TRACKS} select aln_id, col, {_R('avg(score)', 'score')} from ({union}) group by aln_id, col",
        "ungapped_columns": SQL + ", rw as (select aln_id, count(*) as r from seqs group by 1) select aln_id, col from counts join rw using (aln_id) group by aln_id, col, r having sum(n) = r",
        "gated_groups": SQL + f", g as (select row_ix, {_case(GROUP_OF, 'code', '0')} as g, aln_id, col from cells where code > 0), s as (select *, count(*) over (partition by aln_id, col) as t, count(*) over (partition by aln_id, col, g) as k from g)"
        " select row_ix, count(*) as residues, count(*) filter (g > 0 and k >= 0.5 * t) as gated from s group by 1",
        "isoelectric": SQL + f", n as (select row_ix, {_ANY} as len, {counted} from seqs), b(row_ix, step, lo, hi) as (select row_ix, 0, 0.0::double, 14.0::double from n"
        f" union all select row_ix, step + 1, case when {_CHARGE} > 0 then mid else lo end, case when {_CHARGE} > 0 then hi else mid end"
        f" from (select b.*, (lo + hi) / 2 as mid, {', '.join('n_' + a for a in _IONS)} from b join n using (row_ix) where step < 60))"
        f" select row_ix, {_R('case when len = 0 then 7 else (lo + hi) / 2 end', 'pi')} from b join n using (row_ix) where step = 60",
        "variants_placed": f"{SQL}, {_VARIANTS} select * from pl",
        "variant_scores": f"{SQL}, {_VARIANTS}, q(code, q) as (values {_Q}), {_SCORES},"
        f" jsd as (select aln_id, col, {_CLAMP(f'(sum(p * log2(p / ((p + q) / 2)) / 2 + q * log2(q / ((p + q) / 2)) / 2 - q / 2) + {sum(BACKGROUND.values()) / 2!r}::double) * 100')} as cons from canon join q using (code) group by all),"
        " st as (select aln_id, col, sum(n) as total, max(n) as best, min(code) filter (n = m) as consensus from (select *, max(n) over (partition by aln_id, col) as m from counts) group by all),"
        f" f as (select pl.*, coalesce(jsd.cons, best::double / total * 100) as cons, coalesce({_CODE('from_aa')}, consensus) as a, {_CODE('to_aa')} as b from pl left join st using (aln_id, col) left join jsd using (aln_id, col)),"
        " g as (select f.*, coalesce(s, -1) as s from f left join sc using (a, b)),"
        " h as (select *, case when cons is null then 0 else floor(100 * case when b = 0 then 0.9::double when a = b then 0 else greatest(0, least(1, (4 - s) / 8)) end * (0.35::double + 0.65::double * cons / 100) + 0.5::double) end::bigint as score from g)"
        " select ord, seq_name, position, from_aa, to_aa, aln_id, row_ix, col, wild, score, case when cons is null then 'unplaced' when b = 0 then 'deletion' when a = b then 'same' when s >= 1 then 'conservative' when s <= -2 then 'radical' else 'moderate' end as kind,"
        f" {_R('coalesce(cons / 100, 0)', 'confidence')}, case when score < 34 then 'low' when score < 67 then 'medium' else 'high' end as band from h",
        "motif_counts": SQL + f", u as (select row_ix, replace(aligned, '-', '') as u from seqs) {pats}",
        "edit_log": SQL + f", a as (select row_ix, {splice} as x from seqs), b as (select row_ix, substr(x, 1, row_ix % 10) || substr(substr(x, row_ix % 10 + 1), least(length(regexp_extract(substr(x, row_ix % 10 + 1), '^-*')), 2) + 1) as x from a)"
        " select row_ix, md5(repeat('-', row_ix % 3) || x) as aligned from b",
        "same_residues": SQL + " select md5(replace(aligned, '-', '')) as residues, min(row_ix) as first_row, count(*) as copies from seqs group by 1",
        "versions": SQL + " select aln_id, count(*) as sequences, arg_min(length(aligned), row_ix)::int as columns from seqs group by 1",
        "tree_stats": _TREE + f" select {_R('sum(length) filter (parent_id is not null)', 'total')}, {_R('avg(length) filter (parent_id is not null)', 'mean_branch')}, (select count(*) from leaf) as leaves, (select max(dist) from up) as height from nodes",
        "patristic": _TREE + f", pr as (select 's' || s_suppkey as a, 's' || (s_suppkey + 1) as b from supplier) select a, b, {_R('min(x.dist + y.dist)', 'dist')} from pr left join up x on x.node_id = a left join up y on y.node_id = b and y.anc = x.anc group by a, b",
        "ladderize": _TREE + ", tips as (select anc as node_id, count(*) as tips from up where node_id in (select node_id from leaf) group by 1) select node_id, parent_id, (row_number() over (partition by parent_id order by tips desc, node_id) - 1)::int as child_ix from nodes join tips using (node_id) where parent_id is not null",
        "reroot": _TREE + ", p as (select anc as node_id from up where node_id = 'n7') select * from nodes where node_id not in (select node_id from p) union all select parent_id, node_id, length from nodes where node_id in (select node_id from p) and parent_id is not null union all select 'n7', null, 0.0",
        "mean_plddt": f"select *, case when plddt >= 90 then 'very high' when plddt >= 70 then 'high' when plddt >= 50 then 'low' when plddt is not null then 'very low' end as band from (select label as model_id, {_R('avg(case when vec_id % 17 <> 0 then (vec_id % 100)::double end)', 'plddt')}, count(*) as residues from embeddings group by 1)",
    }
