"""Queries of single cells, residue schemes, variants at cells, lanes with features, block edits and pair lookups, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, BACKGROUND, CANONICAL, ungapped_at
from seqgrid.functions.residues import CLASS_OF, GROUP_OF, HYDRO_SCALE, OWN_CLASS, PROPERTY_CLASS, class_scores
from seqgrid.operators import cells as c
from seqgrid.operators import columns, conservation, edits, identity, motif, profile, variants
from seqgrid.plans.bridge import SQL, sequences
from seqgrid.plans.more import _CLAMP, _CODE, _Q, _R, _SCORES, _VARIANTS, _case, rounded, variant_rows

MOTIF = "A{1,2}N"
STEPS = (20, 40, 60)


def _sited(spark: SparkSession, d: str) -> DataFrame:
    """Placed variants; those of even number have a score."""
    ix = F.col("ord")
    return variants.placed(variant_rows(spark, d), sequences(spark, d)).withColumn("score", F.when(ix % 2 == 0, ix * 37 % 101))


def cell_index(spark: SparkSession, d: str) -> DataFrame:
    """The residue number at a place of each row that moves with the row."""
    at = F.col("row_ix") * 7 % 90
    return sequences(spark, d).select("row_ix", at.cast("int").alias("col"), ungapped_at(F.col("aligned"), at.cast("int")).alias("ungapped"))


def running_index(spark: SparkSession, d: str) -> DataFrame:
    return c.row_index(sequences(spark, d))


def fold_inputs(spark: SparkSession, d: str) -> DataFrame:
    return c.fold_inputs(sequences(spark, d)).select("row_ix", F.md5("sequence").alias("sequence"), F.md5("raw").alias("raw"), "substitutions")


def variant_notes(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.long_counts(profile.count_vectors(sequences(spark, d)))
    sited = variants.placed(variant_rows(spark, d), sequences(spark, d))
    return variants.score_variants(sited, profile.column_stats(counts), profile.jsd_track(counts), class_scores(spark)).select("ord", "ref", "note")


def motif_scope(spark: SparkSession, d: str) -> DataFrame:
    return motif.aligned_matches(motif.in_scope(sequences(spark, d), True), MOTIF)


def barcode_features(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d)
    return rounded(conservation.barcode(s, motif.aligned_matches(s, MOTIF)))


def block_edits(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d)
    wide = edits.edit_block(s, s.where("row_ix % 4 = 1"), "insert", 30, 2).withColumnRenamed("changed", "inserted")
    return edits.edit_block(wide, s.where("row_ix % 3 = 0"), "delete", 5, 3).select("row_ix", F.md5("aligned").alias("aligned"), "inserted", F.col("changed").alias("deleted"))


def pair_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each row and those of its alignment whose numbers are greater by one of the steps."""
    s = sequences(spark, d)
    pairs = s.select("aln_id", F.col("row_ix").alias("i"), F.explode(F.array(*[F.col("row_ix") + k for k in STEPS])).alias("j"))
    return rounded(identity.pair_lookup(s, pairs))


def queries() -> dict:
    vectors = lambda s, d: profile.count_vectors(sequences(s, d))
    return {
        "cell_index": cell_index,
        "running_index": running_index,
        "fold_inputs": fold_inputs,
        "scheme_counts": lambda s, d: rounded(columns.scheme_counts(vectors(s, d))),
        "scheme_profile": lambda s, d: rounded(columns.scheme_profile(vectors(s, d))),
        "variants_at": lambda s, d: variants.variants_at(_sited(s, d), "ord"),
        "variant_markers": lambda s, d: variants.markers(_sited(s, d)),
        "variant_notes": variant_notes,
        "motif_scope": motif_scope,
        "barcode_features": barcode_features,
        "block_edits": block_edits,
        "pair_lookup": pair_lookup,
    }


_BAND = "case when score < 34 then 'low' when score < 67 then 'medium' when score is not null then 'high' end"
_RANGES = rf"""lt as (select aln_id, row_ix, grp, list_filter(list_transform(string_split(aligned, ''), lambda x, i: case when x <> '-' then i - 1 end), lambda v: v is not null) as cols,
  string_split(regexp_replace(replace(aligned, '-', ''), '({MOTIF})', '<\1>', 'g'), '<') as parts from seqs),
x as (select *, unnest(range(2, len(parts) + 1)) as k from lt),
rg as (select aln_id, row_ix, grp, (k - 2)::int as match_ix, length(replace(array_to_string(parts[1:k - 1], ''), '>', ''))::int as u_start, (u_start + instr(parts[k], '>') - 1)::int as u_end,
  cols[u_start + 1]::int as col_from, (cols[u_end] + 1)::int as col_to from x)"""


def oracle_sql() -> dict:
    text = lambda table, code: f"case {code} " + " ".join(f"when {ALPHABET.index(a)} then '{v}'" for a, v in table.items()) + " end"
    ranked = " ".join(f"when '{name}' then {k}" for k, name in enumerate(PROPERTY_CLASS))
    lanes = "select aln_id, true as whole, null::varchar as grp, {0} union all select aln_id, false, grp, {1}"
    return {
        "cell_index": SQL + " select row_ix, (row_ix * 7 % 90)::int as col, case when substr(aligned, row_ix * 7 % 90 + 1, 1) not in ('-', '') then length(replace(substr(aligned, 1, row_ix * 7 % 90 + 1), '-', '')) end::int as ungapped from seqs",
        "running_index": SQL + " select aln_id, row_ix, col, case when code > 0 then sum((code > 0)::int) over (partition by aln_id, row_ix order by col) end::bigint as ungapped from cells",
        "fold_inputs": SQL + f" select row_ix, md5(translate(replace(aligned, '-', ''), 'BZXUO*', 'DEACKA')) as sequence, md5(replace(aligned, '-', '')) as raw, length(regexp_replace(replace(aligned, '-', ''), '[{CANONICAL}]', '', 'g'))::int as substitutions from seqs",
        "scheme_counts": SQL + f" select aln_id, code, {text(CLASS_OF, 'code')} as zappo, {_case(OWN_CLASS, 'code')}::int as taylor, {_case(GROUP_OF, 'code', '0')}::int as clustal, {_R(_case(HYDRO_SCALE, 'code'), 'hydropathy')}, sum(n)::bigint as residues from counts group by all",
        "scheme_profile": SQL + f", z as (select aln_id, col, {text(CLASS_OF, 'code')} as k, sum(n) as size from counts where code between 1 and 20 group by all),"
        f" b as (select aln_id, col, first(k order by size desc, case k {ranked} end) as zappo, max(size) as size from z group by all),"
        f" h as (select aln_id, col, sum(n) as total, sum(n * {_case(HYDRO_SCALE, 'code')}) as hydro, count(*)::int as taylor from counts where code between 1 and 20 group by all)"
        f" select h.aln_id, h.col, {_R('hydro / total', 'hydropathy')}, zappo, {_R('size::double / total', 'zappo_share')}, taylor from h join b on h.col = b.col and h.aln_id is not distinct from b.aln_id",
        "variants_at": f"{SQL}, {_VARIANTS}, sc as (select *, case when ord % 2 = 0 then ord * 37 % 101 end as score from pl where col is not null)"
        f" select aln_id, row_ix, col, coalesce(from_aa, wild, '·') as from_aa, to_aa, score, {_BAND} as band from (select *, row_number() over (partition by aln_id, row_ix, col order by ord) as k from sc) where k = 1",
        "variant_markers": f"{SQL}, {_VARIANTS}, sc as (select *, case when ord % 2 = 0 then ord * 37 % 101 else 0 end as score from pl where col is not null)"
        f" select aln_id, row_ix, col, seq_name, position, to_aa, score, {_BAND} as band from sc",
        "variant_notes": f"{SQL}, {_VARIANTS}, q(code, q) as (values {_Q}), {_SCORES},"
        f" jsd as (select aln_id, col, {_CLAMP(f'(sum(p * log2(p / ((p + q) / 2)) / 2 + q * log2(q / ((p + q) / 2)) / 2 - q / 2) + {sum(BACKGROUND.values()) / 2!r}::double) * 100')} as cons from canon join q using (code) group by all),"
        " st as (select aln_id, col, sum(n) as total, max(n) as best, min(code) filter (n = m) as consensus from (select *, max(n) over (partition by aln_id, col) as m from counts) group by all),"
        f" f as (select pl.*, coalesce(jsd.cons, best::double / total * 100) as cons, coalesce({_CODE('from_aa')}, consensus) as a, {_CODE('to_aa')} as b from pl left join st using (aln_id, col) left join jsd using (aln_id, col)),"
        f" g as (select f.*, coalesce(s, -1)::int as s, case when a between 0 and 26 then substr('{ALPHABET}', a + 1, 1) else 'X' end as ref, substr('{ALPHABET}', b + 1, 1) as alt from f left join sc using (a, b))"
        " select ord, ref, case when cons is null then 'position not mapped to a column' else 'conserved ' || floor(cons + 0.5)::int || ' · ' || case when a = b and b <> 0 then 'synonymous (no residue change)' when b = 0 then ref || '→gap deletion'"
        " else ref || '→' || alt || ' ' || case when s >= 1 then 'conservative' when s <= -2 then 'radical' else 'moderate' end || ' (score ' || case when s >= 0 then '+' else '' end || s || ')' end end as note from g",
        "motif_scope": f"{SQL}, {_RANGES}, k as (select aln_id, grp, min(row_ix) as row_ix from seqs where grp is not null group by all)"
        " select aln_id, row_ix, match_ix, u_start, u_end, col_from, col_to from rg where exists (select 1 from k where k.aln_id is not distinct from rg.aln_id and k.row_ix = rg.row_ix and k.grp = rg.grp) or not exists (select 1 from k where k.aln_id is not distinct from rg.aln_id)",
        "barcode_features": f"{SQL}, {_RANGES}, rw as ({lanes.format('count(*) as rows_ from seqs group by 1', 'count(*) from seqs group by all')}),"
        " wd as (select aln_id, max(col) as last from cells group by 1), gr as (select rw.*, unnest(range(0, last + 1))::int as col from rw join wd on rw.aln_id is not distinct from wd.aln_id),"
        f" gc as ({lanes.format('col, code, sum(n) as n from counts group by 1, col, code', 'col, code, count(*) from cells where code > 0 group by all')}),"
        " gs as (select aln_id, whole, grp, col, max(n) as best, sum(n) as total from gc group by all),"
        f" cv as (select distinct aln_id, grp, unnest(range(col_from, col_to))::int as col from rg), ft as ({lanes.format('col from cv group by 1, col', 'col from cv')})"
        f" select gr.aln_id, gr.whole, gr.grp, gr.col, {_R('best::double / total::double * 100', 'conservation')}, {_R('(rows_ - coalesce(total, 0))::double / rows_', 'gap_frac')}, ft.col is not null as feature from gr"
        + "".join(f" left join {t} on {t}.aln_id is not distinct from gr.aln_id and {t}.whole = gr.whole and {t}.grp is not distinct from gr.grp and {t}.col = gr.col" for t in ("gs", "ft")),
        "block_edits": SQL + ", a as (select row_ix, aligned as old, case when row_ix % 4 = 1 then substr(aligned, 1, 30) || '--' || substr(aligned, 31) else aligned end as x from seqs), b as (select *, case when row_ix % 3 = 0 then substr(x, 1, 5) || substr(substr(x, 6), least(length(regexp_extract(substr(x, 6), '^-*')), 3) + 1) else x end as y from a)"
        " select row_ix, md5(y) as aligned, x <> old as inserted, y <> x as deleted from b",
        "pair_lookup": SQL + f", pq as (select a.aln_id, a.row_ix as i, b.row_ix as j, list_zip(string_split(a.aligned, ''), string_split(b.aligned, '')) as z from seqs a join seqs b on a.aln_id is not distinct from b.aln_id and b.row_ix - a.row_ix in {STEPS}),"
        " met as (select aln_id, i, j, list_filter(z, lambda t: coalesce(t[1], '-') <> '-' and coalesce(t[2], '-') <> '-') as z from pq), ct as (select aln_id, i, j, len(list_filter(z, lambda t: t[1] = t[2])) as same, len(z) as compared from met)"
        f" select aln_id, i, j, same, compared, {_R('case when compared > 0 then 100 * same / compared::double else 0 end', 'pct')} from ct",
    }
