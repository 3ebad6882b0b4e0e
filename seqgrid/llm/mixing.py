"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget of words by weight; no source goes beyond MAX_COPIES times its own size,
and what it can't take is shared again by weight. Each document of a source is taken in whole
copies as far as the source's ratio has whole parts (certain copies). The rest of the target is a
sample without replacement: a document gets an inclusion probability, a uniform number from a
hash of its id, and the rank "odds of the number over odds of inclusion"; the lowest ranks are
taken until the words left to the source are used up. Long documents get lower inclusion odds
than short ones, so that the last words are spread over more documents. A document that would go
beyond the target is passed over; PASSES further passes offer the words still left to the next
ranks that fit.

The running sums that the cut needs don't gather a source in one task: words are summed per
log-spaced bucket of ranks first (a partial aggregation), and only the bucket in which a source's
words run out is ordered row by row. What the passes decide is a row per source.

Nulls, ties and edges: null or empty text has size 0 and is taken with the certain copies only;
null source sorts last; a null id draws its number from the text's hash; equal ids draw equal
numbers, and ties go to the smaller size; repeated rows are separate documents that are sampled
together or not at all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqgrid.llm.common import extra_columns_apart, materialize, table, word_array

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_COPIES = 2
PASSES = 3
BUCKETS_PER_OCTAVE = 256
SEED = "mix-1"


def sizes(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """(doc_id, source, size, u): words, and a uniform number in (0, 1) from the id."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), key)), 1, 12), 16, 10).cast("long")
    return docs.select(
        "doc_id",
        "source",
        F.size(word_array(F.col("text"))).cast("long").alias("size"),
        ((bits.cast("double") + 0.5) / F.lit(float(2**48))).alias("u"),
        *([keep] if keep else []),
    )


def targets(sized: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, target), a row per source.

    Filling by weight with a cap: in order of cap over weight, the first source that stays under
    its cap fixes the level for itself and all after it. The windows are over source totals.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(x) for x in WEIGHTS])
    per = per.withColumn(
        "weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    ).withColumn("cap", MAX_COPIES * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn(
        "left",
        F.sum("source_size").over(W.partitionBy()) * (BUDGET_PERCENT / 100.0)
        - F.coalesce(F.sum("cap").over(before), F.lit(0)),
    ).withColumn("shares", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("level", F.col("left") / F.col("shares"))
    open_ = F.col("cap") > F.col("level") * F.col("weight")
    per = per.withColumn("fixed", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "level"))).over(W.partitionBy())["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def _placed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins each document to its source's row of the plan; adds rank and took."""
    right = plan.withColumnRenamed("source", "_source")
    df = sized.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    tilt = 2 * F.col("mean") / (F.col("mean") + F.col("size"))
    p = F.greatest(F.least(F.col("share") * tilt, F.lit(0.999)), F.lit(1e-6))
    p = F.when(F.col("size") > 0, p).otherwise(0.5)
    df = df.withColumn("rank", (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    at = F.struct("rank", "size", F.col("doc_id").alias("id"))
    took = F.exists(
        F.col("cuts"),
        lambda c: (F.col("size") <= c["fits"]) & (c["first_out"].isNull() | (at < c["first_out"])),
    )
    return df.withColumn("took", (F.col("size") > 0) & took)


def _next_cut(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with one more cut: where, among what is still open and fits, the words run out."""
    df = _placed(sized, plan).where(~F.col("took") & (F.col("size") > 0) & (F.col("size") <= F.col("rest")))
    df = df.select(
        "source", "doc_id", "size", "rank", "rest",
        F.floor(F.log2("rank") * BUCKETS_PER_OCTAVE).alias("bucket"),
    )
    counts = df.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    upto = counts.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
    over = F.col("upto") > F.col("rest")
    found = upto.groupBy(F.col("source").alias("_source")).agg(
        F.min(F.when(over, F.col("bucket"))).alias("at"),
        F.max(F.when(~over, F.col("upto"))).alias("before"),
    ).select("_source", "at", F.coalesce("before", F.lit(0)).alias("before"))
    edge = df.join(
        found, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("at"))
    )
    # Equal rows count as one step: the frame ends with the last peer.
    run = F.sum("size").over(W.partitionBy("source").orderBy("rank", "size", "doc_id"))
    edge = edge.withColumn("run", F.col("before") + run)
    out = F.col("run") > F.col("rest")
    last = edge.groupBy(F.col("source").alias("_edge")).agg(
        F.min(F.when(out, F.struct("rank", "size", F.col("doc_id").alias("id")))).alias("first_out"),
        F.max(F.when(~out, F.col("run"))).alias("run"),
    )
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").join(
        last, F.col("source").eqNullSafe(F.col("_edge")), "left"
    )
    words = F.coalesce(F.col("run"), F.col("before"), F.lit(0))
    cut = F.struct(F.col("rest").alias("fits"), F.col("first_out"))
    return joined.select(
        *[c for c in plan.columns if c not in ("rest", "cuts")],
        (F.col("rest") - words).alias("rest"),
        F.concat("cuts", F.array(cut)).alias("cuts"),
    )


def sampling_plan(sized: DataFrame) -> DataFrame:
    """A row per source: its target, certain copies and the cuts of the passes.

    sized: (doc_id, source, size, u) as from `sizes`, written, since every pass reads it.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(ratio + 1e-9)
    cuts = F.array().cast("array<struct<fits:double,first_out:struct<rank:double,size:bigint,id:bigint>>>")
    plan = targets(sized).select(
        "source", "source_size", "target",
        copies.alias("copies"),
        F.greatest(ratio - copies, F.lit(0.0)).alias("share"),
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.greatest(F.col("target") - copies * F.col("source_size"), F.lit(0.0)).alias("rest"),
        cuts.alias("cuts"),
    )
    plan = materialize(plan, "mix-plan")
    for _ in range(PASSES + 1):
        plan = materialize(_next_cut(sized, plan), "mix-plan")
    return plan


def apply_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds n_copies, the times that the mix takes a document whole, and drops the plan's columns."""
    df = _placed(sized, plan).withColumn("n_copies", F.col("copies") + F.col("took").cast("long"))
    return df.drop("copies", "share", "mean", "rest", "cuts", "rank", "took")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(sizes(table(spark, sf_dir, "documents")), "sizes")
    df = apply_plan(sized, sampling_plan(sized))
    return df.select(
        "doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken")
    )


@extra_columns_apart
def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as the plan takes it."""
    sized = materialize(sizes(docs), "sizes")
    plan = sampling_plan(sized)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = sizes(docs.withColumn("_row", row), keep="_row")
    df = apply_plan(whole, plan)
    times = F.sequence(F.lit(1), F.greatest(F.col("n_copies"), F.lit(1)))
    return df.where("n_copies > 0").select("_row", F.explode_outer(times)).select("_row.*")


def _sql(docs: str = "documents", out: str = "") -> str:
    passes, prev = "", "p0"
    for k in range(1, PASSES + 2):
        passes += f"""
o{k} as (
  select rid, size, sum(size) over (partition by source order by rank nulls first, size, doc_id nulls first) as run, rest
  from {prev} where not took and size > 0 and size <= rest
),
p{k} as (
  select p.* exclude (took, rest), p.took or coalesce(o.run <= o.rest, false) as took,
    p.rest - coalesce(sum(case when o.run <= o.rest then p.size else 0 end) over (partition by p.source), 0) as rest
  from {prev} p left join o{k} o using (rid)
),"""
        prev = f"p{k}"
    out = out or "doc_id, size, source_size, target, ((copies + took::int) * size)::bigint as taken"
    return rf"""
with d0 as (
  select row_number() over () as rid, *,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 12))::bigint::double + 0.5::double) / {2**48}::double as u
  from {docs}
),
s1 as (select source, count(*) as n_docs, sum(size)::bigint as source_size from d0 group by source),
s2 as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as weight,
    {MAX_COPIES} * source_size as cap
  from s1
),
s3 as (
  select *, (sum(source_size) over ())::double * {BUDGET_PERCENT / 100}::double
      - coalesce(sum(cap) over (order by cap::double / weight::double, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as lft,
    (sum(weight) over (order by cap::double / weight::double, source nulls last rows between current row and unbounded following))::double as shares
  from s2
),
s4 as (select *, lft / shares as level from s3),
fx as (select arg_min(level, cap::double / weight::double) as fixed from s4 where cap::double > level * weight::double),
s5 as (select s4.*, least(cap::double, coalesce(fixed * weight::double, cap::double)) as target from s4 left join fx on true),
s6 as (select *, case when source_size > 0 then target / source_size::double else 0::double end as ratio from s5),
s7 as (select *, floor(ratio + 1e-9::double)::bigint as copies from s6),
s8 as (
  select source as s_source, source_size, target, copies, greatest(ratio - copies, 0::double) as share,
    source_size::double / n_docs::double as mean, greatest(target - copies * source_size, 0::double) as rest
  from s7
),
r0 as (
  select *, case when size > 0 then greatest(least(share * (2 * mean / (mean + size)), 0.999::double), 1e-6::double) else 0.5::double end as p
  from d0 join s8 on source is not distinct from s_source
),
p0 as (select *, (u / (1 - u)) / (p / (1 - p)) as rank, false as took from r0),{passes}
z as (select * from {prev})
select {out} from z
"""


SQL = _sql()
