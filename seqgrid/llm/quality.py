"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets fixed base measures. Documents that pass the base rule feed one quantile
sketch per language, source and measure: a log-linear histogram that keeps the six bits below
a value's leading one, so a quantile is off by 1/64 of its value at most. Such sketches merge by
adding counts, so the sketch of a language, or of all, is a sum over the source sketches.

A limit comes from the sketch's values above 0 alone, as most texts have no symbols, repeats or
doubled lines at all: the median, moved out by SPREAD percent of its distance to the outer decile.
The limits of a source are drawn towards those of its language, and these towards those of all, as
if the wider group gave SHRINK more values; so a small group needs no rule of its own. Limits
are joined back to the documents.

Nulls, ties and edges: null or empty text has no words and fails the base rule; null language or
source forms a group of its own (null-safe join); a measure that is 0 in all texts sets no limit;
repeated rows are judged alike, each on its own row; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqgrid.llm.common import materialize, shifted, table, word_array

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: measure -> whether there is a lower limit too
MEASURES = {
    "symbol_pm": False,
    "upper_pm": False,
    "dup_line_pm": False,
    "repeat_pm": False,
    "word_len_pc": True,
}
#: Percent of the distance from the median to the outer decile.
SPREAD = 300
#: Values that a wider group's limit counts for.
SHRINK = 100
#: Groups up to which limits are broadcast (about 100 bytes each).
BROADCAST_GROUPS = 100_000
_KEPT_BITS = 7


def base_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_upper) of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = docs.select("doc_id", "lang", "source", text.alias("t"))
    return _measured(solid, "t").drop("t", "w", "s", "h", "g")


def _measured(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("w", word_array(t)).withColumn("s", F.array_join("w", ""))
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("l", lines)
    h = F.col("h")
    three = F.zip_with(
        F.zip_with(h, shifted(h, 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        shifted(h, 2),
        lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
    )
    df = df.withColumn("g", F.slice(three, 1, F.greatest(F.size(h) - 2, F.lit(0))))
    return df.select(
        *[c for c in df.columns if c not in ("l",)],
        F.size("w").cast("long").alias("n_words"),
        F.length("s").cast("long").alias("word_chars"),
        (F.length("s") - F.length(F.regexp_replace("s", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("g")) < F.size("g"), _words_in_repeats(F.col("g")))
        .otherwise(0)
        .cast("long")
        .alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.length("s") - F.length(F.regexp_replace("s", "[A-Z]", ""))).cast("long").alias("n_upper"),
    )


def _words_in_repeats(windows: Column) -> Column:
    """Words inside the 3-word windows that occur twice or more; equal windows meet by a sort."""
    placed = F.sort_array(
        F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    )
    pairs = F.zip_with(
        placed,
        shifted(placed, 1),
        lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])),
    )
    at = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    return F.size(
        F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2))))
    )


def with_measures(df: DataFrame) -> DataFrame:
    """Adds base_failed and the whole-number measures that the sketches take."""
    per = lambda x, unit, of: F.expr(f"({unit} * {x}) div greatest({of}, 1)")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return df.select(
        "*",
        failed.alias("base_failed"),
        per("n_symbols", 1000, "word_chars").alias("symbol_pm"),
        per("n_upper", 1000, "word_chars").alias("upper_pm"),
        per("n_dup_lines", 1000, "n_lines").alias("dup_line_pm"),
        per("n_repeat_words", 1000, "n_words").alias("repeat_pm"),
        per("word_chars", 100, "n_words").alias("word_len_pc"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): one sketch per group and measure at each level.

    Counting is a partial aggregation, so a source with most of the rows sends no more than its
    buckets from each task.
    """
    pairs = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES]
    )
    rows = measured.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("p"))
    cut = "greatest(length(bin(p.v)) - %d, 0)" % _KEPT_BITS
    fine = (
        rows.select(
            "lang",
            "source",
            "p.measure",
            F.expr(f"shiftleft(shiftright(p.v, {cut}), {cut})").alias("bucket"),
        )
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )
    levels = F.explode(
        F.array(
            F.struct(F.lit(2).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), F.lit(None).cast("string").alias("source")),
            F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
        )
    )
    return (
        fine.select(levels.alias("k"), "measure", "bucket", "n")
        .groupBy("k.level", "k.lang", "k.source", "measure", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_hi, word_len_pc_lo) of each source, drawn towards wider groups."""
    w = W.partitionBy("level", "lang", "source", "measure")
    above = F.when(F.col("bucket") > 0, F.col("n")).otherwise(0)
    upto = w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    cum = sketch.select("*", F.sum(above).over(upto).alias("upto"), F.sum(above).over(w).alias("total"))
    q = lambda p: F.min(F.when((100 * F.col("upto") >= p * F.col("total")) & (F.col("bucket") > 0), F.col("bucket")))
    own = cum.groupBy("level", "lang", "source", "measure").agg(
        q(10).alias("q1"), q(50).alias("q2"), q(90).alias("q3"), F.max("total").alias("n")
    )
    own = own.select(
        "level", "lang", "source", "measure", "n",
        F.expr(f"q2 + ({SPREAD} * (q3 - q2)) div 100").alias("hi"),
        F.expr(f"if(q2 is null, null, greatest(q2 - ({SPREAD} * (q2 - q1)) div 100, 0))").alias("lo"),
    )
    at = lambda n: own.where(F.col("level") == n)
    tongue = at(1).select(F.col("lang").alias("_lang"), F.col("measure").alias("_bm"), F.col("n").alias("n1"), F.col("hi").alias("hi1"), F.col("lo").alias("lo1"))
    whole = at(0).select(F.col("measure").alias("_cm"), F.col("hi").alias("hi0"), F.col("lo").alias("lo0"))
    df = at(2).join(tongue, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_bm")), "left")
    df = df.join(whole, F.col("measure") == F.col("_cm"), "left")
    for side in ("hi", "lo"):
        up = f"((n1 * coalesce({side}1, 0) + {SHRINK} * {side}0) div (n1 + {SHRINK}))"
        df = df.withColumn(f"_{side}", F.expr(f"(n * coalesce({side}, 0) + {SHRINK} * {up}) div (n + {SHRINK})"))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(f"_{side}"))).alias(f"{m}_{side}")
    return df.groupBy("lang", "source").agg(*[pick(m, side) for m, both in MEASURES.items() for side in ("hi", "lo")[: 1 + both]])


def judge(measured: DataFrame, limit: DataFrame) -> DataFrame:
    """Adds kept. Limits have a row per group; those of BROADCAST_GROUPS groups at most are broadcast,
    else the join deals the rows out by group, and Spark splits groups that are too large."""
    names = [f"{m}_{side}" for m, both in MEASURES.items() for side in ("hi", "lo")[: 1 + both]]
    groups = limit.select(F.col("lang").alias("_alang"), F.col("source").alias("_asource"), F.struct(*names).alias("_lim"))
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = measured.join(
        F.broadcast(groups) if few else groups,
        F.col("lang").eqNullSafe(F.col("_alang")) & F.col("source").eqNullSafe(F.col("_asource")),
        "left",
    )
    ok = ~F.col("base_failed")
    for m, both in MEASURES.items():
        ok = ok & F.coalesce(F.col(m) <= F.col(f"_lim.{m}_hi"), F.lit(True))
        if both:
            ok = ok & F.coalesce(F.col(m) >= F.col(f"_lim.{m}_lo"), F.lit(True))
    return joined.withColumn("kept", ok).drop("_alang", "_asource", "_lim")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = materialize(with_measures(base_columns(docs)), "quality")
    return judge(measured, materialize(limits(sketches(measured)), "limits")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", *MEASURES,
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rule and the adaptive limits, with their columns.

    Documents are measured once and written with their measures, so that neither the sketches nor
    the verdicts measure again, and no text is shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(
        F.col("lang"), F.col("source"), F.coalesce(F.col("text"), F.lit("")).alias("t"), row.alias("row")
    )
    measured = with_measures(_measured(base, "t")).select("row", "lang", "source", "base_failed", *MEASURES)
    measured = materialize(measured, "measured")
    limit = materialize(limits(sketches(measured)), "limits")
    return judge(measured, limit).where("kept").select("row.*")


def _sql() -> str:
    stack = " union all ".join(
        f"select lang, source, '{m}' as measure, {m} as v from m where not base_failed" for m in MEASURES
    )
    sides = [(m, side) for m, both in MEASURES.items() for side in ("hi", "lo")[: 1 + both]]
    picks = ", ".join(f"max(case when measure = '{m}' then s_{side} end) as {m}_{side}" for m, side in sides)
    ok = " and ".join(f"coalesce(m.{m} {'<=' if side == 'hi' else '>='} lim.{m}_{side}, true)" for m, side in sides)
    drawn = ", ".join(
        f"(a.n * coalesce(a.{x}, 0) + {SHRINK} * ((b.n * coalesce(b.{x}, 0) + {SHRINK} * c.{x}) // (b.n + {SHRINK}))) // (a.n + {SHRINK}) as s_{x}"
        for x in ("hi", "lo")
    )
    return rf"""
with d as (select row_number() over () as rid, * from documents),
w as (select rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from d),
tri as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)
),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from tri) where c > 1),
cov as (
  select rid, count(distinct p) as n
  from (select rid, i as p from rep union all select rid, i + 1 from rep union all select rid, i + 2 from rep)
  group by rid
),
ln as (
  select rid, list_filter(string_split(coalesce(text, ''), chr(10)),
                          lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d
),
b as (
  select d.rid, doc_id, lang, source, len(w)::bigint as n_words,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(cov.n, 0)::bigint as n_repeat_words,
    len(l)::bigint as n_lines,
    len(regexp_extract_all(coalesce(text, ''), '[A-Z]'))::bigint as n_upper
  from d join w using (rid) join ln using (rid) left join cov using (rid)
),
m as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    (1000 * n_symbols) // greatest(word_chars, 1) as symbol_pm,
    (1000 * n_upper) // greatest(word_chars, 1) as upper_pm,
    (1000 * n_dup_lines) // greatest(n_lines, 1) as dup_line_pm,
    (1000 * n_repeat_words) // greatest(n_words, 1) as repeat_pm,
    (100 * word_chars) // greatest(n_words, 1) as word_len_pc
  from b
),
v as ({stack}),
bk as (select lang, source, measure, (v >> c) << c as bucket
  from (select *, greatest(length(bin(v)) - {_KEPT_BITS}, 0) as c from v)),
lv as (
  select 2 as level, lang, source, measure, bucket from bk
  union all select 1, lang, null, measure, bucket from bk
  union all select 0, null, null, measure, bucket from bk
),
sk as (select level, lang, source, measure, bucket, count(*) filter (bucket > 0) as n from lv group by all),
cu as (
  select *, sum(n) over (partition by level, lang, source, measure order by bucket)::bigint as upto,
    sum(n) over (partition by level, lang, source, measure)::bigint as total
  from sk
),
qt as (
  select level, lang, source, measure, max(total) as n,
    min(bucket) filter (bucket > 0 and 100 * upto >= 10 * total) as q1,
    min(bucket) filter (bucket > 0 and 100 * upto >= 50 * total) as q2,
    min(bucket) filter (bucket > 0 and 100 * upto >= 90 * total) as q3
  from cu group by all
),
li as (
  select level, lang, source, measure, n, q2 + ({SPREAD} * (q3 - q2)) // 100 as hi,
    case when q2 is not null then greatest(q2 - ({SPREAD} * (q2 - q1)) // 100, 0) end as lo
  from qt
),
dr as (
  select a.lang, a.source, a.measure, {drawn}
  from (select * from li where level = 2) a
  left join (select * from li where level = 1) b on a.lang is not distinct from b.lang and a.measure = b.measure
  left join (select * from li where level = 0) c on a.measure = c.measure
),
lim as (select lang as g_lang, source as g_source, {picks} from dr group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {ok} as kept, {", ".join(MEASURES)}
from m left join lim on m.lang is not distinct from g_lang and m.source is not distinct from g_source
"""


SQL = _sql()
