"""Benchmark decontamination by winnowing.

A document and an item share a window when WINDOW consecutive words agree. Every run of WINDOW
words holds WINDOW - K + 1 hashes of K words; keeping the smallest of each run (winnowing) keeps
the same one in the document and in the item, so a shared window always shares a fingerprint.
Fingerprints of both sides are joined, and each meeting is extended to the windows around it,
which are compared word for word. An item of fewer than WINDOW words is one window; for the few
lengths of such items every word run of that length is a fingerprint.

Texts are cut into overlapping pieces first, which bounds a row; the words around a meeting are taken
from the piece where it is found, so that texts are never shuffled.

Arrays are exploded with explode_outer and a filter behind it: for explode, the optimizer infers a
filter on the array's size and pushes it below, where every step of the array is computed again.

Nulls, ties and edges: null or empty text has no words and no hits; items without words have no
window; a null item id counts as an item listed as an empty string, and items of one id count
once; repeated document rows each get their own, equal, result; an empty benchmark leaves every
document clean; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.llm.common import LOWER, UPPER, ascii_lower, extra_columns_apart, materialize, shifted, table

WINDOW = 10
K = 5
#: Words of a piece of text; longer texts are worked on piece by piece.
CHUNK = 256
#: Everything in ASCII but letters and digits, upper case left out as text is lower-cased first.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprint rows of the benchmark up to which they are broadcast (about 150 bytes each).
BROADCAST_ROWS = 400_000
_POS_BITS = 28
_POS = (1 << _POS_BITS) - 1


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _grams(h: Column, k: int) -> Column:
    """Hashes of k neighbouring words; the last k - 1 places hold shorter runs."""
    g = h
    for i in range(1, k):
        g = F.zip_with(g, shifted(h, i), lambda a, b: F.xxhash64(a, b))
    return g


def _placed(g: Column, kind: int, length: Column) -> Column:
    """High bits of the hash with the place in the low bits, for the first `length` places."""
    put = lambda x, i: x.bitwiseXOR(F.lit(kind << 40)).bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long"))
    return F.transform(F.slice(g, 1, F.greatest(length, F.lit(0))), put)


def _fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """df with words `w` -> df with `f`, an array of placed fingerprints."""
    n = F.size("w")
    df = df.withColumn("_h", F.transform("w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_g", _placed(_grams(F.col("_h"), K), 0, n - (K - 1)))
    least = lambda a, b: F.least(a, b)
    df = df.withColumn("_2", F.zip_with("_g", shifted(F.col("_g"), 1), least))
    df = df.withColumn("_4", F.zip_with("_2", shifted(F.col("_2"), 2), least))
    df = df.withColumn("_6", F.zip_with("_4", shifted(F.col("_2"), 4), least))
    kept = F.array_distinct(F.slice("_6", 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    parts = [kept] + [_placed(_grams(F.col("_h"), k), k, n - (k - 1)) for k in short]
    return df.withColumn("f", F.concat(*parts)).drop("_h", "_g", "_2", "_4", "_6")


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(fp, q, ik, item_id, iw, n): a row per fingerprint of an item, written; n is its window."""
    df = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), item_words(F.col("text")).alias("w"))
    df = df.withColumn("ik", F.xxhash64("item_id", "w"))
    n = F.size("w")
    long_ = _fingerprints(df.where(n >= WINDOW), [])
    short = [
        df.where(n == k).select("ik", "item_id", "w", _placed(_grams(F.transform("w", lambda x: F.xxhash64(x)), k), k, F.lit(1)).alias("f"))
        for k in range(1, WINDOW)
    ]
    rows = long_.select("ik", "item_id", "w", "f")
    for s in short:
        rows = rows.unionByName(s)
    rows = rows.select("ik", "item_id", "w", F.explode_outer("f").alias("f")).where(F.col("f").isNotNull())
    return materialize(
        rows.select(
            F.col("f").bitwiseAND(F.lit(~_POS)).alias("fp"),
            F.col("f").bitwiseAND(F.lit(_POS)).cast("int").alias("q"),
            "ik",
            "item_id",
            F.col("w").alias("iw"),
            F.least(F.size("w"), F.lit(WINDOW)).alias("n"),
        ),
        "fingerprints",
    )


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, k, b, w): pieces of CHUNK words from word b on, and the WINDOW - 1 words behind them.

    Every window lies whole in a piece, and a row stays short whatever the text's length.
    """
    words = docs.select("doc_id", _row_key(F.col("text")).alias("k"), item_words(F.col("text")).alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(CHUNK))
    cut = F.transform(starts, lambda b: F.struct(b.alias("b"), F.slice("_w", b + 1, CHUNK + WINDOW - 1).alias("w")))
    return words.select("doc_id", "k", F.explode_outer(cut).alias("x")).select("doc_id", "k", "x.b", "x.w")


def hits(docs: DataFrame, fps: DataFrame) -> DataFrame:
    """(doc_id, k, item_id, at, n): windows of items at word `at` of a document.

    k tells rows of one id apart by their text.
    """
    sizes = fps.groupBy("n").count().collect()  # at most WINDOW rows
    short = sorted(r["n"] for r in sizes if r["n"] < WINDOW)
    pieces = chunks(docs)
    f = F.explode_outer("f").alias("f")
    df = _fingerprints(pieces, short).select("doc_id", "k", "b", "w", f).where(F.col("f").isNotNull())
    df = df.select(
        "doc_id",
        "k",
        "b",
        "w",
        F.col("f").bitwiseAND(F.lit(_POS)).cast("int").alias("p"),
        F.col("f").bitwiseAND(F.lit(~_POS)).alias("fp"),
    )
    small = sum(r["count"] for r in sizes) <= BROADCAST_ROWS
    marks = fps.select("fp", "q", "ik", "n")
    if small:  # nothing is shuffled before the words around a meeting are cut out
        met = df.join(F.broadcast(marks), "fp")
    else:
        met = df.drop("w").join(marks, "fp").withColumnsRenamed({"doc_id": "_id", "k": "_k", "b": "_b"})
        on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")) & (F.col("b") == F.col("_b"))
        met = pieces.dropDuplicates(["doc_id", "k", "b"]).join(met, on).drop("_id", "_k", "_b")
    # Words WINDOW - 1 before the place (fewer at the start of the piece) to WINDOW after it.
    near = F.slice("w", F.greatest(F.col("p") - WINDOW + 1, F.lit(0)) + 1, F.least(F.col("p"), F.lit(WINDOW - 1)) + WINDOW)
    rows = met.select("doc_id", "k", "b", "p", "q", "ik", "n", near.alias("near"))
    texts = fps.select("ik", "item_id", "iw").dropDuplicates(["ik"])
    rows = rows.join(F.broadcast(texts) if small else texts, "ik")
    # The window starts at item word s and at word p - q + s of the document.
    k = F.when(F.col("n") < WINDOW, F.col("n")).otherwise(K)
    lo = F.greatest(F.col("q") + k - F.col("n"), F.lit(0), F.col("q") - F.col("p"))
    hi = F.least(F.col("q"), F.size("iw") - F.col("n"))
    from_ = F.least(F.col("p"), F.lit(WINDOW - 1)) - F.col("q")
    same = lambda s: F.slice("near", from_ + s + 1, F.col("n")) == F.slice("iw", s + 1, F.col("n"))
    starts = F.when(lo <= hi, F.filter(F.sequence(lo, F.greatest(lo, hi)), same))
    return (
        rows.select("doc_id", "k", "item_id", "n", (F.col("b") + F.col("p") - F.col("q")).alias("d"), F.explode_outer(starts).alias("s"))
        .where(F.col("s").isNotNull())
        .select("doc_id", "k", "item_id", (F.col("d") + F.col("s")).alias("at"), "n")
        .distinct()
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, k, n_hit, n_items, items_sha256), a row per document text with hits."""
    found = hits(docs, item_fingerprints(items))
    words = F.explode_outer(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))
    return (
        found.select("doc_id", "k", "item_id", words.alias("word"))
        .groupBy("doc_id", "k")
        .agg(F.count_distinct("word").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
        .select(
            "doc_id", "k", "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        )
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "n_hit", "n_items", "items_sha256"
    )
    base = docs.select(
        "doc_id", _row_key(F.col("text")).alias("k"), F.size(item_words(F.col("text"))).cast("long").alias("n_words")
    )
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


@extra_columns_apart
def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with their columns."""
    found = materialize(contamination(docs, items).select(F.col("doc_id").alias("_id"), F.col("k").alias("_k")), "leaks")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (_row_key(F.col("text")) == F.col("_k"))
    return docs.join(found, on, "left_anti")


def _sql(kind: str, docs: str = "documents") -> str:
    out = (
        "select doc_id, n_words, n_hit, n_items, items_sha256, n_hit > 0 as contaminated from r"
        if kind == "report"
        else "select doc_id, text, lang, source, n_chars from r where n_hit = 0"
    )
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with dd as (select row_number() over () as rid, *, {words} as w from {docs}),
it as (select coalesce(item_id::varchar, '') as item_id, {words} as w from benchmark),
iw as (
  select item_id, least(len(w), {WINDOW}) as n, w[s:s + least(len(w), {WINDOW}) - 1] as g
  from (select *, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as s from it where len(w) > 0)
),
ln as (select distinct n from iw),
dw as (select rid, s, n, w[s:s + n - 1] as g
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as s from dd, ln where len(w) >= n)),
hit as (select distinct rid, s, iw.n, item_id from dw join iw on dw.n = iw.n and dw.g = iw.g),
ps as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + n)) as p from hit) group by rid),
im as (select rid, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id, ',' order by item_id)) as items_sha256 from hit group by rid),
r as (
  select dd.*, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256
  from dd left join ps using (rid) left join im using (rid)
)
{out}
"""


SQL = _sql("report")
