"""Near duplicates by min-max hashing, confirmed on full shingle sets.

Each of PERMUTATIONS hash orders gives the least and the greatest shingle of a document, so 64
orders give 128 values for half the hash work. BANDS bands of four values are the buckets: at a
similarity of 0.8 two documents share none of them in about one pair of 20 million.

Documents with equal shingle sets form one class. Within a bucket, classes are compared with a
centre (a star, not all pairs), and confirmed links are joined to components. Classes around one
centre that are in different components then are compared with each other unless what they share
with the centre rules a link out (see `_left_open`). So no link between components is lost, and
no group is expanded into pairs. A pair's sets are compared in full.

Nulls, ties and edges: null, empty or blank text has an empty set, is linked with nothing and is
its own component; a text shorter than a shingle is one shingle; a null id is ignored in a
component's smallest id, unless all its ids are null; repeated rows share class and component;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqgrid.llm.common import extra_columns_apart, materialize, release, table, temporary_tables
from seqgrid.llm.wordhash import WordHash, grams, mixed

PERMUTATIONS = 64
BANDS = 32
_CHUNK = 1 << 14


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _shingles(text: str | None, k: int, words: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    h = words.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if 0 < len(h) < k:
        return grams(h, len(h))
    return np.unique(grams(h, k))


def _band_keys(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(s), _CHUNK):
        x = (s[None, i : i + _CHUNK] ^ b) * a
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    per = PERMUTATIONS // BANDS
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(per):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[i::per])
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + high[i::per])
    return key.view(np.int64)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240607)
        a = rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None] * np.uint64(2)
        words = WordHash()
        for batch in batches:
            n, c, keys = [], [], []
            for text in batch.column("text").to_pylist():
                s = _shingles(text, k, words)
                n.append(len(s))
                c.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(_band_keys(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "t", "n", "c", "keys"],
            )

    return run


def _set_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            sets = [_shingles(t, k, words) for t in batch.column("text").to_pylist()]
            c = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["c", "s"],
            )

    return run


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes with the sizes of their full sets and of what they share."""
    left = sets.select(F.col("c").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select(
        "a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"),
        F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"),
    )


def _similar(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _components(links: DataFrame) -> DataFrame:
    """(c, comp) for every class with a link: labels of neighbours, then of labels, until stable."""
    edges = materialize(
        links.select(F.col("a").alias("c"), F.col("b").alias("o")).unionByName(
            links.select(F.col("b").alias("c"), F.col("a").alias("o"))
        ).distinct(),
        "edges",
    )
    labels = materialize(
        edges.groupBy("c").agg(F.min("o").alias("m")).select("c", F.least("c", "m").alias("comp")), "labels"
    )
    while True:
        near = edges.join(labels.select(F.col("c").alias("o"), F.col("comp").alias("oc")), "o")
        # A class takes the least label around it; the class that its label names takes it too.
        least = near.join(labels, "c").groupBy("c", "comp").agg(F.min("oc").alias("m"))
        least = least.select("c", F.least("comp", "m").alias("m"), F.col("comp").alias("was"))
        offers = least.select("c", "m").unionByName(least.select(F.col("was").alias("c"), "m"))
        best = offers.groupBy("c").agg(F.min("m").alias("m"))
        hop = best.select(F.col("c").alias("m"), F.col("m").alias("m2"))
        new = materialize(
            best.join(hop, "m", "left").join(labels, "c").select(
                "c", F.least("m", F.coalesce("m2", "m")).alias("comp"), F.col("comp").alias("was")
            ),
            "labels",
        )
        if new.where("comp != was").isEmpty():
            return new.select("c", "comp")
        labels = new.select("c", "comp")


def _left_open(star: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) around one centre that are in different components and may still be similar.

    Similar sets of sizes n and o share at least t = percent / (100 + percent) * (n + o) shingles.
    Of the centre's shingles x and y share no more than either shares with the centre; so a class
    whose share falls short of t by `lack` has `lack` shingles in common with its partner that the
    centre lacks (its rest). Two rests with that many in common meet within their first
    |rest| - lack + 1 shingles in an order by rarity (prefix filtering), an equi-join on rare
    shingles. Classes that lack nothing are compared with each other as well. No similar pair is
    left out.
    """
    at = star.select(F.col("a").alias("z"), F.col("b").alias("c"), F.col("nb").alias("n"), "common")
    at = at.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    apart = [F.min("comp").alias("u"), F.max("comp").alias("v")]
    parts = at.groupBy("z").agg(*apart, F.min("n").alias("least")).where("u != v").drop("u", "v")
    need = F.ceil(percent * (F.col("n") + F.col("least")) / (100 + percent) - 1e-9)
    at = materialize(at.join(parts, "z").withColumn("lack", need - F.col("common")).drop("least"), "open")

    full = at.where("lack <= 0")
    full = full.join(full.groupBy("z").agg(*apart).where("u != v").select("z"), "z", "left_semi")
    differ = (F.col("c") < F.col("c_b")) & (F.col("comp") != F.col("comp_b"))
    m = F.least("common", "common_b")
    enough = 100 * m >= percent * (F.col("n") + F.col("n_b") - m)
    other = full.select("z", *[F.col(c).alias(f"{c}_b") for c in ("c", "n", "common", "comp")])
    direct = full.join(other, "z").where(differ & enough).select(F.col("c").alias("a"), F.col("c_b").alias("b"))

    zs = sets.select(F.col("c").alias("z"), F.col("s").alias("sz"))
    rest = at.join(sets.select("c", "s"), "c").join(zs, "z").withColumn("r", F.array_except("s", "sz"))
    rest = rest.where(F.size("r") >= F.col("lack"))
    rest = rest.select("z", "c", "n", "comp", "lack", F.size("r").alias("nr"), F.explode_outer("r").alias("x"))
    rest = materialize(rest.where("x is not null"), "rest")
    often = rest.groupBy("z", "x").agg(F.count("*").alias("f"), *apart)
    often = often.select("z", "x", F.struct(F.col("u") != F.col("v"), "f").alias("f"), (F.col("u") != F.col("v")).alias("joins"))
    rarest = W.partitionBy("z", "c").orderBy("f", "x")
    first = rest.join(often, ["z", "x"]).withColumn("rank", F.row_number().over(rarest))
    first = first.where("joins and rank <= nr - greatest(lack, 1) + 1")
    first = materialize(first.select("z", "x", "c", "n", "comp"), "rarest")
    back = first.select("z", "x", F.col("c").alias("c_b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    near = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    shared = first.join(back, ["z", "x"]).where(differ & near).select(F.col("c").alias("a"), F.col("c_b").alias("b"))
    return direct.unionByName(shared).distinct()


def classes(docs: DataFrame, k: int, percent: int, sign: Callable = _sign) -> tuple[DataFrame, DataFrame]:
    """((doc_id, t, n, c) per row, (c, component_id) per class); `sign` gives sets' digests and band keys."""
    signed = materialize(
        docs.select("doc_id", "text", _digest().alias("t")).mapInArrow(sign(k), "doc_id bigint, t string, n bigint, c binary, keys array<bigint>"),
        "signatures",
    )
    per_class = (
        signed.where(F.col("c").isNotNull())
        .groupBy("c")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    per_class = materialize(per_class, "classes")
    rows = per_class.select("c", "rep", "n", F.explode_outer("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "c")).alias("centre")).where("size > 1")
    rows = rows.select("key", "c").join(shared.select("key", "centre"), "key")
    rows = materialize(rows.select("key", "c", F.col("centre.c").alias("centre")), "buckets")

    star = rows.where(F.col("c") != F.col("centre")).select(F.col("centre").alias("a"), F.col("c").alias("b")).distinct()
    # Sets of the classes that share a bucket, from one text of each.
    wanted = rows.select("c").distinct().join(per_class.select("c", "rep"), "c")
    texts = docs.select("doc_id", "text").join(
        wanted.select(F.col("rep").alias("_rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi"
    )
    sets = texts.select("text").mapInArrow(_set_of(k), "c binary, s array<bigint>").where(F.col("c").isNotNull())
    sets = materialize(sets.dropDuplicates(["c"]), "sets")
    star = materialize(_measured(star, sets), "star")
    links = _similar(star, percent)
    comps = _components(links)
    more = materialize(_similar(_measured(_left_open(star, comps, sets, percent), sets), percent), "links")
    if not more.isEmpty():
        comps = _components(links.unionByName(more))
    named = per_class.select("c", "rep").join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return signed.select("doc_id", "t", "n", "c"), named.join(ids, "comp").select("c", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, sign: Callable = _sign) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    return _judged(docs, k, percent, sign).drop("t")


def _judged(docs: DataFrame, k: int, percent: int, sign: Callable = _sign) -> DataFrame:
    """near_duplicates with t, the digest of the row's text."""
    rows, named = classes(docs, k, percent, sign)
    named = materialize(named, "components")
    out = rows.join(named, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "t",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@extra_columns_apart
def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document of the smallest id of each component; of repeated rows of that id, one."""
    with temporary_tables() as keep:
        # By id and text, as rows of other texts may share the id, null above all.
        copies = _judged(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
        drop = keep(materialize(copies, "copies"))
    del copies
    release(docs)
    left = docs.join(drop, F.col("doc_id").eqNullSafe(F.col("_id")) & (_digest() == F.col("_t")), "left_anti")
    again = materialize(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "repeats")
    if again.isEmpty():
        return left
    # Rows that share an id (few): of those with one text, one stays.
    on = F.col("doc_id").eqNullSafe(F.col("_id"))
    first = W.partitionBy("doc_id", _digest()).orderBy("source", "lang")
    one = left.join(again, on, "left_semi").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return left.join(again, on, "left_anti").unionByName(one)


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
),
s as (
  select distinct doc_id, w[i:i + 3] as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * common >= 80 * (x.n + y.n - common)
),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b),
m as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from d left join n using (doc_id) join m using (doc_id)
"""
