"""Names of ranges of ordered lists, listed within tasks: a range is three numbers until its names are needed."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES = "array<struct<list:bigint,lo:bigint,hi:bigint>>"


class _Lists:
    """Lists of which a task holds what its ranges reach, each from some place on; names are ranked once."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        whole = pa.Table.from_batches(parts)
        number, place = (whole.column(c).to_numpy() for c in ("_list", "_pos"))
        name = whole.column("_name").combine_chunks().cast(pa.large_string())
        self.known = None if not name.null_count else name.is_valid().to_numpy(zero_copy_only=False)
        order = pc.sort_indices(name)
        self.rank = np.empty(len(number), np.int64)
        self.rank[order.to_numpy()] = np.arange(len(number))
        self.sorted = pc.binary_join_element_wise(name.take(order), pa.scalar("", pa.large_string()), pa.scalar(",", pa.large_string()))
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.empty(0, np.int64)
        self.start = dict(zip(number[first].tolist(), (first - place[first]).tolist(), strict=True))

    def digest(self, ranges: list[dict]) -> tuple[int, str]:
        """(how many places the ranges have, MD5 of their names in order, commas between)."""
        at = [np.arange(self.start[r["list"]] + r["lo"], self.start[r["list"]] + r["hi"] + 1) for r in ranges]
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        rank = np.sort(self.rank[at if self.known is None else at[self.known[at]]])
        taken = self.sorted.take(pa.array(rank))
        text = memoryview(taken.buffers()[2] or b"")[: max(int(pc.sum(pc.binary_length(taken)).as_py() or 0) - 1, 0)]
        return len(at), hashlib.md5(text).hexdigest()


def digests(wanted: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """wanted's columns but for `ranges`, with n and digest: how many places the ranges have, and the MD5 of their names in order, commas between.

    wanted: (keys, any columns, ranges), ranges of places in lists, ends included, no place twice. members: (keys, list,
    pos, name), places following each other without a hole. Null names have a place and are not listed.

    Tasks share what is wanted; each gets the parts of lists that its ranges reach, so a task holds names of these, and no row is made for a name of a range.
    """
    spark = wanted.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    own = [c for c in wanted.columns if c not in (*keys, "ranges")]
    wanted = wanted.withColumn("ranges", F.col("ranges").cast(RANGES)).withColumn("_task", F.pmod(F.xxhash64(*own), F.lit(tasks)).cast("int"))
    reach = wanted.select(*keys, "_task", F.inline("ranges")).groupBy(*keys, "_task", "list").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    part = members.join(reach, [*keys, "list"]).where("pos between lo and hi")
    kinds = dict(wanted.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in (*own, "ranges")]
    part = part.select(*keys, "_task", F.lit(False).alias("_asks"), F.col("list").cast("long").alias("_list"), F.col("pos").cast("long").alias("_pos"), F.col("name").cast("string").alias("_name"), *none)
    asks = wanted.select(*keys, "_task", F.lit(True).alias("_asks"), *[F.lit(None).cast(t).alias(c) for c, t in (("_list", "long"), ("_pos", "long"), ("_name", "string"))], *own, "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, lists = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            marks = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (*keys, "_task", "_asks")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                rows = batch.slice(lo, hi - lo)
                at = [rows.column(c)[0].as_py() for c in (*keys, "_task")]
                if at != group:
                    group, held, lists = at, [], None
                if not rows.column("_asks")[0].as_py():
                    held.append(rows.select(["_list", "_pos", "_name"]))
                    continue
                if lists is None:
                    lists = _Lists(held or [rows.slice(0, 0).select(["_list", "_pos", "_name"])])
                    held = []
                found = [lists.digest(r) for r in rows.column("ranges").to_pylist()]
                cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (*keys, *own)), *cols], names=[*keys, *own, "n", "digest"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, *own)) + ", n bigint, digest string"
    dealt = part.unionByName(asks).repartition(tasks, *keys, "_task").sortWithinPartitions(*keys, "_task", "_asks", "_list", "_pos")
    return dealt.mapInArrow(run, schema)
