"""Exact substring dedup: bytes under a LENGTH-byte string that also starts earlier are removed.

Equal strings of LENGTH bytes hold the same least 32-byte hash (their anchor), so the work parts by
anchor: a run of starts with one anchor, with the bytes they cover, is a stretch. Anchors that occur
once are dropped first. Of equal stretches all but the first are repeats as a whole. Different
stretches of one anchor, one copy of each, go to a suffix array per batch of anchors: its
Burrows-Wheeler transform is extended backward breadth first, which sets the common prefixes of
neighbouring suffixes by increasing value and stops at LENGTH, so that neighbours still unset agree
in LENGTH bytes or more. Anchors with more than HOT different stretches don't enter a batch; their
strings are grouped one by one by hash.

Nulls, ties and edges: null text is empty; rows with a null id, or whose id comes with different
texts, are documents of their own (by id and text) and sort last; rows of equal id and text count as
one document; a text shorter than LENGTH loses
nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.llm.common import materialize, row_keys, table
from seqgrid.llm.wordhash import mixed

LENGTH = 100
GRAM = 32
HOT = 50_000
_PIECE = 1 << 22
_BATCH = 1 << 20
_LAST = 2**63 - 1


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _stretches(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, start, number of starts) of every stretch."""
    parts = []
    for at in range(0, max(len(raw) - length + 1, 0), _PIECE):
        b = np.frombuffer(raw, np.uint8, min(_PIECE + length - 1, len(raw) - at), at)
        g = mixed(b.astype(np.uint64) + np.uint64(1))
        size = 1
        while size < GRAM:  # two halves make a gram of twice the size
            g = g[:-size] * np.uint64(0x9E3779B97F4A7C15) + mixed(g[size:])
            size *= 2
        low = np.uint64((1 << 24) - 1)
        full = mixed(g)  # the high bits pick the least gram, its whole hash names the anchor
        g = (full & ~low) | np.arange(len(g), dtype=np.uint64)
        size, want = 1, length - GRAM + 1
        while size * 2 <= want:
            g = np.minimum(g[:-size], g[size:])
            size *= 2
        if want > size:
            g = np.minimum(g[: len(g) - (want - size)], g[want - size :])
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        count = np.diff(np.append(begin, len(g)))
        parts.append((full[(g[begin] & low).view(np.int64)].view(np.int64), begin + at, count))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _scan(length: int, whole: bool):
    """Rows (m[, cx, doc, start, n]) of all stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[] for _ in range(5)]
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = _bytes(text)
                m, start, n = _stretches(raw, length)
                cols[0].append(m)
                if whole:
                    ends = (start + n + length - 1).tolist()
                    cx = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), ends, strict=True)]
                    cols[1].append(np.array(cx, np.uint64).view(np.int64))
                    cols[2].append(np.full(len(m), doc, np.int64))
                    cols[3].append(start)
                    cols[4].append(n)
            names = ["m", "cx", "doc", "start", "n"] if whole else ["m"]
            out = [np.concatenate(c) if c else np.empty(0, np.int64) for c in cols[: len(names)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return run


def _suffix_ranks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, symbols) of the texts one behind the other, each with mark 0 at its end."""
    sym = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    sym[np.cumsum([len(t) + 1 for t in texts]) - 1] = 0
    n = len(sym)

    def joined(high: np.ndarray, low: np.ndarray, by: int, bits: int) -> np.ndarray:
        out = high << bits
        out[:-by] |= low[by:]
        return out

    two = joined(sym, sym, 1, 9)
    seven = joined(joined(joined(two, two, 2, 18), two, 4, 18), sym, 6, 9)
    sa = np.argsort(seven)
    key = seven[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first, step = np.flatnonzero(new), 7
    # A suffix ranks by its group's first place; groups of one are settled.
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        at = sa[open_]
        group = rank[at]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        order = np.argsort(group * (n + 1) + after)
        at, group, after = at[order], group[order], after[order]
        sa[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        first = np.flatnonzero(new)
        rank[at] = np.repeat(open_[first], np.diff(np.append(first, len(at))))
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return sa, rank, sym


def _agreeing(sa: np.ndarray, rank: np.ndarray, sym: np.ndarray, length: int) -> np.ndarray:
    """For every place of the suffix array, whether it agrees with the one before in `length` symbols.

    It may be true as well where a text ends within `length` symbols. Words over a text's end are not
    extended. Places with one preceding symbol map as a whole, so intervals are parted by runs.
    """
    n = len(sa)
    lf, bwt = rank[sa - 1], sym[sa - 1]
    begins = np.concatenate([[True], bwt[1:] != bwt[:-1]])
    run, begins = np.cumsum(begins) - 1, np.flatnonzero(begins)
    ends = np.append(begins[1:], n)
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        size = run[hi - 1] - run[lo] + 1
        owner = np.repeat(np.arange(len(lo)), size)
        r = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - run[lo], size)
        left, right, by = lf[np.maximum(begins[r], lo[owner])], lf[np.minimum(ends[r], hi[owner]) - 1] + 1, bwt[begins[r]]
        if len(owner) > len(lo):
            # Within an interval, equal preceding symbols lead to neighbouring places.
            order = np.argsort(owner * n + left)
            left, right, by, owner = left[order], right[order], by[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (by[1:] != by[:-1])]))
            left, right, by = left[first], right[np.append(first[1:], len(by)) - 1], by[first]
        fresh = unset[right]
        unset[right] = False
        fresh &= by > 0
        lo, hi = left[fresh], right[fresh]
    return unset[:n]


def _repeats(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(doc, from, to) of the starts whose string also starts earlier, in runs.

    Texts of one anchor come in order of doc and start, so an earlier string has a lower place."""
    sa, rank, sym = _suffix_ranks(texts)
    same = _agreeing(sa, rank, sym, length)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    valid = (ends[owner] - np.arange(len(sym)) > length)[sa]
    place, group = sa[valid], np.cumsum(~same | ~valid)[valid]
    later = np.zeros(len(sym), bool)
    if len(place):
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        later[place] = True
        later[np.minimum.reduceat(place, head)] = False
    at = np.flatnonzero(later)
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
    first, last = at[np.append(0, cut)[: len(at)]], at[np.append(cut, len(at))[: len(at)] - 1]
    doc, begin = docs[owner[first]], starts[owner[first]] - (ends - sizes)[owner[first]]
    return list(zip(doc.tolist(), (first + begin).tolist(), (last + begin + length).tolist(), strict=True))


def _bytes_of(length: int, each: bool):
    """The bytes of wanted stretches; each: a row (m, h, doc, pos) per string instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, want in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "want")), strict=True):
                raw = _bytes(text)
                for w in want:
                    s, e = w["start"], w["start"] + w["n"] + length - 1
                    if e > len(raw) or xxhash.xxh3_64_intdigest(raw[s:e]) != w["cx"] % 2**64:
                        continue  # another row of this id
                    if each:
                        rows += [(w["m"], xxhash.xxh3_64_intdigest(raw[i : i + length]) - 2**63, doc, i) for i in range(s, s + w["n"])]
                    else:
                        rows.append((w["m"], raw[s:e], doc, s))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64() if each else pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["m", "b", "doc", "start"])

    return run


def _transform(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            found = _repeats([r[1] for r in held], np.array([r[2] for r in held]), np.array([r[3] for r in held]), length)
            cols = list(zip(*found, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "from", "to"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "b", "doc", "start")), strict=True):
                if held and (row[0], *row[2:]) == (held[-1][0], *held[-1][2:]):
                    continue  # a repeated row
                if size > _BATCH and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield flush()

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc, from, to) byte ranges that repeat earlier text; they may overlap."""
    src = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text")
    often = src.mapInArrow(_scan(length, False), "m bigint").groupBy("m").count().where("count > 1").select("m")
    # Written, so that the join below is between plain exchanges and Spark can split a frequent anchor.
    often = materialize(often, "anchors")
    rows = src.mapInArrow(_scan(length, True), "m bigint, cx bigint, doc bigint, start bigint, n bigint")
    rows = materialize(rows.join(often, "m", "left_semi"), "stretches")
    firsts = materialize(
        rows.groupBy("m", "cx").agg(F.min(F.struct("doc", "start", "n")).alias("f"), F.count("*").alias("times")), "firsts"
    )
    known = firsts.where("times > 1").select("m", "cx", "f")
    again = rows.join(known, ["m", "cx"]).where(F.struct("doc", "start", "n") > F.col("f"))
    again = again.select("doc", F.col("start").alias("from"), (F.col("start") + F.col("n") + length - 1).alias("to"))
    kinds = firsts.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = materialize(firsts.join(kinds, "m").select("m", "cx", "f.*", "kinds"), "wanted")

    def fetched(want: DataFrame, each: bool) -> DataFrame:
        by = want.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("m", "cx", "start", "n")).alias("want"))
        got = src.join(by, F.col("doc") == F.col("_doc")).select("doc", "text", "want")
        kind = "bigint" if each else "binary"
        return got.mapInArrow(_bytes_of(length, each), f"m bigint, b {kind}, doc bigint, start bigint")

    cold = fetched(wanted.where(F.col("kinds") <= hot), False)
    cold = cold.repartition("m").sortWithinPartitions("m", "doc", "start")
    found = cold.mapInArrow(_transform(length), "doc bigint, from bigint, to bigint")
    heated = wanted.where(F.col("kinds") > hot)
    if not heated.isEmpty():
        strings = materialize(fetched(heated, True), "strings")
        first = strings.groupBy("m", "b").agg(F.min(F.struct("doc", "start")).alias("f"))
        late = strings.join(first, ["m", "b"]).where(F.struct("doc", "start") > F.col("f"))
        found = found.unionByName(late.select("doc", F.col("start").alias("from"), (F.col("start") + length).alias("to")))
    return again.unionByName(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
            raw, kept, at, spans, gone = _bytes(text), [], 0, 0, 0
            for r in sorted((r["from"], r["to"]) for r in ranges or []):
                lo, hi = max(r[0], at), min(r[1], len(raw))
                if hi <= lo:
                    continue
                if r[0] > at or not spans:
                    spans += 1
                    kept.append(raw[at:lo])
                gone += hi - lo
                at = hi
            kept.append(raw[at:])
            rows.append((doc_id, len(raw), gone, spans, sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    docs = row_keys(docs.select("doc_id", "text"))
    ranges = materialize(repeated_ranges(docs.select(F.col("_key").alias("doc_id"), "text"), length, hot), "ranges")
    by = ranges.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    out = docs.join(by, F.col("_key") == F.col("_doc"), "left")
    return out.select("doc_id", "text", "ranges").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
