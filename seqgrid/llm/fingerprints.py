"""MinHash fingerprints of whole texts, and what they say of edited and of neighbouring texts.

A text's set holds the hashes of its runs of five words (fewer words: the whole sequence is one). Each of
PERMUTATIONS universal hash functions, x -> (a x + b mod 2 ** 64) div 2 ** 32 over 32-bit x, keeps its
least value over the set, and of that the lowest 16 bits; the fingerprint is these 128 numbers in hex. The
share of numbers that two fingerprints have in common estimates the Jaccard similarity of the sets (texts
that share nothing agree in one of 65536 numbers by chance).

`near_duplicates` joins signature bands in Spark and confirms by the Jaccard similarity of full sets; at
0.8 two documents share none of 32 bands of four numbers in about one pair of 20 million.

An edited text keeps most of its words, so the permutations of runs that both texts have are taken once.
Texts are dealt by range of their ids, once, so that a document and the next one meet where they lie; only
the first and last document of each part meet again. Texts cross the network once and are not written.

Nulls, ties and edges: null counts as empty text; texts without words have an empty set and one common
fingerprint (all numbers 65535), which agrees with itself alone; null ids come first and repeated ids are
ordered by a hash of their text, so a document's next one may be its copy; the last document's next one is
the first, a lone document's itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.llm import neardup
from seqgrid.llm.common import materialize, table
from seqgrid.llm.wordhash import WordHash, grams, mixed, parts

PERMUTATIONS = 128
BANDS = 32
WORDS = 5
#: Shingles that are permuted at once: 128 x 512 products of eight bytes stay in a core's cache.
_CHUNK = 512
_NONE = np.uint64(0xFFFFFFFF)


class MinHash:
    """Least values of shingle sets under universal hash functions."""

    def __init__(self, permutations: int = PERMUTATIONS, seed: int = 12) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**64, (permutations, 1), dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, (permutations, 1), dtype=np.uint64)

    def least(self, shingles: np.ndarray) -> np.ndarray:
        """The least value of each function; repeated shingles change nothing."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        x = shingles >> np.uint64(32)
        for at in range(0, len(x), _CHUNK):
            y = x[None, at : at + _CHUNK] * self.a
            y += self.b
            np.minimum(low, y.min(axis=1), out=low)
        return low >> np.uint64(32)


def _words(text: str, known: WordHash) -> np.ndarray:
    return known.of(text.encode("utf-8", "surrogatepass").lower().split())


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    return grams(words, len(words) if 0 < len(words) < k else k)


def _print(least: np.ndarray) -> bytes:
    return least.astype(np.uint16).astype(">u2").tobytes()


def _likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


class _Reader:
    """Fingerprints of texts and of their edits, one at a time."""

    def __init__(self) -> None:
        self.minhash, self.known = MinHash(), WordHash()

    def of(self, text: str) -> bytes:
        return _print(self.minhash.least(_shingles(_words(text, self.known), WORDS)))

    def both(self, text: str, edited: str) -> tuple[bytes, bytes]:
        """Fingerprints of a text and of one that starts alike; runs within the common start are hashed once."""
        own, other = _words(text, self.known), _words(edited, self.known)
        n = min(len(own), len(other))
        differ = np.flatnonzero(own[:n] != other[:n])
        common = int(differ[0]) if len(differ) else n
        if min(len(own), len(other)) < WORDS or common < WORDS:
            return tuple(_print(self.minhash.least(_shingles(w, WORDS))) for w in (own, other))
        shared = self.minhash.least(grams(own[:common], WORDS))
        rest = (self.minhash.least(grams(w[common - WORDS + 1 :], WORDS)) for w in (own, other))
        return tuple(_print(np.minimum(shared, r)) for r in rest)


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many code points of the following one (or all)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_PRINTS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGES = "part int, first boolean, text string"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("first", pa.bool_()), ("text", pa.string())]
)


def _compared(read: _Reader, doc_id: int | None, text: str, following: str, of_next: bytes | None = None) -> list:
    edited = edited_text(text, following)
    own, other = read.both(text, edited)
    of_next = read.of(following) if of_next is None else of_next
    return [doc_id, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, _likeness(own, other), _likeness(own, of_next), None, None, None]


def _table(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of a sorted part with the next one; the part's first and last are handed on with their texts.

    Documents are taken from the last one of a slice backwards, so that the next one's fingerprint is known.
    """
    read, held, part, started = _Reader(), None, None, False
    for batch in parts(batches, 500):
        docs = list(zip(batch.column("doc_id").to_pylist(), (t or "" for t in batch.column("text").to_pylist()), strict=True))
        part = batch.column("part")[0].as_py()
        out = []
        if not started:
            out.append([docs[0][0], *[None] * 6, part, True, docs[0][1]])
            started = True
        if held is not None:
            docs.insert(0, held)
        held, of_next = docs[-1], read.of(docs[-1][1]) if len(docs) > 1 else None
        for (doc_id, text), (_, following) in zip(docs[-2::-1], docs[:0:-1], strict=True):
            row = _compared(read, doc_id, text, following, of_next)
            of_next = row[3]
            out.append(row)
        if out:
            yield _table(out)
    if started:
        yield _table([[held[0], *[None] * 6, part, False, held[1]]])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _Reader()
    for batch in parts(batches, 500):
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "following")]
        yield _table([_compared(read, *row) for row in zip(*cols, strict=True)]).select(range(7))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    text, mark = F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = docs.select("doc_id", text.alias("text"), mark.alias("mark")).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")
    found = materialize(dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_along, f"{_PRINTS}, {_EDGES}"), "fingerprints")
    edges = found.where("part is not null").select("doc_id", "part", "first", "text")
    # A row for each part: the next part that has rows, the first one behind the last.
    order = W.orderBy("part")
    last = edges.where("not first")
    turn = edges.where("first").select("part").withColumn("to", F.coalesce(F.lead("part").over(order), F.min("part").over(order)))
    starts = edges.where("first").select(F.col("part").alias("to"), F.col("text").alias("following"))
    met = last.join(turn, "part").join(starts, "to").select("doc_id", "text", "following").mapInArrow(_across, _PRINTS)
    both = found.where("part is null").drop("part", "first", "text").unionByName(met)
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    return both.select("doc_id", "n_chars", "edited_sha256", shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next")


def _sign(k: int):
    """Class digests and band keys of texts, in the form that the near-duplicate join takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, known = MinHash(), WordHash()
        for batch in batches:
            n, c, keys = [], [], []
            for text in batch.column("text").to_pylist():
                s = np.unique(_shingles(_words(text or "", known), k))
                n.append(len(s))
                c.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(_bands(minhash.least(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "t", "n", "c", "keys"],
            )

    return run


def _bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of neighbouring numbers."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, -1).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: documents linked by a Jaccard similarity of percent / 100.

    Bands are joined, classes of equal sets compared with a centre of each bucket, and links confirmed on
    full sets, as `neardup` describes; the signatures are those of this module.
    """
    return neardup.near_duplicates(docs, k, percent, _sign)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
