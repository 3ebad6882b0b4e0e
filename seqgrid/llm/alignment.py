"""Alignment of two tokenizers over every text: common cuts, links between overlapping tokens, counts of id pairs.

A is a byte-level BPE, B a piece BPE with byte fallback. Both cover the bytes of a space and the text, so
their tokens are compared by byte offsets. Where tokens of both end, the text is cut into groups. Tokens
that overlap are linked; a pair of ids counts how many links of the whole corpus join them.

Texts are encoded once, in Arrow batches: id lists are flattened beside their parents' places, token sizes
summed within each document, and groups found by a hash join of A's and B's (document, end) keys. The ids
are written beside each task's partial pair counts, which Spark sums. A second pass reads the ids, not the
texts, and looks the counts up. These are broadcast in parts of `part_rows` rows (16 bytes each) at most,
one entry of B's vocabulary more, whatever their number; a part holds all pairs of its B ids, so their
highest count is known, and each document's sums over the parts are added up.

Nulls, ties and edges: null, empty and unencodable texts (joined bytes of A or B differ from a space and
the text) have zeros and an empty digest; ties for a B id's highest count all count; repeated rows count
each; null ids are kept; a very long text is a batch of its own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqgrid.llm.common import materialize, table

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how the byte-level BPE cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of pair counts that are broadcast at once.
PART_ROWS = 4_000_000
#: Characters of text that are aligned at once.
_SLICE = 1_000_000
#: Pair counts that a task holds before it hands them on.
_HELD = 1_000_000
#: Runs from which the merging of one word's bytes grows with their square in one of A's two libraries.
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for c, b in [*((b, b) for b in shown), *((256 + k, b) for k, b in enumerate(rest))]}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, folder: str) -> None:
        path = f"{folder}/{A_FILE}"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_characters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary = {w: i for w, i in spec["model"]["vocab"].items() if w not in special}
        ranks = {bytes(of[c] for c in w): i for w, i in vocabulary.items()}
        self._quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._steady = Tokenizer.from_file(path)
        self._steady.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        entries = [b""] * (1 + max(ranks.values()))
        for w, i in ranks.items():
            entries[i] = w
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        of_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.entries = tuple(pa.array(e, pa.large_binary()) for e in (entries, of_b))
        self.sizes = tuple(pc.binary_length(e).cast(pa.int64()) for e in self.entries)
        most = max(map(len, self.entries))
        #: Decimal ids with what follows them: a comma, a bar, a semicolon or nothing.
        self.decimals = pa.array([f"{i}{s}" for i in range(most) for s in (",", "|", ";", "")], pa.large_binary())
        self.b_size = len(of_b)

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Id lists of A and B; empty where either doesn't give the text back."""
        a = [self._a_ids(f" {t}") if t else [] for t in texts]
        b = self._b.encode(texts, num_threads=1)
        wanted = [f" {t}".encode() if t else b"" for t in texts]
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (a, b)]
        bad = {k for ids, e in zip(lists, self.entries, strict=True) for k in _different(ids, e, wanted)}
        if bad:
            a, b = ([[] if k in bad else x for k, x in enumerate(ids)] for ids in (a, b))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (a, b)]
        return tuple(lists)

    def _a_ids(self, text: str) -> np.ndarray | list[int]:
        if _LONG_RUN.search(text):
            return self._steady.encode(text, add_special_tokens=False).ids
        return self._quick.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)


def _different(ids: pa.ListArray, entries: pa.Array, wanted: list[bytes]) -> list[int]:
    """The places of the texts that the joined bytes of their ids differ from."""
    made = entries.take(pc.list_flatten(ids))
    at = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1) if len(made) else np.zeros(1, np.int64)
    data = memoryview(made.buffers()[2] or b"").cast("B")[at[0] : at[-1]]
    if data == b"".join(wanted) and [*map(len, wanted)] == _summed(np.diff(at), ids.offsets.to_numpy()).tolist():
        return []
    ends = at[ids.offsets.to_numpy()] - at[0]
    return [k for k, w in enumerate(wanted) if data[ends[k] : ends[k + 1]] != w]


@lru_cache(maxsize=2)
def _tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def _summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring offsets."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return np.diff(total[offsets])


class Aligned:
    """Tokens of some documents, their groups and links.

    a, b: flat ids; a_at, b_at: where each document's ids start; a_group, b_group: the token of each that
    ends each group; link_a, link_b: the tokens of each link; link_at: where each document's links start.
    """

    def __init__(self, a: pa.ListArray, b: pa.ListArray, sizes: tuple[pa.Array, pa.Array]) -> None:
        self.a_at, self.b_at = a.offsets.to_numpy().astype(np.int64), b.offsets.to_numpy().astype(np.int64)
        (self.a, a_start, a_end), (self.b, _, b_end) = (self._ends(x, s) for x, s in zip((a, b), sizes, strict=True))
        left = pa.table({"end": a_end, "a": np.arange(len(a_end))})
        right = pa.table({"end": b_end, "b": np.arange(len(b_end))})
        both = left.join(right, "end", join_type="inner", use_threads=False)
        self.a_group, self.b_group = (np.sort(both[c].to_numpy()) for c in "ab")
        first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_end, a_end, "left")
        times = last - first + 1
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(times)])
        self.link_a = np.repeat(np.arange(len(times)), times)
        self.link_b = np.arange(upto[-1]) - np.repeat(upto[:-1] - first, times)
        self.link_at = upto[self.a_at]

    @staticmethod
    def _ends(ids: pa.ListArray, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and keys of document and byte offset of each token's start and end."""
        flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
        size = sizes.take(flat)
        upto = pc.cumulative_sum(size)
        before = pa.array(np.concatenate([np.zeros(1, np.int64), upto.to_numpy(zero_copy_only=False)])).take(ids.offsets)
        end = pc.add(pc.subtract(upto, before.take(parent)), pc.shift_left(parent.cast(pa.int64()), pa.scalar(32, pa.int64()))).to_numpy(zero_copy_only=False)
        return flat.to_numpy(zero_copy_only=False).astype(np.int64), end - size.to_numpy(zero_copy_only=False), end

    def pairs(self, b_size: int) -> np.ndarray:
        """One number for both ids of each link."""
        return self.a[self.link_a] * b_size + self.b[self.link_b]

    def group_counts(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.a_group, self.a_at))

    def digests(self, decimals: pa.Array) -> list[str]:
        """SHA-256 of each document's groups in decimal ids; empty without tokens."""
        a, b = np.arange(len(self.a)), np.arange(len(self.b))
        # A token stands behind the other tokenizer's tokens of earlier groups, those of B behind A's of their own, too.
        a_before = np.concatenate([np.zeros(1, np.int64), self.b_group + 1])[np.searchsorted(self.a_group, a)]
        b_before = self.a_group[np.searchsorted(self.b_group, b)] + 1 if len(b) else b
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[self.a_group], b_mark[self.b_group] = 1, 2
        full = np.diff(self.b_at) > 0
        b_mark[self.b_at[1:][full] - 1] = 3
        merged = np.empty(len(a) + len(b), np.int64)
        merged[a + a_before], merged[b + b_before] = self.a * 4 + a_mark, self.b * 4 + b_mark
        text = decimals.take(pa.array(merged))
        if not len(merged):
            return [""] * (len(self.a_at) - 1)
        at = np.frombuffer(text.buffers()[1], np.int64, len(merged) + 1)[self.a_at + self.b_at]
        data = memoryview(text.buffers()[2]).cast("B")
        return [sha256(data[x:y]).hexdigest() if x < y else "" for x, y in zip(at[:-1], at[1:], strict=True)]


_ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_NARROW = "<u2"


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose lengths sum up to `most`, one at least."""
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _encode(folder: str):
    """Documents' ids, and now and then the counts of the pairs met since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, rows = _tokenizers(folder), [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        def handed(t: pa.Table) -> pa.RecordBatch:
            none = [pa.nulls(1, k) for k in _ENCODED.types[:4]]
            return pa.RecordBatch.from_arrays([*none, pa.array([t["pair"].to_numpy()], _ENCODED.types[4]), pa.array([t["n"].to_numpy()], _ENCODED.types[5])], schema=_ENCODED)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for x, y in _slices([*map(len, texts)], _SLICE):
                a, b = both.encode(texts[x:y])
                made = pa.table({"pair": Aligned(a, b, both.sizes).pairs(both.b_size)}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
                held.append(made.rename_columns(["pair", "n"]) if made.column_names[0] == "pair" else made.select(["pair", "count_all"]).rename_columns(["pair", "n"]))
                rows += len(made)
                if rows > 2 * _HELD:
                    held = [summed()]
                    if len(held[0]) > _HELD:
                        yield handed(held.pop())
                    rows = sum(map(len, held))
                packed = [pa.array([v.tobytes() for v in np.split(ids.values.to_numpy().astype(_NARROW), ids.offsets.to_numpy()[1:-1])], pa.binary()) for ids in (a, b)]
                null = pa.nulls(y - x, _ENCODED.types[4])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(x, y - x), batch.column("doc_id").slice(x, y - x), *packed, null, null], schema=_ENCODED)
        if held:
            yield handed(summed())

    return run


_FOUND = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _unpacked(packed: pa.Array) -> pa.ListArray:
    size = pc.binary_length(packed).to_numpy(zero_copy_only=False) // np.dtype(_NARROW).itemsize
    flat = np.frombuffer(b"".join(packed.to_pylist()), _NARROW).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))


def _measure(folder: str, part, whole: bool):
    """Documents' figures by one part of the pair counts; what doesn't depend on counts is left to the first part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(folder)
        keys, counts, best = part.value
        for batch in batches:
            lengths = (pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False) * 2).tolist()
            for x, y in _slices(lengths, _SLICE):
                own = batch.slice(x, y - x)
                al = Aligned(_unpacked(own.column("a")), _unpacked(own.column("b")), both.sizes)
                met = pa.array(al.pairs(both.b_size)).dictionary_encode()
                pairs = met.dictionary.to_numpy()
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                n = np.where(keys[at] == pairs, counts[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)
                top = (n > 0) & (n == best[pairs % both.b_size])
                of = met.indices.to_numpy()
                sums = [_summed(v, al.link_at) for v in (top[of], n[of])]
                zero = np.zeros(y - x, np.int64)
                sizes = [np.diff(al.a_at), np.diff(al.b_at), al.group_counts(), np.diff(al.link_at)] if whole else [zero] * 4
                digests = al.digests(both.decimals) if whole else [None] * (y - x)
                cols = [own.column("row"), own.column("doc_id"), *(pa.array(v, pa.int64()) for v in (*sizes, *sums)), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, n) of the whole corpus from the tasks' partial counts."""
    met = encoded.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return met.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))


def _count_parts(counts: DataFrame, b_size: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs ascending, counts, highest count per B id) of ranges of B ids with about `most` pairs at most."""
    b = F.col("pair") % b_size
    per = counts.groupBy(b.alias("b")).agg(F.count("*").alias("rows"), F.max("n").alias("n")).orderBy("b").toArrow()  # a row per entry of B's vocabulary
    ids, rows = per["b"].to_numpy(), per["rows"].to_numpy()
    best = np.zeros(b_size, np.int64)
    best[ids] = per["n"].to_numpy()
    for x, y in [*_slices(rows.tolist(), most)] or [(0, 0)]:
        low, high = (int(ids[x]), int(ids[y - 1])) if y else (0, -1)
        part = counts.where((b >= low) & (b <= high)).toArrow()
        order = np.argsort(part["pair"].to_numpy())
        yield part["pair"].to_numpy()[order], part["n"].to_numpy()[order], best


def align(docs: DataFrame, folder: str = FOLDER, part_rows: int = PART_ROWS, each: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row; `each` gets the pair counts."""
    spark = docs.sparkSession
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    encoded = materialize(read.mapInArrow(_encode(folder), "row bigint, doc_id bigint, a binary, b binary, pairs array<bigint>, times array<bigint>"), "tokens")
    counts = materialize(pair_counts(encoded), "pair_counts")
    if each:
        each(counts)
    tokens = encoded.where("row is not null").select("row", "doc_id", "a", "b")
    parts = []
    for part in _count_parts(counts, _tokenizers(folder).b_size, part_rows):
        parts.append(tokens.mapInArrow(_measure(folder, spark.sparkContext.broadcast(part), not parts), _FOUND))
    out = parts[0]
    if len(parts) > 1:
        figures = [c.split()[0] for c in _FOUND.split(", ")][2:8]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in figures], F.max("groups_sha256").alias("groups_sha256"))
    return out.drop("row")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
