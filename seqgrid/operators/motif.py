"""Motif search on ungapped sequences."""

import re
from collections.abc import Iterator
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, ungap
from seqgrid.functions.joins import same_keys


def find_motifs(seqs: DataFrame, regex: str) -> DataFrame:
    """(aln_id, row_ix, match_ix, u_start, u_end): leftmost matches that don't overlap.

    Matches are wrapped in marks, the text is split at the opening mark, and the lengths of the
    parts before a match add up to its place.
    """
    marked = F.regexp_replace(ungap(F.col("aligned")), f"({regex})", "<$1>")
    parts = F.split(marked, "<")
    step = lambda s, p: F.struct(
        (s["at"] + F.length(F.replace(p, F.lit(">"), F.lit("")))).alias("at"),
        F.when(p.contains(">"), F.concat(s["m"], F.array(F.struct(s["at"].alias("s"), (s["at"] + F.instr(p, ">") - 1).alias("e"))))).otherwise(s["m"]).alias("m"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("m"))
    found = F.filter(F.aggregate(parts, zero, step)["m"], lambda m: m["e"] > m["s"])
    df = seqs.select("aln_id", "row_ix", F.posexplode_outer(found).alias("match_ix", "m")).where("m is not null")
    return df.select("aln_id", "row_ix", "match_ix", F.col("m.s").alias("u_start"), F.col("m.e").alias("u_end"))


def _sited(regex: str, names: list[str]):
    compiled = re.compile(regex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, nth, spans, places = [], [], [], []
            for k, text in enumerate(batch.column("aligned").to_pylist()):
                text = text or ""
                found = [m.span() for m in compiled.finditer(text.replace("-", "")) if m.end() > m.start()]
                if not found:
                    continue
                cols = np.flatnonzero(np.frombuffer(text.encode("latin-1", "replace"), np.uint8) != ord("-"))
                at = np.array(found)
                row += [k] * len(found)
                nth += range(len(found))
                spans.append(at)
                places.append(np.stack([cols[at[:, 0]], cols[at[:, 1] - 1] + 1], axis=1))
            both = np.hstack([np.concatenate(spans), np.concatenate(places)]) if row else np.empty((0, 4), np.int64)
            take = pa.array(row, pa.int64())
            keys = [batch.column(k).take(take) for k in ("aln_id", "row_ix")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(nth, pa.int32()), *(pa.array(both[:, c], pa.int32()) for c in range(4))], names=names)

    return run


def aligned_matches(seqs: DataFrame, regex: str) -> DataFrame:
    """(aln_id, row_ix, match_ix, u_start, u_end, col_from, col_to): matches on the ungapped row, ends excluded, and the
    columns from the first to behind the last residue, gaps inside included.

    Rows are read once, in place: neither cells nor a map of residues are made.
    """
    kinds = dict(seqs.dtypes)
    names = ["aln_id", "row_ix", "match_ix", "u_start", "u_end", "col_from", "col_to"]
    return seqs.select("aln_id", "row_ix", "aligned").mapInArrow(_sited(regex, names), f"aln_id {kinds['aln_id']}, row_ix {kinds['row_ix']}, " + ", ".join(f"{n} int" for n in names[2:]))


def in_scope(seqs: DataFrame, by_group: bool) -> DataFrame:
    """The rows that a pattern is looked for in: all, or the first row of each group; all rows of an alignment without groups."""
    if not by_group:
        return seqs
    first = seqs.where("grp is not null").groupBy("aln_id", "grp").agg(F.min("row_ix").alias("row_ix"))
    chosen = same_keys(seqs, first.select("aln_id", "grp", "row_ix"), ["aln_id", "grp", "row_ix"], "left_semi")
    grouped = first.select("aln_id").distinct()
    return chosen.unionByName(same_keys(seqs, grouped, ["aln_id"], "left_anti"))


#: Bytes of patterns that tasks hold at most.
MAX_PATTERN_BYTES = 16 << 20


def needed_literal(regex: str) -> str:
    """The longest text that every match of a regular expression holds; empty if none is sure."""
    found, run = [""], ""

    def walk(items) -> None:
        nonlocal run
        for kind, value in items:
            if kind is _parser.LITERAL:
                run += chr(value)
                continue
            if kind is _parser.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
                continue
            if kind is _parser.AT:
                continue
            found.append(run)
            run = ""
            if kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
                walk(value[2])
                found.append(run)
                run = ""

    try:
        parsed = _parser.parse(regex)
    except re.error:
        return ""
    if parsed.state.flags & re.IGNORECASE:
        return ""
    walk(parsed)
    return max([*found, run], key=len)


def _hits(patterns: list[str], zeros: bool):
    """Counts of every pattern in each row: one pass of an automaton over the literals that matches need, then
    the expressions whose literal was seen, and those that need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needs: dict[str, list[int]] = {}
        always = []
        for k, p in enumerate(patterns):
            if literal := needed_literal(p):
                needs.setdefault(literal, []).append(k)
            else:
                always.append(k)
        trie = ahocorasick.Automaton()
        for literal, ks in needs.items():
            trie.add_word(literal, ks)
        if needs:
            trie.make_automaton()
        compiled = [re.compile(p) for p in patterns]
        for batch in batches:
            row, which, count = [], [], []
            for ix, text in zip(batch.column("row_ix").to_pylist(), batch.column("u").to_pylist(), strict=True):
                text = text or ""
                seen = {id(ks): ks for _, ks in trie.iter(text)} if needs else {}
                n = dict.fromkeys(range(len(patterns)), 0) if zeros else {}
                for k in (*always, *(k for ks in seen.values() for k in ks)):
                    if found := sum(1 for _ in compiled[k].finditer(text)):
                        n[k] = found
                row += [ix] * len(n)
                which += n
                count += n.values()
            yield pa.RecordBatch.from_arrays([pa.array(row, batch.column("row_ix").type), pa.array([patterns[k] for k in which], pa.string()), pa.array(count, pa.int32())], names=["row_ix", "pattern", "matches"])

    return run


def count_motifs(seqs: DataFrame, patterns: DataFrame | list[str], zeros: bool = True) -> DataFrame:
    """(row_ix, pattern, matches) of each pattern of a table (pattern) or list; `zeros`: with those that a row lacks.

    Patterns are a stated query set whose size is checked. Rows meet one automaton of the literals that the
    patterns need, and only the expressions that may match.
    """
    if isinstance(patterns, DataFrame):
        held = patterns.select("pattern").where("pattern is not null").distinct()
        size = held.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
        if size > MAX_PATTERN_BYTES:
            raise ValueError(f"patterns of {size} bytes; {MAX_PATTERN_BYTES} at most")
        patterns = [r["pattern"] for r in held.collect()]
    kind = dict(seqs.dtypes)["row_ix"]
    return seqs.select("row_ix", ungap(F.col("aligned")).alias("u")).mapInArrow(_hits(list(dict.fromkeys(patterns)), zeros), f"row_ix {kind}, pattern string, matches int")


def match_list(ranges: DataFrame) -> DataFrame:
    """Matches (aln_id, row_ix, match_ix, col_from, col_to) in order of rows and columns, with `nth` from 0, the
    alignment's `matches`, and the number of the next and the previous one, around the ends.

    Numbers run within a row and start behind the rows before, so that no task orders all matches.
    """
    rows = ranges.groupBy("aln_id", "row_ix").agg(F.count("*").alias("n"))
    upto = W.partitionBy("aln_id").orderBy("row_ix").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("aln_id", "row_ix", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("aln_id")).alias("matches"))
    here = F.row_number().over(W.partitionBy("aln_id", "row_ix").orderBy("col_from")) - 1
    df = ranges.withColumn("here", here).join(rows, ["aln_id", "row_ix"])
    df = df.withColumn("nth", F.col("before") + F.col("here"))
    step = lambda k: F.pmod(F.col("nth") + k, F.col("matches"))
    return df.select("aln_id", "row_ix", "match_ix", "col_from", "col_to", "nth", "matches", step(1).alias("next"), step(-1).alias("previous"))


def compile_pattern(source: str) -> str:
    """A regular expression of a motif: letters, X, (A,B), ~A, {m,n}, and < or > at the ends.

    X is any residue but a stop, B is B, D or N, Z is Z, E or Q. ValueError if a pattern is malformed.
    """
    text = re.sub(r"\s", "", source).upper()
    letter = "[ACDEFGHIKLMNPQRSTVWYBZXUO*]"
    token = re.compile(rf"(?P<first>^<)|(?P<last>>$)|(?P<unit>~?(?:{letter}|\({letter}+(?:,{letter}+)*\)))(?P<times>\{{\d+(?:,\d*)?\}})?")
    wide = {"X": ALPHABET[1:-1], "B": "BDN", "Z": "ZEQ"}
    members = lambda a: wide.get(a, a)
    as_set = lambda m: re.escape(m) if len(m) == 1 else f"[{m}]"
    at, out = 0, []
    while at < len(text):
        m = token.match(text, at)
        if not m:
            raise ValueError(f"bad pattern at {at}: {source!r}")
        at = m.end()
        if m["first"] or m["last"]:
            out.append("^" if m["first"] else "$")
            continue
        words = m["unit"].strip("~()").split(",")
        if m["unit"].startswith("~"):
            if any(len(w) > 1 for w in words):
                raise ValueError("only single residues can be excluded")
            out.append(f"[^{''.join(members(w) for w in words)}]")
        else:
            each = ["".join(as_set(members(a)) for a in w) for w in words]
            out.append(each[0] if len(each) == 1 and len(words[0]) == 1 else f"(?:{'|'.join(each)})")
        if m["times"]:
            low, _, high = m["times"].strip("{}").partition(",")
            if high and int(high) < int(low):
                raise ValueError("bad range")
            out.append(m["times"])
    if not any(o not in "^$" for o in out):
        raise ValueError("empty pattern")
    return "".join(out)
