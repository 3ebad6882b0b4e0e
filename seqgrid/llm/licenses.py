"""License scans by conditional compression.

Candidate blocks are the stretches of a text that share runs of SHARED words with a template, in its
order and with no more than GAP words between two runs, whatever line breaks and comment marks are in
between. A block is compressed on its own and with each template that it shares runs with as raw
zstandard dictionary; those that save MIN_SAVED of its size are ranked by the bytes saved. Each is
confirmed by the exact differences in wording: the words to insert into and delete from the template's
closest stretch. One that keeps MIN_MATCH of the words of that stretch, and MIN_SAME words, is reported,
unless a better one overlaps it.

A long text is read in pieces of PIECE characters that overlap by more than any template can take up, so
only a piece is split into words at a time; a block seen in two pieces is reported once.

Nulls, ties and edges: null or empty text has no blocks and no rows; a line with two notices has two
rows; equal savings go to the template that comes first by name; repeated rows are reported each; an
empty table gives an empty result; extra columns are ignored; templates without a name or without a run
of SHARED words are never found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.llm.common import table

#: Wordings to look for (fixed values: the licenses' own notices).
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
SHARED = 3
GAP = 12
MIN_MATCH = 0.8
MIN_SAME = 5
MIN_SAVED = 0.2
PIECE = 1 << 15
#: Templates are held in every task; a table of more bytes is refused.
MAX_TEMPLATE_BYTES = 1 << 26
_WORD = re.compile(r"[A-Za-z0-9.]*[A-Za-z0-9][A-Za-z0-9.]*")
_FIELDS = "doc_id bigint, block_from bigint, block_to bigint, license string, n_compressed bigint, n_saved bigint, n_same_words bigint, n_missing_words bigint, n_added_words bigint, missing_words string, added_words string"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_KINDS = [pa.string() if x.endswith("string") else pa.int64() for x in _FIELDS.split(", ")]


def _words(text: str) -> list[str]:
    return [w.strip(".").lower() for w in _WORD.findall(text)]


def _runs(words: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
    return ((i, tuple(words[i : i + SHARED])) for i in range(len(words) - SHARED + 1))


class _Library:
    """The templates, their runs of words and their compressors, as a task holds them."""

    def __init__(self, templates: dict[str, str]):
        self.words = {n: _words(t) for n, t in sorted(templates.items())}
        self.owners: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for n, w in self.words.items():
            for j, r in _runs(w):
                self.owners.setdefault(r, []).append((n, j))
        # A block has a run, and with it the run's longest word; a text without any of those words has no block.
        self.hints = ahocorasick.Automaton()
        for r in self.owners:
            self.hints.add_word(max(r, key=len), True)
        self.hints.make_automaton()
        self.alone = zstandard.ZstdCompressor(level=3)
        self.given = {n: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, t in templates.items() if t}
        self.overlap = 2 * max(map(len, templates.values()), default=0) + 1000

    def hinted(self, text: str) -> bool:
        return bool(len(self.hints)) and next(self.hints.iter(text.lower()), None) is not None

    def pieces(self, text: str) -> Iterator[tuple[int, str]]:
        size = max(PIECE, 4 * self.overlap)
        for at in range(0, max(len(text) - self.overlap, 1), size - self.overlap):
            if self.hinted(piece := text[at : at + size]):
                yield at, piece

    def blocks(self, mine: list[str]) -> Iterator[tuple[str, int, int]]:
        """(template, from, to) of candidate blocks, as places among the words."""
        shared: dict[str, list[tuple[int, int]]] = {}
        for i, r in _runs(mine):
            for n, j in self.owners.get(r, ()):
                shared.setdefault(n, []).append((i - j, i))
        for n, places in shared.items():
            slack = len(self.words[n]) // 8 + 1
            places.sort()
            cut = [k for k in range(1, len(places)) if places[k][0] - places[k - 1][0] > slack]
            for lo, hi in pairwise([0, *cut, len(places)]):
                at = sorted(i for _, i in places[lo:hi])
                far = [k for k in range(1, len(at)) if at[k] - at[k - 1] > GAP + SHARED]
                for x, y in pairwise([0, *far, len(at)]):
                    yield n, at[x], at[y - 1] + SHARED

    def found(self, text: str) -> list[tuple]:
        """What is reported of a text, without its id."""
        good = set()
        for start, piece in self.pieces(text):
            spans = [m.span() for m in _WORD.finditer(piece)]
            mine = _words(piece)
            for n, lo, hi in self.blocks(mine):
                raw = piece[spans[lo][0] : spans[hi - 1][1]].encode("utf-8", "surrogatepass")
                size = len(self.alone.compress(raw))
                saved = size - len(self.given[n].compress(raw))
                if saved < MIN_SAVED * size:
                    continue
                # The words beside the outer runs may belong to the notice too.
                lo, hi = max(lo - SHARED, 0), min(hi + SHARED, len(mine))
                same, missing, added = _differences(self.words[n], mine[lo:hi])
                if sum(m.size for m in same) >= MIN_SAME:
                    a, b = spans[lo + same[0].b][0] + start, spans[lo + same[-1].b + same[-1].size - 1][1] + start
                    good.add((-saved, n, a, b, (a, b, n, size, saved, sum(m.size for m in same), len(missing), len(added), " ".join(missing), " ".join(added))))
        taken: list[tuple] = []
        for _, _, lo, hi, row in sorted(good):
            if all(hi <= t[0] or lo >= t[1] for t in taken):
                taken.append(row)
        return sorted(taken)


def _differences(template: list[str], mine: list[str]) -> tuple[list, list[str], list[str]]:
    """(matching stretches, words of the template that lack, words that are added), without far matches at the ends."""
    same = [m for m in SequenceMatcher(None, template, mine, autojunk=False).get_matching_blocks() if m.size]
    while same:
        common = sum(m.size for m in same)
        span = max(same[-1].a + same[-1].size - same[0].a, same[-1].b + same[-1].size - same[0].b)
        if common >= MIN_MATCH * span:
            break
        same = same[1:] if same[0].size < same[-1].size else same[:-1]
    missing, added = [], []
    for m, after in pairwise(same):
        missing += template[m.a + m.size : after.a]
        added += mine[m.b + m.size : after.b]
    return same, missing, added


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _Library(templates)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and library.hinted(text):
                    rows += [(doc_id, *row) for row in library.found(text)]
            cols = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)

    return run


def _held(templates: DataFrame) -> dict[str, str]:
    """The table (license, text) on the driver, which its size is checked for."""
    df = templates.where("license is not null and text is not null").select("license", "text")
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; {MAX_TEMPLATE_BYTES} at most")
    return {r["license"]: r["text"] for r in df.collect()}


def scan_licenses(docs: DataFrame, templates: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """A row per block that words a license, with its place, size and differences from the template.

    Templates, whole licenses or notices, are a table (license, text) or a dictionary.
    """
    if isinstance(templates, DataFrame):
        templates = _held(templates)
    return docs.select("doc_id", "text").mapInArrow(_scan(TEMPLATES if templates is None else templates), _FIELDS)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
