"""The alignment against token by token loops in plain Python."""

import os
import random
from collections import Counter
from hashlib import sha256

import pytest

from seqgrid.llm import alignment as al
from seqgrid.llm.common import materialize

pytestmark = pytest.mark.skipif(not os.path.isdir(al.FOLDER), reason="no tokenizers")


@pytest.fixture(scope="module")
def both():
    return al.Tokenizers(al.FOLDER)


def plain(both, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by definition."""
    out, counts, links_of = [], Counter(), []
    for _, text in rows:
        t = text or ""
        ids = [both._steady.encode(" " + t, add_special_tokens=False).ids, both._b.encode(t)] if t else [[], []]
        spans = []
        for k in (0, 1):
            at, here = 0, []
            for i in ids[k]:
                e = both.entries[k][i].as_py()
                here.append((at, at + len(e), i, e))
                at += len(e)
            spans.append(here)
        if any(b"".join(x[3] for x in s) != (" " + t).encode() for s in spans) or not t:
            spans = [[], []]
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x[2]) for x in s if before < x[1] <= c) for s in spans))
            before = c
        counts.update(links)
        links_of.append(links)
        out.append([len(spans[0]), len(spans[1]), len(cuts), len(links), sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        ((rows[k][0], *o[:4], sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), o[4]) for k, (o, links) in enumerate(zip(out, links_of, strict=True))), key=str
    )


ROWS = [
    (1, "Hello world, hello again"), (2, None), (3, ""), (4, " "), (5, "  two  spaces\n\nand\tlines "), (6, "naïve café 東京 🙂 ẞß"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (8, "a▁b"), (9, "Hello world, hello again"), (9, "Hello world, hello again"), (None, "no id"), (11, "don't we'll 12345 ...!!"), (12, "  x\u0000y"), (13, "é ﬁ ½ Å"),
]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, row int, n_a string")
    df = materialize(df, "test")
    return sorted(map(tuple, al.align(df, **options).collect()), key=str)


def test_against_loops(spark, both):
    r = random.Random(4)
    bits = ["the", "tokens", " ", "  ", "\n", "é", "🙂", "'s", "12", "Ω", "-", "a" * 30, "qzx"]
    rows = ROWS + [(100 + k, "".join(r.choice(bits) for _ in range(r.randrange(60)))) for k in range(60)]
    want = plain(both, rows)
    assert run(spark, rows) == want
    # Counts in many small parts give the same sums.
    assert run(spark, rows, part_rows=25) == want


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_long_texts_and_runs(spark, both):
    rows = [(1, "x" * 5000), (2, " " * 3000 + "y"), (3, "word " * 3000), (4, "ab" * 2000 + " c")]
    got = run(spark, rows)
    assert [g[1] for g in got] == [len(both._steady.encode(" " + t, add_special_tokens=False).ids) for _, t in rows]
    assert all(g[4] == g[1] + g[2] - g[3] for g in got)


def test_both_libraries_of_a_agree(both):
    r = random.Random(9)
    marks = "abcXYZ 0123 \n\t '“éß東🙂.,-_" + "́ "
    for _ in range(300):
        t = " " + "".join(r.choice(marks) for _ in range(r.randrange(1, 80)))
        assert both._quick.encode_ordinary(t) == both._steady.encode(t, add_special_tokens=False).ids
