"""The manifest against a tree built in plain Python."""

import random
import zlib
from hashlib import sha256

import pytest

from seqgrid.llm import manifest
from seqgrid.llm.common import materialize


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """All levels of a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def way(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 3
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return out


def expected(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted results."""
    by = {}
    for r in rows:
        leaf = h(*map(field, r))
        doc, text = r[0], r[4]
        shown = leaf
        if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0:
            shown = h(*map(field, (*r[:4], text.replace("\n", ""))))
        by.setdefault(r[1], []).append((doc is not None, doc or 0, leaf, shown, doc))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, leaf, shown, doc) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            chain = way(trees[s], at) + way(top, k)
            now = shown
            for left, right in chain:
                now = h(left, now, right)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], h(*[a + b for a, b in chain]), now, now == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, d string, g string, pos long, chain string"


def got(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, "x", "y", 5, "z") for r in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = manifest.op13_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 81, 82), (400, 27, 28, 1, 1, 1, 1)])
def test_against_plain_python(spark, tmp_path, sizes):
    r = random.Random(sum(sizes))
    rows, k = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            k += 1
            rows.append((k, f"s{s}", r.choice(["en", None]), r.choice([k, None]), r.choice([None, "", f"a\nb{k}\n", f"ü{k}"])))
    r.shuffle(rows)
    assert got(spark, rows, tmp_path) == expected(rows)


def test_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(1, None, "en", 1, "a\n")] * 2 + [(1, None, "en", 1, "b\n"), (2, "", "x", 2, "\n" * 50), (3, "é", "x", 2, "q"), (4, "z", "x", 2, "long\n" * 200_000)]
    assert got(spark, rows, tmp_path) == expected(rows)


def test_tampering_is_found(spark, tmp_path):
    rows = [(i, "s", "en", 3, f"line\nline {i}") for i in range(40)]
    verified = {r[0]: r[-1] for r in got(spark, rows, tmp_path)}
    assert verified == {i: zlib.crc32(str(i).encode()) % 2 == 1 for i in range(40)}


def test_empty_table(spark, tmp_path):
    assert got(spark, [], tmp_path) == []


def test_sources_of_many_rows_and_many_sources(spark):
    rows = [(i, f"s{i}" if i % 3 else "hot", "en", i, f"t{i}") for i in range(2000)]
    df = materialize(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), "test")
    one = manifest.manifest(df).select("root", manifest.folded(manifest.F.col("shown"), manifest.F.col("chain")).alias("f")).distinct().collect()
    assert len(one) == 1 and one[0].f == one[0].root == expected(rows)[0][3]
