"""The pipeline against what each stage must keep, on a table with nulls, repeated ids and clashing columns."""

import random

import pytest

import corpus_pipeline


def text(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(50_000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    near = text(200, 500)
    passage = text(60, 501)
    item = text(15, 502)
    rows = [(i, text(120, i), "en", "ab"[i % 2]) for i in range(40)]
    rows += [(100, near, "en", "a"), (101, near, "en", "a"), (102, near + " tail", "en", "b"), (100, near, "en", "a")]
    rows += [(110, text(80, 510) + " " + passage, "en", "a"), (111, passage + " " + text(80, 511), "en", "b")]
    rows += [(120, text(60, 520) + " " + item + " " + text(60, 521), "en", "a")]
    rows += [(130, "too short", "en", "a"), (131, None, None, None), (132, "", "en", "b"), (133, "again and again " * 60, "en", "b")]
    rows += [(None, text(100, 530), "en", None), (None, text(100, 531), None, "b")]
    rows = [(*r, len(r[1] or ""), "x", "x", "x", "x", "x", "x") for r in rows]
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _k string, _cut string, _doc string, _key string, kept string")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("i1", item), ("i2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, passage


def test_stages(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.materialize(stage(spark, docs, path), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = (before, [(r.doc_id, r.text) for r in docs.collect()])
        if name == "quality_rules":  # limits of so few texts are narrow: the next stages get all that pass the base rule
            docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id is null or doc_id < 130")
    texts = {(r[0], r[1]) for r in rows}
    before, after = seen["quality_rules"]
    assert len(before) == len(rows)
    assert set(after) <= {x for x in texts if x[0] not in (130, 131, 132, 133)} and len(after) > 20
    before, after = seen["near_dedup"]
    assert {x[0] for x in before} - {x[0] for x in after} == {101, 102} and len(after) == len(before) - 3
    before, after = seen["substring_dedup"]
    changed = {b[0] for b in set(before) - set(after)}
    assert changed == {111} and len(after) == len(before)
    left = dict(after)[111].split()
    assert len(set(passage.split()) & set(left)) <= 2 and len(left) >= 78
    before, after = seen["decontamination"]
    assert set(before) - set(after) == {x for x in before if x[0] == 120}
    before, after = seen["source_mixing"]
    assert set(after) <= set(before)
    assert all(after.count(x) <= 2 for x in set(after))


def test_run_and_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    got = corpus_pipeline.run(spark, path)
    again = corpus_pipeline.run(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
