"""Limits come from the sketches of each source."""

import random

from seqgrid.llm import quality
from seqgrid.llm.common import materialize


def text(n, seed, share):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" + ("#" if r.random() < share else "") for _ in range(n))


def judged(df):
    measured = materialize(quality.with_measures(quality.base_columns(df)), "test")
    limit = quality.limits(quality.sketches(measured))
    return {r.doc_id: r.kept for r in quality.judge(measured, limit).collect()}, limit.collect()


def test_sources_judge_one_text_differently(spark):
    rows = [(i, text(150, i, 0.01), "en", "plain") for i in range(300)] + [(1000 + i, text(150, i, 0.3), "en", "code") for i in range(300)]
    same = text(150, 9999, 0.4)
    rows += [(2000, same, "en", "plain"), (2001, same, "en", "code"), (2002, None, None, None), (2003, same, None, None)]
    kept, limit = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert not kept[2000] and kept[2001] and not kept[2002]
    assert sum(kept[i] for i in range(300)) >= 290 and sum(kept[1000 + i] for i in range(300)) >= 290
    by = {r.source: r for r in limit}
    # No constant sets a limit: each differs between the two sources as their values do.
    assert by["code"].symbol_pm_hi > 1.3 * by["plain"].symbol_pm_hi


def test_small_groups_are_drawn_to_their_language(spark):
    rows = [(i, text(150, i, 0.01), "en", "large") for i in range(300)] + [(1000 + i, text(150, i, 0.3), "en", "small") for i in range(2)]
    _, limit = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    by = {r.source: r.symbol_pm_hi for r in limit}
    assert by["large"] <= by["small"] < 60 + by["large"]


def test_keep_good_keeps_columns_and_clashing_names(spark):
    rows = [(i, text(120, i, 0.01), "en", "s", i, "x") for i in range(20)] + [(None, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, t string")
    got = quality.keep_good(df)
    assert got.columns == df.columns and {r.n_words for r in got.collect()} == set(range(20))
