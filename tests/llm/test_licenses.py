"""Notices inside long lines."""

import random

import pytest

from seqgrid.llm import licenses


@pytest.mark.parametrize("size", [600, 1800, 9000])
@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_notice_in_a_long_line(name, size):
    r = random.Random(size)
    prose = ["".join(r.choice("aeioudnrst") for _ in range(r.randrange(2, 9))) for _ in range(size // 12)]
    line = " ".join([*prose, licenses.TEMPLATES[name], *prose[::-1]])
    assert {x["license"] for x in scanned(line)} == {name}


def test_two_notices_in_one_line():
    line = "Code: " + licenses.TEMPLATES["apache-2.0"] + ". Pictures: " + licenses.TEMPLATES["cc-by-4.0"]
    assert sorted(x["license"] for x in scanned(line)) == ["apache-2.0", "cc-by-4.0"]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "\r"])
@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_notice_wrapped_over_lines(name, mark):
    words = licenses.TEMPLATES[name].split()
    lines = [mark + " ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    text = "A line of prose.\n" + "\n".join(lines) + "\nAnother one.\n"
    (got,) = scanned(text)
    assert (got["license"], got["n_missing_words"], got["n_added_words"]) == (name, 0, 0)
    assert text[got["block_from"] : got["block_to"]].split()[0] == words[0]
    assert got["n_same_words"] == len(licenses._words(licenses.TEMPLATES[name]))


def test_differences_are_named():
    (got,) = scanned(licenses.TEMPLATES["apache-2.0"].replace("may not use", "shall never use").replace("a copy of ", ""))
    assert (got["missing_words"], got["added_words"]) == ("may not a copy of", "shall never")


def test_notices_of_one_family_are_told_apart():
    for name in ("agpl-3.0", "lgpl-3.0", "gpl-3.0"):
        assert {x["license"] for x in scanned("x\n" + licenses.TEMPLATES[name])} == {name}


@pytest.mark.parametrize("shift", range(0, 4000, 333))
def test_notice_where_pieces_of_a_long_text_meet(shift):
    size = licenses.PIECE - 2000 + shift
    text = "ab cd. " * (size // 7) + licenses.TEMPLATES["mit"] + " ef gh" * 9000
    (got,) = scanned(text)
    assert (got["license"], got["n_missing_words"], got["n_added_words"]) == ("mit", 0, 0)


def test_prose_that_shares_runs_is_no_notice():
    assert not scanned("He was free: under the license of the poet, for any purpose, in all copies of the software.")
    assert not scanned("the mit license " * 2000)


def test_templates_from_a_table(spark):
    rows = [("own", "Zebra terms apply to everything delivered herein without exception"), (None, "x"), ("none", None), ("short", "a")]
    table = spark.createDataFrame(rows, "license string, text string")
    docs = spark.createDataFrame([(1, "x\nZebra terms apply to everything\ndelivered herein without exception.", "y"), (2, None, "y"), (None, "", "y")], "doc_id long, text string, license string")
    assert [(r.doc_id, r.license) for r in licenses.scan_licenses(docs, table).collect()] == [(1, "own")]
    assert licenses.scan_licenses(docs, table.limit(0)).count() == 0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def scanned(text):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    return [x for b in licenses._scan(licenses.TEMPLATES)(iter([batch])) for x in b.to_pylist()]


def test_template_of_short_words():
    words = "we do not let you use it for any of the jobs that we ask of you"
    found = licenses._Library({"short": words}).found(f"xx yy\n# {words}\nzz")
    assert [(r[2], r[5]) for r in found] == [("short", 17)]
