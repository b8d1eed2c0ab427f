"""Boundary sets against sorted lists, and the transformation on odd rows."""

import hashlib
import re

import numpy as np
import pytest

from isopleth.llm import middle

CLASH = "doc_id long, text string, n string, form string, output int, llm_form int, llm_cut int"


@pytest.mark.parametrize(
    "offsets, kinds",
    [
        ([0, 5, 9, 65535, 65536, 131075], ["ArrayContainer", "ArrayContainer", "ArrayContainer"]),
        (list(range(300)) + list(range(500, 70_000)), ["RunContainer", "RunContainer"]),
        (list(range(0, 140_000, 3)), ["BitmapContainer", "BitmapContainer", "ArrayContainer"]),
        (list(range(10)) + list(range(5 * 65536, 5 * 65536 + 60_000, 2)), ["RunContainer", "BitmapContainer"]),
    ],
)
def test_select(offsets, kinds):
    held = middle.OffsetSet(np.array(offsets))
    assert [type(c).__name__ for c in held.containers] == kinds
    assert len(held) == len(offsets)
    step = max(1, len(offsets) // 500)
    assert [held.select(i) for i in range(0, len(offsets), step)] == offsets[::step]
    assert held.select(len(offsets) - 1) == offsets[-1]


@pytest.mark.parametrize("text", ["", "a", " ", "ab cd", "a1b\n\té中\U0001f600Zz", "@[`{AZaz", "word " * 30_000 + "end", "1" * 70_000, "a" * 70_000, "é" * 3])
def test_borders(text):
    ends, at = [0], 0
    for token in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
        at += len(token)
        ends.append(at)
    held = middle.borders(text)
    assert len(held) == len(ends)
    assert [held.select(i) for i in range(0, len(ends), max(1, len(ends) // 300))] == ends[:: max(1, len(ends) // 300)]


@pytest.mark.parametrize("text", ["<", "<<S", "a<P", "<M<S<P", "x<>S>", "plain words"])
def test_rebuild_with_halves_of_markers(text):
    for start in range(len(text) + 1):
        for end in range(start, len(text) + 1):
            for form in (middle.PSM, middle.SPM):
                assert middle.rebuild(middle.arrange(text, form, start, end), form) == text


def wanted(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rows(docs):
    rows = [(i, f"Some text, number {i}:\n" + "é x" * (i % 9)) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "a <M> b"), (None, "no id"), (None, None), (7, rows[7][1]), (203, "word " * 30_000), (-4, "below")]
    out = middle.fill_in_middle(docs(rows, CLASH), "doc_id", "text").collect()
    assert len(out) == len(rows) and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == wanted(r.doc_id, r.text)
    again = middle.fill_in_middle(docs(rows[-3:]), "doc_id", "text")
    assert {r.back for r in again.withColumn("back", middle.rebuilt("output", "form")).collect()} == {t for _, t in rows[-3:]}
    assert middle.fill_in_middle(docs([]), "doc_id", "text").count() == 0


def test_a_text_column_named_like_a_result(spark):
    df = spark.createDataFrame([(1, "one two three")], "n long, output string")
    r = middle.fill_in_middle(df, "n", "output").first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == wanted(1, "one two three")
