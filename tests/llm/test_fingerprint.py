"""Fingerprints against plain loops, and the chain of documents on odd rows."""

import hashlib
import random

import numpy as np
import pytest

from isopleth.llm import fingerprint as fp

MASK = (1 << 64) - 1
CLASH = "doc_id long, text string, id int, body string, chunk int, kind string, fingerprint string"


def mixed(x):
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 29)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 32)


def plain(text):
    """The definition, element by element."""
    if not text:
        return [0] * fp.SIZE
    points, odd = [ord(c) for c in text], 0x9E3779B97F4A7C15
    width = min(fp.K, len(points))
    seen, elements = {}, []
    for place in range(len(points) - width + 1):
        name = points[place] + width
        for p in points[place + 1 : place + width]:
            name = (name * odd + p) & MASK
        name = mixed(name) >> 24
        number = seen[name] = seen.get(name, -1) + 1
        elements.append((name, number, place, mixed((name << 24) + number & MASK) >> 32))
    elements.sort()
    out = []
    for i in range(1, fp.SIZE + 1):
        factor = mixed(i * odd & MASK) >> 32 | 1
        chosen = sorted(elements, key=lambda e: e[3] * factor & 0xFFFFFFFF)[: fp.TUPLE]
        entry = 0
        for name, *_ in sorted(chosen, key=lambda e: e[2]):
            entry = mixed((entry * odd + name + 1) & MASK)
        out.append((entry >> 32) % 65535 + 1)
    return out


@pytest.mark.parametrize("slice_, joint", [(1 << 14, 1 << 24), (7, 1 << 24), (1 << 14, 0)])
def test_against_the_definition(monkeypatch, slice_, joint):
    monkeypatch.setattr(fp, "SLICE", slice_)
    monkeypatch.setattr(fp, "_JOINT", joint)
    rng = random.Random(4)
    texts = ["", "a", "abcd", "abcde", "abcdef", "aaaaaaaaaaaaaaaaaaaa", "é中\U0001f600" * 9]
    texts += ["".join(rng.choices("ab \n", k=rng.randrange(1, 300))) for _ in range(30)]
    for text in texts:
        assert np.frombuffer(fp.fingerprint(text), ">u2").tolist() == plain(text)


def test_order_and_edits_show():
    rng = random.Random(5)
    words = [f"w{rng.randrange(10_000)}" for _ in range(800)]
    text = " ".join(words)
    half = " ".join(words[400:] + words[:400])
    twice = " ".join(w for i, w in enumerate(words) if i % 10)
    other = " ".join(f"w{rng.randrange(10_000)}" for _ in range(800))
    like = lambda t: fp.likeness(fp.fingerprint(text), fp.fingerprint(t))
    assert like(text) == 1.0 and fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1.0
    assert like(text + " more") > 0.9 and 0.2 < like(twice) < 0.8
    # All runs but a few are the same after the move; only pairs within one half keep their order.
    assert 0.25 < like(half) < 0.75
    assert like(other) < 0.1 and like("") == 0.0


def chained(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(i, t or "", order[(n + 1) % len(order)][1] or "") for n, (i, t) in enumerate(order)]


def result(rows):
    out = []
    for ident, text, following in rows:
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        mine, other, theirs = map(fp.fingerprint, (text, changed, following))
        out.append((ident, len(text), hashlib.sha256(changed.encode()).hexdigest(), mine.hex(), other.hex(), fp.likeness(mine, other), fp.likeness(mine, theirs)))
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r.id, r.n_chars, r.edited_sha256, r.fingerprint.hex(), r.edited_fingerprint.hex(), r.near_edited, r.near_next) for r in df.collect()), key=repr)


def test_chain(docs, both_ways):
    rng = random.Random(6)
    rows = [(i * 3, "".join(rng.choices("abc é\n", k=rng.randrange(60)))) for i in range(80)]
    rows += [(1000, None), (1001, "x" * 40_000 + "y" * 20_000), (1002, "")]
    rng.shuffle(rows)
    # 0 wraps round to the largest id; a row without id is the last of all.
    for extra in ([], [(None, "no id")]):
        assert collected(fp.edited_chain(docs(rows + extra, CLASH), "doc_id", "text")) == result(chained(rows + extra))


def test_chain_of_repeated_rows(docs, both_ways):
    rows = [(5, "same text here")] * 60 + [(4, "another one"), (5, None)]
    out = collected(fp.edited_chain(docs(rows), "doc_id", "text"))
    assert len(out) == 62 and sum(r[-1] == 1.0 for r in out) >= 58
    lone = collected(fp.edited_chain(docs([(7, "abcabcabc")]), "doc_id", "text"))
    assert lone == result([(7, "abcabcabc", "abcabcabc")])
    assert fp.edited_chain(docs([]), "doc_id", "text").count() == 0


def test_column(docs):
    out = fp.fingerprints(docs([(1, None), (2, "abc"), (2, "abc")], CLASH), "text").collect()
    assert [bytes(r.fingerprint) for r in out] == [bytes(2 * fp.SIZE), fp.fingerprint("abc"), fp.fingerprint("abc")]
