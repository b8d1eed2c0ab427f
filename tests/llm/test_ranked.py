"""Ranked search against brute force, in many blocks, bundles and rounds, and on odd rows."""

import math
import random
import re
from collections import Counter

import pytest

from isopleth.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, id int, block string, item long, score string"


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, hits):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m, score = 75 + 25 * n * n_docs // n_terms, 0
            for t in split(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:hits], 1)]
    return sorted(out, key=repr)


def found(spark, docs_df, items, hits=20, columns="item_id long, text string"):
    out = ranked.search(docs_df, "doc_id", "text", spark.createDataFrame(items, columns), "item_id", "text", hits)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("text", ["", "Ab-cD 12é_x", "ÀÉ Àé", "a\x00b\x7fc{d", "\U0001f600x y", "  "])
def test_terms(text):
    assert [t.decode() for t in ranked.terms(text.encode())] == split(text)


def corpus(n, seed):
    """Zipf-like words, and copies, so frequent terms, ties and rare terms all occur."""
    rng = random.Random(seed)
    texts = [" ".join(f"W{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return [(i, texts[i] if i % 5 else texts[0]) for i in range(n)]


@pytest.mark.parametrize("block, bundle, round_", [(2048, 1 << 15, 1 << 20), (16, 1 << 15, 1 << 20), (16, 128, 1 << 20), (64, 64, 512)])
def test_against_brute_force(spark, docs, monkeypatch, block, bundle, round_):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked, "BUNDLE_WEIGHT", bundle)
    monkeypatch.setattr(ranked, "ROUND_WEIGHT", round_)
    rows = corpus(150, 1)
    items = [(i, t) for i, (_, t) in enumerate(corpus(14, 2))] + [(90, "w1 w1 W1 w2"), (91, "nothing_here"), (92, None)]
    assert found(spark, docs(rows, CLASH).repartition(3), items, 5) == brute(rows, items, 5)


def test_pruning_leaves_accumulators_out(spark, docs):
    """The floor after the rare terms keeps most documents of a frequent term out."""
    rows = [(i, "common " * (i % 3 + 1) + (f"rare{i % 40}" if i % 2 else "") + " filler" * (i % 7)) for i in range(400)]
    items = [(1, "rare1 rare3 common"), (2, "common")]
    assert found(spark, docs(rows), items, 3) == brute(rows, items, 3)
    wanted = {b"rare1": 0, b"rare3": 1, b"common": 2}
    counts = ranked.counted(docs(rows), "doc_id", "text", wanted).toArrow()
    plan = ranked.planned({0: [(0, 0, 1), (0, 1, 1), (0, 2, 1)]}, counts, 3)
    assert plan.n_docs == 400 and plan.n_terms == sum(len(split(t)) for _, t in rows)
    assert plan.owner.tolist()[2] == 3 and plan.ahead(2)[0] == int(plan.best[2])
    assert plan.weight[0] > plan.weight[2]


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, " \t!"), (None, "alpha beta"), (None, "alpha beta"), (4, "alpha " * 30_000), (5, "Alpha"), (5, "Alpha"), (6, "alphA")]
    items = [(None, "alpha"), (7, "ALPHA beta"), (7, "beta"), (8, ""), (9, None)]
    assert found(spark, docs(rows), items) == brute(rows, items, 20)
    assert found(spark, docs([]), items) == [] == found(spark, docs(rows), [])
    assert found(spark, docs(rows), [("x", "beta")], columns="item_id string, text string")[0][0] == "x"
