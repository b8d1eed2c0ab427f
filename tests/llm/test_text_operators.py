"""The text operators against brute force, and on missing, empty, repeated and odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from isopleth.llm import chat, decontaminate, exact_dedup, jaccard, language, line_dedup, pieces, quality, toxicity, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "word " * 30_000 + "end"
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "no id"), (4, LONG), (5, "same"), (5, "same"), (6, "same"), (None, None)]
CLASH = "doc_id long, text string, llm_id string, llm_made long, kept string, id int, llm_hash int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("text", ["", " ", "a ", "  a  b\n c", "\t", "<s>", "▁x▁ ▁", "é中\x00b", "ﬁ Å ½", "a　b", "x" * 500, " " * 70, LONG])
def test_pieces_are_the_library_s(text):
    import sentencepiece

    table, whole = pieces.ChunkTable(MODEL, limit=3), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert table.exact
    assert np.frombuffer(table.ids(text), np.int32).tolist() == whole.encode(text)


def test_pieces_odd_rows(spark, docs):
    out = pieces.decode(pieces.encode(docs(ODD), "text", "ids", MODEL), "ids", "back", MODEL).collect()
    assert len(out) == len(ODD)
    assert all(r.back == (r.text or "") for r in out)
    assert pieces.encode(docs([]), "text", "ids", MODEL).count() == 0


def test_pieces_there_and_back_are_those_of_two_steps(docs):
    table = docs(ODD * 3 + [(50, LONG)])
    two = pieces.decode(pieces.encode(table, "text", "ids", MODEL), "ids", "back", MODEL).select("doc_id", "text", "ids", "back")
    one = pieces.round_trip(table, "text", "ids", "back", MODEL).select("doc_id", "text", "ids", "back")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    same = pieces.round_trip(table, "text", "Doc_id", "TEXT", MODEL)
    assert same.columns == [*(c for c in table.columns if c not in ("doc_id", "text")), "Doc_id", "TEXT"]
    assert sorted(r["TEXT"] for r in same.collect()) == sorted(t or "" for _, t in ODD * 3 + [(50, LONG)])


def test_pieces_ask_the_library_for_many_words_at_once():
    table, asked = pieces.ChunkTable(MODEL), []
    library = table.processor

    class Counting:
        def encode(self, text):
            asked.append(text)
            return library.encode(text)

    table.processor = Counting()
    text = " ".join(f"{'  ' * (n % 5 == 0)}w{n}é▁{n}" for n in range(3000)) + "  "
    assert np.frombuffer(table.ids(text), np.int32).tolist() == library.encode(text)
    assert len(asked) < 30


@pytest.mark.parametrize("limit", [3, 200_000])
def test_pieces_of_slices_are_the_library_s(monkeypatch, limit):
    """Also behind a batch's first slice, and where words, markers and missing texts meet at its ends."""
    import pyarrow as pa

    rng = random.Random(5)
    parts = ["a", "the", " ", " ", "  ", "▁", "\n", "é", "中", "😀", "\x00", "<s>"]
    texts = [rng.choice([None, ""]) if rng.random() < 0.2 else "".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    monkeypatch.setattr(pieces, "SLICE_BYTES", 500)
    table = pieces.ChunkTable(MODEL, limit)
    slices = list(pieces._slices(pa.array(texts)))
    assert len(slices) > 50
    got = pa.concat_arrays([table.lists(s) for s in slices]).to_pylist()
    assert got == [table.processor.encode(t or "") for t in texts]
    # Texts by the library alone: what a vocabulary across markers gets.
    table.exact = False
    assert table.lists(pa.array(texts[:500])).to_pylist() == got[:500]


@pytest.mark.parametrize("shared", [b"", b"p" * 5000])
def test_trie_against_a_dictionary_and_spills(shared):
    """Also texts that begin alike for long: one label holds that, and spills go by what lies behind it."""
    rng = random.Random(3)
    keys = [shared + bytes(rng.choices(b"abc", k=rng.randrange(12))) for _ in range(3000)]
    for limit in (None, 1 << 30, 20_000, 300):
        trie, want = exact_dedup.Trie(limit), {}
        for i, k in enumerate(keys):
            trie.insert(k, (1, -(i % 7), i))
            want[k] = exact_dedup._merged(want[k], (1, -(i % 7), i)) if k in want else (1, -(i % 7), i)
            if limit == 20_000:
                assert trie.root.weight <= limit and trie.files < 40
        assert (trie.files > 0) == (limit is not None and limit < 1 << 30)
        if limit is None and shared:
            (only,) = trie.root.kids.values()
            assert only.label == shared and len(only.kids) == 3
            # All weights add up.
            total = lambda n: (len(n.label) + exact_dedup._NODE_BYTES) * (n is not trie.root) + sum(map(total, (n.kids or {}).values()))
            assert trie.root.weight == total(trie.root)
        got = list(trie.items())
        assert len(got) == len(want) and dict(got) == want


def test_exact_groups(docs):
    rows = [(9, "a b"), (3, "ab"), (7, "a\tb "), (4, "ab"), (8, "c"), (8, "c"), (None, "d"), (1, None), (2, " \n"), (5, LONG)]
    out = exact_dedup.exact_groups(docs(rows, CLASH), "doc_id", "text", spill_bytes=100).collect()
    got = {(r.doc_id, r.text): (r.keep_id, r.group_size, r.kept) for r in out}
    assert len(out) == len(rows)
    assert got[(9, "a b")] == (7, 4, False) and got[(7, "a\tb ")] == (7, 4, True)
    assert got[(8, "c")] == (8, 2, True) and got[(None, "d")] == (None, 1, True)
    assert got[(1, None)] == (2, 2, False) and got[(5, LONG)] == (5, 1, True)
    assert exact_dedup.exact_groups(docs([]), "doc_id", "text").count() == 0


def test_lines(docs):
    rows = [
        (3, "Shared line here\nown line of three\n Shared LINE here\t"), (1, "shared line here\nx"), (2, "x\nown line of two"),
        (4, None), (5, ""), (None, "shared line here\nshort"), (6, "ééééééééé\nshared line here"), (7, "ééééééééé"), (8, LONG), (9, LONG + "\n"),
    ]
    out = by_id(line_dedup.drop_repeated_lines(docs(rows, CLASH), "doc_id", "text", "left_over"))
    assert (out[3].left_over, out[3].n_lines, out[3].n_dropped) == ("own line of three", 3, 2)
    assert out[1].left_over == "shared line here\nx" and out[None].left_over == "short"
    assert (out[4].left_over, out[4].n_lines) == ("", 1) and out[5].left_over == ""
    assert out[6].left_over == out[7].left_over == "ééééééééé"
    assert out[8].left_over == LONG and out[9].left_over == ""
    assert line_dedup.drop_repeated_lines(docs([]), "doc_id", "text").count() == 0


def test_lines_of_rows_without_id(docs):
    rows = [(1, "\n".join(f"shared line {k}" for k in range(9)))] + [(None, f"shared line {k}\nown line {k % 3}") for k in range(9)] + [(None, None), (1, "shared line 3")]
    out = line_dedup.drop_repeated_lines(docs(rows), "doc_id", "text").collect()
    # Rows without id are one document: their own lines repeat within it and stay.
    assert sorted(r.kept for r in out if r.doc_id is None) == sorted([""] + [f"own line {k % 3}" for k in range(9)])
    assert sorted(r.n_dropped for r in out) == [0] * 3 + [1] * 9


def brute_links(rows, rule):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append((i, {tuple(w[k : k + rule.words]) for k in range(max(1, len(w) - rule.words + 1))} if w else set()))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= rule.percent * len(x | y):
                top[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return {i: low[find(k)] for k, (i, _) in enumerate(sets) if i is not None}


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85), jaccard.Rule(5, 80), jaccard.Rule(1, 50)])
def test_jaccard_against_brute_force(docs, rule):
    rng, rows = random.Random(rule.percent), []
    for _ in range(12):
        base = words(rng, rng.choice([3, 8, 40, 120]))
        for _ in range(rng.randrange(1, 22)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 % 1009, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "one"), (2004, "one"), (None, "one"), (2005, LONG), (2006, LONG)]
    got = by_id(jaccard.link_components(docs(rows, CLASH), "doc_id", "text", rule, part_rows=4))
    want = brute_links(rows, rule)
    assert {i: got[i].component_id for i in want} == want
    assert got[None].component_id is None and got[2000].n_shingles == 0


def test_keep_one(docs):
    rows = [(2, "a b c d e f g"), (1, "a b c d e f g"), (3, "q"), (3, "q"), (None, "z"), (None, "z"), (4, None)]
    kept = jaccard.keep_one(docs(rows), "doc_id", "text")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None", "None"]
    assert kept.columns == docs(rows).columns and jaccard.keep_one(docs([]), "doc_id", "text").count() == 0


def test_divide_skip_against_counting():
    rng = random.Random(5)
    index = {q: sorted(rng.sample(range(40), rng.choice([2, 3, 30]))) for q in range(30)}
    for least in (1, 2, 5, 9):
        query = rng.sample(range(35), 20)
        want = {e for e in range(40) if sum(e in index.get(q, ()) for q in query) >= least}
        assert {e for e, n, rest in jaccard.divide_skip(query, index, least) if jaccard.reaches(e, n, rest, least)} == want


def test_decontamination(spark, docs):
    rng = random.Random(8)
    items = {i: words(rng, 30, 10**6) for i in range(6)}
    items[6], items[7] = words(rng, 9, 10**6), words(rng, 3, 10**6)
    spoilt = list(items[1])
    spoilt[10], spoilt[20] = "other", "thing"
    rows = [
        (10, " ".join(words(rng, 50, 10**6) + items[0] + words(rng, 50, 10**6))), (11, " ".join(spoilt).upper()),
        (12, " ".join(items[2][:8] + words(rng, 9, 10**6))), (13, " ".join(words(rng, 400, 10**6))), (14, " ".join(items[6])),
        (15, " ".join(items[7])), (16, None), (17, ""), (18, LONG), (None, " ".join(items[0])), (19, " ".join(items[3] + items[4])), (19, "x"),
    ]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(None, "x"), (8, None)], "item_id long, text string")
    got = decontaminate.contaminated(docs(rows, CLASH), "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 0), (11, 1), (14, 6), (19, 3), (19, 4)}
    hit = next(r for r in got if r.doc_id == 11)
    assert (hit.doc_start, hit.n_aligned, hit.n_matched) == (0, 30, 28)
    assert decontaminate.contaminated(docs([]), "doc_id", "text", bench, "item_id", "text").count() == 0


def test_every_short_pattern_that_counts_holds_a_seed():
    item = np.random.default_rng(1).integers(0, 2**63, 13).astype(np.uint64)
    for n in range(1, 14):
        masks = decontaminate.MASKS[decontaminate.tier(n)]
        asked = set(zip(*(x.tolist() for x in decontaminate.seeds(item[:n], masks))))
        for bits in range(1 << n):
            same = np.array([bits >> i & 1 for i in range(n)], bool)
            if decontaminate.stretch(same)[2] >= decontaminate.needed(n):
                told = zip(*(x.tolist() for x in decontaminate.seeds(np.where(same, item[:n], ~item[:n]), masks)))
                assert not asked.isdisjoint(told), (n, f"{bits:0{n}b}")


@pytest.mark.parametrize("least", decontaminate.MASKS)
def test_every_long_pattern_that_counts_holds_a_seed(least):
    # The score of a best stretch walks from 0 to its top, up by 1 and down by 2, and meets the top
    # only at the end. Tops above ``least`` end in a walk to ``least`` that has enough matches.
    masks = [(len(m), int(m, 2)) for m in decontaminate.MASKS[least]]
    for top in range(1, least + 1):
        seen, todo = set(), [(0, 0, 0)]
        while todo:
            last, score, n = todo.pop()
            for b in (0, 1):
                at = ((last << 1 | b) & (1 << 12) - 1, score + (1 if b else -2), min(least, n + b))
                if at in seen or not 0 <= at[1] <= top or any(at[0] & m == m for _, m in masks):
                    continue
                assert at[1:] != (top, least), "a stretch without any seed"
                if at[1] < top:
                    seen.add(at)
                    todo.append(at)


def test_decontamination_with_many_substitutions(spark, docs):
    rng = random.Random(18)
    items = {p: words(rng, 39, 10**6) for p in (4, 5)} | {n: words(rng, 10, 10**6) for n in (6, 7)} | {n: words(rng, n - 10, 10**6) for n in range(11, 18)}
    items[20] = items[11][:1] * 2
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    spoilt = {i: [f"x{k}" if i < 8 and k % (i if i < 6 else 5) == (i - 1 if i < 6 else 4 if i == 6 else 9) else w for k, w in enumerate(t)] for i, t in items.items()}
    rows = [(i, " ".join(words(rng, 20, 10**6) + t + words(rng, 20, 10**6))) for i, t in spoilt.items()]
    got = decontaminate.contaminated(docs(rows), "doc_id", "text", bench, "item_id", "text", min_tokens=1).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in items} | {(20, 11)}


def test_decontamination_of_items_with_many_texts(spark, docs):
    rng = random.Random(19)
    question, answer = words(rng, 20, 10**6), words(rng, 50, 10**6)
    bench = spark.createDataFrame([(0, " ".join(t)) for t in (question, answer, question)], "item_id long, text string")
    rows = [(1, " ".join(words(rng, 30, 10**6) + question)), (2, " ".join(answer)), (3, " ".join(question + answer)), (4, " ".join(words(rng, 60, 10**6)))]
    got = decontaminate.contaminated(docs(rows), "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r.doc_id, r.doc_start, r.item_start, r.n_aligned, r.n_matched) for r in got} == {(1, 30, 0, 20, 20), (2, 0, 0, 50, 50), (3, 20, 0, 50, 50)}


def test_template_language():
    page = chat.compiled("{% if 'a' == 'b' %}no{% else %}{{ 'x' ~ 'y' | upper }}{% endif %}{% for m in messages %}[{{ m.text }}]{% endfor %}")
    assert "".join(page([{"text": "1"}, {"text": "2"}]).parts) == "xY[1][2]"
    assert chat.parse("a{{ 'b' ~ 'c' }}{% if not 'x' %}d{% endif %}") == (chat.Text("abc"),)
    for bad in ("{{ a.b.c }}", "{{ f() }}", "{% for x %}", "{% if x %}", "{{ 'x' | eval }}", "{{ __import__('os') }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)


@pytest.mark.parametrize("text", ["", "<|im_end|>", "\\", "\\n", "<", "|im_end|>", "<\\|im_end|>", "a\n<|im_start|>assistant\nb<|", "é中"])
def test_chat_round_trip(text):
    page = chat.compiled(chat.TEMPLATE)([{"role": text, "text": text}, {"role": "assistant", "text": text}])
    whole = "".join(page.parts)
    assert list(chat.read_back(whole)) == [(text, text), ("assistant", text)]
    assert [chat.unescape(whole[a:b]) for a, b in page.spans] == [text] * (1 + (text == "assistant"))


def test_conversations_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (None, 0, "user", "x"), (2, None, "user", "first"), (2, 0, "user", LONG), (2, 0, "user", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: list(chat.read_back(r.formatted)) for r in chat.format_conversations(df, "conv_id", "turn", "role", "text").collect()}
    assert got == {1: [("", "hi"), ("assistant", "")], None: [("user", "x")], 2: [("user", "first")] + [("user", LONG)] * 2}


def test_merkle_audit(spark):
    rng = random.Random(1)
    good = [(f, n, f"{f}-{n}-{rng.random()}".encode()) for f in range(3) for n in range(70)]
    bad = [(f, n, b"#" if (f, n) in {(0, 5), (2, 69)} else r) for f, n, r in good if (f, n) != (1, 30)] + [(1, 90, b"new"), (None, 1, b"x")]
    schema, depth = "file long, number long, record binary", warc.depth_for(128, 4)
    trees = [warc.tree(warc.leaves(spark.createDataFrame(r, schema), "file", "number", "record"), depth, 4) for r in (good + [(0, None, b"x")], bad)]
    got = warc.audit(*trees, 4).collect()
    assert {(r.file, r.number, r.kind) for r in got} == {(0, 5, "changed"), (2, 69, "changed"), (1, 30, "missing"), (1, 90, "extra")}
    offset = {(f, n): sum(len(x) for g, m, x in good if g == f and m < n) for f, n, _ in good}
    assert all(r.offset == offset[(r.file, r.number)] for r in got if r.kind != "extra")
    none = spark.createDataFrame([], schema)
    empty = warc.tree(warc.leaves(none, "file", "number", "record"), depth, 4)
    assert warc.audit(empty, empty, 4).count() == 0


def test_merkle_audit_of_places_taken_more_than_once(spark):
    good = [(0, n, f"{n}-{k}".encode()) for n in range(40) for k in range(3)] + [(0, 8, b"8-0")]
    schema, depth = "file long, number long, record binary", warc.depth_for(64, 4)
    made = lambda rows: warc.tree(warc.leaves(spark.createDataFrame(rows, schema), "file", "number", "record"), depth, 4)
    # One of several is hurt, is gone, is there once less or once more.
    bad = [(f, n, b"#" if (n, r) in {(k, f"{k}-{j}".encode()) for k, j in ((1, 0), (2, 1), (3, 2))} else r) for f, n, r in good if r != b"5-1"]
    bad.remove((0, 8, b"8-0"))
    got = warc.audit(made(good), made(bad[::-1] + [(0, 9, b"9-2")]), 4).collect()
    assert {(r.number, r.kind) for r in got} == {(n, "changed") for n in (1, 2, 3, 5, 8, 9)}
    assert all(r.offset == sum(len(x) for _, m, x in good if m < r.number) for r in got)
    assert warc.audit(made(good), made(good[::-1]), 4).count() == 0


def test_segments_against_definition():
    rng = random.Random(2)
    for _ in range(200):
        # Binary fractions, so that sums are exact and ties are ties; negative tokens of any weight.
        values = [rng.choice([2.0, 0.75, 0.0, -0.25, -0.25, -1.5, rng.randrange(-64, 32) / 16]) for _ in range(rng.randrange(14))]

        def best(lo, hi):  # the recursion that defines all maximal segments
            sums = [(sum(values[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            if not sums or max(sums)[0] <= 0:
                return []
            _, _, _, a, b = max(sums)
            return best(lo, a) + [(a, b - 1)] + best(b, hi)

        got = toxicity.segments(np.array(values))
        assert [(a, b) for a, b, _ in got] == best(0, len(values))


def test_toxicity_learns_and_handles_odd_rows(spark, docs):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 60) + (["awful", "vileness"] if i % 5 == 0 else []) + words(rng, 20))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    table = docs(rows + [(500 + k, t) for k, (_, t) in enumerate(ODD)], CLASH)
    model = toxicity.fit(table, "doc_id", "text", labels, "doc_id", "toxic")
    out = by_id(toxicity.score(table, "text", model))
    assert all((out[i].toxicity >= 0.7) == (i % 5 == 0) for i in range(300, 400))
    hit = out[305].toxicity_passages
    assert [out[305].text[p.start : p.end] for p in hit] == ["awful vileness"]
    assert all(0 <= out[500 + k].toxicity < 0.5 for k in range(len(ODD)))
    none = toxicity.fit(table, "doc_id", "text", labels.limit(0), "doc_id", "toxic")
    assert toxicity.score(docs(ODD), "text", none).filter("toxicity = 0").count() == len(ODD)
    assert toxicity.score(docs([]), "text", model).count() == 0


def test_toxicity_counts_copies_once_and_similar_rows_each(spark, docs):
    rng = random.Random(31)
    hot = words(rng, 30, 10**6)
    similar = [" ".join(words(rng, 60, 10**6) + hot) for _ in range(60)]
    copies = [toxicity.kinship(" ".join(t.split())) for t in similar]
    assert len(set(copies)) == 60 and toxicity.kinship(similar[0] + "  ") == copies[0]
    rows = [(i, " ".join(words(rng, 60) + (["awful", "vileness"] if i % 5 == 0 else []) + words(rng, 20))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    fitted = [toxicity.fit(docs(t), "doc_id", "text", labels, "doc_id", "toxic") for t in (rows, rows + rows[:60] * 9)]
    # Repeated rows change how common a word is in all documents, and nothing else.
    assert fitted[0].chance == fitted[1].chance and all(np.isfinite(list(m.weights.values())).all() for m in fitted)
    assert fitted[0].weights.keys() == fitted[1].weights.keys()


def test_language_learns_and_handles_odd_rows(spark, docs):
    rng = random.Random(6)
    kinds = {"aa": ["ba", "bo", "bu"], "cc": ["xik", "zek", "qex"]}
    rows = [(i, " ".join(rng.choices(kinds[k], k=rng.choice([5, 400]))), k) for i, k in enumerate(["aa", "cc"] * 100)]
    model = language.fit(docs(rows[:150]), "doc_id", "text", "lang", epochs=4)
    out = language.predict(docs(rows[150:]), "text", model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    odd = language.predict(docs([(1, None), (2, ""), (3, "12 !"), (4, LONG)]), "text", model).collect()
    assert [r.lang_pred for r in odd][:3] == ["und"] * 3 and odd[3].lang_pred in kinds
    assert language.predict(docs([(1, "x")]), "text", None).first().lang_pred == "und"
    assert language.fit(docs([]), "doc_id", "text", "lang") is None


def test_folded_network_is_the_trained_one():
    rng = np.random.default_rng(0)
    rows, labels = rng.integers(0, 255, (8, language.WINDOW), dtype=np.uint8), np.arange(8) % 2
    p = language.train(rows, labels, 2, epochs=1)
    length = language.WINDOW - 3
    conv = sum(p["e"][rows][:, j : j + length] @ p["f"][j] for j in range(4))
    want = np.maximum(conv.max(axis=1) + p["b"], 0) @ p["d"] + p["c"]
    assert np.allclose(language.logits(rows, language.folded(p, ["a", "b"])), want, atol=1e-3)
    body = bytes(range(1, 250)) * 5
    assert set(np.concatenate(language.windows(body)).tolist()) >= set(body)


def test_quality_learns_and_handles_odd_rows(spark, docs):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        text = " ".join(words(rng, 50)) + "." if good else " | ".join(w + "$$" for w in words(rng, 50))
        rows.append((i, text, "en", "site" if good else "farm", len(text)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (1, None)], "doc_id long, quality int")
    table = docs(rows + [(500 + k, t) for k, (_, t) in enumerate(ODD)])
    model = quality.fit(table, "doc_id", "text", "source", "lang", labels, "doc_id", "quality")
    out = by_id(quality.score(table, "text", "source", "lang", model))
    assert sum((out[i].quality >= 0.5) == (i % 3 > 0) for i in range(200, 400)) >= 195
    assert all(0 <= out[500 + k].quality <= 1 for k in range(len(ODD)))
    assert quality.fit(docs([]), "doc_id", "text", "source", "lang", labels.limit(0), "doc_id", "quality") == 0.0


def test_rows_without_id_and_repeated_ids_in_the_pipeline_s_stages(spark, docs):
    import corpus_pipeline

    rng = random.Random(23)
    a, b, c, d = (words(rng, 60, 10**6) for _ in range(4))
    near = lambda t: " ".join(t[:59] + ["other"])
    a, b, c, d, *close = (*map(" ".join, (a, b, c, d)), *map(near, (a, b, c, d)))
    # Copies without id; two linked texts under one smallest id; one id in two groups; ids before none.
    rows = [(None, a), (None, a), (None, close[0]), (1, b), (1, close[1]), (2, b), (3, c), (3, d), (4, c), (5, close[3]), (None, close[2]), (6, None), (None, "")]
    left = corpus_pipeline.drop_near_duplicates(spark, docs(rows, CLASH), "").select("doc_id", "text").collect()
    got = {(r.doc_id, r.text) for r in left}
    assert len(left) == len(got) == 6 and got - {(None, a), (None, close[0]), (1, b), (1, close[1])} == {(3, c), (3, d), (6, None), (None, "")}
    assert len([i for i, _ in got if i == 1]) == 1
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    odd = [(None, f"{a} {item}"), (None, a), (7, f"{b} {item}"), (7, b), (None, None)]
    kept = corpus_pipeline.drop_contaminated(spark, docs(odd), "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, a), (7, b), (None, None)}


def test_quality_marks_the_surest_of_all_rows(spark):
    buckets = quality.Buckets()
    texts = ["bad junk spam"] * 3 + ["fine prose here"] * 3 + [f"word{i}" for i in range(300)] + ["best"]
    places, data = quality._sparse([[None] * len(texts), [None] * len(texts), texts], buckets)
    rows = spark.createDataFrame([(i, 7, p, d) for i, (p, d) in enumerate(zip(places, data))] + [(306, 7, places[-1], data[-1])], quality._PLACED).repartition(5)
    first, second = np.zeros(quality.CONTENT + 1), np.zeros(quality.PAGE + 1)
    x = quality._dense(places, data)[0]
    np.testing.assert_allclose(x[0], quality.content(texts[0], buckets), atol=2e-3)
    first[:-1] = 30 * x[-1] + 9 * x[3] - 9 * x[0]
    first[quality.WORD_BUCKETS : -1] = 0
    z = x @ first[:-1]
    mark = quality._marker(rows, 3)
    for at in (0, 3):
        (mats, labels), (_, none) = mark([first, second])
        high = sorted((i for i in range(len(z)) if z[i] >= np.log(9)), key=lambda i: (-round(z[i], 4), i))[at : at + 3]
        low = sorted((i for i in range(len(z)) if z[i] <= -np.log(9)), key=lambda i: (round(z[i], 4), i))[at : at + 3]
        assert labels.tolist() == [1] * len(high) + [0] * len(low) and not len(none)
        np.testing.assert_array_equal(mats[0], x[high + low])
    assert 306 not in high


def test_documents_that_line_dedup_empties_go(spark, docs):
    import corpus_pipeline

    one, two = "a line that is long enough", "another line that is long"
    rows = [(1, f"{one}\n{two}"), (2, f"{one}\n{two}"), (3, f"{two}\n \n{one}\t"), (4, f"{one}\nx"), (5, f"{two}\nand one of its own"), (6, None), (7, ""), (8, " \n")]
    left = corpus_pipeline.drop_shared_lines(spark, docs(rows), "").collect()
    assert {r.doc_id: r.text for r in left} == {1: rows[0][1], 4: "x", 5: "and one of its own", 6: None, 7: "", 8: " \n"}
    assert {r.doc_id: r.n_chars for r in left if r.n_chars is not None} == {4: 1, 5: 18}


def test_a_task_of_the_pipeline_has_one_python_worker(spark, docs):
    import corpus_pipeline

    table = docs([(i, "a line that is long enough\nx") for i in range(3)])
    for stage in (corpus_pipeline.drop_shared_lines, corpus_pipeline.tokenize):
        plan = stage(spark, table, "")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_toxicity_learns_without_an_rdd(spark, docs, monkeypatch):
    rows = [(i, f"some words of row {i}" + " awful" * (i % 5 == 0)) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    table = docs(rows)
    # The rows of a list would be read by Python workers apart from those of the functions.
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert toxicity.fit(table, "doc_id", "text", labels, "doc_id", "toxic").weights


def test_pipeline(spark, docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0.5 * given.count() < out.count() < given.count()
    texts = given.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        texts = stage(spark, texts, sf)
        assert texts.count() == 0
    odd = docs([(i, t, None, None, len(t or "")) for i, t in ODD])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sf)
        assert odd.columns == given.columns, name
    # Of the rows with the same id and text, and of equal texts, the first is left.
    assert odd.filter("text = 'same'").count() == 1
    last = corpus_pipeline.tokenize(spark, odd, sf)
    digest = hashlib.sha256(b"same").hexdigest()
    assert last.filter(F.col("decoded_sha256") == digest).count() == 1
