"""Columns with the names that operators use, empty tables, and passages by brute force."""

import random

import public_tokenizers

from isopleth.llm import chat, decontaminate, language, pieces, quality, toxicity
from isopleth.llm.toxicity import Model

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_replace_their_own_column_only(spark):
    df = spark.createDataFrame([(1, "some text", "x", 7), (2, None, "y", 8)], "doc_id long, text string, ids string, llm_made int")
    out = pieces.encode(df, "text", "ids", MODEL)
    assert out.columns == df.columns and dict(out.dtypes)["ids"] == "array<int>"
    back = pieces.decode(out, "ids", "text", MODEL).collect()
    assert [(r.doc_id, r.text, r.llm_made) for r in back] == [(1, "some text", 7), (2, "", 8)]


def test_language_and_toxicity_of_columns_with_their_names(spark):
    """The text itself may be in a column that the result replaces."""
    df = spark.createDataFrame([(1, "abc", "old", 5, 6), (2, None, "old", 5, 6)], "doc_id long, score string, lang_pred string, llm_made int, LLM_MADE_ int")
    out = language.predict(df, "score", None).collect()
    assert [(r.doc_id, r.lang_pred, r.score, r.llm_made, r["LLM_MADE_"]) for r in out] == [(1, "und", 0.0, 5, 6), (2, "und", 0.0, 5, 6)]
    plain = Model({"abc": 9.0}, 1.0, 0.0, [0.0, 1.0], [0.0, 1.0])
    out = toxicity.score(df.withColumnRenamed("lang_pred", "score_passages"), "score", plain, "score").collect()
    assert out[0].score > out[1].score == 0.0 and [(p.start, p.end) for p in out[0].score_passages] == [(0, 3)] and out[0].llm_made == 5


def test_quality_replaces_its_score(spark):
    df = spark.createDataFrame([(1, "a", "s", "en", "old", 3)], "doc_id long, text string, source string, lang string, score string, llm_made int")
    assert quality.score(df, "text", "source", "lang", 0.25, "score").first().asDict() == {**df.first().asDict(), "score": 0.25}


def test_conversations_with_clashing_names_and_without_rows(spark):
    columns = "conv_id long, turn int, role string, text string, formatted string, spans int, Formatted_ string"
    df = spark.createDataFrame([(1, 1, "assistant", "hi", "f", 1, "g"), (1, 0, "user", None, "f", 2, "g")], columns)
    page = chat.format_conversations(df, "conv_id", "turn", "role", "text").first()
    assert list(chat.read_back(page.formatted)) == [("user", ""), ("assistant", "hi")]
    assert [page.formatted[s.start : s.end] for s in page.spans] == ["hi"]
    empty = chat.format_conversations(df.limit(0), "conv_id", "turn", "role", "text")
    assert empty.count() == 0 and empty.columns == ["conv_id", "formatted", "spans"]


def test_contamination_against_every_shift(spark, docs):
    """Every document is laid over every item at every shift; no seed, no filter, no join."""
    rng = random.Random(12)
    words = lambda n, v=60: [f"w{rng.randrange(v)}" for _ in range(n)]
    items = [(i, words(n)) for i, n in enumerate([1, 2, 3, 4, 5, 7, 9, 10, 12, 13, 15, 20, 30, 40])]
    rows = []
    for d in range(120):
        body = words(rng.randrange(0, 60), 5000)
        for _ in range(rng.randrange(3)):
            passage = list(rng.choice(items)[1])
            for k in range(len(passage)):
                if rng.random() < 0.12:
                    passage[k] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.randrange(3) :]
        rows.append((d, " ".join(body)))
    tokens = decontaminate.Tokens()
    want = {}
    for d, body in rows:
        doc = tokens.of(body)
        for i, item_words in items:
            item = tokens.of(" ".join(item_words))
            laid = [decontaminate.overlap(doc, item, shift) for shift in range(-len(item) + 1, len(doc))]
            best = min(laid, key=lambda o: (-o[3], o[2], o[0], o[1]), default=None)
            if best is not None and best[3] >= decontaminate.needed(len(item)):
                want[d, i] = best
    test = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = decontaminate.contaminated(docs(rows), "doc_id", "text", test, "item_id", "text", min_tokens=1).collect()
    assert {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_aligned, r.n_matched) for r in got} == want
    assert len(want) > 60 and len({i for _, i in want}) == len(items)
