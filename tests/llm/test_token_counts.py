import random

from voxfield.llm import token_counts, tokens

from .helpers import documents, empty, odd

BITS = ["a", "the", "don't", "'s", " ", "  ", "\n", " \n", "9", "x9_", "É", "½", ".", "!!", "日", "\t", "'re", "\xa0", "-"]


def whole(text):
    return len(tokens.encoder().whole.encode(text or "", add_special_tokens=False).ids)


def edited(text, edits):
    text = text or ""
    for start, stop, replacement in edits:
        start = min(max(0, start), len(text))
        stop = min(max(start, stop), len(text))
        text = text[:start] + (replacement or "") + text[stop:]
    return text


def test_edits_equal_whole_encoding(monkeypatch):
    cut = token_counts.segments
    monkeypatch.setattr(token_counts, "segments", lambda text, size=2: cut(text, size))
    rng, coder = random.Random(5), tokens.encoder()
    for _ in range(300):
        text = "".join(rng.choices(BITS, k=rng.randint(0, 25)))
        document = token_counts.Document(text, *token_counts.leaves([text], coder)[0])
        assert document.tree.tokens == whole(text)
        for _ in range(4):
            a = rng.randint(0, len(document.text))
            b = a + rng.choice([0, 1, 2, 5, 9])
            new = "".join(rng.choices(BITS, k=rng.choice([0, 1, 2, 8])))
            want = edited(document.text, [(a, b, new)])
            document.edit(a, b, new, coder)
            assert document.text == want and document.tree.tokens == whole(want)
            assert sum(document.tree.values()[0]) == len(want)


def test_only_touched_regions_are_encoded():
    text = " ".join(f"word{k}" for k in range(20_000))
    coder = tokens.encoder()
    document = token_counts.Document(text, *token_counts.leaves([text], coder)[0])
    document.edit(50_000, 50_003, "new", coder)
    assert 0 < document.encoded < 2_000 and document.tree.tokens == whole(document.text)


def test_recount(spark):
    texts = ["one two three " * 60, None, "", "short", "repeated", "no edits here"]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 4"))
    edits = [(0, 0, 5, 30, "X"), (0, 1, 2, 2, " in"), (0, 1, 2, 2, " in"), (1, 0, 0, 9, "text"), (2, 0, 3, 1, "né"),
             (3, 0, -4, 99, None), (4, 0, 8, 8, " end"), (99, 0, 0, 0, "unknown")]
    table = spark.createDataFrame(edits, "doc_id long, seq long, start long, stop long, replacement string")
    got = token_counts.recount(docs, table).collect()
    assert len(got) == 7
    for r in got:
        own = sorted({e for e in edits if e[0] == r["doc_id"]}, key=lambda e: e[1])
        want = edited(texts[r["doc_id"]], [e[2:] for e in own])
        assert (r["n_tokens"], r["n_edits"], r["n_tokens_after"]) == (whole(texts[r["doc_id"]]), len(own), whole(want))
        assert (r["text"] or "") == want
    trees = {r["doc_id"]: r for r in token_counts.build(docs).collect()}
    for k, text in enumerate(texts):
        assert trees[k]["n_tokens"] == sum(trees[k]["leaf_tokens"]) == whole(text)
        assert sum(trees[k]["leaf_chars"]) == len(text or "")


def test_repeated_lines_go(spark):
    docs = documents(spark, ["a b\nc\na b\nc\n\n\nd", "x\nx"])
    got = {r["doc_id"]: r for r in token_counts.recount(docs, token_counts.repeated_lines(docs)).collect()}
    assert got[0]["text"] == "a b\nc\n\n\nd" and got[1]["text"] == "x"
    assert all(r["n_tokens_after"] == whole(r["text"]) for r in got.values())


def test_odd_tables(spark):
    docs = odd(spark)
    got = token_counts.recount(docs, token_counts.repeated_lines(docs)).collect()
    assert len(got) == docs.count() and all(r["n_tokens_after"] == whole(r["text"]) for r in got)
    none = empty(spark)
    assert token_counts.recount(none, token_counts.repeated_lines(none)).count() == 0
