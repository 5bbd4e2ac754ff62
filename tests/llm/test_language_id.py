import random
import re

from voxfield.llm import language_id

from .helpers import documents, empty, odd

WORDS = {"en": "the of and house water thing which with work through", "de": "der die und haus wasser über grün nicht schön",
         "fr": "le la été où forêt maison garçon eau très voilà"}


def text_of(rng, name, n=60):
    own = WORDS[name].split()
    return " ".join("".join(rng.sample(own, 2)) if rng.random() < 0.3 else rng.choice(own) for _ in range(n))


def plain_phrases(reference, text):
    phrases = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at:at + size + 1] in reference:
            size += 1
        at, phrases = at + max(1, size), phrases + 1
    return phrases


def test_parse_equals_plain_search():
    rng = random.Random(4)
    references = {"a": "abcab cabba ac", "b": "bbbac ccb abd"}
    model = language_id.fit({k: [v] for k, v in references.items()}, 1000)
    for _ in range(300):
        text = "".join(rng.choices("aBcdx ,1", k=rng.randint(1, 60)))
        plain = re.sub("[^a-z]+", " ", text.lower())
        assert model.phrases([None, text, ""])[0].tolist() == [
            [0, 0], [plain_phrases(r, plain) for r in references.values()], [0, 0]]


def test_windows_cover_the_whole_text():
    model = language_id.fit({"a": ["ab"], "b": ["cd"]}, 1000)
    text = "cd" * 5_000
    counts = model.phrases([text])[0][0]
    assert counts[0] == len(text) and len(text) / 2 <= counts[1] <= len(text) / 2 + len(text) / language_id.WINDOW + 1
    assert model.predict(["ab" * 200 + "cd" * 5000])[0] == ["b"]


def test_large_alphabets_keep_all_letters():
    """Two languages over the same thousands of letters in other orders, and one over a few hundred."""
    rng = random.Random(3)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    pairs = {name: [rng.choice(letters) + rng.choice(letters) for _ in range(400)] for name in ("ja", "zh")}
    pairs["ko"] = [chr(0xAC00 + rng.randrange(500)) for _ in range(200)]
    text = lambda name, n: "".join(rng.choices(pairs[name], k=n))
    model = language_id.fit({name: [text(name, 300) for _ in range(12)] for name in pairs}, 20_000)
    assert len(set(model.letters[[ord(c) for own in pairs.values() for w in own for c in w]].tolist())) > 900
    for name in pairs:
        assert model.predict([text(name, 60) for _ in range(20)])[0] == [name] * 20


def test_steps_equal_the_automaton():
    rng = random.Random(8)
    for k in (2, 20, 500):
        automaton = language_id.suffix_automaton([rng.randrange(1, k + 1) for _ in range(2000)])
        steps = language_id.Steps(8)
        steps.place([3, 5], k + 2)
        root = steps.add(automaton, k + 2)
        numbers, todo = {0: root}, [0]
        while todo:
            state = todo.pop()
            for symbol in range(1, k + 1):
                cell = int(steps.packed[numbers[state] + symbol])
                assert (cell >> 32 == numbers[state]) == (symbol in automaton[state])
                if symbol in automaton[state]:
                    to = automaton[state][symbol]
                    if to not in numbers:
                        numbers[to] = cell & 0xFFFFFFFF
                        todo.append(to)
                    assert numbers[to] == cell & 0xFFFFFFFF
        assert len(set(numbers.values())) == len(automaton)


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    names = [rng.choice(list(WORDS)) for _ in range(300)]
    docs = documents(spark, [text_of(rng, n) for n in names], names)
    model = language_id.train(docs.filter("doc_id < 150"))
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == 300 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == names[r["doc_id"]] for r in rows if r["doc_id"] >= 150]
    assert sum(held) >= 0.98 * len(held)


def test_odd_tables(spark):
    docs = odd(spark)
    rows = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(rows) == docs.count()
    for r, text in zip(sorted(rows, key=str), range(len(rows))):
        assert r["lang_pred"] in {"en", "de", "fr", "und"} and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 8)} == {"und"}
    nothing = language_id.train(empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty(spark), nothing).count() == 0
