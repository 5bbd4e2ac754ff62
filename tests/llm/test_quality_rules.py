import random
import re

import numpy as np

from voxfield.llm import quality_rules

from .helpers import documents, empty, labels, odd


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    inside = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(line in lines[:k] for k, line in enumerate(lines)), len(inside))


def test_counts():
    rng = random.Random(1)
    bits = ["a", "b", "é", "##", " ", "  ", "\n", "a b c", "\x0b", "\x85", "日|"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "x x x x x", "a\r\na\r\n"]
    for text in texts:
        assert quality_rules.count_statistics(text) == plain_counts(text)


def noisy(seed=13, n=800):
    rng = np.random.default_rng(seed)
    columns = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    return columns, (columns["a"] > 0.8) | ((columns["b"] > 0.7) & (columns["c"] < 0.3))


def test_rules_recover_the_conjunctions():
    columns, bad = noisy()
    rules = quality_rules.learn(columns, bad)
    fresh, truth = noisy(seed=9)
    got = np.zeros(len(truth), dtype=bool)
    for rule in rules:
        got |= quality_rules.covers(rule, fresh)
    assert np.mean(got == truth) > 0.95 and 2 <= len(rules) <= quality_rules.MOST_RULES


def test_no_rule_from_noise():
    rng = np.random.default_rng(5)
    assert len(quality_rules.learn({"a": rng.random(500)}, rng.random(500) < 0.3)) <= 1
    assert quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, dtype=bool)) == []
    assert quality_rules.learn({"a": np.zeros(50)}, np.ones(50, dtype=bool)) == []


def test_judgement_of_a_table(spark):
    rng = random.Random(4)
    texts, quality = [], []
    for k in range(300):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(80)]
        bad = k % 4 == 0
        texts.append(" ".join(w + "##" * (bad and rng.random() < 0.7) for w in words))
        quality.append(int(not bad))
    texts += ["few words", " ".join(["again and again"] * 40), None]
    rows = {r["doc_id"]: r for r in quality_rules.judge(
        documents(spark, texts), labels(spark, [(k, q, 0) for k, q in enumerate(quality) if k < 200])).collect()}
    for k, text in enumerate(texts):
        r, want = rows[k], plain_counts(text)
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
    assert [rows[k]["kept"] for k in range(200, 300)] == [bool(q) for q in quality[200:]]
    assert not any(rows[k]["kept"] for k in (300, 301, 302))


def test_expression_equals_the_rules(spark):
    columns, bad = noisy()
    rules = [(quality_rules.Condition("n_words", True, 60.0), quality_rules.Condition("word_length", False, 4.5)),
             (quality_rules.Condition("symbols_by_word", True, 0.2),)]
    frame = spark.createDataFrame([(n, 5 * n, s, 0, 0) for n in (0, 10, 61, 100) for s in (0, 10, 50)],
                                  ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    short = frame.withColumn("word_chars", frame["word_chars"] - frame["n_words"])
    got = [r[0] for r in short.select(quality_rules.first_rule(rules)).collect()]
    want = [1 if r["n_words"] > 60 else 2 if r["n_symbols"] / max(1, r["n_words"]) > 0.2 else None for r in short.collect()]
    assert got == want


def test_odd_tables(spark):
    docs = odd(spark)
    for marks in (labels(spark, [(None, 0, 0), (4, None, 1), (99, 1, 1)]), labels(spark, []),
                  labels(spark, [(4, 1, 0), (4, 0, 0), (5, 1, 0)])):
        rows = quality_rules.judge(docs, marks).collect()
        assert len(rows) == docs.count() and not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.judge(empty(spark), labels(spark, [])).count() == 0
