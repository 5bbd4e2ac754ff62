import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxfield.llm import toxicity

from .helpers import documents, empty, labels, odd

INSULTS = {"en": ["oaf", "dolt", "nitwit"], "fr": ["idiotte", "crétine"]}


def corpus(seed=2, n=600):
    rng = random.Random(seed)
    words = {"en": ["the", "and", "with", "house", "water", "thing", "why", "work"],
             "fr": ["été", "où", "forêt", "être", "maison", "garçon", "eau", "très"]}
    texts, toxic, lang = [], [], []
    for k in range(n):
        own = "en" if k % 3 else "fr"
        body = rng.choices(words[own], k=rng.randint(5, 80))
        bad = rng.random() < 0.2
        for _ in range(3 * bad):
            body.insert(rng.randrange(len(body)), rng.choice(INSULTS[own]).upper() + rng.choice(["", "!", ","]))
        texts.append(" ".join(body))
        toxic.append(int(bad))
        lang.append(own)
    return texts, toxic, lang


def test_held_out_accuracy():
    texts, toxic, lang = corpus()
    model = toxicity.fit(texts[:400], np.array(toxic[:400]), lang[:400], np.ones(400))
    scores = model.scores(texts[400:])
    assert np.mean((scores >= 0.5) == np.array(toxic[400:])) > 0.97
    assert model.languages == ["en", "fr"]
    assert np.mean(model.language(texts[400:]) == [model.languages.index(x) for x in lang[400:]]) > 0.95


def test_pooling_stays_within_a_text():
    texts, toxic, lang = corpus(n=120)
    model = toxicity.fit(texts, np.array(toxic), lang, np.ones(120))
    odd_texts = [texts[0], None, "", texts[1], "one", texts[2]]
    alone = np.array([model.logits([t])[0] for t in odd_texts])
    assert np.allclose(model.logits(odd_texts), alone, atol=1e-4)


def test_whole_text_counts():
    texts, toxic, lang = corpus()
    model = toxicity.fit(texts, np.array(toxic), lang, np.ones(len(texts)))
    long = "the water " * 30_000 + "dolt nitwit oaf"
    assert model.scores([long])[0] >= 0.5 > model.scores(["the water " * 30_000])[0]


def test_queries_of_a_table(spark):
    texts, toxic, lang = corpus()
    docs = documents(spark, texts, lang)
    held = {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 == 0}
    marks = labels(spark, [(k, 1, toxic[k]) for k in range(len(texts)) if k not in held])
    model = toxicity.train(docs, marks)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert np.mean([rows[k]["predicted"] == toxic[k] for k in held]) > 0.95
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {k for k, r in rows.items() if r["predicted"] == 0}


def test_odd_tables(spark):
    docs = odd(spark)
    none = labels(spark, [(3, 1, None), (None, 0, 1), (77, 0, 1)])
    for marks in (none, none.limit(0), labels(spark, [(1, 0, 0), (2, 1, 1), (2, 1, 1), (4, 0, 0), (5, 0, 0)])):
        model = toxicity.train(docs, marks)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), none)).count() == 0


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    texts, toxic, lang = corpus(n=400)
    docs, marks = documents(spark, texts, lang), labels(spark, [(k, 0, t) for k, t in enumerate(toxic)])
    rows = toxicity._labelled(docs, marks, 7)
    trained = rows.filter("not held").count()
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    monkeypatch.setattr(toxicity, "EPOCHS", (6, 6))
    found = rows.select("toxic", "words", F.floor(F.col("place") * 4).alias("shard")).repartition(4, "shard").sortWithinPartitions("shard")
    pieces = [(shard, len(coded)) for part in found.rdd.glom().collect() for shard, _, coded in toxicity._pieces(
        [pa.RecordBatch.from_pylist([r.asDict() for r in part])] if part else [])]
    assert sum(n for _, n in pieces) == rows.count() == len(texts) and max(n for _, n in pieces) <= 100
    model = toxicity.train(docs, marks)
    letters = toxicity._letter_sums(rows)
    assert {k: v.sum() for k, v in letters.items()} == {
        k: toxicity.letters([t for t, x in zip(texts, lang) if x == k]).sum() for k in set(lang)}
    assert sum(r["n"] for r in toxicity._check_counts(rows.filter("held"), model)) == len(texts) - trained
    scores = model.scores(texts)
    assert np.mean((scores >= 0.5) == np.array(toxic)) > 0.95
