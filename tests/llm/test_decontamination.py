import random

from voxfield.llm import decontamination

from .helpers import documents, empty, odd

ITEMS = "item_id long, text string"


def plain_best(item, text):
    """(distance, first end) of the closest substring, by the whole table."""
    column, best = list(range(len(item) + 1)), (len(item), 0)
    for place, c in enumerate(text):
        new = [0]
        for k, p in enumerate(item, 1):
            new.append(min(column[k] + 1, new[-1] + 1, column[k - 1] + (p != c)))
        column = new
        if column[-1] < best[0]:
            best = column[-1], place + 1
    return best


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(500):
        item = "".join(rng.choices("abc ", k=rng.randint(1, 12)))
        text = "".join(rng.choices("abc ", k=rng.randint(0, 30)))
        want, most = plain_best(item, text), rng.randint(0, 12)
        got = decontamination.Pattern(item).best(text, 0, len(text), most)
        assert got == (want if want[0] <= most and want[1] else None if want[0] > most else got)


def test_pieces_cover_the_item():
    for size in range(1, 40):
        item = "abcdefghij" * 4
        for errors in range(0, size):
            own = decontamination.pieces(item[:size], errors)
            assert len(own) == errors + 1 and "".join(p for _, p in own) == item[:size]
            assert all(item[a:a + len(p)] == p and p for a, p in own)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_matches_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(k, sentence(rng, rng.randint(8, 25))) for k in range(8)] + [(8, None), (9, ""), (10, "..."), (11, None)]
    items += [(12, items[0][1])]
    texts = [None, "", "nothing here"]
    for _ in range(60):
        middle = items[rng.randrange(8)][1]
        letters = list(middle.upper() if rng.random() < 0.2 else middle)
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12, 20])):
            place = rng.randrange(len(letters))
            letters[place:place + rng.randint(0, 1)] = rng.choice(["", "z", "qq"])
        texts.append(f"{sentence(rng, 20)} {''.join(letters)}... {sentence(rng, 20)}")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.matches(
        documents(spark, texts), spark.createDataFrame(items, ITEMS), block_chars=300).collect()}
    want = {}
    for k, text in enumerate(texts):
        for number, raw in items:
            item, plain = decontamination.plain(raw), decontamination.plain(text)
            best = plain_best(item, plain) if item and plain else None
            if best and best[0] <= decontamination.budget(len(item), decontamination.ERROR_RATE):
                want[k, number] = best[0]
    assert {k: r["distance"] for k, r in got.items()} == want and want
    for (k, number), r in got.items():
        plain, item = decontamination.plain(texts[k]), decontamination.plain(dict(items)[number])
        assert plain_best(item, plain[r["start"]:r["stop"]])[0] == r["distance"]
    clean = {r["doc_id"] for r in decontamination.keep_clean(
        documents(spark, texts), spark.createDataFrame(items, ITEMS)).collect()}
    assert clean == set(range(len(texts))) - {k for k, _ in want}


def test_odd_tables(spark):
    docs = odd(spark)
    items = spark.createDataFrame([(1, "same text here now"), (2, None), (3, "?!")], ITEMS)
    assert sorted(r["doc_id"] for r in decontamination.matches(docs, items).collect()) == [5, 5, 6]
    kept = decontamination.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontamination.matches(empty(spark), items).count() == 0
    assert decontamination.matches(docs, items.limit(0)).count() == 0
    assert decontamination.keep_clean(docs, items.limit(0)).count() == docs.count()
