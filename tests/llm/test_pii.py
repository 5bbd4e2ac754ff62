import hashlib
import math
import random
import re
import time

from voxfield.llm import pii

from .helpers import documents, empty, odd

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m.group() if c in "0123456789"]
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
            if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", "x@y.de", ".", "-", " ", "é", "1", "255", "256", "1.2.3.4", "+1", "4111111111111111", "(555)",
            "4111 1111 1111 1111", "+", "%", "12-34", "0", "@@", "..", "٣"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 16))) for _ in range(3000)] + [None, "", "a" * 3000 + "@", "@" * 50]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)
    assert sum(map(bool, map(plain_spans, texts))) > 500


def test_long_numbers():
    """Leading zeros without end, long runs of digits and dots; the time grows with the length only."""
    for text in ["0" * 5000 + ".1.1.1", "0" * 4000 + "255.1.1.1", "1.2.3." + "0" * 6000, "1" * 3000, "1." * 800, "9" * 700 + ".1.1.1.1.1.1.1"]:
        want = [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255
                                                                          for p in m.group().split("."))]
        assert [s for s in pii.base_spans(text) if s[1] == "ip"] == [(a, "ip", b) for a, _, b in want]
    start = time.time()
    for text in ["7" * 1_000_000, "0" * 1_000_000 + ".1.1.1", "1." * 500_000, "+1" + "(" * 500_000, "a" * 500_000 + "@", "@" * 300_000]:
        pii.base_spans(text)
    assert time.time() - start < 20


def test_least_surprise():
    """Benjamini and Hochberg over rounded surprises."""
    assert pii.least_surprise({}, 0) == math.inf and pii.least_surprise({10: 5}, 5) == math.inf
    counts = {120: 2, 60: 1, 10: 97}  # exp(-12) * 100 and exp(-6) * 100 / 3 stay below 0.05 and 0.15; exp(-1) doesn't
    assert pii.least_surprise(counts, 100) == 12.0 and pii.least_surprise({120: 2, 70: 1, 10: 97}, 100) == 7.0


def revealing_corpus():
    """One address always stands near a nickname that stands nowhere else; another word stands everywhere."""
    rng = random.Random(3)
    words = ["".join(rng.choices("aeinorst", k=6)) for _ in range(400)]
    texts = []
    for k in range(60):
        body = rng.choices(words, k=40)
        body.insert(rng.randrange(40), "everywhere")
        if k % 10 == 0:
            body[20:20] = ["Zebulon", "mail", "zeb@example.org", "everywhere"]
            body.append("ZEBULON")
        texts.append(" ".join(body))
    return texts


def test_revealing_terms(spark):
    texts = revealing_corpus() + [None, ""]
    rows = {r["doc_id"]: r for r in pii.spans(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        base = plain_spans(text)
        marked = [(m.start(), "term", m.end()) for m in re.finditer("(?i)zebulon|mail", text or "")
                  if not any(a < m.end() and m.start() < b for a, _, b in base)] if base else []
        assert rows[k]["spans"] == pii.listed(sorted(base + marked))
        assert rows[k]["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert rows[k]["n_email"] == len(base) and rows[k]["n_term"] == len(marked)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, texts)).collect()}
    assert "[email]" in clean[0] and not re.search("(?i)zebulon|zeb@", clean[0]) and clean[1] == texts[1]


def test_copies_of_one_passage_reveal_nothing(spark):
    text = "unusualword anotherword near me@example.org " + "filler text here " * 20
    rows = pii.spans(documents(spark, [text + str(k) for k in range(12)] + ["other words"] * 30)).collect()
    assert all(r["n_term"] == 0 for r in rows) and sum(r["n_email"] for r in rows) == 12


def test_replace():
    assert pii.replace("ab cd ef", "email:0:2,term:3:5") == "[email]  ef"
    assert pii.replace("abcdef", "ip:0:4,card:2:6") == "[ip]ef" and pii.replace(None, "") is None


def test_odd_tables(spark):
    docs = odd(spark)
    rows = pii.spans(docs).collect()
    assert len(rows) == docs.count() and all(r["spans"] == "" for r in rows)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    assert pii.spans(empty(spark)).count() == 0 and pii.sanitise(empty(spark)).count() == 0


def test_terms_beside_rare_values(spark):
    """Each address stands once, so only what the addresses share (a domain) can tell; one value stands twice."""
    rng = random.Random(9)
    words = ["".join(rng.choices("aeinorst", k=6)) for _ in range(400)]
    texts = []
    for k in range(400):
        body = rng.choices(words, k=40)
        if k < 8:
            body[20:20] = ["Quillmark", f"user{k}@quill.example", "office"]
        elif k < 10:
            body[20:20] = ["single@home.example"]
            body[3:3] = ["Wexford"]
        elif k < 60:
            body[20:20] = ["office"]
        texts.append(" ".join(body))
    rows = {r["doc_id"]: r for r in pii.spans(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        names = {text[int(a):int(b)] for kind, a, b in (s.split(":") for s in rows[k]["spans"].split(",") if s) if kind == "term"}
        assert names == ({"Quillmark"} if k < 8 else {"Wexford"} if k < 10 else set())
