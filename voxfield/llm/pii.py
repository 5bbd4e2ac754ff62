"""Personal data: pattern spans, and terms that reveal the protected values by co-occurrence.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found in whole texts. Personal values are rare, so
a span is protected as its exact value, as the part that it shares with others (domain, network, first digits) and as its
kind. A term (a plain word of at least ``LEAST_LETTERS`` letters) is weighed against each of these by the documents that
hold both, anywhere in the text: with n(t) documents that hold the term, n(e) the protected group and n(t,e) both, of D in
all, what there is to reveal is log2(D / n(e)), and the term reveals log2(s D / n(e)) with the smoothed share
s = (n(t,e) + 1/2) / (n(t) + 1). A term is marked wherever it stands in the documents of the group if it gives away at
least ``DISCLOSED`` of that and the joint occurrence is significant: by the Chernoff bound on the chance of that many
joint documents, with at most ``CHANCE`` of the findings expected false. For the test, documents with the same words
around the value count once, so copies of one passage prove nothing; what stands in one surrounding can't be
significant. ``sanitise`` removes such terms and replaces base spans by their kind.

All counts run over all documents as sums that merge before the shuffle. To disclose that much a term must have at least
the share (n(e) / D) ** (1 - DISCLOSED) of its documents among those with personal data, which two counts by word tell;
only the words that pass for the smallest group meet the groups, by a join on the row. Pairs are never collected.

Defined results: a null or empty text has no spans; repeated rows count again and get a row each; overlapping spans of
different kinds are all kept; a marked term never overlaps a base span; extra columns are ignored by ``spans`` and
passed through by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.store import materialize
from .common import map_batches, slices_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR_WORDS = 8
LEAST_LETTERS = 3
DISCLOSED = 0.95
CHANCE = 0.05
#: Surprises are counted in steps of a tenth up to 100.
STEPS, MOST_STEPS = 10, 1000
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match from inside a run of digits would end where one from its first digit does, so only that is tried, once.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[0-9]")
_term = re.compile(r"[^\W\d_]{%d,}" % LEAST_LETTERS)
_near = 24 * NEAR_WORDS


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain; the run before each @ is read backwards, so long runs cost no retries."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, stop) in code points, by start and then kind."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    if _digit.search(text):
        out += [(m.start(), 1, m.end()) for m in _ip.finditer(text)
                if all(len(p) < 4 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
        for m in _card.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _phone.finditer(text)
                    if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def entity(kind: str, value: str) -> str:
    """The value that spellings of one entity share."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{re.sub('[^0-9]', '', value)}"


def groups(kind: str, value: str) -> list[str]:
    """What a span is protected as: its value, the part that it shares with others, its kind."""
    own = entity(kind, value)
    plain = own.partition(":")[2]
    part = plain.partition("@")[2] if kind == "email" else plain.rpartition(".")[0] if kind == "ip" else plain[:6]
    return [own, f"{kind} part:{part}", f"{kind} kind"]


def nearby(text: str, start: int, stop: int) -> list[str]:
    """The plain words next to a span, at most ``NEAR_WORDS`` on each side."""
    low = max(0, start - _near)
    before = [m.group().lower() for m in _term.finditer(text, low, start) if m.start() > low or low == 0]
    after = [m.group().lower() for m in _term.finditer(text, stop, stop + _near)]
    return before[-NEAR_WORDS:] + after[:NEAR_WORDS]


def _row() -> Column:
    """A name for rows of equal id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def _extract(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row; the text where it has spans, and for each its groups and the terms nearby."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, lists, found, held = [], [], [], []
        for text in batch.column(2).to_pylist():
            own = base_spans(text)
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(s[1] == kind for s in own))
            lists.append(listed(own))
            digests.append(hashlib.sha256(lists[-1].encode()).hexdigest())
            found.append([{"groups": groups(kind, text[a:b]), "terms": nearby(text, a, b)} for a, kind, b in own])
            held.append(text if own else None)
        kind = pa.list_(pa.struct([("groups", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
             pa.array(lists, pa.string()), pa.array(found, kind), pa.array(held, pa.string())],
            names=["row", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "found", "held"])
    return map_batches(
        docs.select(_row().alias("row"), "doc_id", "text"), run,
        f"row string, doc_id {ids}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, base string, "
        "found array<struct<groups: array<string>, terms: array<string>>>, held string")


def document_counts(texts: DataFrame, weight: str | None = None) -> DataFrame:
    """(term, n): in how many documents each plain word of ``text`` stands; a row counts ``weight`` times."""
    def run(batches):
        for batch in batches:
            for part in slices_of(batch, 0, 16 << 20):
                lists = [list({w.lower() for w in _term.findall(t)}) if t else [] for t in part.column(0).to_pylist()]
                words = pa.array(lists, pa.list_(pa.string())).flatten().dictionary_encode()
                times = np.repeat(part.column(1).to_numpy(), [len(x) for x in lists])
                n = np.bincount(words.indices.to_numpy(), times, len(words.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], names=["term", "n"])
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    return texts.select("text", times.alias("times")).mapInArrow(run, "term string, n bigint").groupBy("term").agg(
        F.sum("n").alias("n"))


def _words_of(held: DataFrame) -> DataFrame:
    """(row, term) for every distinct plain word of each text."""
    def run(batches):
        for batch in batches:
            for part in slices_of(batch, 1, 4 << 20):
                lists = pa.array([list({w.lower() for w in _term.findall(t)}) for t in part.column(1).to_pylist()],
                                 pa.list_(pa.string()))
                rows = part.column(0).take(lists.value_parent_indices())
                yield pa.RecordBatch.from_arrays([rows, lists.flatten()], names=["row", "term"])
    return held.select("row", "held").mapInArrow(run, "row string, term string")


def _surprise(joint, group, term, total) -> Column:
    """Minus the log of the Chernoff bound on ``joint`` or more of ``group`` documents holding a term of ``term`` in
    ``total``."""
    q, p = joint / group, F.least(term / total, F.lit(1.0))
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.when(q > p, group * (q * F.log(q / p) + rest)).otherwise(0.0)


def least_surprise(counts: dict[int, int], tests: int, chance: float = CHANCE) -> float:
    """The lowest surprise that keeps the expected share of false findings at ``chance`` (Benjamini and Hochberg).

    ``counts`` has the number of pairs by surprise, rounded down to ``1 / STEPS``.
    """
    least, above = math.inf, 0
    for step in sorted(counts, reverse=True):
        above += counts[step]
        if tests * math.exp(-step / STEPS) <= chance * above:
            least = step / STEPS
    return least


def revealing(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(group, term) pairs over the disclosure threshold; ``held`` are the distinct rows with spans and their copies."""
    spans_of = held.select("row", "copies", F.explode("found").alias("f")).select(
        "row", "copies", F.explode("f.groups").alias("group"),
        F.xxhash64(F.array_sort(F.array_distinct("f.terms"))).alias("around"))
    belongs = materialize(spans_of.groupBy("group", "row").agg(F.min("around").alias("around"), F.first("copies").alias("copies")),
                          "pii-groups")
    # one passage in many copies is one surrounding; its smallest row stands for all
    first = belongs.groupBy("group", "around").agg(F.min("row").alias("least"), F.sum("copies").alias("rows"))
    sizes = materialize(first.groupBy("group").agg(F.count("*").alias("n_around"), F.sum("rows").alias("n_group"))
                        .filter("n_around > 1"), "pii-sizes")
    total, smallest = docs.count(), sizes.agg(F.min("n_group")).first()[0]
    if smallest is None:
        return sizes.select("group", F.lit("").alias("term")).limit(0)
    # a term gives enough away only if at least this share of its documents holds personal data
    share = F.lit((smallest / total) ** (1 - DISCLOSED))
    in_held = document_counts(held.select(F.col("held").alias("text"), "copies"), "copies").filter("n > 1")
    likely = document_counts(docs).join(in_held.withColumnRenamed("n", "_held"), "term").filter(
        F.col("_held") + 0.5 >= share * (F.col("n") + 1)).select("term", "n")
    likely = materialize(likely, "likely-terms")
    leaders = first.select("group", F.col("least").alias("row"), F.lit(1).alias("proof"))
    of = belongs.select("group", "row", "copies").join(sizes.select("group"), "group").join(leaders, ["group", "row"], "left")
    # words meet groups by the row, and only words that may reveal something
    pairs = _words_of(held).join(likely.select("term"), "term", "left_semi").join(of, "row").groupBy("group", "term").agg(
        F.sum("copies").alias("n_both"), F.coalesce(F.sum("proof"), F.lit(0)).alias("n_proofs")).filter("n_proofs > 1")
    all_documents = F.lit(float(total))
    secret = F.log2(all_documents / F.col("n_group"))
    weighed = pairs.join(sizes, "group").join(likely, "term").select(
        "group", "term", _surprise(F.col("n_proofs"), F.col("n_around"), F.col("n"), all_documents).alias("surprise"),
        ((secret > 0) & (F.log2((F.col("n_both") + 0.5) / (F.col("n") + 1)) + secret >= DISCLOSED * secret)).alias("discloses"))
    weighed = materialize(weighed, "pii-pairs")
    steps = F.least(F.floor(F.col("surprise") * STEPS), F.lit(MOST_STEPS))
    counts = {r[0]: r[1] for r in weighed.groupBy(steps.alias("step")).count().collect()}
    least = least_surprise(counts, sum(counts.values()))
    return weighed.filter(F.col("discloses") & (F.col("surprise") >= F.lit(least))).select("group", "term")


def _term_spans(text: str, terms: set[str], base: str) -> list[tuple[int, str, int]]:
    taken = [tuple(map(int, s.split(":")[1:])) for s in base.split(",") if s]
    return [(m.start(), TERM, m.end()) for m in _term.finditer(text)
            if m.group().lower() in terms and not any(a < m.end() and m.start() < b for a, b in taken)]


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, row) of every row; ``row`` is a digest of id and text."""
    extracted = materialize(_extract(docs), "pii-spans")
    held = materialize(extracted.filter("base <> ''").groupBy("row").agg(
        F.first("base").alias("base"), F.first("found").alias("found"), F.first("held").alias("held"),
        F.count("*").alias("copies")), "pii-held")
    told = materialize(revealing(docs, held), "revealing-terms")
    # a group's rows meet its terms by the words of the text: a join by the group alone would be rows times terms
    groups_of = held.select("row", F.explode(F.array_distinct(F.flatten("found.groups"))).alias("group"))
    words = _words_of(held).join(told.select("term").distinct(), "term", "left_semi").join(groups_of, "row")
    marks = materialize(words.join(told, ["group", "term"], "left_semi").groupBy("row").agg(
        F.collect_set("term").alias("terms")), "revealing-marks")
    texts = held.select("row", F.col("held").alias("text"), "base").join(marks, "row")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lists, counts = batch.column(0), [], []
        for text, base, terms in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            more = _term_spans(text, set(terms), base)
            own = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
            order = {k: n for n, k in enumerate((*KINDS, TERM))}
            lists.append(listed(sorted(own + more, key=lambda s: (s[0], order[s[1]], s[2]))))
            counts.append(len(more))
        return pa.RecordBatch.from_arrays([rows, pa.array(lists, pa.string()), pa.array(counts, pa.int64())],
                                          names=["row", "all", "n_more"])
    marked = map_batches(texts.select("row", "text", "base", "terms"), run, "row string, all string, n_more bigint")
    return extracted.drop("found", "held").join(marked, "row", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.coalesce("all", "base").alias("spans"),
        F.coalesce("n_more", F.lit(0)).alias("n_term"), "row")


def replace(text: str | None, spans_text: str | None) -> str | None:
    """The text with terms removed and other spans replaced by their kind; of overlapping spans the first counts."""
    if not text or not spans_text:
        return text
    out, at = [], 0
    for kind, a, b in (s.split(":") for s in spans_text.split(",")):
        if int(a) >= at:
            out += [text[at:int(a)], "" if kind == TERM else f"[{kind}]"]
            at = int(b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """All documents with ``text`` sanitised and all other columns as they are."""
    names, marker = docs.columns, "_pii_spans"
    found = spans(docs).filter("spans <> ''").select(F.col("row").alias("_pii_row"), F.col("spans").alias(marker))
    joined = docs.withColumn("_pii_row", _row()).join(
        found.dropDuplicates(["_pii_row"]), "_pii_row", "left").select(*names, marker)
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns[:-1])
        clean = [replace(t, s) for t, s in zip(columns[at].to_pylist(), batch.column(len(names)).to_pylist())]
        columns[at] = pa.array(clean, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)
    return map_batches(joined, run, docs.schema)
