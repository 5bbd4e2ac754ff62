"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions only.

Terms are runs of letters and digits, lower-cased, each known by its XXH64. The lexicon holds the terms whose inverse
document frequency lies in a band: at least ``RARE`` and at most ``COMMON`` of all documents hold them. With d distinct
terms in a mean document, at most d / RARE terms can be that frequent; RARE is raised where d / RARE would exceed
``MOST_TERMS``, so the lexicon's size is bounded whatever the number of documents, and every task can hold it.

A document is known by its distinct lexicon terms in sorted order; where these are fewer than ``LEAST`` or than
``LEAST_SHARE`` of its terms (odd words, a rare language), by all its terms.
The fingerprint is the hash of all of them (classic I-Match), then hashes of the terms in ``PARTS`` random subsets of the
lexicon at each of ``SCALES`` rates, each rate a quarter of the one before. An edit changes only the subsets that hold a
changed term, so the subsets of low rates survive large edits and those of high rates tell near copies apart.

The likeness of two fingerprints is the share of equal hashes among the subsets from which at least one of both documents
has a term; equal fingerprints, and two without terms, have likeness 1.

Texts cross the cluster once (to the document that precedes them only as long a head as its edit needs) and are never
gathered by term: the lexicon is looked up inside the row.

Defined results: a null text is empty; the next document is that of the next larger distinct doc_id (nulls count as the
smallest id; after the last the first follows; a single document is followed by itself), of several rows with one id the
one with the smallest text hash; repeated rows get equal results; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scan import ordered_row_numbers
from ..functions.store import materialize

RARE, COMMON = 0.001, 0.2
MOST_TERMS = 1 << 19
LEAST, LEAST_SHARE = 4, 0.125
SCALES = 7
PARTS = 32
FIRST_PARTS = 8
BUCKETS = 1 << 14
#: Bits of a term's hash: scale s keeps terms whose lowest 2 s bits are zero and cuts them by the bits from here on.
PART_BITS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: Column | str) -> Column:
    """The hashes of a text's distinct terms."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON, most_terms: int = MOST_TERMS) -> DataFrame:
    """The terms in the band by the document frequencies in all texts, at most ``most_terms`` of them: one row whose
    ``buckets`` hold the terms by their remainder."""
    spark = docs.sparkSession
    counts = materialize(docs.select(F.explode(terms("text")).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")), "imatch-frequencies")
    n = docs.count()
    held = counts.agg(F.sum("n")).first()[0] or 0
    least = max(rare * n, held / most_terms)
    band = counts.filter((F.col("n") >= least) & (F.col("n") <= common * n))
    filled = band.groupBy(F.pmod("term", F.lit(BUCKETS)).alias("id")).agg(F.collect_list("term").alias("own"))
    every = spark.range(BUCKETS).join(filled, "id", "left").select(
        F.struct("id", F.coalesce("own", F.array().cast("array<bigint>")).alias("own")).alias("b"))
    return materialize(every.agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["own"]).alias("buckets")),
                       "imatch-lexicon")


def _subsets(kept: Column, scale: int) -> Column:
    """The 16-bit hashes of a scale's subsets and of all later ones; null where a subset holds no term."""
    parts = PARTS if scale else FIRST_PARTS
    left = parts + PARTS * (SCALES - 1 - scale)

    def part(t: Column) -> Column:
        return F.shiftrightunsigned(t, PART_BITS + 5 * scale).bitwiseAND(F.lit(parts - 1))

    def hashed(j: Column) -> Column:
        return let(F.filter(kept, lambda t: part(t) == j),
                   lambda own: F.when(F.size(own) > 0, F.xxhash64(own).bitwiseAND(F.lit(0xFFFF)).cast("int")))
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), hashed)
    if scale < SCALES - 1:
        fewer = F.filter(kept, lambda t: t.bitwiseAND(F.lit(3 << 2 * scale)) == 0)
        own = F.concat(own, let(fewer, lambda t: _subsets(t, scale + 1)))
    return F.when(F.size(kept) == 0, F.array_repeat(F.lit(None).cast("int"), left)).otherwise(own)


def with_prints(df: DataFrame, text: str, band: DataFrame, name: str) -> DataFrame:
    """``df`` with a column (whole, parts) of a text: the hash of all kept terms, and those of the subsets.

    The lexicon is a scalar subquery. It is named once, so that the optimizer puts it into the test of a term; the plan
    shows its name only, and no row carries it.
    """
    def inside(t: Column) -> Column:
        return F.array_contains(F.get(F.col("_lexicon"), F.pmod(t, F.lit(BUCKETS)).cast("int")), t)

    def chosen(all_terms: Column) -> Column:
        enough = F.greatest(F.lit(float(LEAST)), LEAST_SHARE * F.size(all_terms))
        return let(F.filter(all_terms, inside), lambda kept: F.when(F.size(kept) < enough, all_terms).otherwise(kept))
    mark = let(F.sort_array(let(terms(text), chosen)),
               lambda kept: F.struct(F.xxhash64(kept).alias("whole"), _subsets(kept, 0).alias("parts")))
    return df.withColumn("_lexicon", band.scalar()).select(*df.columns, mark.alias(name))


def written(mark: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits, then four for each subset, dashes for one without terms."""
    four = F.transform(mark["parts"], lambda p: F.coalesce(F.lpad(F.lower(F.hex(p.cast("long"))), 4, "0"), F.lit("----")))
    return F.concat(F.lpad(F.lower(F.hex(mark["whole"])), 16, "0"), F.array_join(four, ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that are not empty in both."""
    same = F.zip_with(a["parts"], b["parts"], lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False))))
    return F.when(a["whole"] == b["whole"], F.lit(1.0)).otherwise(
        let(F.filter(same, lambda s: s.isNotNull()),
            lambda held: F.size(F.filter(held, lambda s: s)) / F.greatest(F.size(held), F.lit(1)).cast("double")))


def fingerprints(docs: DataFrame, band: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of (doc_id, text)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_prints(texts, "text", band, "mark").select("doc_id", written(F.col("mark")).alias("fingerprint"))


def followers(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(id, pick, prev_id, want): the row of each id that the preceding id takes its head from, how long that must be at
    most, and whether an id has several rows."""
    text = F.coalesce("text", F.lit(""))
    ids = docs.select("doc_id", F.xxhash64(text).alias("pick"), F.floor(F.length(text) / 2).cast("int").alias("want"))
    ids = ids.groupBy("doc_id").agg(F.min("pick").alias("pick"), F.max("want").alias("want"), F.count(F.lit(1)).alias("rows"))
    places = materialize(ordered_row_numbers(ids, [], ["doc_id"], "place"), "imatch-order")
    total = places.count()
    before = places.select((F.col("place") % F.lit(max(total, 1)) + 1).alias("place"), F.col("doc_id").alias("prev_id"), "want")
    chain = places.select("place", F.col("doc_id").alias("id"), "pick").join(before, "place").drop("place")
    return materialize(chain, "imatch-followers"), not places.filter("rows > 1").isEmpty()


def against_edits(docs: DataFrame, band: DataFrame) -> DataFrame:
    """Every document (doc_id, n_chars, edited, mark, edited_mark, next_mark) with an edited text: its second half gives way
    to the head of the next document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chain, repeated = followers(docs)
    # the test of the hash is no join key, so both joins deal the texts out alike and share one exchange
    same_row = F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0
    heads = texts.join(chain, texts["doc_id"].eqNullSafe(chain["id"]) & same_row).select("prev_id", "want", "text")
    heads = with_prints(heads, "text", band, "next_mark").select("prev_id", F.left("text", F.col("want")).alias("head"), "next_mark")
    if repeated:
        heads = heads.dropDuplicates(["prev_id"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = texts.join(heads, texts["doc_id"].eqNullSafe(heads["prev_id"])).select(
        "doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.left("text", n - half), F.left("head", half)).alias("edited"),
        "next_mark")
    return with_prints(with_prints(both, "text", band, "mark"), "edited", band, "edited_mark").drop("text")
