"""Registered queries of the text operators; each applies its operator to the whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (conversation_trie, decontamination, imatch, language_id, lattice_lm, packing, periodic_runs, pii,
               quality_rules, secrets, simhash, token_counts, toxicity)
from ..functions.store import materialize
from .common import bucket, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = bucket("doc_id", 4)
    model = language_id.train(docs.filter((remainder >= 0) & (remainder != 2)))
    return language_id.identify(docs, model).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")


@query("op2_edit_aware_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its repeated lines are edited out."""
    docs = table(spark, sf_dir, "documents")
    trees = materialize(token_counts.build(docs), "token-trees")
    return token_counts.recount(docs, token_counts.repeated_lines(docs), trees=trees, texts=False)


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents")).drop("row")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the labelled documents outside the held-out fifth."""
    return toxicity.train(docs.filter(bucket("doc_id", 5) > 0), labels)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_lattice_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice_lm.score(table(spark, sf_dir, "documents"), bucket("doc_id", 10) > 0)
    return scored.select("doc_id", (bucket("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def periodic_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by their ids, go on periodically from one of their words."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    block = words[start:start + period]
    return words[:start] + (block * -(-(n - start) // period))[:n - start]


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), periodic_tail).withColumn(
        "_best", periodic_runs.strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length",
                        "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_imatch")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = imatch.against_edits(docs, imatch.lexicon(docs))
    mark, edited, following = F.col("mark"), F.col("edited_mark"), F.col("next_mark")
    return marked.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), imatch.written(mark).alias("fingerprint"),
        imatch.written(edited).alias("edited_fingerprint"), imatch.likeness(mark, edited).alias("near_edited"),
        imatch.likeness(mark, following).alias("near_next"))


#: CRC-32 bit by bit: the bytes of the text, each followed by eight shifts (-1).
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}) + 1),
    lambda i: list_prepend(ascii({0}[i])::BIGINT, list_transform(range(8), lambda j: -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS size, {_CRC32.format("(conv_id::VARCHAR)")} % 6 AS h FROM t GROUP BY conv_id),
c AS (SELECT s.conv_id, s.h, g.conv_id AS giver, least(s.h, coalesce(g.size, 0)) AS given
  FROM s LEFT JOIN s g ON g.conv_id = s.conv_id - s.conv_id % 100),
u AS (
  SELECT c.conv_id, t.place AS d, t.r, t.x FROM c JOIN t ON t.conv_id = c.giver AND t.place <= c.given
  UNION ALL
  SELECT c.conv_id, t.place - c.h + c.given, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.place > c.h),
w AS (SELECT conv_id, d, length(x) AS chars, dense_rank() OVER (ORDER BY r, x) AS word FROM u),
q AS (SELECT c.conv_id, coalesce(list(w.word ORDER BY w.d) FILTER (WHERE w.word IS NOT NULL), []) AS words
  FROM c LEFT JOIN w ON w.conv_id = c.conv_id GROUP BY c.conv_id),
e AS (SELECT conv_id, words, unnest(range(len(words) + 1)) AS d FROM q),
m AS (SELECT conv_id, d, list_slice(words, 1, d) AS path, d = len(words) AS ends FROM e),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY path, d),
k AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * coalesce(w.chars, 0) AS saved
  FROM n LEFT JOIN k ON k.path = n.path LEFT JOIN w ON w.conv_id = n.conv_id AND w.d = n.d),
b AS (SELECT m.path, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
  FROM v JOIN m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY m.path)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, v.ends_sha256
FROM v JOIN b ON b.path = v.path LEFT JOIN n p ON v.d > 0 AND p.path = list_slice(v.path, 1, v.d - 1)
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered(table(spark, sf_dir, "conversations"))
    return conversation_trie.nodes(*conversation_trie.share_heads(turns))
