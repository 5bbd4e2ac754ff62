import __spark_entry__
import corpus_pipeline
from voxfield.llm import decontamination, packing, queries, simhash
from voxfield.llm.common import table


def test_stages_hand_over(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-" + name)
        assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= before
        before = kept[-1]
    toxic, single, clean, masked = kept
    assert single < toxic and clean < single and masked == clean
    items = [decontamination.plain(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    texts = [decontamination.plain(r["text"]) for r in docs.collect()]
    assert not any(item in text for item in items for text in texts)
    prints = [simhash.fingerprint(r["text"]) & (1 << 64) - 1 for r in docs.collect()]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == masked and len(set(prints)) >= len(prints) - 2
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * total / packing.CAPACITY + 2


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
    assert set(queries.QUERIES) <= set(names)
