"""Each stage against its operator's own result on a small table."""

import __spark_entry__ as entry
import corpus_pipeline
from corpuslake.llm import common as C
from corpuslake.llm import pii
from corpuslake.llm.decontamination import decontamination
from corpuslake.llm.ngram_join import component_ids
from corpuslake.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = C.table(spark, SF)
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == before.columns, name
        kept[name] = (before, docs)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = kept["quality rules"]
    assert ids(after) == ids(quality_rules(before).filter("kept"))
    before, after = kept["n-gram Jaccard join"]
    assert ids(after) == ids(component_ids(before).filter("n_shingles = 0 OR doc_id = component_id"))
    before, after = kept["benchmark decontamination"]
    found = C.keyed(before).join(decontamination(before, C.table(spark, SF, "benchmark")), ["did", "dn"])
    assert ids(after) == ids(found.filter("NOT contaminated"))
    before, after = kept["PII"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {d: pii.redacted(t, pii.find(t)[1]) for d, t in texts.items()}
    assert ids(stages["packing"](spark, docs, SF)) == ids(docs)


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
