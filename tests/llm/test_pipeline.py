import numpy as np

import corpus_pipeline
import __spark_entry__ as entry
from labelflow.llm import decontam, quality, secrets
from labelflow.llm.queries import QUERIES, byte_vocabulary
from labelflow.sources.tables import table

from tests_llm_brute import components_by_brute, hit_ids, tokens_by_tiktoken

SF = "/root/testdata/sf0.01"


def test_queries_are_registered():
    q = entry.queries()
    assert set(QUERIES) <= set(q) and [k for k in QUERIES if k.startswith("op")] == sorted(
        (k for k in QUERIES if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))
    assert len([k for k in QUERIES if k.startswith("op")]) == 10 and "pipeline" in q


def test_stages_decide_on_what_is_left(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = stage(spark, kept, SF).cache()
        after = {r.doc_id: r for r in kept.collect()}
        assert kept.columns == names and set(after) <= set(before)
        if name == "quality":
            model = quality.fit(docs, table(spark, SF, "labels", "doc_id", "quality"))
            assert set(after) == {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
        elif name == "near_copies":
            comp = components_by_brute([(i, r.text) for i, r in before.items()])
            assert set(after) == set(comp.values())
        elif name == "benchmark":
            bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            assert set(before) - set(after) == hit_ids([(i, r.text) for i, r in before.items()], bench)
        else:
            live = {r.doc_id for r in secrets.report(spark.createDataFrame(list(before.values()), docs.schema)).where("n_live > 0").collect()}
            assert set(after) == set(before) and {i for i in after if after[i].text != before[i].text} == live
    rows = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert [r.doc_id for r in rows] == sorted(texts) and all(r.exact for r in rows)
    want = tokens_by_tiktoken([texts[r.doc_id] for r in rows], byte_vocabulary())
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want and [r.n_tokens for r in rows] == [len(w) for w in want]


def test_odd_and_empty_documents(spark, odd_docs, tmp_path):
    bench = spark.createDataFrame([(1, "lost row with five words")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    for docs, out in ((odd_docs, tmp_path / "odd"), (odd_docs.limit(0), tmp_path / "empty")):
        docs.write.parquet(str(out / "documents.parquet"))
        bench.write.parquet(str(out / "benchmark.parquet"))
        labels.write.parquet(str(out / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(out)).collect()
        assert all(r.exact for r in rows)
    assert decontam.WINDOW == 10
