import collections
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, empty

import corpus_pipeline
from nearfield.llm import fertility, packing, secret_scan, simhash


def test_stages_match_their_operators(spark):
    docs, columns = awkward(spark).select(*corpus_pipeline.COLUMNS), corpus_pipeline.COLUMNS
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name == "quality rules":
            kept = {(r["doc_id"]) for r in fertility.quality(docs).collect() if r["kept"]}
            assert {r["doc_id"] for r in out.collect()} == kept
        elif name == "near-dedup":
            found = simhash.similar_groups(docs.filter("doc_id is not null")).collect()
            assert {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == {r["component_id"] for r in found}
        elif name == "secret scan":
            assert not any(r["findings"] for r in secret_scan.secret_spans(out).collect())
            assert out.count() == docs.count()
        else:
            want = packing.tokenise_pieces(docs).groupBy("doc_id").count().collect()
            assert collections.Counter(r["doc_id"] for r in out.collect()) == {r["doc_id"]: r["count"] for r in want}
            break
        assert out.columns == columns
        docs = out.persist()


def test_empty_documents(spark):
    docs = empty(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
