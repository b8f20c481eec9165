from collections import defaultdict

import corpus_pipeline

from stowage.llm import langid
from stowage.session import table

from .test_duplicates import kept_brute, slow_matches
from .test_text_models import slow_base


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    columns, rows = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, sf_dir).cache()
        rows = after.collect()
        if name == "language":
            model = langid.learn(docs)
            assert {r.doc_id for r in rows} == {k for k, r in before.items() if (p := model.predict(r.text))[0] != "und" and p[1] >= model.limit}
        elif name == "near_duplicates":
            assert {r.doc_id for r in rows} == kept_brute([(k, r.text) for k, r in before.items()])
        elif name == "benchmark_leaks":
            items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
            assert {r.doc_id for r in rows} == before.keys() - {k for k, _ in slow_matches([(k, r.text) for k, r in before.items()], items)}
        elif name == "personal_data":
            assert {r.doc_id for r in rows} == before.keys()
            assert all(not slow_base(r.text) and r.n_chars == len(r.text) for r in rows)
            assert all(r.text == before[r.doc_id].text for r in rows if not any(c.isdigit() or c == "@" for c in before[r.doc_id].text))
        if name != "packing":
            assert after.columns == columns
            docs = after
    by = defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 1024 and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_run_gives_the_last_stage(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns) and found.count() > 0


def test_odd_rows_go_through(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, sf_dir)
            if name != "packing":
                assert after.columns == docs.columns
                docs = after
            after.collect()
