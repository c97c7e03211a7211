import re

import corpus_pipeline
from pyspark.sql import functions as F

from pairlab.llm import mixing, quality, secret_scan, simhash
from pairlab.llm.common import saved, table
from tests.llm.cases import no_docs, odd_docs
from tests.llm.test_packing import valid

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs, after = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after[name] = (docs, out)
        docs = out
    before, out = after["quality rules"]
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    judged = quality.judge(before, table(spark, SF, "labels")).select("row.doc_id", "kept").collect()
    assert kept == {r["doc_id"] for r in judged if r["kept"]} and 0 < len(kept) < len(judged)

    before, out = after["simhash near-dedup"]
    groups = simhash.near_duplicates(before).collect()
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted({r["component_id"] for r in groups})

    before, out = after["secret scans"]
    assert out.count() == before.count()
    secret = re.compile(secret_scan.ACCESS + "|" + secret_scan.HEX)
    texts = {r["doc_id"]: r for r in out.collect()}
    changed = 0
    for r in before.collect():
        new = texts[r["doc_id"]]
        changed += new["text"] != r["text"]
        assert not secret.search(new["text"]) and new["n_chars"] == len(new["text"])
        assert new["text"] == r["text"] or "[SECRET]" in new["text"]
    assert changed > 0

    before, out = after["mixing sources"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).select("row.doc_id", "copies").collect()}
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert times == {i: c for i, c in copies.items() if c}

    before, out = after["best-fit packing"]
    rows = out.collect()
    valid(rows)
    assert sum(r["piece"] == 0 for r in rows) == before.count()


def test_run_returns_placed_pieces(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert valid(rows)


def test_stages_stand_odd_and_empty_tables(spark):
    for make in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, make(spark), SF)
            rows = out.collect()
            if name not in ("quality rules", "best-fit packing"):
                assert out.columns == make(spark).columns
            assert make is odd_docs or not rows
    assert corpus_pipeline.STAGES[2][1](spark, odd_docs(spark), SF).filter(F.col("text").isNull()).count() == 2
