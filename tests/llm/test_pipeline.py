import os

import pytest
from test_simhash_pivots import brute_survivors

import corpus_pipeline as c
from releaselens.llm import decontaminate, queries, quality_rules, secret_links

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages_against_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(c.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
            break
        assert out.columns == columns and len(rows) <= len(before)
        after = {r["doc_id"]: r for r in rows}
        if name == "quality_rules":
            kept = quality_rules.judge(docs).where("kept").select("doc.doc_id").collect()
            assert set(after) == {r[0] for r in kept}
        if name == "near_duplicates":
            ids = sorted(before)
            want, _ = brute_survivors(ids, [before[i]["text"] for i in ids])
            assert set(after) == want
        if name == "benchmark_passages":
            bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            bad = {r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()}
            assert set(after) == set(before) - bad
        if name == "secrets":
            assert set(after) == set(before)
            for d, r in after.items():
                assert not secret_links.base_spans(r["text"])
                if not secret_links.base_spans(before[d]["text"]):
                    assert r == before[d]
        docs = out


def test_run_returns_the_last_stage(spark):
    out = c.run(spark, FOLDER)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_names_of_the_queries():
    assert sorted({int(k[2:].split("_")[0]) for k in queries.queries()}) == list(range(1, 14))


def test_stages_bound_what_a_worker_holds(spark):
    """Batches of whole texts are bounded in bytes; an encoder that keeps few units gives the same pieces."""
    import pyarrow as pa

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(setting, None)
    texts = [" ".join(f"w{(7 * i + k) % 97}" for k in range(80_000)) for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    try:
        c.secrets(spark, docs, "")
        held = [r[0] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(held) > 1 and max(held) < (4 << 20) + 2 * len(texts[0])
    finally:
        spark.conf.unset(setting) if usual is None else spark.conf.set(setting, usual)
    few, many = (c.config_packing.pieces(docs.limit(2), c.VOCABULARY, c.END_ID, kept=n) for n in (50, 1000))
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
