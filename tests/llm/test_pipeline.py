"""The pipeline, stage by stage, against what brute force keeps on a small corpus."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import BASE, SCHEMA, UPPER, brute_near, family, prose
from vecscore.llm.common import free_heap


def test_stages(spark, tmp_path):
    clean = [prose(120 + k, 200 + k) for k in range(12)]
    near = family(10, 60)
    texts = [*clean, *near, BASE, BASE.upper(), BASE, "too short", None, "| a | b | c |\n" * 40]
    rows = [(k, t, "en", "s1" if k % 4 else "s2", len(t or ""), 1, "k", True) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs
    ids = {name: Counter(r.doc_id for r in df.select("doc_id").collect()) for name, df in out.items()}
    assert set(range(22)) <= set(ids["quality_rules"]) and not {25, 26, 27} & set(ids["quality_rules"])
    left = {k: texts[k] for k in ids["quality_rules"]}
    newest = {t.translate(UPPER): k for k, t in sorted(left.items())}
    assert set(ids["exact_dedup"]) == set(newest.values())
    groups = brute_near({k: texts[k] for k in newest.values()}, 5, 80)
    assert set(ids["near_dedup"]) == {k for k, (_, root) in groups.items() if root == k}
    assert set(ids["mix_sources"]) == set(ids["near_dedup"]) == set(ids["pack"])
    pieces = out["pack"].groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert all(r["sum(length)"] == r.doc_tokens * ids["mix_sources"][r.doc_id] for r in pieces)
    assert out["mix_sources"].columns == out["quality_rules"].columns


def test_a_grown_heap_is_given_back(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    grown = spark.sparkContext._gateway.new_array(spark._jvm.long, 100_000_000)
    before = runtime.totalMemory()
    assert before >= 8 * len(grown)
    spark.sparkContext._gateway.detach(grown)
    del grown
    free_heap(spark)
    assert runtime.totalMemory() <= before - 500_000_000
