"""The corpus pipeline: every stage against plain Python on what the stage before kept, and awkward tables."""

from collections import Counter

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmill.llm import quality

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def chain(spark, docs, sf_dir):
    """[(stage, its input, its output)]"""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, result))
        docs = result
    return out


def written(spark, tmp_path, given, schema, benchmark=brute.BENCHMARK):
    spark.createDataFrame(given, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def check_stages(steps, benchmark):
    by_name = {name: (docs, out) for name, docs, out in steps}
    for name, (docs, out) in by_name.items():
        if name != "shards":
            assert out.columns == docs.columns, name

    docs, out = by_name["quality_rules"]
    judged = quality.judged(quality.counted(docs))
    assert out.count() == judged.filter("kept").count()
    failed = {b[0] for b in brute.quality_counts([(r["doc_id"], r["text"]) for r in docs.collect()]) if b[6]}
    assert not failed & {r["doc_id"] for r in out.collect() if r["doc_id"] is not None}

    docs, out = by_name["near_duplicates"]
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    roots = brute.components([brute.shingles(t) for _, t in pairs])
    least = {}
    for (i, t), r in zip(pairs, roots, strict=True):
        if brute.shingles(t):
            least[r] = min((i is None, i or 0), least.get(r, (True, 1 << 60)))
    kept = Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert set(least.values()) <= set(kept) and sum(kept.values()) == len(least) + sum(not brute.shingles(t) for t in {p[1] for p in pairs})

    docs, out = by_name["decontamination"]
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bad = brute.contamination(pairs, benchmark)
    assert brute.in_order((r["doc_id"], r["text"]) for r in out.collect()) == brute.in_order(p for p, b in zip(pairs, bad, strict=True) if not b[5])

    docs, out = by_name["mix"]
    given, got = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
    assert set(got) <= set(given) and all(n <= 2 * given[r] for r, n in got.items())

    docs, out = by_name["shards"]
    assert out.count() == docs.count() and out.filter("shard NOT BETWEEN 0 AND 7").isEmpty()
    slots = out.groupBy("shard").agg(F.max("slot").alias("m"), F.count_distinct("slot").alias("d"), F.count("*").alias("n")).collect()
    assert all(r["m"] + 1 == r["d"] == r["n"] for r in slots)


def test_stages_on_driver_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    steps = chain(spark, docs, SMALL)
    check_stages(steps, benchmark)
    assert brute.in_order(rows(corpus_pipeline.run(spark, SMALL).select("doc_id", "shard"))) == brute.in_order(rows(steps[-1][2].select("doc_id", "shard")))


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing columns, and a text of five megabytes."""
    long_text = "\n".join(" ".join(f"w{k % 1000} w{k // 1000}" for k in range(n, n + 100)) for n in range(0, 550_000, 100))
    assert len(long_text) > 5_000_000
    given = [*brute.awkward_rows(), (900, long_text, "en", "web", len(long_text), *brute.EXTRA)]
    docs = written(spark, tmp_path, given, brute.SCHEMA)
    steps = chain(spark, docs.filter("doc_id IS NULL OR doc_id <> 900"), str(tmp_path))
    check_stages(steps, brute.BENCHMARK)
    assert {900} <= {r["doc_id"] for r in chain(spark, docs, str(tmp_path))[1][2].select("doc_id").collect()}


@pytest.mark.parametrize("table", ["documents", "benchmark"])
def test_empty_tables(spark, tmp_path, table):
    given = [] if table == "documents" else brute.awkward_rows()
    written(spark, tmp_path, given, brute.SCHEMA, [] if table == "benchmark" else brute.BENCHMARK)
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert n == 0 if table == "documents" else n > 0
