"""The corpus pipeline against brute-force versions of its stages."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from test_operators import brute_components, brute_contamination, brute_quality

from lectern.llm import mixing, shards


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, awkward):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = awkward.select(*docs.columns).where("doc_id is null or doc_id >= 0").withColumn("doc_id", awkward["doc_id"] + 100_000)
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_and_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    text = columns.index("text")
    key = lambda rs: sorted(map(repr, rs))

    good = P.quality_rules(spark, docs, tables)
    want = [r for r in rows if not brute_quality(r[text])[-1]]
    got = [tuple(r) for r in good.collect()]
    assert good.columns == columns and set(got) <= set(want) and len(got) >= 0.95 * len(want)

    one = P.ngram_jaccard_join(spark, good, tables)
    found = brute_components([(r[0], r[text]) for r in got])
    groups = {}
    for (d, n, c), r in zip(found, got):
        groups.setdefault((c, None if c is not None else r[text]), []).append(r)
    kept = [tuple(r) for r in one.collect()]
    assert one.columns == columns and len(kept) == len(groups)
    assert {r[0] for r in kept} == {c for c, _ in groups}

    clean = P.benchmark_decontamination(spark, one, tables)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]

    def bad(r):
        n, hit, _ = brute_contamination(r[text], items)
        return hit > 0 and 20 * hit >= n

    assert key(tuple(r) for r in clean.collect()) == key(r for r in kept if not bad(r))

    mixed = P.source_mixing(spark, clean, tables)
    taken = mixing.mixture(clean, epochs=1)
    assert mixed.columns == columns and mixed.count() == taken.count() > 0

    final = P.run(spark, tables)
    assert final.columns == [*columns, "slot", "shard"]
    assert key(tuple(r) for r in final.select(columns).collect()) == key(tuple(r) for r in mixed.collect())
    table = shards.lookup_table(shards.shard_names())
    assert all(r.shard == table[r.slot] for r in final.collect())


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]


def test_empty_tables(spark, tmp_path):
    for n in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").limit(0).write.parquet(str(tmp_path / f"{n}.parquet"))
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-2:] == ["slot", "shard"]
