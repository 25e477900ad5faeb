import pytest

import corpus_pipeline
from wardline.llm import mixing, simhash


@pytest.fixture
def moving_scan(spark, tmp_path):
    """A table of many files, and a call that makes Spark cut its next scan into other partitions."""
    rows = [(i, f"text number {i} with words {i * 7} and {i * 13} of its own {i * 31}", "en", "ab"[i % 2], 1) for i in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(12).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield spark.read.parquet(path), lambda: spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 27))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_near_dedup_keeps_every_group_when_the_scan_is_cut_otherwise(monkeypatch, moving_scan):
    docs, move = moving_scan
    inner = simhash.near_duplicate_groups

    def groups(*args, **kwargs):
        out = simhash.cut(inner(*args, **kwargs))
        move()
        return out

    monkeypatch.setattr(simhash, "near_duplicate_groups", groups)
    assert sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == list(range(60))


def test_mix_keeps_rows_with_their_own_size_when_the_scan_is_cut_otherwise(monkeypatch, spark, moving_scan):
    docs, move = moving_scan
    inner = mixing.mix_sources

    def mixed(*args, **kwargs):
        out = mixing.cut(inner(*args, **kwargs))
        move()
        return out

    monkeypatch.setattr(mixing, "mix_sources", mixed)
    rows = corpus_pipeline.mix(spark, docs, "").collect()
    assert sorted(r.doc_id for r in rows) == list(range(60))
