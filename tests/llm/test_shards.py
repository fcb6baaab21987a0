"""Round trips through versions, merges and failed writers."""

import pytest

from larkspur.llm.shards import LostRace, ShardStore


def store(spark, tmp_path, **more):
    return ShardStore(spark, f"file://{tmp_path}/store", **more)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_appends_merge_by_tier_and_read_back(spark, tmp_path):
    s = store(spark, tmp_path, target=1 << 30)
    want = []
    for k in range(9):
        part = [(k * 10 + i, f"text {k} {i}", None if i % 3 else "x") for i in range(5)]
        want += part
        s.append(spark.createDataFrame(part, "id long, text string, note string"))
    assert s.version() == 9 and len(s.manifest()["shards"]) == 9
    assert rows(s.read()) == rows(spark.createDataFrame(want, "id long, text string, note string"))
    s.compact()
    assert len(s.manifest()["shards"]) < 4
    assert sorted(r["id"] for r in s.read().collect()) == sorted(w[0] for w in want)


def test_batches_hot_keys_nulls_and_repeats(spark, tmp_path):
    s = store(spark, tmp_path)
    part = [(i % 7, "same", "hot" if i % 3 else None) for i in range(300)] + [(None, None, "b c/=%")]
    df = spark.createDataFrame(part, "id long, text string, _batch string").withColumnRenamed("_batch", "b")
    s.append(df.withColumn("_batch", df["b"]), "b")
    assert len(s.manifest()["shards"]) == 3 and s.version() == 3
    assert sorted(x["rows"] for x in s.manifest()["shards"]) == [1, 100, 200]
    assert s.read().count() == 301
    s.compact()
    assert s.read().count() == 301


def test_large_shards_are_left_alone(spark, tmp_path):
    s = store(spark, tmp_path, target=1)
    for k in range(5):
        s.append(spark.createDataFrame([(k,)], "id long"))
    before = s.manifest()
    assert s.compact() == before


def test_a_version_is_made_once(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(spark.createDataFrame([(1,)], "id long"))
    base = s.manifest()
    s.append(spark.createDataFrame([(2,)], "id long"))
    with pytest.raises(LostRace):
        s.commit(base, base["shards"], base["schema"])
    assert s.version() == 2 and s.read().count() == 2
    assert s.read(1).count() == 1


def test_vacuum_deletes_what_no_manifest_names(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(spark.createDataFrame([(1,)], "id long"))
    spark.createDataFrame([(9,)], "id long").write.parquet(f"{s.root}/data/lost")
    s.vacuum()
    assert (tmp_path / "store/data/lost").exists()  # a writer may be about to commit it
    s.vacuum(age=-60)
    assert not (tmp_path / "store/data/lost").exists() and s.read().count() == 1


def test_a_writer_between_write_and_commit(spark, tmp_path):
    """Another writer appends and compacts before this one's commit, which is then tried again."""
    one, two = store(spark, tmp_path), store(spark, tmp_path)
    for k in range(3):
        one.append(spark.createDataFrame([(k,)], "id long"))
    commit, raced = one.commit, []

    def late(base, shards, schema):
        if not raced:
            raced.append(1)
            two.append(spark.createDataFrame([(100,)], "id long"))
            two.compact()
            two.vacuum()
        return commit(base, shards, schema)

    one.commit = late
    one.append(spark.createDataFrame([(200,)], "id long"))
    assert rows(one.read()) == [(0,), (1,), (2,), (100,), (200,)]
    assert sum(x["rows"] for x in one.manifest()["shards"]) == 5


def test_a_merge_whose_shards_are_gone_is_given_up(spark, tmp_path):
    one, two = store(spark, tmp_path), store(spark, tmp_path)
    for k in range(4):
        one.append(spark.createDataFrame([(k,)], "id long"))
    written, raced = one._written, []

    def late(path):
        if not raced:
            raced.append(1)
            two.compact()
        return written(path)

    one._written = late
    one.compact()
    assert rows(one.read()) == [(0,), (1,), (2,), (3,)] and len(one.manifest()["shards"]) == 1


def test_a_reader_across_a_compaction(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(4):
        s.append(spark.createDataFrame([(k,)], "id long"))
    before = s.read()
    s.compact()
    s.vacuum()
    assert rows(before) == rows(s.read()) == [(0,), (1,), (2,), (3,)]


def test_long_texts_clashing_names_and_another_schema(spark, tmp_path):
    s = store(spark, tmp_path)
    part = [(k, "x" * 3_000_000 if k == 2 else "", "a") for k in range(4)]
    for row in part:
        s.append(spark.createDataFrame([row], "_batch long, _merge string, at string"))
    s.compact()
    assert rows(s.read()) == sorted(part)
    with pytest.raises(ValueError, match="schema"):
        s.append(spark.createDataFrame([(1,)], "id long"))


def test_empty(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.manifest()["version"] == 0
    s.append(spark.createDataFrame([], "id long, text string"))
    assert s.compact()["shards"] == [] and s.read().columns == ["id", "text"] and s.read().count() == 0
