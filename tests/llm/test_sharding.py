from collections import defaultdict

import numpy as np
import pytest

from reqsieve.llm import sharding


def plain(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.array([0, 1, -1, 5, 2**62, -(2**63), *range(100, 400)], np.int64)
    for shards in (1, 2, 7, 40, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain(int(k), shards) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard_and_few():
    keys = np.arange(50_000)
    before, after = sharding.jump(keys, 40), sharding.jump(keys, 41)
    moved = before != after
    assert (after[moved] == 40).all() and 0.8 / 41 < moved.mean() < 1.2 / 41
    counts = np.bincount(before, minlength=40)
    assert counts.min() > 0.85 * 50_000 / 40


@pytest.mark.parametrize("slice_rows", [200_000, 3])
def test_slots_are_gapless(spark, slice_rows):
    rows = [(i % 50 if i % 7 else None, "same" if i % 3 else f"t{i}", 9, 9) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard int").repartition(4)
    found = sharding.assign_shards(frame, "doc_id", 5, ["doc_id", "text"], slice_rows).collect()
    assert len(found) == 300 and sorted(found[0].__fields__) == sorted(["doc_id", "text", "shard", "grown_shard", "slot"])
    slots = defaultdict(list)
    for r in found:
        assert r.shard == plain(r.doc_id or 0, 5) and r.grown_shard == plain(r.doc_id or 0, 6)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(empty, "doc_id", 5, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_shard("doc_id", 0)


def test_written_shards(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "doc_id").transform(lambda d: sharding.write_shards(d, str(tmp_path / "s"), "doc_id", 4) or d)
    again = spark.read.parquet(str(tmp_path / "s")).collect()
    assert len(again) == 100 and all(r.shard == plain(r.doc_id, 4) for r in again)
