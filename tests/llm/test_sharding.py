import zlib
from collections import defaultdict

import pytest

from surecal.llm import sharding
from surecal.llm.common import table
from surecal.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, slot string"


def check(rows, shards, slack=0.011):
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    if slack is not None:
        whole = sum(r.size for r in rows)
        largest = max(r.size for r in rows)
        for s in range(shards):
            assert abs(sum(r.size for r in by[s]) - whole / shards) <= slack * whole / shards + largest
    return by


@pytest.mark.parametrize("part_bytes", [32 << 20, 2_000])
def test_hot_group_is_spread(spark, part_bytes):
    rows = [(i, f"text {i} " * (i % 50), "x") for i in range(3_000)]
    rows += [(10_000 + i, "the same text " * 4, "x") for i in range(1_500)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shard_documents(df, 8, sharding.Settings(part_bytes=part_bytes)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted(r[:2] for r in rows)
    by = check(out, 8)
    assert sum(any(r.doc_id >= 10_000 for r in part) for part in by.values()) > 1
    # A group that fits is not torn apart.
    few = spark.createDataFrame(rows[:3_000] + [(20_000 + i, "pair", "x") for i in range(2)], SCHEMA)
    homes = {r.shard for r in sharding.shard_documents(few, 8).collect() if r.text == "pair"}
    assert len(homes) == 1


@pytest.mark.parametrize("part_bytes", [32 << 20, 3_000])
def test_groups_that_fit_are_not_cut(spark, part_bytes):
    # Groups of 1, 5 and 10 % of a shard, in any place of the order.
    rows = [(i, f"plain {i} " + "x" * (i % 90), "x") for i in range(8_000)]
    shard = sum(len(t) + 1 for _, t, _ in rows) * 1.2 / 16
    for g in range(48):
        text = f"group {g} " + "y" * 60
        rows += [(100_000 + 1000 * g + i, text, "x") for i in range(int(shard * (0.01, 0.05, 0.095)[g % 3] / (len(text) + 1)))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = sharding.shard_documents(df, 16, sharding.Settings(part_bytes=part_bytes)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    homes = defaultdict(set)
    for r in out:
        homes[r.text].add(r.shard)
    assert {len(h) for h in homes.values()} == {1}
    check(out, 16, 0.11)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "é" * 100_000, "x"), (None, None, None)] + [
        (3, "same", "x")] * 50
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert len(out) == len(rows)
    check(out, 4, None)
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_query(spark, sf):
    out = QUERIES["op6_sharding"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    groups, whole = defaultdict(list), sum(r.size for r in out)
    slots = defaultdict(list)
    for r in out:
        groups[texts[r.doc_id]].append(r)
        slots[r.shard].append(r.slot)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for held in groups.values():
        if sum(r.size for r in held) <= 0.1 * whole / 16:
            assert len({r.shard for r in held}) == 1
    largest = max(r.size for r in out)
    for s in range(16):
        assert abs(sum(r.size for r in out if r.shard == s) - whole / 16) <= 0.11 * whole / 16 + largest
    assert len(out) == len(texts) and all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)
