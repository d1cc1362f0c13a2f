"""The trie of conversations."""

import random

import brute
import pytest

from threadloom.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def as_set(df):
    rows = df.collect()
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    found = {tuple(r[c] for c in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_op11_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_set(queries.op11_prefix_trie(spark, folder)) == brute.trie(rows, rebuilt=True)


def made(seed, n, texts, longest):
    draw = random.Random(seed)
    turns = lambda: [(draw.choice(["user", "bot", None]), draw.choice(texts)) for _ in range(draw.choice([1, 3, longest]))]
    stems = [turns() for _ in range(5)]
    rows = []
    for c in draw.sample(range(-40, 3 * n), n):
        stem = draw.choice(stems)
        path = [*stem[: draw.randrange(len(stem) + 1)], *(turns() if draw.random() < 0.4 else [])]
        order = [None, *range(len(path) - 1)] if path and draw.random() < 0.3 else range(len(path))
        rows += [(c, t, role, text) for t, (role, text) in zip(order, path, strict=True)]
    same = [(c, t, "user", f"same {t}") for c in range(3 * n, 4 * n) for t in range(3)]
    draw.shuffle(rows)
    return [*rows, *same, (None, 1, "user", "no conversation"), (7 * n, 1, None, None), (7 * n, 1, None, None)]


@pytest.mark.parametrize(("segment", "shards"), [(64, 1), (3, 4), (2, 11), (1, 5)])
def test_segments_and_shards_change_nothing(spark, monkeypatch, segment, shards):
    """Nodes that many shards and segments share."""
    monkeypatch.setattr(prefix_trie, "BLOCK_SEGMENTS", 2)
    rows = made(segment, 60, ["a", "b c", "", None, "a  b\tc"], 14)
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert as_set(prefix_trie.prefix_trie(df, size=segment)) == brute.trie(rows, rebuilt=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_conversations(spark, tmp_path):
    df = spark.createDataFrame([(21, 1, "user", "one", 5), (45, None, None, None, 5), (45, 2, "bot", "x y", 5), (None, 3, "a", "b", 5)], SCHEMA + ", n_convs int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [tuple(r)[:4] for r in df.collect()]
    assert as_set(queries.op11_prefix_trie(spark, str(tmp_path))) == brute.trie(rows, rebuilt=True)
    assert prefix_trie.prefix_trie(df.filter("1 = 0")).count() == 0
