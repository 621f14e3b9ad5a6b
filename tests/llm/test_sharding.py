"""The ring, key by key, and input columns with odd names."""

from __future__ import annotations

import random
from bisect import bisect_left

import pytest

from trajecta.llm import html_extract, secret_scan, sharding, simhash, url_filter


def clockwise(counts, n_shards, epsilon):
    """Where each key goes: first those that find room with the owner of their place, then the others, on from node to node."""
    at, owner = sharding.ring_owners(n_shards)
    room = sharding.capacities(sum(counts.values()), n_shards, epsilon)
    home, late = {}, []
    for slot in sorted(counts):
        node = bisect_left(at, slot) % len(at)
        for rank in range(counts[slot]):
            if room[owner[node]]:
                room[owner[node]] -= 1
                home[slot, rank] = owner[node]
            else:
                late.append((slot, rank, node))
    for slot, rank, node in late:
        while not room[owner[node % len(at)]]:
            node += 1
        room[owner[node % len(at)]] -= 1
        home[slot, rank] = owner[node % len(at)]
    return home


def placed(counts, n_shards, epsilon):
    return {(slot, i): shard for slot, a, b, shard, _ in sharding.place(counts, n_shards, epsilon) for i in range(a, b)}


@pytest.mark.parametrize("epsilon", [0.0, 0.1, 0.5])
def test_places_are_those_of_a_clockwise_walk(epsilon):
    r = random.Random(int(10 * epsilon))
    for n_shards in (1, 3, 17, 40):
        counts = {r.randrange(sharding.RING): r.randint(1, 40) for _ in range(400)}
        counts[r.randrange(sharding.RING)] = 6000  # a slot that overflows many shards
        got = placed(counts, n_shards, epsilon)
        assert got == clockwise(counts, n_shards, epsilon)


def test_few_rows_move_when_a_shard_is_added():
    r = random.Random(8)
    counts = {}
    for _ in range(60_000):
        slot = r.randrange(sharding.RING)
        counts[slot] = counts.get(slot, 0) + 1
    a, b = placed(counts, 40, 0.0), placed(counts, 41, 0.0)
    assert sum(a[k] != b[k] for k in a) < 0.12 * len(a)


def test_columns_named_like_those_of_operators_come_back(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", "some text of a document", "s")], "doc_id long, url string, text string, source string").selectExpr("*", "'x' as __h", "'y' as __fp", "'z' as __host", "'u' as __spans")
    names = {"__h", "__fp", "__host", "__spans"}
    for out in (sharding.shard_rows(df, n_shards=2), simhash.simhash_duplicates(df), secret_scan.find_secrets(df), secret_scan.redact_live(df), url_filter.filter_urls(df, url_filter.rule_table(spark, url_filter.RULES))):
        row = out.collect()[0]
        assert names <= set(out.columns) and [row[c] for c in ("__h", "__fp", "__host", "__spans")] == ["x", "y", "z", "u"]
    page = html_extract.extract_pages(spark.createDataFrame([("<p>x", "v")], "html string, __h string"), html_extract.default_model()).collect()[0]
    assert page["__h"] == "v"
