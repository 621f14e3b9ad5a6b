"""Shingles, near copies and the rows that stay, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from trajecta.llm import bloom, near_copies, shingling

DOCS = "doc_id long, text string, source string"


def plain_shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain_classes(texts):
    """For each text the number of the first that it leads to."""
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_shingles_are_those_of_the_words():
    r = random.Random(1)
    odd = [None, "", "a", " a b  c d ", "a b c d e", "\n", "A B C D E f", "x" * 3000 + " b c d e", ("w" + "z" * 600 + " ") * 7, "é b c d e f g", "q" * 700_000 + " a b c d e f", " " * 600_000 + "a b c d e", "\x1c a b c d e \x85 f g h"]
    odd += [" ".join(r.choice("abcd") * r.randint(1, 700) for _ in range(2000)), " ".join(f"w{r.randrange(9000)}" for _ in range(150_000))]
    many = list(shingling.shingle_sets(odd))
    assert [len(s) for s in many] == [len(plain_shingles(t)) for t in odd]
    assert all((np.diff(s.astype(object)) > 0).all() for s in many if len(s) < 5000)
    for t, s in zip(odd, many, strict=True):
        assert (shingling.shingles(t) == s).all()
    assert (shingling.shingles("A b C d E f") == shingling.shingles("a\tB c\nd e F")).all()


def test_profiles_never_differ_more_than_the_sets():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 3000)
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: r.randint(0, n)]) | {r.getrandbits(64) for _ in range(r.randint(1, n // 3 + 1))}
        p = near_copies.Profiles([near_copies.profile(np.array(sorted(s), np.uint64)) for s in (a, b, a)])
        i, j = np.array([0, 1, 0]), np.array([1, 0, 2])
        if max(p.level) <= 2 * min(p.level):
            d = p.differences(i, j)
            assert d[0] == d[1] <= len(a ^ b) and d[2] == 0


def test_permutations_do_not_crowd_out_copies(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    made = [(k, " ".join(r.sample(words, 300)), "s") for k in range(60)]
    for k in (7, 41):
        w = made[k][1].split()
        w[150] = "edited"
        made.append((1000 + k, " ".join(w), "s"))
    got = {o["doc_id"]: o["component_id"] for o in near_copies.near_copies(spark.createDataFrame(made, DOCS)).collect()}
    assert got == {k: k if k < 1000 else k - 1000 for k, _, _ in made}


def test_hot_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    r = random.Random(4)
    base = [f"w{r.randrange(4000)}" for _ in range(120)]
    made = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        made.append((k, " ".join(w), "s"))
    got = {o["doc_id"]: o["component_id"] for o in near_copies.near_copies(spark.createDataFrame(made, DOCS)).collect()}
    assert got == dict(enumerate(plain_classes([t for _, t, _ in made])))


def test_a_large_group_does_not_become_all_its_pairs(spark, monkeypatch):
    r, passed, linked = random.Random(6), [], []
    similar, components = near_copies.similar, near_copies.connected_components
    monkeypatch.setattr(near_copies, "similar", lambda found, *rest: passed.append(found.count()) or similar(found, *rest))
    monkeypatch.setattr(near_copies, "connected_components", lambda edges: linked.append(edges.count()) or components(edges))
    made = []
    for k in range(1200):  # 396 shingles, of which at most 20 are a text's own: all are similar
        w = [f"w{p}" for p in range(400)]
        for p in r.sample(range(400), 4):
            w[p] = f"x{r.randrange(10**9)}"
        made.append((k, " ".join(w), "s"))
    got = {o["component_id"] for o in near_copies.near_copies(spark.createDataFrame(made, DOCS)).collect()}
    assert got == {0} and max(passed) < 4 * len(made) and max(linked) < 4 * len(made)


def near_rows(n):
    """One group of n texts, each a component, all with the same profile."""
    same = near_copies.profile(np.random.default_rng(7).integers(0, 1 << 63, 96, dtype=np.uint64))
    node, zero = np.arange(n), np.zeros(n, np.int64)
    columns = {"key": zero + 1, "i": zero, "j": zero, "side": zero, "node": node, "size": zero + 96, "place": zero, "component": node, "profile": [same] * n}
    return pa.RecordBatch.from_pydict(columns)


@pytest.mark.parametrize("n", [40, 1500])
def test_what_a_round_holds_back_is_told(n):
    out = pa.Table.from_batches(near_copies._apart(1)(iter([near_rows(n)]))).to_pylist()
    some, back = {(o["a"], o["b"]) for o in out if o["b"] is not None}, {o["a"] for o in out if o["b"] is None}
    assert {x for p in some for x in p} == set(range(n)) and len(some) <= 2 * n
    assert {x for i in range(n) for x in (i, n - 1 - i) if i < n - 1 - i and (i, n - 1 - i) not in some} <= back
    every = pa.Table.from_batches(near_copies._apart(n)(iter([near_rows(n)]))).to_pylist()
    assert len(every) == n * (n - 1) // 2 and all(o["b"] is not None for o in every)


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(3000)}" for _ in range(60)) for _ in range(4)]
    near = base[0].split()
    near[5] = "other"
    return [(5, base[0], "a"), (3, " ".join(near), "b"), (7, base[1], "a"), (7, base[2], "a"), (7, base[1], "a"), (None, base[3], "c"), (None, base[3], "c"), (None, base[1], "d"), (9, base[3], "e"), (11, None, "f"), (12, "", "f"), (None, None, None)]


def test_one_row_of_each_class_stays(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, DOCS).withColumnRenamed("source", "__d1")  # an odd name for an input column
    kept = near_copies.keep_one(df)
    rows = kept.collect()
    assert kept.columns == df.columns and len(rows) == len(set(plain_classes([t for _, t, _ in odd_rows])))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == [(False, 3), (False, 7), (False, 7), (False, 9), (False, 11)] or sorted(r["doc_id"] for r in rows) == [3, 7, 7, 9, 12]
    assert {r["text"] for r in rows if r["doc_id"] == 7} == {odd_rows[2][1], odd_rows[3][1]}
    assert near_copies.keep_one(df.limit(0)).collect() == []


def test_bloom_filter_passes_all_keys(spark):
    df, keys = spark.range(2000).withColumnRenamed("id", "k"), spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    for size in (32, 1 << 16):
        hit = {r["k"] for r in bloom.with_hit(df, ["k"], keys, 286, size).where("__hit").collect()}
        assert {r["k"] for r in keys.collect()} <= hit and (size == 32 or len(hit) < 320)
