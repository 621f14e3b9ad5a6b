"""SimHash near-duplicates: fingerprints, pivot distance tables and components.

Reference fingerprints (pivots) stand in for the fingerprints. The 64 bits fall into PARTS parts; two fingerprints at
most LINK = 3 bits apart agree on at least PARTS - 3 of them, so for one choice of parts (a table) their distances to
all pivots, measured within those parts, are the same. Each table therefore deals fingerprints out by these distances:
only fingerprints with equal rows meet, which comes to a join of equal parts that goes before the search by coordinates
(cells of distances to full-width pivots alone hold far too many: these all lie near 32). Of what meets, pairs whose distances to the full-width pivots differ by more
than 3 in some coordinate are discarded (the triangle inequality), and the survivors are verified bit by bit. No pair
within 3 bits is missed. Groups larger than a block are dealt out once more, as pairs of blocks, and a task passes on
only as many links as keep what it saw connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, checkpoint, map_batches, shielded, table, with_outputs
from trajecta.llm.components import connected_components

SEED, SHINGLE, LINK, PARTS = 42, 3, 3, 5
PIVOTS, TABLE_PIVOTS = 24, 16
BLOCK = 4096
PIECE = 1 << 16  # shingles that are hashed at a time


def fingerprint(text: str | None) -> int:
    """64 bits: 1 where more than half of the shingles' hashes have a 1."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for a in range(0, n, PIECE):
        part = words[a : min(a + PIECE, n) + SHINGLE - 1]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*[part[k:] for k in range(SHINGLE)], strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with __fp, the fingerprint as a signed long, and without its text unless keep_text."""
    fields = [f for f in df.schema.fields if f.name != text]
    kept = [*fields, *[df.schema[text]] * keep_text]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(fp)], [f.name for f in kept] + ["__fp"])

    return map_batches(df.select(*[f"`{f.name}`" for f in fields], f"`{text}`"), run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["__fp long"]))


def pivots() -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=64))
    return rng.integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, PIVOTS, dtype=np.uint64)


def masks(parts: int = PARTS, same: int = PARTS - LINK) -> list[int]:
    """The bits of each table: all choices of so many parts."""
    edge = [round(64 * i / parts) for i in range(parts + 1)]
    part = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(parts)]
    return [sum(part[i] for i in c) for c in combinations(range(parts), same)]


def distances(fp: np.ndarray, mask: int = (1 << 64) - 1, n: int = PIVOTS) -> np.ndarray:
    """A row for each fingerprint: Hamming distances to the pivots within mask."""
    return np.bitwise_count((fp[:, None] ^ pivots()[None, :n]) & np.uint64(mask)).astype(np.int8)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def table_keys(fp: np.ndarray, masks: list[int]) -> np.ndarray:
    """A row for each table: a digest of each fingerprint's distances to the pivots within the table's mask."""
    out = np.empty((len(masks), len(fp)), np.uint64)
    for t, m in enumerate(masks):
        key = np.full(len(fp), 0x9E3779B97F4A7C15 + t, np.uint64)
        for w in np.ascontiguousarray(distances(fp, m, TABLE_PIVOTS)).view(np.uint64).reshape(len(fp), -1).T:
            key = (key ^ w) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
        out[t] = key
    return out


def table_rows(fps: DataFrame) -> DataFrame:
    """(table, key, fp): key is a digest of the row of distances to the pivots within the table's parts."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = _rows(b)
        keys = table_keys(fp, masks())
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), len(fp))), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fp.view(np.int64), len(keys)))], ["table", "key", "fp"])

    return map_batches(fps.select("fp"), run, "table int, key long, fp long")


def _forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (one from left, one from right) that are linked, only as many as keep what is linked connected."""
    root = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    d, out = distances(fp).astype(np.int8), []
    for i in left:
        near = right[right > i] if left is right else right
        for c in range(0, PIVOTS, 4):  # by and by: most pairs fall at the first coordinates
            if not len(near):
                break
            near = near[(np.abs(d[near, c : c + 4] - d[i, c : c + 4]) <= LINK).all(axis=1)]
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= LINK]
        for j in near:
            a, b = find(int(i)), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(i), int(j)))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (table, key, i, j, side, fp) that come sorted, the links within each (table, key, i, j)."""
    rest: list[np.ndarray] = []
    names = ["a", "b"]

    def groups(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = rows[:, :4]
        cut = np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1
        a, b = [], []
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
        for s, e in zip(starts[stops - starts > 1], stops[stops - starts > 1], strict=True):
            fp, side = np.ascontiguousarray(rows[s:e, 5]).view(np.uint64), rows[s:e, 4]
            at = np.arange(e - s)
            left, right = (at, at) if rows[s, 2] == rows[s, 3] else (at[side == 0], at[side == 1])
            for i, j in _forest(fp, left, right):
                a.append(int(rows[s + i, 5]))
                b.append(int(rows[s + j, 5]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        same = (rows[:, :4] == rows[-1, :4]).all(axis=1)
        n = len(rows) - (int(same[::-1].argmin()) if not same.all() else len(rows))
        if n:
            yield from groups(np.concatenate([*rest, rows[:n]]))
            rest = []
        elif rest and (rest[-1][-1, :4] != rows[-1, :4]).any():
            yield from groups(np.concatenate(rest))
            rest = []
        rest.append(rows[n:])
    if rest:
        yield from groups(np.concatenate(rest))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that connect just what links of at most 3 bits connect."""
    return arrow_map(deal(checkpoint(table_rows(fps)), "fp"), _links, "a long, b long")


def deal(rows: DataFrame, item: str) -> DataFrame:
    """(table, key, i, j, side, item), sorted, from rows (table, key, item): each group of two and more in one task, or, if it is larger than BLOCK, each pair (i, j) of its blocks."""
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes, ["table", "key"])
    chunks = F.ceil(F.col("n") / BLOCK)
    met = met.withColumn("chunks", chunks.cast("int")).withColumn("c", F.pmod(F.xxhash64(item), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("c")).alias("i"), F.greatest(k, F.col("c")).alias("j"), (k < F.col("c")).cast("int").alias("side")))
    dealt = met.withColumn("p", F.explode(pairs)).select("table", "key", "p.i", "p.j", "p.side", *[c for c in rows.columns if c not in ("table", "key")])
    return dealt.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")


def near_duplicates(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """marked (key, __fp) with component_id: the smallest key that a chain of links reaches, the row's own included.

    Null keys are the smallest of none: a class of rows with null keys only has a null component_id.
    """
    fps = checkpoint(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(key).alias("least")))
    found = connected_components(links(fps))
    classes = fps.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(named, "__fp")


@shielded
def simhash_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df without its text, with fingerprint (16 hex digits) and component_id.

    Null and empty texts have the fingerprint zero and are linked like any other; shorter texts than a shingle are hashed
    whole, however long; repeated rows share their fingerprint. Input columns with the names of outputs are replaced. An
    empty table gives an empty result.
    """
    marked = checkpoint(with_fingerprint(with_outputs(df, ["fingerprint", "component_id"]), text))
    out = near_duplicates(marked, key)
    return out.select(*[F.col(c) for c in marked.columns if c != "__fp"], F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
