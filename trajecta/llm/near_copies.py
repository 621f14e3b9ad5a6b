"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Exact copies are merged first. Then operator 4's search (the module simhash: pivot distance tables, discarding by the
largest difference of coordinates, verifying bits) runs over a 64-bit SimHash of each text's set of shingles and finds
many links cheaply.

What it misses is found exactly. Shingles are put in one order for all texts, the most common ones last. Two sets with
a similarity of 0.8 share a shingle among the first fifth of either, so texts that share such a shingle and are not yet
joined by verified links are compared. Each text has a profile: how many of its shingles fall into each of some buckets.
The sum of differences of two profiles is at most the number of shingles that only one text holds (the same triangle
inequality), so most pairs fall without their texts being read, and none that is similar does. What is left is verified
on the two sets. This goes in rounds, so that a large group of near copies does not become all its pairs: of those that
share a shingle, each text is held against its nearest and the first, and what is similar is joined. Texts with pairs that
a round held back go to the next, which drops those that are joined by then and takes more of the rest, until none is held
back. So no link is wrong, and the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.bloom import with_hit
from trajecta.llm.common import arrow_map, checkpoint, free_memory, map_batches, shielded, slices, written
from trajecta.llm.components import connected_components
from trajecta.llm.shingling import shingle_sets, shingles
from trajecta.llm.simhash import BLOCK, links

__all__ = ["copy_classes", "keep_one", "near_copies", "shingles"]

SIMILAR = 0.8
LEAST_BUCKETS, MOST_BUCKETS, FULL = 16, 1024, 15  # of a profile; what a bucket counts at most
COMMON, MOST_COMMON, COUNTED = 8, 1 << 16, 1 << 19  # a shingle is common if a task's texts hold it so often; so many are put last; a task counts so many
PAIRS = 1 << 16  # that are looked at together (and four times as many cells of profiles)
FEW_KEYS = 3  # shared shingles of a text that are looked at before all are
MORE = 8  # times as many of a text's nearest in the next round


def set_fingerprint(found: np.ndarray) -> int:
    """64 bits: 1 where more than half of the set's digests have a 1; as a signed number."""
    ones = np.unpackbits(found.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(found), bitorder="little").tobytes(), "little", signed=True)


def profile(found: np.ndarray) -> bytes:
    """How many of the set fall into each bucket, at most FULL, two to a byte. There is a bucket for every one or two, within bounds."""
    n = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, int(np.ceil(np.log2(len(found) / 2))))))
    count = np.minimum(np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n), FULL).astype(np.uint8)
    return (count[0::2] | count[1::2] << 4).tobytes()


class Profiles:
    """Profiles of several texts, and the sums of differences between them; those of one have half or twice the buckets of those that are similar, or as many."""

    def __init__(self, packed: list[bytes]) -> None:
        self.level = np.array([2 * len(x) for x in packed])
        self.at, self.rows, self.folded = np.zeros(len(packed), np.int64), {}, {}
        for n in np.unique(self.level).tolist():
            here = np.flatnonzero(self.level == n)
            self.at[here] = np.arange(len(here))
            raw = np.frombuffer(b"".join(packed[i] for i in here), np.uint8).reshape(len(here), n // 2)
            rows = np.stack([raw & 15, raw >> 4], axis=2).reshape(len(here), n).astype(np.int16)
            self.rows[n], self.folded[n // 2] = rows, np.minimum(rows[:, : n // 2] + rows[:, n // 2 :], FULL)

    def differences(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair (i, j) the sum of differences, on the fewer buckets of both."""
        out, low, high = np.empty(len(i), np.int32), np.minimum(self.level[i], self.level[j]), np.maximum(self.level[i], self.level[j])
        for n in np.unique(low).tolist():
            for wider in (False, True):
                here = np.flatnonzero((low == n) & ((high > n) == wider))
                for s in range(0, len(here), 4 * PAIRS // n):
                    h = here[s : s + 4 * PAIRS // n]
                    small, large = np.where(self.level[i[h]] == n, i[h], j[h]), np.where(self.level[i[h]] == n, j[h], i[h])
                    other = self.folded[n] if wider else self.rows[n]
                    out[h] = np.abs(self.rows[n][self.at[small]] - other[self.at[large]]).sum(axis=1, dtype=np.int32)
        return out


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Digests of the MOST_COMMON most common shingles of the texts (the only column), the rarest first.

    Tasks name those they see COMMON times. Which are found sets the cost of the prefixes, and nothing else.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def merge() -> None:
            nonlocal seen, count, size
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (seen[:0], count[:0])
            at = np.searchsorted(seen, new)
            old = np.zeros(len(new), bool)
            old[at < len(seen)] = seen[at[at < len(seen)]] == new[at < len(seen)]
            count[at[old]] += n[old]
            seen, count = np.insert(seen, at[~old], new[~old]), np.insert(count, at[~old], n[~old])
            held.clear()
            size, least = 0, 1
            while len(seen) > COUNTED:  # the rarest go, so that a task's memory stays bounded
                seen, count = seen[count > least], count[count > least]
                least += 1

        for b in batches:
            for part in slices(b):
                for found in shingle_sets(part.column(0).to_pylist()):
                    held.append(found)
                    size += len(found)
                    if size > COUNTED // 2:
                        merge()
        merge()
        often = count >= COMMON
        yield pa.RecordBatch.from_arrays([pa.array(seen[often].view(np.int64)), pa.array(count[often])], ["key", "n"])
        free_memory()

    total = arrow_map(texts, over, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = total.orderBy(F.col("n").desc(), "key").limit(MOST_COMMON).collect()
    return np.array([r["key"] for r in reversed(top)], np.int64).view(np.uint64)


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Of a sorted set of shingles those of which a set with similarity SIMILAR holds one: uncommon ones first, by digest, then common ones by rank. common is sorted; maybe is a bitmap of its last bits."""
    n = len(found) - int(np.ceil(SIMILAR * len(found) - 1e-9)) + 1
    known = maybe[found & np.uint64(len(maybe) - 1)]
    some = np.flatnonzero(known)
    if not len(some):
        return found[:n]
    at = np.minimum(np.searchsorted(common, found[some]), len(common) - 1)
    real = common[at] == found[some]
    known[some[~real]] = False
    late = found[some[real]][np.argsort(rank[at[real]])]
    return np.concatenate([found[~known], late])[:n]


def _apart(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sorted rows (key, i, j, side, node, size, place, component, profile) pairs (a, b) of different components that can be similar: of each text in each group those with so many of its nearest and with the first of all. Texts with further pairs follow as (a, null)."""

    def near(rows: np.ndarray, i: np.ndarray, j: np.ndarray, profiles: Profiles) -> tuple[np.ndarray, ...]:
        """Of the pairs (i, j) of rows those that can be similar, and their sums of differences."""
        size, component, rest = rows[:, 5], rows[:, 7], rows[:, 5] - rows[:, 6]  # rest: shingles from the shared one on
        both = size[i] + size[j]
        only = both * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6  # so many shingles at most are in one set only
        fine = (component[i] != component[j]) & (np.minimum(rest[i], rest[j]) * 2 >= both - only)
        i, j, only = i[fine], j[fine], only[fine]
        differ = profiles.differences(i, j)
        fine = differ <= only
        return i[fine], j[fine], differ[fine]

    def thinned(found: list[tuple[np.ndarray, ...]], lead: np.ndarray, further: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of found pairs (i, j, differ) those that pass; rows of the others are marked in further. lead: whether a row has its group's smallest node."""
        i, j, differ = (np.concatenate(x) for x in zip(*found, strict=True))
        of, it = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)  # each pair counts for both of its texts
        order = np.lexsort((np.tile(differ, 2), of))
        at = np.arange(len(of))
        first = np.concatenate(([True], of[order][1:] != of[order][:-1]))[: len(of)]
        keep = lead[i] | lead[j]
        keep[it[order][at - np.maximum.accumulate(np.where(first, at, 0)) < most]] = True
        further[i[~keep]] = further[j[~keep]] = True
        return i[keep], j[keep], differ[keep]

    def batch(a: np.ndarray, b: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if len(a):
            ends = [pa.array(a), pa.nulls(len(a), pa.int64())] if b is None else [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    def pairs(rows: np.ndarray, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        """rows of whole groups."""
        start = np.concatenate(([0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1))
        size = np.diff(np.concatenate((start, [len(rows)])))
        group = np.repeat(np.arange(len(start)), size)
        node = rows[:, 4]
        lead, further = node == np.minimum.reduceat(node, start)[group], np.zeros(len(rows), bool)
        profiles = Profiles(packed)
        if len(start) == 1 and (rows[0, 1] != rows[0, 2] or len(rows) ** 2 > 2 * PAIRS):
            same = rows[0, 1] == rows[0, 2]
            left, right = (np.arange(len(rows)),) * 2 if same else (np.flatnonzero(rows[:, 3] == 0), np.flatnonzero(rows[:, 3] == 1))
            found, count = [], 0
            for s in range(0, len(left), step := max(1, PAIRS // max(1, len(right)))):
                i, j = np.repeat(left[s : s + step], len(right)), np.tile(right, len(left[s : s + step]))
                if same:
                    i, j = i[j > i], j[j > i]
                found.append(near(rows, i, j, profiles))
                count += len(found[-1][0])
                if count > 2 * PAIRS:
                    found = [thinned(found, lead, further)]
                    if (count := len(found[0][0])) > PAIRS:  # so many are not held
                        yield from batch(node[found[0][0]], node[found[0][1]])
                        found, count = [], 0
        else:
            after = np.repeat(start + size, size) - np.arange(len(rows)) - 1  # rows of its group behind each row
            i = np.repeat(np.arange(len(rows)), after)
            found = [near(rows, i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after), profiles)]
        if found:
            i, j, _ = thinned(found, lead, further)
            yield from batch(node[i], node[j])
        yield from batch(np.unique(node[further]))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes]]] = []  # whole groups
        last: list[tuple[np.ndarray, list[bytes]]] = []  # the rows of the last group so far
        count = 0  # pairs of the whole groups

        def emit(parts: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[pa.RecordBatch]:
            if parts:
                yield from pairs(np.concatenate([h[0] for h in parts]), [x for h in parts for x in h[1]])
            parts.clear()

        def close() -> Iterator[pa.RecordBatch]:
            """The last group is whole."""
            nonlocal count
            n = sum(len(h[0]) for h in last)
            if n and (last[0][0][0, 1] != last[0][0][0, 2] or n * n > PAIRS):
                yield from emit(last)
            elif n > 1 and len({c for h in last for c in h[0][:, 7].tolist()}) > 1:
                held.extend(last)
                count += n * n // 2
            last.clear()
            if count > PAIRS:
                yield from emit(held)
                count = 0

        for batch in batches:
            for part in slices(batch):
                rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns[:-1]], axis=1)
                packed = part.column(8).to_pylist()
                cut = np.concatenate(([0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1, [len(rows)]))
                for s, e in zip(cut[:-1], cut[1:], strict=True):
                    if last and (last[-1][0][0, :3] != rows[s, :3]).any():
                        yield from close()
                    last.append((rows[s:e], packed[s:e]))
        yield from close()
        yield from emit(held)
        free_memory()

    return over


def in_groups(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (key, node, ...) as (key, i, j, side, node, ...), sorted, each key's in one task; the rows of a key in hot (key, n) as pairs (i, j) of blocks."""
    chunks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    met = rows.join(hot, "key", "left").withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("c")).alias("i"), F.greatest(k, F.col("c")).alias("j"), (k < F.col("c")).cast("int").alias("side")))
    dealt = met.withColumn("p", F.explode(pairs)).select("key", "p.i", "p.j", "p.side", *[c for c in rows.columns if c != "key"])
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def text_digest(text: str) -> list[Column]:
    """Two 64-bit digests of a text, null counting as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("d1"), F.xxhash64(F.lit(5), t).alias("d2")]


def similar(found: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (a, b) of found whose sets are similar. Only texts that occur in a pair are shuffled; sets are compared within the JVM, row by row."""
    wanted = written(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "d1", "d2"), "node"))
    count = wanted.count()
    if not count:
        return found
    probed = with_hit(source.select("text", *text_digest("text")), ["d1", "d2"], wanted.select("d1", "d2"), count).where("__hit")
    texts = probed.join(wanted, ["d1", "d2"]).groupBy("node").agg(F.first("text").alias("text"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(b.column(1).to_pylist()))
        ends = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "set"])

    sets = checkpoint(map_batches(texts, cut, "node long, set array<long>"))
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("own")), sets.select(F.col("node").alias("b"), F.col("set").alias("other"))
    both = F.size(F.array_intersect("own", "other"))
    pairs = found.join(right, "b").join(left, "a")  # no groups: a text that many lead to is split like any skewed join
    return checkpoint(pairs.where(both >= SIMILAR * (F.size("own") + F.size("other") - both) - 1e-9).select("a", "b"))


def without_copies(marked: DataFrame) -> DataFrame:
    """marked's rows (node, d1, d2, ...), of equal digests only the one with the smallest node. Only narrow rows are grouped, and only rows that may go are shuffled whole."""
    least = marked.groupBy("d1", "d2").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "least")
    extra = written(marked.select("node", "d1", "d2").join(least, ["d1", "d2"]).where("node <> least").select("node"))
    probed = with_hit(marked, ["node"], extra, extra.count())
    return probed.where("not __hit").drop("__hit").unionByName(probed.where("__hit").join(extra, "node", "left_anti").drop("__hit"))


def copy_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """(d1, d2, component): for the digests of each distinct text the number of its class of exact copies and similar texts."""
    source = df.select(F.col(text).alias("text"))
    ordered = common_shingles(source)
    rank = np.argsort(ordered)
    common, maybe = ordered[rank], np.zeros(1 << 20, bool)
    maybe[common & np.uint64(len(maybe) - 1)] = True

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(b.column(0).to_pylist()))
        first = [prefix(x, common, rank, maybe) for x in sets]
        ends = np.cumsum([0] + [len(x) for x in first], dtype=np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view(np.int64)))
        own = [pa.array([len(x) for x in sets], pa.int32()), pa.array([set_fingerprint(x) for x in sets], pa.int64()), pa.array([profile(x) for x in sets], pa.binary()), keys]
        return pa.RecordBatch.from_arrays([b.column(1), b.column(2), *own], ["d1", "d2", "size", "fp", "profile", "first"])

    marked = map_batches(source.select("text", *text_digest("text")), run, "d1 long, d2 long, size int, fp long, profile binary, first array<long>")
    nodes = without_copies(checkpoint(marked.withColumn("node", F.monotonically_increasing_id())))

    fps = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    met = links(fps.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    ends = fps.select(F.col("fp").alias("fa"), F.col("node").alias("a")), fps.select(F.col("fp").alias("fb"), F.col("node").alias("b"))
    equal = nodes.select("fp", F.col("node").alias("b")).join(fps.select("fp", F.col("node").alias("a")), "fp").where("a <> b").select("a", "b")
    met = checkpoint(met.join(ends[0], "fa").join(ends[1], "fb").select("a", "b").unionByName(equal))
    found = similar(met, nodes, source)
    components = checkpoint(connected_components(found))

    places = nodes.select("node", F.posexplode("first").alias("place", "key"))
    counts = checkpoint(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    hot = written(counts.where(F.col("n") > BLOCK))
    shared = with_hit(places, ["key"], counts.select("key"), counts.count(), 1 << 22).where("__hit").join(counts.select("key"), "key")
    shared = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("shared"))  # no longer than the text's prefix
    kept = checkpoint(shared.join(nodes.select("node", "size", "profile"), "node"))
    few, most, asked = True, 1, kept
    while True:
        labelled = asked.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        some = F.slice("shared", 1, FEW_KEYS) if few else F.col("shared")
        rows = labelled.withColumn("s", F.explode(some)).select("s.key", "node", "size", "s.place", "component", "profile")
        told = written(arrow_map(in_groups(rows, hot), _apart(most), "a long, b long").distinct())
        more = similar(told.where("b is not null"), nodes, source)
        if not more.isEmpty():
            joined = components.select(F.col("node").alias("a"), F.col("component").alias("b"))  # stars stand for all links so far
            components = checkpoint(connected_components(joined.unionByName(more)))
        if few:
            few = False  # all shared shingles of all texts are next
            continue
        back = told.where("b is null").select(F.col("a").alias("node"))
        if back.isEmpty():
            break
        asked, most = kept.join(back, "node", "left_semi"), most * MORE
    return nodes.select("node", "d1", "d2").join(components, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) for each row: the smallest key that exact copies and similar texts lead to, the row's own included.

    Null texts count as empty; empty texts are copies of each other. Rows with a null key are left out. Rows that repeat a
    key each count with their own text. Texts are taken whole, however long. An empty table gives an empty result; other
    columns are left out.
    """
    df = df.where(F.col(key).isNotNull())
    rows = df.select(F.col(key).alias("id"), *text_digest(text))
    named = rows.join(checkpoint(copy_classes(df, text)), ["d1", "d2"])
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return named.join(least, "component").select(F.col("id").alias(key), "component_id")


@shielded
def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that with the smallest key (null last), of equal keys the one whose text has the smaller digest; of rows that agree in both, one.

    Most rows stay; those that may go are found by a Bloom filter, and only they are shuffled. All columns are kept.
    """
    classes = checkpoint(copy_classes(df, text))
    each = df.select(F.col(key).alias("id"), *text_digest(text)).groupBy("id", "d1", "d2").agg(F.count("*").alias("n"))
    named = checkpoint(each.join(classes, ["d1", "d2"]))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("d1").alias("d1"), F.col("d2").alias("d2"))
    best = named.groupBy("component").agg(F.min(order).alias("best")).select("component", F.col("best.id").alias("bid"), F.col("best.d1").alias("b1"), F.col("best.d2").alias("b2"))
    stays = F.col("id").eqNullSafe(F.col("bid")) & (F.col("d1") == F.col("b1")) & (F.col("d2") == F.col("b2"))
    judged = named.join(best, "component").withColumn("stays", stays).select(F.col("id").alias("__id"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "stays", "n")
    rows = df.withColumns(dict(zip(("__d1", "__d2"), text_digest(text), strict=True)))
    out = rows
    for doubtful, stay in ((written(judged.where("not stays")), False), (written(judged.where("stays and n > 1")), True)):
        count = doubtful.count()
        if not count:
            continue
        probed = with_hit(out, ["__d1", "__d2"], doubtful.select("__d1", "__d2"), count)
        unsure = probed.where("__hit").drop("__hit")
        if stay:
            unsure = unsure.dropDuplicates([key, "__d1", "__d2"])
        else:
            gone = doubtful.select("__id", F.col("__d1").alias("__g1"), F.col("__d2").alias("__g2"))
            unsure = unsure.join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__d1") == F.col("__g1")) & (F.col("__d2") == F.col("__g2")), "left_anti")
        out = probed.where("not __hit").drop("__hit").unionByName(unsure)
    return out.select(*df.columns)
