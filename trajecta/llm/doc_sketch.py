"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines), and these into pieces at places that depend on the words alone, so that an edit
changes only the pieces near it. Every distinct piece has a 64-bit digest, which goes into HASHES cells of a sketch: each
cell counts its digests and xors them and their check sums. Two versions are compared by subtracting their cells; peeling
cells that hold one digest recovers the digests that differ. If peeling fails, both versions are sketched again with
twice as many cells. The fingerprints that are returned have CELLS cells, so that equal texts have equal ones; a likeness
that needs more cells comes from larger sketches of the same digests, which are not returned. All steps run over the cells of many documents at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, table

CELLS, HASHES = 24, 3
CHUNK_DOCS, CHUNK_CHARS = 256, 1 << 20
ROWS_A_BUCKET, MOST_BUCKETS, OVERSAMPLE = 4096, 1 << 15, 8


def digests(text: str) -> np.ndarray:
    """Digests of the distinct pieces: three to fifteen words that end where a word says so, or with the line."""
    out = set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        start = 0
        for i, w in enumerate(words):
            if i - start >= 2 and ((w[-1] * 31 + w[0] * 7 + len(w)) & 3 == 0 or i - start >= 14):
                out.add(xxhash.xxh3_64_intdigest(b" ".join(words[start : i + 1])))
                start = i + 1
        if start < len(words):
            out.add(xxhash.xxh3_64_intdigest(b" ".join(words[start:])))
    return np.fromiter(out, np.uint64, len(out))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _check(x: np.ndarray) -> np.ndarray:
    return (_mix(x, HASHES) >> np.uint64(32)).astype(np.uint32)


class Cells:
    """The sketches of n documents, m cells each, in flat arrays."""

    def __init__(self, n: int, m: int) -> None:
        self.n, self.m = n, m
        self.count, self.key, self.check = np.zeros(n * m, np.int32), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint32)

    def put(self, doc: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> None:
        """Add (sign 1) or take out (-1) digests."""
        part, check = self.m // HASHES, _check(digest)
        for h in range(HASHES):
            at = doc * self.m + h * part + (_mix(digest, h) % np.uint64(part)).astype(np.int64)
            np.add.at(self.count, at, np.int32(sign) if isinstance(sign, int) else sign)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document whether all digests came out, and the numbers of digests with positive and negative count."""
        more, less = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        live = np.arange(self.n * self.m)
        while len(live):
            at = live[np.abs(self.count[live]) == 1]
            at = at[self.check[at] == _check(self.key[at])]
            if not len(at):
                break
            doc, digest, sign = at // self.m, self.key[at], self.count[at]
            order = np.lexsort((digest, doc))
            doc, digest, sign = doc[order], digest[order], sign[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
            doc, digest, sign = doc[new], digest[new], sign[new]
            np.add.at(more, doc[sign > 0], 1)
            np.add.at(less, doc[sign < 0], 1)
            self.put(doc, digest, -sign)
            live = live[np.isin(live // self.m, np.unique(doc))]
        whole = ((self.count == 0) & (self.key == 0)).reshape(self.n, self.m).all(axis=1)
        return whole, more, less


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """For each pair the share of digests that both have among all, from subtracted and peeled sketches."""
    size_a, size_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    only_a = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        diff = Cells(len(todo), cells)
        for side, sizes, sign in ((a, size_a, 1), (b, size_b, -1)):
            diff.put(np.repeat(np.arange(len(todo)), sizes[todo]), np.concatenate([side[i] for i in todo]), sign)
        whole, more, less = diff.peel()
        whole &= more - less == size_a[todo] - size_b[todo]
        only_a[todo[whole]] = more[whole]
        todo, cells = todo[~whole], cells * 2
    union = size_b + only_a
    return np.where(union > 0, (size_a - only_a) / np.maximum(union, 1), 1.0)


def sketches(parts: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The fingerprints as text: number of digests, then counts, keys and check sums of the cells."""
    s = Cells(len(parts), cells)
    sizes = np.array([len(x) for x in parts], np.uint32)
    s.put(np.repeat(np.arange(len(parts)), sizes), np.concatenate(parts), 1)
    rows = zip(sizes, s.count.reshape(-1, cells), s.key.reshape(-1, cells), s.check.reshape(-1, cells), strict=True)
    return [base64.b64encode(n.astype("<u4").tobytes() + c.astype("<i4").tobytes() + k.astype("<u8").tobytes() + x.astype("<u4").tobytes()).decode() for n, c, k, x in rows]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most key, by binary search (0 for null)."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.coalesce(key >= F.element_at(array, middle + 1), F.lit(False)) & (s["lo"] < s["hi"])
        return F.struct(F.when(right, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    def safe(s: Column, i: Column) -> Column:
        return F.when(s["lo"] >= s["hi"], s).otherwise(halve(s, i))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), safe)["lo"]


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (__bucket, __role, __key, __text) partitioned and sorted so that each row's next one follows.

    The order is by key, null first, then by the text's hash. Buckets are ranges of keys, cut at keys that occur: the
    rows at a cut also go to the bucket before it (role 1), those that come first of all to the last. Texts are shuffled
    once. At most OVERSAMPLE x MOST_BUCKETS keys, a sample for the cuts, reach the driver.
    """
    keys = df.select(F.col(key).cast("long").alias("k"))
    head = keys.agg(F.count("*").alias("n"), F.min("k").alias("least"), F.count_if(F.col("k").isNull()).alias("nulls")).first()
    buckets = max(1, min(-(-head["n"] // ROWS_A_BUCKET), MOST_BUCKETS))
    every = max(1, head["n"] // (OVERSAMPLE * buckets))
    sample = sorted(r["k"] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct().limit(4 * OVERSAMPLE * MOST_BUCKETS).collect() if r["k"] is not None) if buckets > 1 else []
    bounds = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)} - {head["least"]} if sample else set())
    k = F.col("__key")
    own = _bucket(k, bounds)
    first = k.isNull() if head["nulls"] else k == F.lit(head["least"])
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    at_cut = F.element_at(cuts, F.greatest("__own", F.lit(1))) == k if bounds else F.lit(False)
    rows = df.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__own", own)
    places = F.array(
        F.struct(F.col("__own").alias("__bucket"), F.lit(0).alias("__role")),
        F.when(F.col("__own") > 0, F.when(F.coalesce(at_cut, F.lit(False)), F.struct((F.col("__own") - 1).alias("__bucket"), F.lit(1).alias("__role")))),
        F.when(F.coalesce(first, F.lit(False)), F.struct(F.lit(len(bounds)).alias("__bucket"), F.lit(1).alias("__role"))),
    )
    dealt = rows.withColumn("__places", F.filter(places, lambda p: p.isNotNull())).select("__key", "__text", F.explode("__places").alias("p"))
    dealt = dealt.select("p.__bucket", "p.__role", "__key", "__text").repartition("__bucket")
    return dealt.sortWithinPartitions("__bucket", "__role", F.col("__key").asc_nulls_first(), F.xxhash64("__text"))


def compare_versions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row.

    The edited text replaces the last floor(n_chars / 4) code points by the first as many (or all) of the next row's text,
    by ascending key (null first; ties by the text's hash), after the last row the first. Null texts count as empty; two
    empty texts are alike (1). Rows that repeat follow each other. Texts are sketched whole, however long. An empty table
    gives an empty result; other columns are left out.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (bucket, role, key, text, digests), the next of each behind it."""
        pairs = [(r, s) for r, s in zip(rows, rows[1:], strict=False) if r[1] == 0]
        edits = [r[3][: len(r[3]) - len(r[3]) // 4] + s[3][: len(r[3]) // 4] for r, s in pairs]
        own, new, after = [r[4] for r, _ in pairs], [digests(e) for e in edits], [s[4] for _, s in pairs]
        values = [
            pa.array([r[2] for r, _ in pairs], pa.int64()), pa.array([len(r[3]) for r, _ in pairs], pa.int64()),
            pa.array([sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits], pa.string()),
            pa.array(sketches(own), pa.string()), pa.array(sketches(new), pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
        ]
        return pa.RecordBatch.from_arrays(values, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for bucket, role, k, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if role and rows and rows[-1][1]:
                    continue  # only the first of the rows after a bucket counts
                rows.append((bucket, role, k, t, digests(t)))
                size += len(t)
                if len(rows) > CHUNK_DOCS or size > CHUNK_CHARS:
                    if len(rows) > 1 and any(not r[1] for r in rows[:-1]):
                        yield emit(rows)
                    rows, size = rows[-1:], len(t)
        if len(rows) > 1:
            yield emit(rows)

    return arrow_map(with_next(df, key, text), run, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_document_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
