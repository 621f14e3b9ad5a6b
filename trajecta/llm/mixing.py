"""Mixing sources to target weights by balanced sampling (the cube method).

A source whose target is r times its size takes every document floor(r) times and, with probability r - floor(r), once
more. These extra copies are drawn by the cube method: inclusion probabilities move through the null space of the
constraints (the total of tokens and the number of documents), three documents at a time, until one becomes 0 or 1. The
moves keep both totals exactly. The flight runs in blocks of documents of one source; at most two documents of a block
stay fractional, and those of all blocks of a source fly again, until one block of it is left. Its last two are the
landing problem: they are rounded, and documents of that block changed, until the total of tokens is as near as it gets.
So that there are some to change, each block hands on some decided documents of all sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import WORD, checkpoint, shielded, table

BLOCK = 4096
EPS = 1e-9


def flight(sizes: list[float], p: list[float], seed: int) -> list[float]:
    """Move p until at most two entries are fractional; sums of p and of p x size stay. Documents come in the given order."""
    p = list(p)
    queue = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    active, at = queue[:3], 3
    draws = _draws(seed)
    while len(active) == 3:
        i, j, k = active
        u = [sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(active, u, strict=True) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(active, u, strict=True) if v)
        step = up if next(draws) * (up + down) < down else -down
        for x, v in zip(active, u, strict=True):
            p[x] += step * v
            p[x] = 0.0 if p[x] < EPS else 1.0 if p[x] > 1 - EPS else p[x]
        active = [x for x in active if 0 < p[x] < 1]
        while len(active) < 3 and at < len(queue):
            active.append(queue[at])
            at += 1
    return p


def land(sizes: list[float], p: list[float], start: list[float]) -> list[float]:
    """Round what is fractional (at most two entries) so that the number of documents moves by less than one from that of the start, and the total of size least; of equal ways the first.

    A large document may be among the last. While the total is off, the two decided documents whose exchange (one in, one
    out) brings it nearest change places: the number of documents stays.
    """
    p, s = np.array(p, float), np.array(sizes, float)
    wanted = float(np.dot(start, s))
    rest = [i for i in range(len(p)) if 0 < p[i] < 1]
    if rest:
        fixed, number = float(np.dot(np.where((p > 0) & (p < 1), 0, p), s)), float(p[rest].sum())
        ways = [m for m in range(1 << len(rest)) if abs(number - m.bit_count()) < 1 - EPS]
        best = min(ways, key=lambda m: (abs(wanted - fixed - sum(s[i] for b, i in enumerate(rest) if m >> b & 1)), abs(number - m.bit_count()), m))
        for b, i in enumerate(rest):
            p[i] = best >> b & 1
    off = float(np.dot(p, s)) - wanted
    while abs(off) > 0.5:
        out, into = np.flatnonzero(p == 0), np.flatnonzero(p == 1)
        if not len(out) or not len(into):
            break
        out = out[np.argsort(s[out], kind="stable")]
        at = np.searchsorted(s[out], s[into] - off)  # the document to take in so that the total comes near
        at = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(out) - 1)])
        left = np.abs(off + s[out[at]] - s[into])
        k, i = np.unravel_index(int(left.argmin()), left.shape)
        if left[k, i] >= abs(off) - 0.5:
            break
        p[into[i]], p[out[at[k, i]]] = 0, 1
        off += s[out[at[k, i]]] - s[into[i]]
    return p.tolist()


def _draws(seed: int) -> Iterator[float]:
    n = 0
    while True:
        yield xxhash.xxh64_intdigest(f"{seed}:{n}") / 2.0**64
        n += 1


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """source, source_size and target from a table of source and size (a row for each document).

    Sources by code point, null last, get the weights in turn; targets share the total of all sizes, but none is above
    limit times its source's size: the excess goes to the others by weight until none is above.
    """
    totals = checkpoint(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
        .withColumn("__n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)  # one row for each source
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int")))
    )
    head = totals.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, level = float(head["t"] or 0), float(head["t"] or 0) / float(head["w"] or 1)
    while True:  # the level rises until the capped sources stay the same
        capped = F.col("weight") * level >= F.col("source_size") * limit
        got = totals.agg(F.sum(F.when(capped, F.col("source_size") * limit)).alias("c"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        if not got["w"]:
            break
        new = (total - float(got["c"] or 0)) / float(got["w"])
        if new <= level * (1 + 1e-12):
            break
        level = new
    return totals.select("source", "source_size", "source_docs", "__n", F.least(F.col("weight") * level, F.col("source_size") * limit).alias("target"))


def _fly(df: DataFrame) -> DataFrame:
    """One round: p moves within each (__n, __block). A source's only block lands; of others __keep marks what flies on: fractional rows, and decided ones evenly spaced by size."""
    names = [f.name for f in df.schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "__h", "doc_id"], ascending=[False, True, True], kind="stable")  # the smallest come last and may stay
        sizes, start = pdf["size"].astype(float).tolist(), pdf["__p"].tolist()
        p = flight(sizes, start, int(pdf["__n"].iloc[0]) * 1_000_003 + int(pdf["__block"].iloc[0]) * 31 + len(start))
        blocks = int(pdf["__blocks"].iloc[0])
        pdf["__p"] = land(sizes, p, start) if blocks == 1 else p
        decided = np.flatnonzero((pdf["__p"] == 0) | (pdf["__p"] == 1))
        keep = np.full(len(pdf), blocks > 1)
        keep[decided] = False
        if blocks > 1 and len(decided):
            keep[decided[np.linspace(len(decided) - 1, 0, min(len(decided), max(2, BLOCK // blocks))).astype(int)]] = True
        pdf["__keep"] = keep
        return pdf[names]

    return df.groupBy("__n", "__block").applyInPandas(run, df.schema)


def mix(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target, copies and taken; every row stays, also those taken 0 times.

    Reruns agree: draws come from hashes. Rows that repeat in all columns are interchangeable. Null ids and sources are
    values like others, null sizes count as 0. Documents of size 0 may get copies, which take nothing. An empty table
    gives an empty result; other columns are left out (take() keeps them).
    """
    sizes = sizes.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    targets = source_targets(sizes, weights, limit)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(limit))).otherwise(F.lit(0.0))
    rows = sizes.withColumnRenamed("source", "__source").join(targets, F.col("__source").eqNullSafe(F.col("source"))).drop("__source")
    rows = rows.withColumn("__rate", rate).withColumn("__whole", F.floor(F.col("__rate") + EPS).cast("long")).withColumn("__p", F.greatest(F.col("__rate") - F.col("__whole"), F.lit(0.0)))
    rows = rows.withColumn("__h", F.xxhash64("doc_id", "size")).withColumn("__blocks", F.ceil(F.col("source_docs") / BLOCK)).withColumn("__block", F.pmod("__h", F.col("__blocks")))
    keep = ["doc_id", "size", "source_size", "target", "source", "__whole", "__p", "__h", "__n", "__blocks", "__block"]
    rows = rows.select(*keep)
    fractional = (F.col("__p") > EPS) & (F.col("__p") < 1 - EPS)
    done = [rows.where(~fractional)]
    state = rows.where(fractional).withColumn("__keep", F.lit(False))
    blocks = (rows.agg(F.max("__blocks")).first() or [0])[0] or 0
    while blocks:
        state = checkpoint(_fly(state))
        done.append(state.where("not __keep").drop("__keep"))
        if blocks == 1:
            break
        state = state.where("__keep").withColumn("__blocks", F.ceil(F.col("__blocks") / (BLOCK // 2))).withColumn("__block", F.pmod("__block", F.col("__blocks")))
        blocks = -(-blocks // (BLOCK // 2))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("__whole") + F.round("__p").cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


@shielded
def take(df: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """df's rows as often as the mix of their sizes in words says: rows repeat, or go.

    A row is known by the digests of all its columns, so null and repeated ids do no harm; rows that agree in all columns
    are interchangeable. Null texts have size 0, null sources are a source. An empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    digest = F.concat_ws(":", F.xxhash64(row), F.xxhash64(F.lit(11), row))
    sizes = checkpoint(df.select(digest.alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")))
    copies = mix(sizes, weights, limit).groupBy("doc_id").agg(F.sum("copies").alias("__copies"), F.count("*").alias("n")).where("__copies > 0")
    copies = checkpoint(copies.select(F.col("doc_id").alias("__row"), "__copies", "n"))
    rows = df.withColumn("__row", digest)
    if copies.where("n > 1").limit(1).count():  # rows that repeat are taken once for all of them
        rows = rows.dropDuplicates(["__row"])
    taken = rows.join(copies, "__row")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[f"`{c}`" for c in df.columns])


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = checkpoint(docs.select("doc_id", "source", word_count().alias("size")))
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
