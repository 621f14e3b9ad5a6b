"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into RING slots; the first virtual node clockwise of a slot owns it. Each shard has a capacity. A key
goes to its owner; keys that overflow a full shard continue clockwise to the next shard with room, so no shard exceeds
its capacity. Only the number of keys in each slot reaches the driver (RING counts, a fixed bound); it turns them into
intervals of ranks within a slot, and every row finds its shard by its own rank.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import shielded, table, with_outputs

RING = 1 << 14


def ring_owners(n_shards: int, virtual_nodes: int = 64) -> tuple[list[int], list[int]]:
    """The virtual nodes clockwise: (slot of each, shard of each). A new shard only adds nodes."""
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}:{v}", 42) % RING, xxhash.xxh64_intdigest(f"{s}:{v}", 7), s) for s in range(n_shards) for v in range(virtual_nodes))
    return [x[0] for x in nodes], [x[2] for x in nodes]


def capacities(n_rows: int, n_shards: int, epsilon: float) -> list[int]:
    """epsilon 0: sizes that sum up to n_rows and are at most one apart; otherwise ceil((1 + epsilon) of the mean) each."""
    if epsilon:
        return [int(-(-(1 + epsilon) * n_rows // n_shards))] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def place(counts: dict[int, int], n_shards: int, epsilon: float = 0.0, virtual_nodes: int = 64) -> list[tuple[int, int, int, int, int]]:
    """(slot, from rank, to rank, shard, first place in the shard) for the keys of each slot.

    Keys that fit their own shard come first, in ring order; those that don't then continue clockwise in ring order.
    """
    at, owner = ring_owners(n_shards, virtual_nodes)
    free = capacities(sum(counts.values()), n_shards, epsilon)
    used, out, over = [0] * n_shards, [], []

    def take(slot: int, start: int, n: int, shard: int) -> int:
        got = min(n, free[shard])
        if got:
            out.append((slot, start, start + got, shard, used[shard]))
            used[shard] += got
            free[shard] -= got
        return got

    for slot in sorted(counts):
        node = bisect_left(at, slot) % len(at)
        got = take(slot, 0, counts[slot], owner[node])
        if got < counts[slot]:
            over.append((slot, got, node))
    for slot, got, node in over:
        step = 1
        while got < counts[slot]:
            got += take(slot, got, counts[slot] - got, owner[(node + step) % len(at)])
            step += 1
            if step > len(at) + 1:
                raise ValueError("the shards have less room than there are rows")
    return out


@shielded
def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 40, epsilon: float = 0.0, virtual_nodes: int = 64) -> DataFrame:
    """df's rows with size, text_crc32, law, shard, slot and grown_shard; text itself is dropped after it is measured.

    Every row is placed once. A row's place on the ring comes from its key, its text's CRC-32 and size, so that rows with
    a null or repeated key spread too; rows equal in all three are interchangeable and lie side by side. With epsilon 0
    the counts of the shards are at most one apart (law ``rows``), and grown_shard is null. Null text counts as empty
    (size 16, CRC 0). An empty table gives an empty result. Input columns with the names of outputs are replaced.
    """
    spark = df.sparkSession
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    sized = with_outputs(df.withColumns({"__size": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 16, "__crc": F.crc32(raw)}).drop(text), ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    hashed = sized.withColumn("__h", F.xxhash64(F.col(key), F.col("__crc"), F.col("__size")))
    hashed = hashed.withColumn("__ring", F.shiftrightunsigned("__h", 50).cast("int"))
    counts = {r["__ring"]: r["n"] for r in hashed.groupBy("__ring").agg(F.count("*").alias("n")).collect()}  # at most RING rows
    pieces = place(counts, n_shards, epsilon, virtual_nodes) if counts else []
    intervals = spark.createDataFrame(pieces, "__slot int, __from long, __to long, shard int, __base long")  # at most RING + n_shards rows
    order = Window.partitionBy("__ring").orderBy("__h", F.col(key).asc_nulls_first(), "__crc", "__size")
    ranked = hashed.withColumn("__rank", F.row_number().over(order).cast("long") - 1)
    put = ranked.join(F.broadcast(intervals), (F.col("__ring") == F.col("__slot")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    kept = [F.col(c) for c in sized.columns if not c.startswith("__")]
    return put.select(
        *kept, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows" if not epsilon else "bounded").alias("law"), F.col("shard"), (F.col("__base") + F.col("__rank") - F.col("__from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_rows(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
