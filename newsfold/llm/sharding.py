"""Sharding by Karmarkar-Karp differencing (operator 8).

Equal texts are indivisible groups. Groups whose size is above a fixed fraction of the
whole (so that their number has a fixed bound) are partitioned first, in one task. All
others are dealt to chunks of bounded size; each chunk starts from a partial partition
that is its share of the large groups' loads, and then repeatedly combines the two
partial partitions of largest spread, the larger loads of one with the smaller of the
other. As every chunk ends nearly even, so does their sum.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import running_total, settle


def differencing(sizes: np.ndarray, shards: int, start: np.ndarray | None = None) -> np.ndarray:
    """Shard of each item. ``start``: loads that shards have already; it names the shards.

    Partial partitions are vectors of ``shards`` loads. Two are combined by adding the
    largest load of one to the smallest of the other, and so on; the difference that
    counts is what stays. Ties are taken in order, so the result is the same each time.
    """
    n = len(sizes)
    start = np.zeros(shards) if start is None else np.asarray(start, np.float64)
    parent = list(range(n + shards))
    heap, tick = [], 0
    order = np.argsort(start, kind="stable")[::-1]
    heap.append((-(start.max() - start.min()), -1, start[order] - start.min(), (n + order).tolist()))
    for i in np.argsort(-sizes, kind="stable").tolist():
        loads = np.zeros(shards)
        loads[0] = sizes[i]
        heap.append((-float(sizes[i]), tick, loads, [i] + [-1] * (shards - 1)))
        tick += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, slots_a = heapq.heappop(heap)
        _, _, b, slots_b = heapq.heappop(heap)
        loads, slots = a + b[::-1], []
        for x, y in zip(slots_a, reversed(slots_b)):
            if x < 0 or y < 0:
                slots.append(max(x, y))
            else:
                parent.append(len(parent))
                parent[x] = parent[y] = len(parent) - 1
                slots.append(len(parent) - 1)
        by = np.argsort(-loads, kind="stable")
        loads = loads[by] - loads.min()
        heapq.heappush(heap, (-float(loads[0]), tick, loads, [slots[k] for k in by.tolist()]))
        tick += 1
    root = np.array(parent)
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    label = {int(root[n + s]): s for s in range(shards)}
    return np.array([label[int(r)] for r in root[:n]], np.int64) if n else np.empty(0, np.int64)


def assign_groups(groups: DataFrame, shards: int, chunk_groups: int = 2048, large_per_shard: int = 32) -> DataFrame:
    """``(key, shard)`` of ``groups(key, bytes)`` with unique keys.

    A group is large if above 1 / (shards * large_per_shard) of all bytes, so at most
    shards * large_per_shard groups are; the others go to chunks of about ``chunk_groups``.
    """
    groups = settle(groups.select("key", F.col("bytes").cast("long").alias("bytes")))
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    limit = total / (shards * large_per_shard)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        return pd.DataFrame({"key": pdf["key"], "shard": differencing(pdf["bytes"].to_numpy(), shards), "bytes": pdf["bytes"]})

    large = settle(groups.where(F.col("bytes") > limit).groupBy(F.lit(0).alias("one")).applyInPandas(whole, "key string, shard int, bytes long"))
    loads = np.zeros(shards)
    for shard, size in large.groupBy("shard").agg(F.sum("bytes")).collect():  # one row a shard
        loads[shard] = size
    rest = max(total - loads.sum(), 1.0)
    chunks = max(1, -(-count // chunk_groups))

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        sizes = pdf["bytes"].to_numpy()
        return pd.DataFrame({"key": pdf["key"], "shard": differencing(sizes, shards, loads * (sizes.sum() / rest))})

    small = groups.where(F.col("bytes") <= limit).withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))
    dealt = small.groupBy("chunk").applyInPandas(chunk, "key string, shard int")
    return large.select("key", "shard").unionByName(dealt)


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, shard, slot.

    Sizes are the text's UTF-8 bytes plus ``overhead``. Null texts count as empty, and with the
    empty ones are one group. Rows that repeat an id each take a slot. Slots are gapless from 0
    in each shard, by the id's hash. An empty frame gives an empty one.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    rows = settle(df.select(
        F.col(id_col).alias("id"), F.md5(held).alias("key"), (F.octet_length(held) + overhead).cast("long").alias("size"), F.crc32(held).alias("text_crc32")
    ))
    placed = settle(assign_groups(rows.groupBy("key").agg(F.sum("size").alias("bytes")), shards))
    rows = rows.join(placed, "key").drop("key").withColumn("_order", F.xxhash64(F.lit("slot"), F.col("id")))
    return running_total(rows, ["shard"], "_order", F.lit(1), "slot").drop("_order")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document, under the law ``bytes``."""
    return shard(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
