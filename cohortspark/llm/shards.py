"""Minimum-cost-flow resharding (operator 3)."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import col, numbered, shared_folder, table, whole


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from every old shard to every new one that moves all supply at least cost.

    Successive shortest paths with potentials on the bipartite graph; a path
    carries as much as its bottleneck, so the number of rounds depends on the
    number of shards and not on the bytes.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are smaller than the supply")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        dist, prev = [float("inf")] * (n + m), [-1] * (n + m)
        heap = [(0 - potential[i], i) for i in range(n) if left[i]]
        base = min(d for d, _ in heap)
        heap = [(d - base, i) for d, i in heap]
        for d, i in heap:
            dist[i] = d
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                edges = [(n + j, cost[u][j]) for j in range(m)]
            else:
                edges = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in edges:
                nd = d + c + potential[u] - potential[v]
                if nd < dist[v]:
                    dist[v], prev[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        open_ends = [j for j in range(m) if room[j] and dist[n + j] < float("inf")]
        end = n + min(open_ends, key=lambda j: (dist[n + j] + potential[n + j], j))
        limit = dist[end]
        for v in range(n + m):
            potential[v] += min(dist[v], limit)
        path = [end]
        while prev[path[-1]] >= 0:
            path.append(prev[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for a, b in zip(path, path[1:]):
            if a >= n:
                amount = min(amount, flow[b][a - n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def plan_moves(sizes: dict[int, int], shards: int, capacities: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """Byte ranges (old shard, from, to, new shard); what can stay at home comes first."""
    total, old = sum(sizes.values()), sorted(sizes)
    capacities = capacities or [total // shards + (j < total % shards) for j in range(shards)]
    cost = [[int(j != i) for j in range(shards)] for i in old]
    flow = min_cost_flow([sizes[i] for i in old], capacities, cost)
    ranges = []
    for k, i in enumerate(old):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if flow[k][j]:
                ranges.append((i, at, at + flow[k][j], j))
                at += flow[k][j]
    return ranges


def reshard(
    docs: DataFrame,
    old: Column,
    shards: int = 16,
    capacities: list[int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Where each row goes: doc_id, text, size, text_crc32, old, block, shard, slot, affected.

    Only the byte sum of every old shard reaches the driver, where the flow
    problem over (old shards x new shards) is solved; moving a byte costs 1,
    leaving it costs 0.  The rows of an old shard stand in blocks of about
    ``block_bytes`` by hash; the flow cuts that order into ranges, so whole blocks
    move and only the blocks at a cut are split between shards.  ``affected``
    marks the rows of blocks that move or are cut.

    Cases: a null text has size 1 and the CRC of no bytes; a null ``old`` counts as
    shard 0; repeated rows are placed one by one; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        col(id_col).alias("doc_id"),
        whole(text_col).alias("text"),
        (F.octet_length(whole(text_col)) + 1).cast("long").alias("size"),
        F.crc32(whole(text_col).cast("binary")).alias("text_crc32"),
        F.coalesce(old.cast("int"), F.lit(0)).alias("old"),
    )
    sizes = {r["old"]: r["size"] for r in rows.groupBy("old").agg(F.sum("size").alias("size")).collect()}
    ranges = plan_moves(sizes, shards, capacities)
    blocks = spark.createDataFrame([(i, max(1, -(-s // block_bytes))) for i, s in sizes.items()], "old int, blocks long")
    cuts = spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], "cut int, old int, lo long, hi long, shard int")
    # both tables have one row per shard pair at most
    placed = rows.join(F.broadcast(blocks), "old").withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), "blocks")).drop("blocks")
    placed = numbered(placed, ["old"], "block", ["doc_id", "text_crc32", "size"], {"start": "size", "seq": "1L"})
    placed = placed.join(F.broadcast(cuts), "old").filter("start + size DIV 2 >= lo AND start + size DIV 2 < hi").drop("lo", "hi")
    per = placed.groupBy("cut", "shard").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("cut", (before - F.col("first")).alias("shift"))
    placed = placed.join(F.broadcast(offsets), "cut").withColumn("slot", F.col("seq") + F.col("shift"))
    moved = F.max(F.when(F.col("shard") != F.col("old"), 1).otherwise(0)).over(Window.partitionBy("old", "block"))
    return placed.select("doc_id", "text", "size", "text_crc32", "old", "block", "shard", "slot", (moved == 1).alias("affected"))


def rewrite_affected(placed: DataFrame, folder: str) -> DataFrame:
    """Write the rows of affected blocks under ``folder``/shard=N and return all rows.

    Rows of other blocks stay in their old files.  What was written is read back,
    so size and text_crc32 of the result are those of the new files.
    """
    spark = placed.sparkSession
    out = placed.filter("affected").select("doc_id", "text", "old", "slot", "shard")
    out.write.mode("overwrite").partitionBy("shard").parquet(folder)
    schema = out.schema
    again = spark.read.schema(schema).parquet(folder).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "old", "shard", "slot"
    )
    stay = placed.filter("NOT affected").select(*again.columns)
    return stay.unionByName(again)


def op3_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout keeps each source in one of 16 shards; the new one holds equal bytes."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(16))
    folder = f"{shared_folder(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/shards-{uuid.uuid4().hex}"
    rows = rewrite_affected(reshard(docs, old), folder)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard")
    )
