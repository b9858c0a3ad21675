"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 10).

The ring is cut into ``cells``. A key's hash picks its cell; virtual nodes sit on cells, and the
shards met going clockwise from a cell are that cell's preference list. Every shard has a
capacity; keys that find a shard full go on clockwise. All keys of a cell share one preference
list, so the whole walk is decided from the count per cell: a table of ``cells`` rows whatever
the size of the input. Only DataFrame functions touch the rows themselves.

Cases: a null key hashes like any other value; equal keys and repeated rows are ordered by their
remaining columns (rows equal in all of them are interchangeable); a null text has size 1 and the
checksum of no bytes; an empty table gives an empty result; columns besides key and text are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096
VNODES = 64


def ring_points(shards: int, vnodes: int, cells: int) -> list[list[int]]:
    """For each cell, the distinct shards met clockwise, nearest first."""
    at: dict[int, list[tuple[bytes, int]]] = {}
    for shard in range(shards):
        for replica in range(vnodes):
            digest = hashlib.sha256(f"{shard}/{replica}".encode()).digest()
            at.setdefault(int.from_bytes(digest[:8], "big") % cells, []).append((digest, shard))
    points = [(cell, shard) for cell in sorted(at) for _, shard in sorted(at[cell])]
    order: list[list[int]] = []
    first = 0
    for cell in range(cells):
        while first < len(points) and points[first][0] < cell:
            first += 1
        seen: dict[int, None] = {}
        for i in range(len(points)):
            seen.setdefault(points[(first + i) % len(points)][1])
            if len(seen) == shards:
                break
        order.append(list(seen))
    return order


def capacities(total: int, shards: int, epsilon: float) -> list[int]:
    """Rows each shard may hold. With epsilon 0 they sum to the total, so counts differ by one at most."""
    if epsilon <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [max(1, -int(-(1 + epsilon) * total // shards))] * shards


def walk(counts: dict[int, int], order: Sequence[Sequence[int]], room: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, from rank, to rank, home, shard, first slot) for every run of keys that lands together."""
    room, used, runs = list(room), [0] * len(room), []
    for cell, prefer in enumerate(order):
        rank, left = 0, counts.get(cell, 0)
        for shard in prefer:
            take = min(left, room[shard])
            if take:
                runs.append((cell, rank, rank + take, prefer[0], shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                rank += take
                left -= take
            if not left:
                break
        if left:
            raise ValueError("the capacities are smaller than the number of keys")
    return runs


def bounded_ring(docs: DataFrame, key: Column, shards: int = 8, epsilon: float = 0.0, vnodes: int = VNODES, cells: int = CELLS, order_by: Sequence[Column] = ()) -> DataFrame:
    """row (all columns of ``docs``), home_shard, shard (int) and slot (long, gapless from 0 in each shard).

    ``epsilon`` is the slack of the bounded load: a shard holds at most (1 + epsilon) times the
    mean; 0 makes the counts at most one apart. The counting pass reads the key column alone. A
    cell's keys are ranked in one task each: ``cells`` is set so that a cell's share of the keys
    fits, and keys that are all equal are ranked as one cell.
    """
    spark = docs.sparkSession
    spot = F.xxhash64(key)
    cell = F.pmod(spot, F.lit(cells)).cast("int")
    counts = {r["cell"]: r["n"] for r in docs.select(cell.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = walk(counts, ring_points(shards, vnodes, cells), capacities(sum(counts.values()), shards, epsilon))
    # At most cells + cells * shards rows, set by the ring and never by the data: safe to broadcast.
    plan = spark.createDataFrame(runs, "cell int, rank_from long, rank_to long, home_shard int, shard int, first_slot long")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), spot.alias("spot"), cell.alias("cell"), *(c.alias(f"order_{k}") for k, c in enumerate(order_by)))
    own = Window.partitionBy("cell").orderBy("spot", *(f"order_{k}" for k in range(len(order_by))))
    ranked = boxed.withColumn("rank", F.row_number().over(own).cast("long") - 1)
    return (
        ranked.join(F.broadcast(plan), "cell")
        .where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select("row", "home_shard", "shard", (F.col("first_slot") + F.col("rank") - F.col("rank_from")).alias("slot"))
    )


def op10_bounded_ring_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 7, counts at most one apart (law ``rows``)."""
    from quirelake.llm.common import documents

    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = bounded_ring(sized, F.col("doc_id"), shards=8, order_by=[F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return placed.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
