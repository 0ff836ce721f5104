"""Filling containers of fixed capacity: shortest-pack-first over the histogram of lengths.

Only the histogram (one count for each length up to the capacity) reaches the driver. Lengths are placed longest
first; all items of one length go, a group of equal packs at a time, to the packs with the least in them. The
outcome is a list of packing patterns with counts, from which each item finds its pack by its rank among the
items of its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectorium.llm.common import checkpointed, in_parts

#: Items of one length that a part should hold when they are ranked, so that no length is ranked by one task alone.
RANKED = 50_000


def place(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length an array of slots (first rank, first pack, offset in the pack).

    A slot takes items of consecutive ranks into consecutive packs. A group of packs with the same content is
    (used, first pack, packs); groups stand in a heap by what they hold, so the emptiest come first.
    """
    slots: dict[int, list[tuple[int, int, int]]] = {}
    groups: list[tuple[int, int, int]] = []
    packs = 0
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit into {capacity}")
        rank, left = 0, histogram[length]
        own = slots[length] = []
        while left:
            if groups and groups[0][0] + length <= capacity:
                used, first, count = heapq.heappop(groups)
                if count > left:
                    heapq.heappush(groups, (used, first + left, count - left))
                    count = left
                own.append((rank, first, used))
                if used + length < capacity:
                    heapq.heappush(groups, (used + length, first, count))
                rank, left = rank + count, left - count
                continue
            # no pack has room: new ones, each filled with as many of this length as it holds, the last with the rest
            each = capacity // length
            for count, items in ((left // each, each), (1, left % each)):
                if not count or not items:
                    continue
                own += [(rank + i * count, packs, i * length) for i in range(items)]
                if items * length < capacity:
                    heapq.heappush(groups, (items * length, packs, count))
                rank, packs = rank + count * items, packs + count
            left = 0
    return {k: np.array(v, dtype=np.int64) for k, v in slots.items()}


def pack(sizes: DataFrame, capacity: int, id_column: str = "doc_id", size_column: str = "tokens") -> DataFrame:
    """(id, piece, size, pack_id, pack_offset): the place of each item, or of each piece of an item too large.

    An item larger than `capacity` is cut into full pieces and a rest; no other item is cut. Items of size 0 or
    null take no space: they are put into pack 0 at offset 0 as piece 0. Repeated rows are items of their own.
    Order among items of one length is by id within parts, so equal input gives an equal packing. An empty table
    gives an empty result. `sizes` must be cheap to read twice (see checkpointed).
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    size = F.coalesce(F.col(size_column).cast("bigint"), F.lit(0))
    items = sizes.select(F.col(id_column).alias("id"), size.alias("whole"))
    empty = items.where("whole <= 0").select("id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("pack_id"), F.lit(0).cast("bigint").alias("pack_offset"))
    pieces = items.where("whole > 0").select(
        "id", F.posexplode(F.expr(f"transform(sequence(0L, (whole - 1) div {capacity}), i -> least({capacity}L, whole - i * {capacity}L))")).alias("piece", "size"),
    )
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most `capacity` rows
    # as many parts of each length as its number of items asks for: few lengths have more than one
    several = [F.struct(F.lit(n).alias("size"), F.lit(-(-count // RANKED)).alias("parts")) for n, count in sorted(histogram.items()) if count > RANKED]
    parts = F.element_at(F.map_from_entries(F.array(*several)), F.col("size")) if several else F.lit(None).cast("int")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.coalesce(parts, F.lit(1)).cast("bigint")))
    slots = place(histogram, capacity)

    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("size", "part").count().select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")) if several else None
    within = Window.partitionBy("size", "part").orderBy("id", "piece")
    ranked = pieces.withColumn("at", F.row_number().over(within) - 1)
    if several:  # a row for each length and part: fewer than `capacity` and one for each RANKED items
        ranked = ranked.join(starts, ["size", "part"])
    ranked = ranked.select("id", "piece", "size", (F.col("start") + F.col("at") if several else F.col("at").cast("bigint")).alias("rank"))
    shared = sizes.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in in_parts(batches):
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            pack_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, mine = slots[int(n)], length == n
                k = np.searchsorted(own[:, 0], rank[mine], side="right") - 1
                pack_id[mine] = own[k, 1] + rank[mine] - own[k, 0]
                offset[mine] = own[k, 2]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.compute.cast(batch.column("piece"), pa.int64()), batch.column("size"), pa.array(pack_id), pa.array(offset)], ["id", "piece", "size", "pack_id", "pack_offset"])

    kind = sizes.schema[id_column].dataType.simpleString()
    placed = ranked.mapInArrow(run, f"id {kind}, piece bigint, size bigint, pack_id bigint, pack_offset bigint")
    return placed.unionByName(empty).withColumnRenamed("id", id_column)


def pack_all(sizes: DataFrame, containers: list[tuple[int, int]], id_column: str = "doc_id", size_column: str = "tokens") -> DataFrame:
    """`pack` for each (container_id, capacity), with the container_id before each row.

    The sizes are checkpointed once, as every capacity reads them three times.
    """
    kept = checkpointed(sizes.select(id_column, size_column))
    out = None
    for container_id, capacity in containers:
        own = pack(kept, capacity, id_column, size_column).select(F.lit(container_id).cast("int").alias("container_id"), "*")
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = pack(kept.limit(0), 1, id_column, size_column).select(F.lit(0).alias("container_id"), "*")
    return out
