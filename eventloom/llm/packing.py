"""Containers of fixed capacity filled by sum-of-squares packing.

An item goes where the sum of the squared numbers of partly filled containers, by fill level, grows least;
one array of those numbers is all the state. Items are packed in shards; the containers that stay open at
the end of a round are emptied and packed again in fewer shards, until one shard holds the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.runtime import Stages

CAPACITY = 2048
SHARD = 50_000  # items of a shard
LARGE = 4  # items of at least capacity / LARGE go first, largest first; the small ones then fill the gaps
SLACK = 64  # unused units up to which a container counts as full between rounds


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (0 < size <= capacity), numbered from 0 in order of opening.

    Moving a container from level h to h + s changes the sum by 2 (n[h+s] - n[h] + 1); opening one by
    2 n[s] + 1; filling one up by 1 - 2 n[h]. Of equal choices the fullest container wins.
    """
    level = np.zeros(capacity + 1, np.int64)
    heads: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        room = capacity - s
        best, cost = 0, (2 * level[s] + 1 if s < capacity else 0)
        if room > 0:
            have = np.flatnonzero(level[1 : room + 1]) + 1
            if len(have):
                change = 2 * (level[have + s] - level[have] + 1)
                if have[-1] == room:
                    change[-1] = 1 - 2 * level[room]
                k = len(change) - 1 - int(np.argmin(change[::-1]))
                if change[k] <= cost:
                    best = int(have[k])
        if best:
            c = heads[best].pop()
            level[best] -= 1
        else:
            c = opened
            opened += 1
        now = best + s
        if now < capacity:
            heads[now].append(c)
            level[now] += 1
        out[i] = c
    return out


def _pack(capacity: int):
    """Packs each shard of a partition sorted by shard; a shard's sizes are bounded by SHARD's multiple."""

    def shard_rows(shard: int, ids: pa.Array, piece: pa.Array, size: np.ndarray) -> pa.RecordBatch:
        where = np.zeros(len(size), np.int64)
        some = size > 0
        where[some] = sum_of_squares(size[some], capacity)
        fill = np.bincount(where, weights=size)
        container = pa.array([f"{shard}-{c}" for c in where.tolist()])
        return pa.RecordBatch.from_arrays([ids, piece, pa.array(size), container, pa.array(fill[where].astype(np.int64))], names=["id", "piece", "size", "container", "filled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            return shard_rows(key, *(t.column(i).combine_chunks() for i in (1, 2)), t.column(3).to_numpy())

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            cuts = (np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(shard)]):
                if key is not None and shard[i] != key:
                    yield close()
                    held = []
                key = int(shard[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield close()

    return run


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """id, piece, n, container_id, container_fill: every item, or every piece of an item above capacity.

    Such an item is cut into full pieces, each a container of its own, and a rest, which is packed like an
    item. No other item is split. Items of null or no size take no room: they lie in the first container of
    their shard. Rows count each, repeats included; extra columns are ignored; an empty table gives an empty
    result; large items are packed in order of size, the others in order of a hash. Shards are drawn by hash of the id, so no key is hot.
    """
    spark = items.sparkSession
    stages = Stages(spark, "packing")
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    whole = F.floor((size - 1) / capacity)
    rows = stages.write(items.select(F.col(id_col).alias("id"), size.alias("size"), F.greatest(whole, F.lit(0)).alias("full")))
    pieces = rows.where("full > 0").select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    done = [pieces.select("id", "piece", F.lit(capacity).cast("bigint").alias("size"), F.concat_ws("-", F.lit("full"), "id", "piece").alias("container"), F.lit(capacity).cast("bigint").alias("filled"))]
    left = rows.select("id", F.col("full").alias("piece"), (F.col("size") - F.col("full") * capacity).alias("size"))
    kind = items.schema[id_col].dataType.simpleString()
    first, before = 0, None
    while count := left.count():
        shards = max(1, round(count / shard))
        last = shards == 1 or before is not None and count > 0.8 * before  # a round that closed little: sizes that do not combine
        before = count
        placed = left.select((F.pmod(F.xxhash64("id", "piece"), F.lit(shards)) + first).alias("shard"), "id", "piece", "size")
        large = F.when(F.col("size") * LARGE >= capacity, F.col("size"))
        placed = placed.repartition(shards, "shard").sortWithinPartitions("shard", large.desc_nulls_last(), F.xxhash64("id", "piece"), "id", "piece")
        packed = stages.write(placed.mapInArrow(_pack(capacity), f"id {kind}, piece bigint, size bigint, container string, filled bigint"))
        first += shards
        if last:
            done.append(packed)
            break
        full = F.col("filled") >= capacity - SLACK
        done.append(packed.where(full))
        left = packed.where(~full).select("id", "piece", "size")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), "piece", F.col("size").alias("n"), F.col("container").alias("container_id"), F.col("filled").alias("container_fill"))


def pack_documents(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, container_id, container_fill over (doc_id, n_tokens)."""
    packed = pack(counts, "doc_id", "n_tokens", capacity)
    return packed.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.col("n").alias("n_tokens"), "container_id", "container_fill")
