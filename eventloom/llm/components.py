"""Groups of everything that pairwise matches link, directly or through others.

Union-find over a two-dimensional grid: vertices are hashed into blocks, an edge belongs to the cell of its
two blocks, and every cell runs a local union-find over its own edges. A vertex then gathers the
representatives found in its row and column of cells and takes the one first in hash order; edges between
different parents go into the next round, with fresh hashes, until none is left. Parents chain back to
every vertex by joins. A vertex that a third of all edges touch has them spread over a whole row of cells,
and leaves a cell as one link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.runtime import Stages

EDGES_PER_CELL = 100_000


def local_roots(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Union-find over edges a[i]-b[i] of vertices 0..n-1: for each vertex the one of least rank among
    those it is linked with. Hooking larger roots to smaller ones and halving paths, on whole arrays."""
    order = np.argsort(rank, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    parent = np.arange(len(order))
    a, b = place[a], place[b]
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return order[parent[place]]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit integers (splitmix), so no two vertices tie."""
    with np.errstate(over="ignore"):
        z = x.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _cells(salt: int):
    """Local union-find of each cell of a partition that is sorted by cell; repeated edges are adjacent."""

    def solve(cell: list[np.ndarray]) -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*cell))
        names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = names[local_roots(at[: len(a)], at[len(a) :], _mixed(names, salt))]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(root)], names=["v", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = (np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(cell)]):
                if key is not None and cell[i] != key:
                    yield solve(held)
                    held, size = [], 0
                key = cell[i]
                held.append((a[i:j], b[i:j]))
                size += j - i
                if size > 8 * EDGES_PER_CELL:  # many edges among few vertices: keep a spanning forest only
                    forest = solve(held)
                    v, root = (c.to_numpy() for c in forest.columns)
                    held, size = [(v, root)], 0
        if held:
            yield solve(held)

    return run


def components(edges: DataFrame, a: str, b: str, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """group_id, member: every value of the two columns, with the smallest value of its component.

    An edge with one null end names its other end without a link, as does a loop; null in both names
    nothing. Repeats and direction play no part; extra columns are ignored; an empty table gives an empty
    result. Values are integers of up to 64 bits. The number of cells follows the number of edges left, so
    tasks stay of one size and the last rounds run in one cell; expected rounds grow with the logarithm.
    """
    spark = edges.sparkSession
    stages = Stages(spark, "components")
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    ends = edges.select(F.coalesce(F.least(x, y), x, y).alias("a"), F.coalesce(F.greatest(x, y), x, y).alias("b"))
    vertices = ends.where("a is not null").distinct()
    left = stages.write(vertices)
    names = left
    maps: list[DataFrame] = []
    salt = 0
    while count := left.where("a <> b").count():
        salt += 1
        side = max(1, math.ceil(math.sqrt(2 * count / edges_per_cell)))
        block = lambda c: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(side))
        p, q = block("a"), block("b")
        cells = left.where("a <> b").select((F.least(p, q) * side + F.greatest(p, q)).alias("cell"), "a", "b")
        grid = side * (side + 1) // 2
        local = cells.repartition(grid, "cell").sortWithinPartitions("cell", "a", "b").mapInArrow(_cells(salt), "v bigint, root bigint")
        local = stages.write(local)
        rank = F.xxhash64(F.lit(-salt), "root")
        parents = stages.write(local.groupBy("v").agg(F.min_by("root", F.struct(rank, "root")).alias("parent")))
        up = parents.select(F.col("v").alias("root"), F.col("parent").alias("root_parent"))
        # the cell's link v - root, between the two parents; v's other cells have theirs
        linked = local.join(parents, "v").join(up, "root").select(F.least("parent", "root_parent").alias("a"), F.greatest("parent", "root_parent").alias("b"))
        nxt = stages.write(linked.where("a <> b").distinct())
        stages.drop(local)
        if left is not names:
            stages.drop(left)
        left = nxt
        maps.append(parents)
    # from the last round back: parents of parents
    top = None
    for parents in reversed(maps):
        if top is None:
            top = parents.select("v", F.col("parent").alias("top"))
        else:
            over = top.select(F.col("v").alias("parent"), F.col("top").alias("over"))
            top = parents.join(over, "parent", "left").select("v", F.coalesce("over", "parent").alias("top"))
    loops = names.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    if top is None:
        return loops.select(F.col("member").alias("group_id"), "member")
    placed = stages.write(loops.join(top.withColumnRenamed("v", "member"), "member", "left").select("member", F.coalesce("top", "member").alias("top")))
    stages.keep(placed)
    least = placed.groupBy("top").agg(F.min("member").alias("group_id"))
    return placed.join(least, "top").select("group_id", "member")


def set_edges(sets: DataFrame, members: str) -> DataFrame:
    """a, b: each value of an array linked with the array's smallest, so n values give n edges, not n^2."""
    known = F.filter(F.col(members), lambda m: m.isNotNull() & (m != 0))
    return sets.select(F.array_distinct(known).alias("m")).where("size(m) > 0").select(F.array_min("m").alias("a"), F.explode("m").alias("b"))


def label_groups(pairs: DataFrame, sets: DataFrame, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """p4_found: group_id, label of each label other than 0 and null in cluster_pairs or merge_groups."""
    known = lambda c: F.when(F.col(c) != 0, F.col(c))
    edges = pairs.select(known("m_k1").alias("a"), known("m_k2").alias("b")).unionByName(set_edges(sets, "members"))
    return components(edges, "a", "b", edges_per_cell).select("group_id", F.col("member").alias("label"))
