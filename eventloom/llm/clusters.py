"""Clusters of mutually similar records, by parallel pivot correlation clustering.

Records are ordered by a hash of their id. In each round those below a cut of the hash are candidates. A
candidate that resembles no unassigned record earlier in the order is a local minimum (all earlier ones are
candidates too, so this is exact) and becomes a pivot; candidates are tested in parallel, each on its own.
Every unassigned record then joins the most similar pivot that it resembles, and what is left goes into the
next round. Clusters get their medoid, medoids that resemble each other are joined by the same rounds, and
every record is reassigned to the closest medoid.

Records here are waveforms: arrays with missing samples, alike if they correlate over the samples that
both hold. Correlations come from matrix products of a batch of records with a block of pivots, so no
pairs are stored and what is sent to a task has a fixed bound. Waveforms travel as packed bytes, without
gain and offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.runtime import Stages

SIMILAR = 0.8
SHARED = 0.5  # of the samples of the longest: two records that share fewer are not compared
FIRST, MOST = 512, 4096  # candidates of the first and of a later round; a block of pivots
USUAL = 80  # samples for which a block has MOST rows; longer records make smaller blocks
TYPICAL = 3
_ROWS = "event_id bigint, x binary, pivot bigint, similarity double"


def packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes of 32-bit numbers."""
    x = np.ascontiguousarray(x, np.float32)
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed bytes without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.float32).reshape(len(column), width).astype(np.float64)


class Waves:
    """Waveforms prepared for masked correlation."""

    def __init__(self, x: np.ndarray):
        self.mask = np.isfinite(x)
        n = np.maximum(self.mask.sum(axis=1, keepdims=True), 1)
        x = np.where(self.mask, x, 0.0)
        x = np.where(self.mask, x - x.sum(axis=1, keepdims=True) / n, 0.0)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)  # gain and offset removed
        self.whole = self.mask.all(axis=1)

    def __len__(self) -> int:
        return len(self.x)

    def normal(self) -> np.ndarray:
        """Waveforms of mean 0 and norm 1, NaN where samples are missing."""
        return np.where(self.mask, self.x, np.nan)

    def part(self, rows: np.ndarray) -> Waves:
        out = object.__new__(Waves)
        out.mask, out.x, out.whole = self.mask[rows], self.x[rows], self.whole[rows]
        return out


def _masked(a: Waves, b: Waves) -> np.ndarray:
    ma, mb = a.mask.astype(np.float64), b.mask.astype(np.float64)
    n = np.maximum(ma @ mb.T, 1)
    sa, sb = a.x @ mb.T, ma @ b.x.T
    va = (a.x * a.x) @ mb.T - sa * sa / n
    vb = ma @ (b.x * b.x).T - sb * sb / n
    both = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
    enough = n >= SHARED * a.x.shape[1]
    return np.divide(a.x @ b.x.T - sa * sb / n, both, out=np.zeros_like(both), where=(both > 1e-12) & enough)


def correlations(a: Waves, b: Waves) -> np.ndarray:
    """Pearson correlations over the samples that both hold; 0 where one has no variance there, or where
    these are fewer than SHARED of all."""
    out = a.x @ b.x.T  # right where both are whole
    if not a.whole.all():
        out[~a.whole] = _masked(a.part(~a.whole), b)
    if not b.whole.all():
        out[:, ~b.whole] = _masked(a, b.part(~b.whole))
    return out


def _minima(ids: np.ndarray, waves: Waves, similar: float):
    """Of candidate rows (event_id, x) those that resemble no earlier one; ``ids`` has all in hash order."""
    by_id = np.argsort(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                own = by_id[np.searchsorted(ids, b.column(0).to_numpy(), sorter=by_id)]
                alike = correlations(Waves(unpacked(b.column(1), waves.x.shape[1])), waves) > similar
                alike[np.arange(len(own)), own] = True
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(alike.argmax(axis=1) == own))], names=["event_id"])

    return run


def _closest(ids: np.ndarray, waves: Waves, similar: float):
    """Adds the closest pivot to rows (event_id, x, pivot, similarity) where it beats the one they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                c = correlations(Waves(unpacked(b.column(1), waves.x.shape[1])), waves)
                best = c.argmax(axis=1)
                r = c[np.arange(len(best)), best]
                old = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                had = ~np.isnan(old)
                better = (r > similar) & (~had | (r > np.where(had, old, 0)))
                pivot = np.where(better, ids[best], np.where(had, b.column(2).fill_null(0).to_numpy(), 0))
                value = np.where(better, r, np.where(had, old, 0.0))
                none = ~(better | had)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot, pa.int64(), mask=none), pa.array(value, pa.float64(), mask=none)], names=["event_id", "x", "pivot", "similarity"])

    return run


def _collected(df: DataFrame, width: int, *order: str) -> tuple[np.ndarray, Waves]:
    t = df.select("event_id", "x", *(c for c in order if c != "event_id")).toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros(0, np.int64), Waves(np.zeros((0, width)))
    if order:
        t = t.sort_by([(c, "ascending") for c in dict.fromkeys((*order, "event_id"))]).combine_chunks()
    return t.column(0).to_numpy(), Waves(unpacked(t.column(1).combine_chunks(), width))


def _unplaced(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "x", F.lit(None).cast("bigint").alias("pivot"), F.lit(None).cast("double").alias("similarity"))


def _blocks(rows: DataFrame, width: int) -> Iterator[tuple[np.ndarray, Waves]]:
    """(event_id, x) in order of event_id, so many at a time. The rows are few next to the records; of each
    block only ids are sorted, and its rows then fetched by their range."""
    least = None
    while True:
        after = rows if least is None else rows.where(F.col("event_id") > least)
        last = after.select("event_id").orderBy("event_id").limit(_block(width)).agg(F.max("event_id")).first()[0]
        if last is None:
            return
        yield _collected(after.where(F.col("event_id") <= last), width, "event_id")
        least = last


def _block(width: int) -> int:
    return max(1, min(MOST, MOST * USUAL // max(1, width)))


def pivot_rounds(rows: DataFrame, stages: Stages, similar: float, width: int) -> DataFrame:
    """event_id, x, pivot, similarity of (event_id, x), a written table; a pivot has itself.

    The candidates of a round are the rows under a cut of the hash, set so that about a block of them are
    expected: a filter, not a sort. Tasks get the candidates to find the pivots, and the pivots to place rows."""
    order = F.xxhash64("event_id")
    rest, done, size, cut, n = _unplaced(rows), [], min(FIRST, _block(width)), -(1 << 63), rows.count()
    while n:
        aim = size
        while True:
            at = (1 << 63) - 1 if n <= aim else cut + ((1 << 63) - cut) * aim // n
            candidates = rest.where(order <= F.lit(at)).withColumn("h", order)
            ids, waves = _collected(candidates, width, "h")
            if len(ids):
                break
            aim *= 2
        chosen = candidates.select("event_id", "x").mapInArrow(_minima(ids, waves, similar), "event_id bigint").toArrow().column(0).to_numpy()
        keep = np.flatnonzero(np.isin(ids, chosen))
        left = Observation()
        placed = rest.mapInArrow(_closest(ids[keep], waves.part(keep), similar), _ROWS).observe(left, F.count_if(F.col("pivot").isNull()).alias("n"))
        step = stages.write(placed)
        done.append(step.where("pivot is not null"))
        if left.get["n"] >= n:
            raise RuntimeError("a pivot does not resemble itself")
        rest, n, cut, size = step.where("pivot is null"), left.get["n"], at, _block(width)
    out = done[0] if done else _unplaced(rows)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _sums(width: int):
    """Per pivot of a task's rows: the sum of its members' normalised waveforms, at most MOST pivots at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["pivot", "total"])

        for batch in batches:
            if batch.num_rows:
                names, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                part = np.zeros((len(names), width))
                np.add.at(part, at, Waves(unpacked(batch.column(1), width)).x)
                for name, v in zip(names.tolist(), part):
                    total[name] = total[name] + v if name in total else v
                if len(total) > MOST:
                    yield out()
                    total = {}
        if total:
            yield out()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of partial sums (event_id, x) of a partition sorted by pivot, one pivot in memory at a time."""
    key, total = None, None
    for batch in batches:
        ids, sums = [], []
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            v = np.frombuffer(raw, np.float64)
            if name == key:
                total = total + v
            else:
                if key is not None:
                    ids.append(key)
                    sums.append(total)
                key, total = name, v
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), packed(np.array(sums))], names=["event_id", "x"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), packed(total[None, :])], names=["event_id", "x"])


def _most_central(ids: np.ndarray, means: Waves):
    """Per pivot of a batch of members (event_id, x, pivot): the one that correlates most with its mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pivots, events = batch.column(2).to_numpy(), batch.column(0).to_numpy()
                waves = Waves(unpacked(batch.column(1), means.x.shape[1]))
                score = np.zeros(len(pivots))
                for p in np.unique(pivots):
                    rows = np.flatnonzero(pivots == p)
                    score[rows] = correlations(waves.part(rows), means.part(np.searchsorted(ids, [p])))[:, 0]
                first = np.lexsort((events, -score, pivots))
                first = first[np.concatenate(([True], pivots[first][1:] != pivots[first][:-1]))]
                yield pa.RecordBatch.from_arrays([pa.array(pivots[first]), pa.array(score[first]), batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first))], names=["pivot", "score", "event_id", "x"])

    return run


def medoids(members: DataFrame, stages: Stages, width: int) -> DataFrame:
    """pivot, event_id, x of the medoid of each cluster of (event_id, x, pivot): the member of the highest
    correlation with the mean of its cluster, whose correlations with all members so have the largest sum.

    Means are sums of partial sums; they reach the tasks in blocks. Medoids of batches are compared after."""
    partial = members.select("pivot", "x").mapInArrow(_sums(width), "pivot bigint, total binary")
    means = partial.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(_added, "event_id bigint, x binary")
    means = stages.write(means)
    out = None
    for ids, known in _blocks(means, width):
        part = members.where((F.col("pivot") >= int(ids[0])) & (F.col("pivot") <= int(ids[-1])))
        part = part.select("event_id", "x", "pivot").mapInArrow(_most_central(ids, known), "pivot bigint, score double, event_id bigint, x binary")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return members.select("pivot", "event_id", "x")
    return out.groupBy("pivot").agg(F.max(F.struct("score", (-F.col("event_id")).alias("o"), "event_id", "x")).alias("m")).select("pivot", "m.event_id", "m.x")


def waveforms(df: DataFrame, id_col: str, column: str, width: int) -> DataFrame:
    """event_id, x of the rows whose array holds samples that differ, and enough of them to be like another:
    without gain and offset, padded to ``width``, packed. Of several rows of one id the first in order of their bytes counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.full((len(size), width), np.nan)
            x[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            x[~np.isfinite(x)] = np.nan
            held = np.isfinite(x)
            some = held.sum(axis=1) >= max(2, SHARED * width)
            some &= np.where(held, x, -np.inf).max(axis=1, initial=-np.inf) > np.where(held, x, np.inf).min(axis=1, initial=np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), packed(Waves(x[some]).normal())], names=["event_id", "x"])

    rows = df.where(F.col(id_col).isNotNull() & (F.size(column) > 0)).select(F.col(id_col).alias("event_id"), F.col(column).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "event_id bigint, x binary").groupBy("event_id").agg(F.min("x").alias("x"))


def widest(df: DataFrame, column: str) -> int:
    return int(df.agg(F.max(F.size(column))).first()[0] or 0)


def clusters(clips: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """event_id, cluster_id, similarity: the members of clusters of at least two; cluster_id is the
    event_id of the medoid that its members were assigned to, similarity the correlation with it.

    Clips that are null, empty, or constant (all zero among them) over the samples they hold, and clips that
    resemble no other, are in no cluster. A clip shorter than the longest holds the first samples only; two
    clips that share fewer than half as many samples as the longest has are not alike. Repeats count once. Ties go to
    the smaller hash. Extra columns are ignored. An empty table gives an empty result.
    """
    return _clusters(clips, similar, Stages(clips.sparkSession, "clusters"))


def _clusters(clips: DataFrame, similar: float, stages: Stages) -> DataFrame:
    width = max(0, widest(clips, "clips"))
    rows = stages.write(waveforms(clips, "event_id", "clips", width))
    found = pivot_rounds(rows, stages, similar, width)
    size = found.groupBy("pivot").agg(F.count("*").alias("n"))
    real = stages.write(size.where("n > 1").select("pivot"))
    medoid = stages.write(medoids(found.join(real, "pivot").select("event_id", "x", "pivot"), stages, width))
    joined = pivot_rounds(medoid.select("event_id", "x"), stages, similar, width)
    top = stages.write(medoid.select("event_id", F.col("pivot").alias("was")).join(joined.select("event_id", F.col("pivot").alias("top")), "event_id").select("was", "top"))
    # every record against every remaining medoid, a block of medoids at a time
    tops = medoid.join(top.select(F.col("top").alias("event_id")).distinct(), "event_id").select("event_id", "x")
    best = found.join(top, found["pivot"] == top["was"], "left").select("event_id", "x", "top")
    best = best.select("event_id", "x", F.lit(None).cast("bigint").alias("pivot"), F.lit(None).cast("double").alias("similarity"), "top")
    for ids, waves in _blocks(tops, width):
        best = best.mapInArrow(_with_rest(_closest(ids, waves, similar), 4), f"{_ROWS}, top bigint")
    # a member that resembles its pivot but no medoid stays with the pivot's cluster
    placed = stages.write(best.select("event_id", F.coalesce("pivot", "top").alias("cluster_id"), "similarity").where("cluster_id is not null"))
    stages.keep(placed)
    several = placed.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    return placed.join(several, "cluster_id").select("event_id", "cluster_id", "similarity")


def _with_rest(run, n: int):
    """The function on the first n columns of a batch, with the others carried along."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in run(iter([batch])):
                rest = batch.slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, *rest.columns[n:]], names=[*out.schema.names, *batch.schema.names[n:]])

    return wrapped


def next_in_group(rows: DataFrame, group: str, item: str, span: int = 1 << 16) -> DataFrame:
    """group, item, next: each item with the next of its group. Groups are cut into spans of item values,
    so that a group of any size is no task's whole work; the last of a span takes the first of the next."""
    cut = rows.select(group, item).withColumn("span", F.floor(F.col(item) / span))
    within = cut.withColumn("next", F.lead(item).over(Window.partitionBy(group, "span").orderBy(item)))
    firsts = cut.groupBy(group, "span").agg(F.min(item).alias("first"))
    after = firsts.select(group, "span", F.lead("first").over(Window.partitionBy(group).orderBy("span")).alias("after"))
    return within.join(after, [group, "span"]).select(group, item, F.coalesce("next", "after").alias("next"))


def next_members(clips: DataFrame) -> DataFrame:
    """p2_found: event_id_a, event_id_b of each clip and the next of its cluster."""
    chain = next_in_group(clusters(clips), "cluster_id", "event_id")
    return chain.where("next is not null").select(F.col("event_id").alias("event_id_a"), F.col("next").alias("event_id_b"))


def describe(clips: DataFrame, templates: DataFrame) -> DataFrame:
    """cluster_id, n_members, typical (the members closest to the medoid, first the medoid), mean_similarity,
    features (means of features2 by position), template_id and template_similarity (the closest template
    that resembles the medoid, of those that are neither null nor constant; null if there is none).

    Of a large cluster each task keeps its own most typical members before any are shuffled."""
    stages = Stages(clips.sparkSession, "describe")
    members = stages.write(clusters(clips))
    order = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("similarity"), "event_id")
    typical = members.withColumn("place", F.row_number().over(order)).where(f"place <= {TYPICAL}").groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "event_id"))), lambda s: s["event_id"]).alias("typical"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.avg("similarity").alias("mean_similarity"))
    once = clips.select("event_id", "features2").dropDuplicates(["event_id"])
    place = members.join(once, "event_id").select("cluster_id", F.posexplode("features2").alias("place", "f")).groupBy("cluster_id", "place").agg(F.avg("f").alias("f"))
    features = place.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "f"))), lambda s: s["f"]).alias("features"))
    width = max(0, widest(clips, "clips"), widest(templates, "template0"))
    own = size.select(F.col("cluster_id").alias("event_id")).join(waveforms(clips, "event_id", "clips", width), "event_id")
    best = _unplaced(own)
    for ids, waves in _blocks(stages.write(waveforms(templates, "result_id", "template0", width)), width):
        best = best.mapInArrow(_closest(ids, waves, SIMILAR), _ROWS)
    template = best.select(F.col("event_id").alias("cluster_id"), F.col("pivot").alias("template_id"), F.col("similarity").alias("template_similarity"))
    return size.join(typical, "cluster_id").join(features, "cluster_id", "left").join(template, "cluster_id", "left")
