"""Pairing records with the nearest in time, by expanding rings.

A ring has a reach, and time is cut into buckets of some reaches. A left row compares with its own bucket and
with the records of the two beside it that lie within the reach of the border: a match within the reach is
provably the nearest. Rows without one go on to a ring of twice the reach, in buckets of twice the width, up
to the tolerance.

Within a bucket both sides are merged in order of time, each left row meeting the record before it and the
one after it: the work is linear however many records a burst holds, here or in any other key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.runtime import Stages

RINGS = 2  # the last has the tolerance as its reach, each before it half of the next
WIDTH = 8  # reaches of a bucket: one record in four is sent to a second bucket


def _ring(rest: DataFrame, records: DataFrame, names: list[str], reach: float) -> DataFrame:
    """names, t, id, distance, rid of each left row: its nearest record in the bucket or within the reach of its
    borders; null where there is none. One shuffle by bucket; repeats of a left row count once."""
    width = WIDTH * reach or 1.0
    bucket = F.floor(F.col("t") / width).cast("double")
    place = F.col("t") - bucket * width
    near = F.array_compact(F.array(bucket, F.when(place <= reach, bucket - 1), F.when(width - place <= reach, bucket + 1)))
    both = rest.select(*names, bucket.alias("bucket"), "t", "id", F.lit(True).alias("left")).unionByName(records.select(*names, F.explode(near).alias("bucket"), "t", F.col("id").alias("rid"), F.lit(False).alias("left")), allowMissingColumns=True)
    # of equal times a record comes before a left row from either side, and the smaller id last
    w = Window.partitionBy(*names, "bucket")
    record = F.when(~F.col("left"), F.struct("t", "rid"))
    both = both.withColumn("before", F.last(record, ignorenulls=True).over(w.orderBy("t", "left", F.desc("rid")).rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", F.last(record, ignorenulls=True).over(w.orderBy(F.desc("t"), "left", F.desc("rid")).rowsBetween(Window.unboundedPreceding, 0)))
    pick = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("t") - F.col(f"{c}.t")).alias("distance"), F.col(f"{c}.t").alias("rt"), F.col(f"{c}.rid").alias("rid")))
    once = both.where("left").withColumn("best", F.least(pick("before"), pick("after"))).groupBy(*names, "bucket", "t", "id").agg(F.min("best").alias("best"))
    return once.select(*names, "t", "id", "best.distance", "best.rid")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, right_id: str, tolerance: float, rings: int = RINGS) -> DataFrame:
    """left_id, right_id, distance: for each left row the nearest right row of the same keys, at most
    ``tolerance`` away; left rows without one give no row.

    Both frames have the key and time columns and their id; other columns are ignored, whatever their
    names. A right row may serve several left rows. Of two equally near, the earlier counts, and of equal
    times the smaller id. Rows with a null key or a null or non-finite time have no partner. Repeats count
    once. Empty tables give an empty result. A hot key is split by its buckets.
    """
    stages = Stages(left.sparkSession, "nearest")
    names = [f"k{i}" for i in range(len(keys))]

    def rows(df: DataFrame, id_col: str) -> DataFrame:
        t = F.col(time).cast("double")
        picked = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), t.alias("t"), F.col(id_col).alias("id"))
        fine = ~F.isnan("t") & (F.abs("t") != float("inf"))
        return picked.where(fine & F.col("t").isNotNull() & F.expr(" and ".join(f"{n} is not null" for n in names)))

    rest, records, found = rows(left, left_id), rows(right, right_id), []
    for ring in range(rings):
        reach = tolerance / 2 ** (rings - 1 - ring)
        done = _ring(rest, records, names, reach)
        if ring < rings - 1:
            done = stages.write(done)
        found.append(done.where(F.col("distance") <= reach).select(F.col("id").alias(left_id), F.col("rid").alias(right_id), "distance"))
        rest = done.where(F.coalesce(F.col("distance") > reach, F.lit(True))).select(*names, "t", "id")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nearest_firings(firings: DataFrame, detail: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """p5_found: event_id_a, event_id_b of each firing and its nearest detail firing."""
    a = firings.withColumnRenamed("event_id", "event_id_a")
    b = detail.withColumnRenamed("event_id", "event_id_b")
    return nearest(a, b, ["recording_id", "channel"], "time", "event_id_a", "event_id_b", tolerance).select("event_id_a", "event_id_b")
