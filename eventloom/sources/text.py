"""Numeric text files: rows of the file are samples, columns are channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators.series import BY

SPAN = 1 << 16  # samples of a recording that are listed together

def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """channel, t, value of a file of numbers separated by commas or blanks. A first line that holds no
    number is a header; blank lines do not count. Fields that are no numbers are null.

    Lines are numbered by the files' own order, which needs the sizes of the partitions, not a sort."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("id", F.monotonically_increasing_id())
    part = F.shiftright("id", 33)
    sizes = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per partition
    numbered = lines.withColumn("part", part).join(F.broadcast(before), "part").withColumn("row", F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1))
    fields = F.filter(F.split(F.trim("value"), r"[,\s]+"), lambda s: s != "")
    rows = numbered.select("row", F.transform(fields, lambda s: s.try_cast("double")).alias("x"))
    named = rows.where("row = 0").select(F.forall("x", lambda v: v.isNull()).alias("head")).first()
    skip = 1 if named and named["head"] else 0
    return rows.where(F.col("row") >= skip).select((F.col("row") - skip).alias("t"), F.posexplode("x").alias("i", "value")).select((F.col("i") + 1).alias("channel"), "t", "value")


def number_text(v: Column) -> Column:
    """Whole numbers without decimals, others as they are."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def as_lines(series: DataFrame, transpose: bool = True, delimiter: str = "\t", max_rows: int = 10**9, max_cols: int = 2000, text: Callable[[Column], Column] = number_text) -> DataFrame:
    """recording_id, row, line: each recording's array as text, one line per sample (or per channel without
    ``transpose``), with zero for samples that are missing. More rows or columns than the guards allow is an
    error, not a cut."""
    size = series.groupBy(*BY).agg((F.max("t") + 1).alias("n"), F.sort_array(F.collect_set("channel")).alias("channels"))
    rows, cols = ("n", "size(channels)") if transpose else ("size(channels)", "n")
    most = size.agg(F.max(F.expr(rows)).alias("rows"), F.max(F.expr(cols)).alias("cols")).first()
    if (most["rows"] or 0) > max_rows or (most["cols"] or 0) > max_cols:
        raise ValueError(f"{most['rows']} rows by {most['cols']} columns exceed {max_rows} by {max_cols}")
    row, column = ("t", "channel") if transpose else ("channel", "t")
    cells = series.groupBy(*BY, F.col(row).cast("bigint").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("bigint"), text(F.col("value"))))).alias("cells"))
    whole = F.col("channels").cast("array<bigint>")
    if transpose:  # a recording's samples are listed span by span, so that a long one is spread over tasks
        spans = size.select(*BY, "n", whole.alias("columns"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(SPAN).cast("bigint"))).alias("start"))
        grid = spans.repartition(*BY, "start").select(*BY, "columns", F.explode(F.sequence("start", F.least(F.col("start") + SPAN, F.col("n")) - 1)).alias("row"))
    else:
        grid = size.select(*BY, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1).alias("columns"), F.explode(whole).alias("row"))
    filled = F.transform("columns", lambda c: F.coalesce(F.col("cells")[c], F.lit("0")))
    return grid.join(cells, [*BY, "row"], "left").select(*BY, "row", F.array_join(filled, delimiter).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines of one recording in order; of several, one folder of files each."""
    lines.repartitionByRange(*BY, "row").sortWithinPartitions(*BY, "row").select(*BY, "line").write.partitionBy(*BY).text(path)
